"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is scored over all its windows of WINDOW words, each STRIDE words after the last, and takes its worst
window. A word's input is a vector of its own (for the words of the training sample that occur in enough
documents) beside the mean of vectors of its character trigrams. The network learns from documents, not windows:
in each epoch the window that scores highest of all of a document's windows stands for it (in the first epoch, the one
whose words are the most telling by their log odds).

Only the training sample is bounded, by TRAIN_DOCS documents and TRAIN_BYTES of text; every window of every sampled text
takes part, and scoring covers every word of every document. VOCABULARY and MIN_DOCS are parameters of the model: they say
which words and beginnings get a vector of their own; any other word is told by its trigrams.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractloom.llm import textscan as ts
from tractloom.llm.runtime import arrow_pass, given_back, held_out, short_batches

WINDOW, STRIDE = 16, 8
HIDDEN = 8
WORD_DIM, CHAR_DIM, CHAR_SLOTS = 8, 6, 2048
BEGIN_DIM, BEGINS = 6, range(4, 9)
INPUT_DIM = WORD_DIM + CHAR_DIM + BEGIN_DIM
#: Labelled documents and bytes of their texts that training reads at most, and words with a vector of their own.
TRAIN_DOCS, TRAIN_BYTES, VOCABULARY = 3000, 48 << 20, 20_000
#: Documents of the sample that a vector needs, and the documents that its first odds are shrunk by.
MIN_DOCS, PRIOR = 5, 10.0
EPOCHS, BATCH_DOCS, RATE = 10, 64, 0.01
THRESHOLD = 0.3
BLOCK = 2048


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start word, number of words and document of all windows; a text without words has one empty window."""
    n = np.diff(first)
    k = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(n)), k)
    order = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    off = order * STRIDE
    return first[doc] + off, np.minimum(n[doc] - off, WINDOW), doc


def trigrams(b: ts.Bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the character (byte) trigrams of some words, with marks at both ends, and where each word's begin."""
    n = end - start
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(start, n)
    x = ts.LOWER[b.data[at]].astype(np.int64) if len(at) else np.zeros(0, np.int64)
    left, right = np.zeros_like(x), np.zeros_like(x)
    left[1:], right[:-1] = x[:-1], x[1:]
    left[first[:-1][n > 0]] = 1
    right[first[1:][n > 0] - 1] = 2
    return ((left * 65599 + x) * 65599 + right) * 0x9E3779B1 % (1 << 32) * CHAR_SLOTS >> 32, first


def beginnings(b: ts.Bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the first 4..8 bytes of some words, one column each; 0 where a word is shorter."""
    out = np.zeros((len(start), len(BEGINS)), np.uint64)
    h = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BEGINS[-1]):
            at = start + k
            on = at < end
            h = h * np.uint64(0x100000001B3) + np.where(on, ts.LOWER[b.data[np.minimum(at, len(b.data) - 1)]], 0).astype(np.uint64) if len(b.data) else h
            if k + 1 in BEGINS:
                out[:, k + 1 - BEGINS[0]] = np.where(on, ts.mix_seed(h, k), 0)
    return out


class Network:
    """Parameters by name; E: word vectors (row 0: unknown), C: trigram vectors, B: vectors of beginnings, per direction W, U, b; attention A, v; output u, c."""

    def __init__(self, vocabulary: np.ndarray, begins: np.ndarray, rng: np.random.Generator) -> None:
        self.vocabulary, self.begins = vocabulary, begins
        d, h = INPUT_DIM, HIDDEN
        f = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"E": f(len(vocabulary) + 1, WORD_DIM, scale=0.1), "C": f(CHAR_SLOTS, CHAR_DIM, scale=0.1), "B": f(len(begins) + 1, BEGIN_DIM, scale=0.05)}
        self.p["B"][0] = 0
        for s in "fb":
            self.p |= {"W" + s: f(d, 3 * h), "U" + s: f(h, 3 * h), "b" + s: np.zeros(3 * h, np.float32)}
        self.p |= {"A": f(2 * h, h), "v": f(h), "u": f(2 * h), "c": np.full(1, -2.0, np.float32)}
        self.slope, self.shift = 1.0, 0.0

    def vectors(self, word: np.ndarray, slot: np.ndarray, first: np.ndarray, begin: np.ndarray) -> np.ndarray:
        n = np.diff(first)
        out = np.empty((len(word), INPUT_DIM), np.float32)
        for k in range(0, len(word), 1 << 16):
            z = min(k + (1 << 16), len(word))
            c = np.zeros((first[z] - first[k] + 1, CHAR_DIM))
            np.cumsum(self.p["C"][slot[first[k] : first[z]]], axis=0, out=c[1:])
            at = first[k : z + 1] - first[k]
            out[k:z, WORD_DIM : WORD_DIM + CHAR_DIM] = (c[at[1:]] - c[at[:-1]]) / np.maximum(n[k:z], 1)[:, None]
        out[:, :WORD_DIM] = self.p["E"][word]
        out[:, WORD_DIM + CHAR_DIM :] = self.p["B"][begin].sum(1)
        return out

    @staticmethod
    def lookup(table: np.ndarray, h: np.ndarray) -> np.ndarray:
        i, found = ts.sorted_lookup(table, h.ravel())
        return np.where(found, i + 1, 0).reshape(h.shape)

    def states(self, xw: np.ndarray, idx: np.ndarray, mask: np.ndarray, s: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction; xw: inputs of distinct words times W + b."""
        u, h3 = self.p["U" + s], HIDDEN
        n, steps = idx.shape
        h = np.zeros((n, h3), np.float32)
        out = np.empty((steps, n, h3), np.float32)
        for t in range(steps) if s == "f" else range(steps - 1, -1, -1):
            x = xw[idx[:, t]]
            r = h @ u
            g = sigmoid(x[:, : 2 * h3] + r[:, : 2 * h3])
            z, q = g[:, :h3], g[:, h3:]
            m = np.tanh(x[:, 2 * h3 :] + q * r[:, 2 * h3 :])
            new = np.where(mask[:, t, None], m + z * (h - m), h)
            if keep is not None:
                keep.append((t, h, z, q, m, r[:, 2 * h3 :]))
            h = new
            out[t] = h
        return out

    def forward(self, xf: np.ndarray, xb: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        kf, kb = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self.states(xf, idx, mask, "f", kf), self.states(xb, idx, mask, "b", kb)], axis=2)
        a = np.tanh(h @ self.p["A"])
        e = np.where(mask.T, a @ self.p["v"], -1e9)
        w = np.exp(e - e.max(0))
        w *= mask.T
        w /= np.maximum(w.sum(0), 1e-9)
        ctx = (w[:, :, None] * h).sum(0)
        if keep is not None:
            keep |= {"kf": kf, "kb": kb, "h": h, "a": a, "w": w, "ctx": ctx}
        return ctx @ self.p["u"] + self.p["c"][0]

    def gradients(self, vec: np.ndarray, idx: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        p, h3 = self.p, HIDDEN
        k: dict = {}
        logit = self.forward(vec @ p["Wf"] + p["bf"], vec @ p["Wb"] + p["bb"], idx, mask, k)
        d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {"u": k["ctx"].T @ d, "c": np.array([d.sum()], np.float32)}
        dctx = d[:, None] * p["u"]
        dh = k["w"][:, :, None] * dctx
        dw = (k["h"] * dctx).sum(2)
        de = k["w"] * (dw - (k["w"] * dw).sum(0))
        g["v"] = np.einsum("tnh,tn->h", k["a"], de)
        da = de[:, :, None] * p["v"] * (1 - k["a"] ** 2)
        g["A"] = np.einsum("tni,tnj->ij", k["h"], da)
        dh = dh + da @ p["A"].T
        dvec = np.zeros_like(vec)
        for s, steps, part in (("f", k["kf"], dh[:, :, :h3]), ("b", k["kb"], dh[:, :, h3:])):
            gu, gb, gw = np.zeros_like(p["U" + s]), np.zeros_like(p["b" + s]), np.zeros_like(p["W" + s])
            nxt = np.zeros((len(y), h3), np.float32)
            for t, h, z, q, m, rn in reversed(steps):
                on = mask[:, t, None]
                total = part[t] + nxt
                dn = np.where(on, total, 0)
                dm = dn * (1 - z) * (1 - m**2)
                dz = dn * (h - m) * z * (1 - z)
                dq = dm * rn * q * (1 - q)
                dr = np.concatenate([dz, dq, dm * q], axis=1)
                dx = np.concatenate([dz, dq, dm], axis=1)
                nxt = np.where(on, dn * z, total) + dr @ p["U" + s].T
                gu += h.T @ dr
                gb += dx.sum(0)
                x = vec[idx[:, t]]
                gw += x.T @ dx
                np.add.at(dvec, idx[:, t], dx @ p["W" + s].T)
            g |= {"U" + s: gu, "b" + s: gb, "W" + s: gw}
        return g, dvec, logit


def embed(net: Network, b: ts.Bytes, w: ts.Words) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Distinct words of a batch: their vectors, which one each word is, and what made the vectors. The last vector is that of no word."""
    _, one, inv = np.unique(w.hash, return_index=True, return_inverse=True)
    word = net.lookup(net.vocabulary, w.hash[one])
    slot, first = trigrams(b, w.start[one], w.end[one])
    begin = net.lookup(net.begins, beginnings(b, w.start[one], w.end[one]))
    vec = net.vectors(word, slot, first, begin)
    return np.concatenate([vec, np.zeros((1, vec.shape[1]), np.float32)]), inv, (word, slot, first, begin)


def window_matrix(start: np.ndarray, size: np.ndarray, inv: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    at = start[:, None] + np.arange(WINDOW)
    mask = np.arange(WINDOW) < size[:, None]
    return (np.where(mask, inv[np.minimum(at, len(inv) - 1)], none) if len(inv) else np.full(at.shape, none)), mask


def worst_windows(net: Network, texts: pa.Array) -> np.ndarray:
    """The highest logit over all windows of each text. Equal windows of a batch are computed once."""
    b = ts.as_bytes(texts)
    out = []
    for i, j in ts.slices(b):
        p = ts.part(b, i, j)
        w = ts.words(p, ts.ALNUM_WORDS)
        vec, inv, _ = embed(net, p, w)
        xf, xb = vec @ net.p["Wf"] + net.p["bf"], vec @ net.p["Wb"] + net.p["bb"]
        start, size, doc = windows(w.first)
        idx, mask = window_matrix(start, size, inv, len(vec) - 1)
        with np.errstate(over="ignore"):
            key = ts.splitmix((idx.astype(np.uint64) * ts._powers(WINDOW)[0][:WINDOW]).sum(1))
        _, one, back = np.unique(key, return_index=True, return_inverse=True)
        logit = np.empty(len(one))
        for k in range(0, len(one), BLOCK):
            s = one[k : k + BLOCK]
            logit[k : k + BLOCK] = net.forward(xf, xb, idx[s], mask[s])
        out.append(np.maximum.reduceat(logit[back], np.flatnonzero(np.diff(doc, prepend=-1))))
    return np.concatenate(out) if out else np.zeros(0)


def train(texts: pa.Array | list[str | None], labels: np.ndarray, seed: int = 7) -> Network:
    """A network from labelled texts; without both labels it scores every text alike, by their share."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    b = ts.as_bytes(texts)
    w = ts.all_words(b, ts.ALNUM_WORDS)
    share = float(y.mean()) if len(y) else 0.0
    w.doc = w.doc.astype(np.int32)
    h, doc = distinct(w.hash, w.doc)
    vocab, odds = weighed(h, doc, y, share)
    _, one = np.unique(w.hash, return_index=True)
    starts = beginnings(b, w.start[one], w.end[one])
    which = np.searchsorted(w.hash[one], h)
    by_doc = np.argsort(doc, kind="stable")
    which, of_doc = which[by_doc], doc[by_doc]
    of_begins = [weighed(*distinct(starts[which, k], of_doc), y, share) for k in range(len(BEGINS))]
    begins = np.concatenate([x for x, _ in of_begins])
    order = np.argsort(begins)
    net = Network(vocab, begins[order], rng)
    begin_odds = np.concatenate([x for _, x in of_begins])[order]
    net.p["c"][0] = np.log((share + 1e-3) / (1 - share + 1e-3))
    if not len(y) or y.min() == y.max():
        net.p["u"][:] = 0
        return net
    # The first number of a vector begins as the smoothed log odds of its word or beginning.
    net.p["E"][1:, 0] = odds
    net.p["B"][1:, 0] = begin_odds
    start, size, wdoc = windows(w.first)
    # A window's evidence: the summed log odds of its words and of their beginnings, where they speak for toxicity.
    word_odds = np.concatenate([[0], np.maximum(odds, 0)])[net.lookup(vocab, w.hash[one])]
    word_odds += np.maximum(np.concatenate([[0], begin_odds])[net.lookup(net.begins, starts)], 0).max(1)
    vec, inv, made = embed(net, b, w)
    told = np.concatenate([[0], np.cumsum(word_odds[inv])])
    top = told[start + size] - told[start]
    idx, mask = np.empty((len(start), WINDOW), np.int32), np.empty((len(start), WINDOW), bool)
    for k in range(0, len(start), BLOCK):
        z = slice(k, k + BLOCK)
        idx[z], mask[z] = window_matrix(start[z], size[z], inv, len(vec) - 1)
    of = np.searchsorted(wdoc, np.arange(b.n + 1))
    del w, told, inv, doc, h, which, of_doc, starts
    word, slot, tri, begin = made
    mom = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        if epoch:
            vec = np.concatenate([net.vectors(word, slot, tri, begin), np.zeros((1, INPUT_DIM), np.float32)])
            xf, xb = vec @ net.p["Wf"] + net.p["bf"], vec @ net.p["Wb"] + net.p["bb"]
            top = np.concatenate([net.forward(xf, xb, idx[k : k + BLOCK], mask[k : k + BLOCK]) for k in range(0, len(idx), BLOCK)])
        best = np.array([of[d] + np.argmax(top[of[d] : of[d + 1]]) for d in range(b.n)])
        perm = rng.permutation(b.n)
        for k in range(0, b.n, BATCH_DOCS):
            docs = perm[k : k + BATCH_DOCS]
            used, local = np.unique(idx[best[docs]], return_inverse=True)
            real = used[used < len(word)]
            n_tri = tri[real + 1] - tri[real]
            sub_first = np.concatenate([[0], np.cumsum(n_tri)])
            sub_slot = slot[np.arange(sub_first[-1]) - np.repeat(sub_first[:-1], n_tri) + np.repeat(tri[real], n_tri)]
            v = np.concatenate([net.vectors(word[real], sub_slot, sub_first, begin[real]), np.zeros((1, INPUT_DIM), np.float32)])
            g, dvec, _ = net.gradients(v, local.reshape(len(docs), WINDOW), mask[best[docs]], y[docs])
            dvec = dvec[: len(real)]
            ge, gc = np.zeros_like(net.p["E"]), np.zeros_like(net.p["C"])
            np.add.at(ge, word[real], dvec[:, :WORD_DIM])
            np.add.at(gc, sub_slot, np.repeat(dvec[:, WORD_DIM : WORD_DIM + CHAR_DIM] / np.maximum(n_tri, 1)[:, None], n_tri, axis=0))
            gb = np.zeros_like(net.p["B"])
            np.add.at(gb, begin[real].ravel(), np.repeat(dvec[:, WORD_DIM + CHAR_DIM :], len(BEGINS), axis=0))
            gb[0] = 0
            g |= {"E": ge, "C": gc, "B": gb}
            step += 1
            for name, grad in g.items():  # Adam
                m, s = mom[name]
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                net.p[name] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    # A last fit of two numbers puts the worst window's logit on the scale of document labels.
    x = worst_windows(net, texts)
    net.slope, net.shift = platt(x, y)
    return net


def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once for each document, by hash; 0 stands for nothing."""
    order = np.argsort(h, kind="stable")  # documents are in order already
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    new &= h != 0
    return h[new], doc[new]


def weighed(h: np.ndarray, doc: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of enough documents (the most frequent ones, sorted), and their smoothed log odds between the labels."""
    if not len(h):
        return h, np.zeros(0)
    value, first, n = np.unique(h, return_index=True, return_counts=True)
    pos = np.add.reduceat(y[doc].astype(np.float64), first)
    keep = np.flatnonzero(n >= MIN_DOCS)
    keep = np.sort(keep[np.argsort(-n[keep], kind="stable")][:VOCABULARY])
    n, pos = n[keep], pos[keep]
    share = min(max(share, 1e-3), 1 - 1e-3)
    return value[keep], np.log((pos + PRIOR * share) / (n - pos + PRIOR * (1 - share))) - np.log(share / (1 - share))


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, c = 1.0, 0.0
    for _ in range(30):
        q = sigmoid(a * x + c)
        w = q * (1 - q) + 1e-6
        g = np.array([((y - q) * x).sum() - 0.01 * (a - 1), (y - q).sum()])
        hess = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        da, dc = np.linalg.solve(hess, g)
        a, c = a + float(np.clip(da, -1, 1)), c + float(np.clip(dc, -2, 2))
    return max(a, 0.05), c


def sampled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(text, label) in one partition: labelled texts outside the held-out fold, in the order of a hash of their id, at most limit.

    Labels of documents that are there are chosen first, by ids alone, so what is joined to the texts is bounded in rows.
    """
    usable = labels.where(F.col(label).isNotNull() & ~held_out(4)).select("doc_id", label).join(docs.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    short_batches(docs.sparkSession)
    # limit() leaves one partition in order.
    return found.select("text", F.col(label).cast("float").alias("label")).coalesce(1)


def fitting(limit_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deals the bytes out in the rows' order, as they stream by. A text that doesn't fit into what is left is passed over; later, shorter ones still count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = limit_bytes
        for b in batches:
            take = []
            for n in (pc.binary_length(b.column(0)).fill_null(0)).to_pylist():
                take.append(n <= left)
                left -= n if n <= left else 0
            yield b.filter(pa.array(take, pa.bool_()))

    return run


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, limit_bytes: int = TRAIN_BYTES) -> DataFrame:
    """The rows that trained() learns from: those of sampled(), whole, of at most limit_bytes in all."""
    return sampled(docs, labels, label, limit).mapInArrow(given_back(fitting(limit_bytes)), "text string, label float")


def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of all batches."""
    got = [b for b in batches if b.num_rows]
    texts = pa.chunked_array([pa.array([], pa.large_string()), *[b.column(0).cast(pa.large_string()) for b in got]])
    return texts.combine_chunks(), np.concatenate([np.zeros(0, np.float32), *[b.column(1).to_numpy(zero_copy_only=False) for b in got]])


def trained(docs: DataFrame, labels: DataFrame, label: str, limit: int, train_: Callable, limit_bytes: int = TRAIN_BYTES) -> object:
    """train_(texts, labels) over the rows of labelled(), in one task and one Python worker; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = train_(*gathered(fitting(limit_bytes)(batches)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    rows = sampled(docs, labels, label, limit).mapInArrow(given_back(run), "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else train_(pa.array([], pa.large_string()), np.zeros(0, np.float32))


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    return trained(docs, labels, "toxic", TRAIN_DOCS, train)


OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(docs: DataFrame, net: Network, carry: list[str]) -> DataFrame:
    """score and predicted of every document; a null or empty text has one empty window."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make() -> Callable:
        n: Network = shared.value

        def f(b: pa.RecordBatch) -> dict:
            s = sigmoid(n.slope * worst_windows(n, b.column(0)) + n.shift)
            return {"score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

        return f

    return arrow_pass(docs, {"text": F.col("text")}, carry, make, OUT)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. Null and empty texts get the score of an empty window; a
    text of any length is scored over all its windows; repeated rows score alike, and windows that tie give one score; an
    empty table gives no rows; other columns are not carried, so their names can't clash. Labels of the held-out fold, of
    rows without id or label, and of unknown documents are not learned from; of labels that repeat an id, one counts.
    """
    done = score(docs, fit(docs, labels), ["doc_id"])
    return done.select("doc_id", held_out(4).alias("held_out"), "_out.*")
