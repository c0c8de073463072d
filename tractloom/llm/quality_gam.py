"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins, and a score is a sum of lookups: one table per feature, one per chosen pair
of features. The tables are learned by cyclic boosting: in turn each feature gets a shallow tree over its bins,
fitted to the current residuals with a small step; then pairs are ranked by what a coarse grid still explains, and
the best get trees over two features in the same way. Scoring adds bins up, for a batch at a time.

The labelled sample that is learned from is bounded by TRAIN_DOCS and by the TRAIN_BYTES that trained() takes. Only the text is looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractloom.llm import textscan as ts
from tractloom.llm import textstats as st
from tractloom.llm.runtime import arrow_pass, held_out
from tractloom.llm.toxicity import trained, sigmoid

FEATURES = (
    "log_words", "word_length", "word_length_spread", "symbol_share", "upper_share", "digit_share", "bang_share", "stop_share",
    "distinct_share", "repeat_share", "duplicate_lines", "words_per_line", "pipe_words", "symbol_words", "bang_words", "upper_words", "non_ascii_share", "short_words",
)
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 120, 60, 8, 0.15
LEAST_ROWS, RIDGE = 8, 3.0
#: Labelled documents that training reads at most.
TRAIN_DOCS = 8000
THRESHOLD = 0.7

SYMBOL = ts.byte_class([(ord(c), ord(c)) for c in "#*$%&|<>@=_{}[]\\^~+"])
UPPER = ts.byte_class([(65, 90)])
DIGIT = ts.byte_class([(48, 57)])
BANG = ts.byte_class([(0x21, 0x21)])
STOP = ts.byte_class([(0x2E, 0x2E), (0x2C, 0x2C), (0x3F, 0x3F)])
HIGH = ts.byte_class([(0x80, 0xFF)])


def features(b: ts.Bytes) -> np.ndarray:
    """One row of FEATURES for each text; a text without words has zeros."""
    w = ts.words(b, ts.SPACE_WORDS, lower=False)
    n = np.diff(w.first)
    one = np.maximum(n, 1)
    size = (w.end - w.start).astype(np.float64)
    mean = ts.per_doc(size, w.first) / one
    spread = np.sqrt(np.maximum(ts.per_doc(size * size, w.first) / one - mean**2, 0))
    chars = np.maximum(np.diff(b.offsets), 1)
    share = lambda t: st.byte_sums(t[b.data], b.offsets) / chars
    c = np.concatenate([[0], np.cumsum(UPPER[b.data])])
    upper = (c[w.end] - c[w.start]) >= np.maximum(size - 2, 2)
    last = b.data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    key = st.doc_keys(w.hash, w.doc)
    rep = np.flatnonzero(st.repeated(key))
    extra = np.ones(len(rep), bool)
    if len(rep):
        extra[np.unique(key[rep], return_index=True)[1]] = False
    distinct = n - np.bincount(w.doc[rep[extra]], minlength=b.n)
    lines, dup = st.duplicate_lines(b, w)
    by_word = lambda flags: ts.per_doc(flags, w.first) / one
    return np.stack([
        np.log1p(n), mean, spread, share(SYMBOL), share(UPPER), share(DIGIT), share(BANG), share(STOP),
        distinct / np.sqrt(one), st.repeat_words(w) / one, dup / np.maximum(lines, 1), n / np.maximum(lines, 1), by_word((size == 1) & (last == 0x7C)), by_word(SYMBOL[last]), by_word(BANG[last]), by_word(upper), share(HIGH), by_word(size <= 3),
    ], axis=1)


def all_features(texts: pa.Array) -> np.ndarray:
    b = ts.as_bytes(texts)
    got = [features(ts.part(b, i, j)) for i, j in ts.slices(b)]
    return np.concatenate(got) if got else np.zeros((0, len(FEATURES)))


class Gam:
    def __init__(self) -> None:
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []  # bin -> coarse bin, per feature
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        self.constant = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.constant)
        if not self.edges or not len(x):
            return out
        b = self.bins(x)
        for k, t in enumerate(self.tables):
            out += t[b[:, k]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """The best cut of bins lo..hi: gain, and the first bin of the right side."""
    cg, ch, cn = (np.cumsum(v[lo:hi]) for v in (g, h, n))
    ok = (cn[:-1] >= LEAST_ROWS) & (cn[-1] - cn[:-1] >= LEAST_ROWS)
    if not ok.any():
        return 0.0, lo
    left, right = cg[:-1] ** 2 / (ch[:-1] + RIDGE), (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + RIDGE)
    gain = np.where(ok, left + right - cg[-1] ** 2 / (ch[-1] + RIDGE), -1)
    k = int(np.argmax(gain))
    return float(gain[k]), lo + k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A piecewise constant step over bins with at most this many pieces, grown at the best cut."""
    pieces = [(0, len(g))]
    while len(pieces) < leaves:
        best = max((( *_split(g, h, n, a, z), a, z) for a, z in pieces if z - a > 1), default=(0.0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        _, cut, a, z = best
        pieces.remove((a, z))
        pieces += [(a, cut), (cut, z)]
    out = np.zeros(len(g))
    for a, z in pieces:
        out[a:z] = g[a:z].sum() / (h[a:z].sum() + RIDGE)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One cut of the first feature, and on each side one of the second."""
    best, out = 0.0, np.zeros(g.shape)
    for k in range(1, g.shape[0]):
        step, gain = np.zeros(g.shape), 0.0
        for a, z in ((0, k), (k, g.shape[0])):
            gs, hs, ns = g[a:z].sum(0), h[a:z].sum(0), n[a:z].sum(0)
            if ns.sum() < LEAST_ROWS:
                break
            t = shallow_tree(gs, hs, ns, 2)
            step[a:z] = t
            gain += float((t * gs - 0.5 * t * t * (hs + RIDGE / len(gs))).sum())
        if gain > best:
            best, out = gain, step
    return out


def train(x: np.ndarray, y: np.ndarray) -> Gam:
    """Without both labels the score is the (smoothed) share of ones."""
    m = Gam()
    share = (y.sum() + 0.5) / (len(y) + 1)
    m.constant = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return m
    q = np.linspace(0, 1, BINS + 1)[1:-1]
    m.edges = [np.unique(np.quantile(x[:, k], q)) for k in range(x.shape[1])]
    b = m.bins(x)
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    for e in m.edges:
        size = len(e) + 1
        m.coarse.append(np.arange(size) * min(PAIR_BINS, size) // size)
    f = np.full(len(y), m.constant)

    def sums(idx: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = sigmoid(f)
        return np.bincount(idx, y - p, size), np.bincount(idx, p * (1 - p), size), np.bincount(idx, minlength=size)

    for _ in range(ROUNDS):
        for k, t in enumerate(m.tables):
            step = RATE * shallow_tree(*sums(b[:, k], len(t)))
            t += step
            f += step[b[:, k]]
    size = [int(c[-1]) + 1 for c in m.coarse]
    idx = {}
    gains = []
    for i, j in itertools.combinations(range(x.shape[1]), 2):
        idx[i, j] = m.coarse[i][b[:, i]] * size[j] + m.coarse[j][b[:, j]]
        g, h, _ = sums(idx[i, j], size[i] * size[j])
        gains.append((float((g * g / (h + RIDGE)).sum()), (i, j)))
    m.pairs = [p for _, p in sorted(gains, reverse=True)[:PAIRS]]
    m.pair_tables = [np.zeros((size[i], size[j])) for i, j in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(m.pairs, m.pair_tables, strict=True):
            step = RATE * pair_tree(*(v.reshape(t.shape) for v in sums(idx[i, j], t.size)))
            t += step
            f += step.ravel()[idx[i, j]]
    return m


def _train(texts: pa.Array, y: np.ndarray) -> Gam:
    return train(all_features(texts), y.astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame) -> Gam:
    return trained(docs, labels, "quality", TRAIN_DOCS, _train)


OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(docs: DataFrame, model: Gam, carry: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        m = shared.value

        def f(batch: pa.RecordBatch) -> dict:
            s = sigmoid(m.logit(all_features(batch.column(0))))
            return {"score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

        return f

    return arrow_pass(docs, {"text": F.col("text")}, carry, make, OUT)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts get the score of no words; a text of any length is measured whole; repeated rows score alike,
    and texts that fall into the same bins tie; an empty table gives no rows; other columns are not carried, so their
    names can't clash. Without both labels every text gets the share of good ones.
    """
    return score(docs, fit(docs, labels), ["doc_id"]).select("doc_id", held_out(4).alias("held_out"), "_out.*")
