"""LM scoring: a Katz backoff trigram model over word tokens, kept in partitioned tables.

Packs. Each task reads texts in packs of a few megabytes: the distinct words of a pack, and its tokens as places among
them. The words of all packs meet in parts by hash, where they are counted and numbered by frequency; the numbers go
back to their packs. From then on tokens are small whole numbers, which pack tightly.

Model. Every trigram of the training texts is counted, those seen once too: per pack first, then in parts by its middle
word, so that a part holds, of all its words b, the trigrams (a, b, w) and hence the bigrams (b, w) too. A middle word
that is so frequent that it would fill a part is dealt out by the word before it; its bigrams are summed in parts of
their own and sent to each of the parts that its trigrams are in. Counts of counts over all parts give Good-Turing
discounts for both orders. With h' the context h without its first word, the weight of h is

    alpha(h) = (1 - sum of P(w | h) over the w seen after h) / (1 - sum of P(w | h') over the same w)

so that probabilities after every context sum to one exactly. P(w) is additive over all training tokens and one unknown
type: (c + 1) / (N + V + 1).

Scoring. Tokens travel packed to the part of their middle word, where the recursion runs to its end: P(w | a b) is the
discounted share if the trigram was seen, else alpha(a b) P(w | b), and that in turn is the discounted share if the pair
was seen, else alpha(b) P(w). Sums by document return to their packs, one row for each pack and part. No table is ever
collected or broadcast; what comes to the driver is counts of counts and the frequent words, at most one per part.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractloom.llm import textscan as ts
from tractloom.llm.runtime import discarded, held_out, released, shared_folder, short_batches, stored

#: Stands for the end of a text among the hashes of words.
END = np.uint64(0x5851F42D4C957F2D)
#: Numbers of words that no training text has, and of what stands before a text; words begin after them.
UNKNOWN, START, FIRST = 0, 1, 2
#: Counts from TOP on are not discounted.
TOP = 6
#: Bytes of text in a pack.
PACK = 4 << 20
_K = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.uint64(32)


# Packed columns


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers that aren't negative: their first bytes together, then their second bytes and so on, compressed."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return width.to_bytes(1, "little") + len(x).to_bytes(7, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def spread(raw: bytes) -> np.ndarray:
    """What squeeze() packed."""
    width, n = raw[0], int.from_bytes(raw[1:8], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(raw[8:], n * width, "zstd"), np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal entries begin, and how long they are."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))


def grouped(head: np.ndarray, tail: np.ndarray) -> list[bytes]:
    """Two columns sorted by (head, tail): the heads and the lengths of their runs, and the tails by differences."""
    first, length = runs(head)
    with np.errstate(over="ignore"):
        top = np.diff(head[first], prepend=np.zeros(1, np.uint64))
        step = np.diff(tail, prepend=np.zeros(1, np.uint64))
    step[first] = tail[first]
    return [squeeze(top), squeeze(length), squeeze(step)]


def ungrouped(top: bytes, length: bytes, step: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = spread(length).astype(np.int64)
    with np.errstate(over="ignore"):
        head, d = np.cumsum(spread(top), dtype=np.uint64), spread(step)
        c = np.cumsum(d, dtype=np.uint64)
        first = np.cumsum(n) - n
        tail = c - np.repeat(c[first] - d[first], n)
    return np.repeat(head, n), tail


BLOBS = ("c0", "c1", "c2", "c3", "c4", "c5")
ROW = "part long, kind int, pack long, r long, x long, " + ", ".join(f"{c} binary" for c in BLOBS)


def packed(rows: list[tuple]) -> pa.RecordBatch:
    """rows: part, kind, pack, r, x, list of blobs."""
    cols = [pa.array([r[k] for r in rows], pa.int32() if k == 1 else pa.int64()) for k in range(5)]
    cols += [pa.array([r[5][k] if k < len(r[5]) else None for r in rows], pa.binary()) for k in range(len(BLOBS))]
    return pa.RecordBatch.from_arrays(cols, names=["part", "kind", "pack", "r", "x", *BLOBS])


def sums_out(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.float64).tobytes()


def sums_in(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float64)


def joined(found: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *found])


# Parts


class Deal:
    """Which part a trigram is in: that of its middle word, or of that word and the one before it where the middle word is hot."""

    def __init__(self, parts: int, hot: dict[int, int]) -> None:
        self.parts = parts
        self.hot = np.array(sorted(hot), np.uint64)
        self.salts = np.array([hot[k] for k in sorted(hot)], np.uint64)

    def _part(self, b: np.ndarray, salt: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (ts.mix_seed(b * _K + salt, 3) >> np.uint64(33)) % np.uint64(self.parts)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        salt = np.zeros(len(b), np.uint64)
        if len(self.hot):
            i, on = ts.sorted_lookup(self.hot, b)
            salt[on] = ts.mix_seed(a[on], 4) % self.salts[i[on]]
        return self._part(b, salt)

    def all_of(self, b: int) -> list[int]:
        """All parts of a hot word."""
        n = int(self.salts[np.searchsorted(self.hot, np.uint64(b))])
        return np.unique(self._part(np.full(n, b, np.uint64), np.arange(n, dtype=np.uint64))).tolist()

    def is_hot(self, b: np.ndarray) -> np.ndarray:
        return ts.sorted_lookup(self.hot, b)[1]


#: Bytes of text whose trigrams make up a part, at most; a part is one group in a task's memory.
PART_BYTES = 16 << 20


def parts_for(docs: DataFrame) -> int:
    """Parts of the tables: by the bytes of all texts, and at least twice as many as the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(2 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-total // PART_BYTES))


def word_part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


# Packs and numbers of words


def token_hashes(b: ts.Bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end of each text, and how many there are by text."""
    w = ts.all_words(b, ts.SPACE_WORDS)
    n = np.diff(w.first) + 1
    h = np.full(int(n.sum()), END)
    h[np.arange(len(w.hash)) + w.doc] = w.hash
    return h, n


PACK_ROW = "pack long, words binary, seen binary, tokens binary, sizes binary, ids binary, flags binary"


def _one(schema: str, row: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *[pa.array([x], pa.binary()) for x in row[1:]]], names=[x.split()[0] for x in schema.split(", ")])


def packs(docs: DataFrame) -> DataFrame:
    """docs: text, doc_id, skip (not learned from). Packs are named by chance when they are written, and only read from then on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = ts.as_bytes(batch.column(0))
            for i, j in ts.slices(every, PACK):
                h, n = token_hashes(ts.part(every, i, j))
                skip = batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)
                words, at = np.unique(h, return_inverse=True)
                seen = np.bincount(at[np.repeat(~skip, n)], minlength=len(words))
                # Frequent words get the small places, so that tokens pack well.
                order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                ids = batch.column(1).slice(i, j - i)
                flags = skip.astype(np.uint64) | np.asarray(ids.is_null()).astype(np.uint64) << np.uint64(1)
                id_bytes = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
                name = int.from_bytes(os.urandom(8), "little") >> 1
                yield _one(PACK_ROW, [name, words[order].tobytes(), squeeze(seen[order]), squeeze(place[at]), squeeze(n), id_bytes, squeeze(flags)])

    return docs.select("text", "doc_id", "skip").mapInArrow(run, PACK_ROW)


ASK, TOTALS, FREQUENT = range(3)


def numbered(found: DataFrame, parts: int) -> DataFrame:
    """The words of all packs, counted and numbered. ASK: to each pack, numbers (c0) and counts (c1) of its words of a part;
    TOTALS: training tokens (r) and distinct words (x) of a part; FREQUENT: number (r) and count (x) of a part's most frequent words.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            w, n = np.frombuffer(row["words"], np.uint64), spread(row["seen"])
            part = word_part(w, parts)
            o = np.argsort(part, kind="stable")
            yield packed([(int(part[i[0]]), ASK, row["pack"], None, None, [w[i].tobytes(), squeeze(n[i])]) for s, k in zip(*runs(part[o]), strict=True) for i in [o[s : s + k]]])

    def answer(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        name, c0, c1 = (t.column(c).to_pylist() for c in ("pack", "c0", "c1"))
        asked = [np.frombuffer(x, np.uint64) for x in c0]
        w, at = np.unique(joined(asked), return_inverse=True)
        count = np.bincount(at, joined([spread(x) for x in c1]), len(w)).astype(np.int64)
        known = count > 0
        order = np.argsort(-count, kind="stable")
        number = np.empty(len(w), np.uint64)
        number[order] = np.arange(len(w), dtype=np.uint64) * np.uint64(parts) + np.uint64(part + FIRST)
        if int(number[known].max(initial=0)) >= 1 << 32:
            raise ValueError("more than 2**32 distinct words")
        number[~known] = UNKNOWN
        rows, z = [], 0
        for p, x in zip(name, asked, strict=True):
            i = at[z : z + len(x)]
            rows.append((part, ASK, p, None, None, [squeeze(number[i]), squeeze(count[i])]))
            z += len(x)
        total = int(count.sum())
        rows.append((part, TOTALS, None, total, int(known.sum()), []))
        rows += [(part, FREQUENT, None, int(number[k]), int(count[k]), []) for k in order[:parts].tolist() if count[k] * parts > total]
        return pa.Table.from_batches([packed(rows)])

    return found.select("pack", "words", "seen").mapInArrow(ask, ROW).groupBy("part").applyInArrow(answer, ROW)


CODED = "pack long, number binary, count binary, tokens binary, sizes binary, ids binary, flags binary"


def coded(found: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """Packs with the numbers and counts of their words in place of the words."""
    got = answers.where(F.col("kind") == ASK).groupBy("pack").agg(F.collect_list(F.struct("part", "c0", "c1")).alias("got"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            w = np.frombuffer(row["words"], np.uint64)
            o = np.argsort(word_part(w, parts), kind="stable")
            number, count = np.zeros(len(w), np.uint64), np.zeros(len(w), np.uint64)
            replies = sorted(row["got"], key=lambda x: x["part"])
            number[o], count[o] = joined([spread(x["c0"]) for x in replies]), joined([spread(x["c1"]) for x in replies])
            yield _one(CODED, [row["pack"], squeeze(number), squeeze(count), row["tokens"], row["sizes"], row["ids"], row["flags"]])

    return found.drop("seen").join(got, "pack").mapInArrow(run, CODED)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def _trigrams(row: dict) -> tuple[np.ndarray, ...]:
    """Of each token of a pack: the two before it, itself, its count, its document; then which documents are not learned from."""
    number, count = spread(row["number"]), spread(row["count"])
    at, n = spread(row["tokens"]).astype(np.int64), spread(row["sizes"]).astype(np.int64)
    w = number[at]
    first = np.cumsum(n) - n
    b = np.full(len(w), START, np.uint64)
    b[1:] = w[:-1]
    b[first] = START
    a = np.full(len(w), START, np.uint64)
    a[1:] = b[:-1]
    a[first] = START
    return a, b, w, count[at], np.repeat(np.arange(len(n)), n), (spread(row["flags"]) & np.uint64(1)) > 0


def _ordered(a: np.ndarray, b: np.ndarray, w: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The order by part, b, a, w."""
    o = np.lexsort((w, b << _HIGH | a))
    return o[np.argsort(part[o].astype(np.uint16 if len(part) and part.max() < 65536 else np.int64), kind="stable")]


# The model's tables

TABLE, SIZES2, SIZES3, HOT_PAIRS, TOKENS = range(10, 15)


def _trigram_rows(kind: int, pack: int | None, part: np.ndarray, a: np.ndarray, b: np.ndarray, rest: list[np.ndarray]) -> list[tuple]:
    return [(int(part[s]), kind, pack, None, None, [*grouped(b[s : s + k], a[s : s + k]), *[squeeze(x[s : s + k]) for x in rest]]) for s, k in zip(*runs(part), strict=True)]


def _pair_rows(to: np.ndarray, b: np.ndarray, w: np.ndarray, n: np.ndarray, c: np.ndarray) -> list[tuple]:
    """Rows by destination, which is kept in r."""
    o = np.argsort(to, kind="stable")
    return [(None, HOT_PAIRS, None, int(to[i[0]]), None, [*grouped(b[i], w[i]), squeeze(n[i]), squeeze(c[i])]) for s, k in zip(*runs(to[o]), strict=True) for i in [o[s : s + k]]]


def _sizes(kind: int, part: int, n: np.ndarray) -> list[tuple]:
    return [(part, kind, None, r, int(x), []) for r, x in enumerate(np.bincount(np.minimum(n, TOP + 1).astype(np.int64), minlength=TOP + 2)) if x]


def _read(t: pa.Table, kind: int) -> list[np.ndarray]:
    """Head, tail and the further columns of all rows of a kind."""
    got = [[np.zeros(0, np.uint64)] for _ in range(4 if kind == HOT_PAIRS else 5)]
    blobs = [t.column(c) for c in BLOBS]
    for k in np.flatnonzero(t.column("kind").to_numpy() == kind).tolist():
        raw = [x[k].as_py() for x in blobs[: len(got) + 1]]
        for to, x in zip(got, [*ungrouped(*raw[:3]), *map(spread, raw[3:])], strict=True):
            to.append(x)
    return [np.concatenate(x) for x in got]


def _pairs(b: np.ndarray, w: np.ndarray, n: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs (b, w) in order, with summed counts."""
    key = b << _HIGH | w
    o = np.argsort(key, kind="stable")
    key = key[o]
    first, _ = runs(key)
    return key[first] >> _HIGH, key[first] & np.uint64(0xFFFFFFFF), np.add.reduceat(n[o], first) if len(first) else n, c[o[first]]


def counted(packs_: DataFrame, deal: Deal) -> DataFrame:
    """TABLE: the trigrams of a part with counts (c4) and the counts of their last words (c5); SIZES3, SIZES2: how many (x) have
    a count (r); HOT_PAIRS: the pairs of hot words in this part, to be summed in part r.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            a, b, w, c, doc, skip = _trigrams(row)
            use = ~skip[doc]
            a, b, w, c = a[use], b[use], w[use], c[use]
            part = deal.of(a, b)
            o = _ordered(a, b, w, part)
            a, b, w, c, part = a[o], b[o], w[o], c[o], part[o]
            first, n = runs(part, b, a, w)
            yield packed(_trigram_rows(TABLE, None, part[first], a[first], b[first], [w[first], n, c[first]]))

    def reduce(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        b, a, w, n, c = _read(t, TABLE)
        o = np.lexsort((w, b << _HIGH | a))
        a, b, w, c = a[o], b[o], w[o], c[o]
        first, _ = runs(b, a, w)
        n = np.add.reduceat(n[o], first)
        a, b, w, c = a[first], b[first], w[first], c[first]
        rows = _trigram_rows(TABLE, None, np.full(len(a), part), a, b, [w, n, c]) + _sizes(SIZES3, part, n)
        pb, pw, pn, pc = _pairs(b, w, n, c)
        hot = deal.is_hot(pb)
        rows += _sizes(SIZES2, part, pn[~hot])
        to = word_part(ts.mix_seed(pb[hot] * _K ^ pw[hot], 6), deal.parts)
        rows += [(part, *r[1:]) for r in _pair_rows(to, pb[hot], pw[hot], pn[hot], pc[hot])]
        return pa.Table.from_batches([packed(rows)])

    return packs_.mapInArrow(send, ROW).groupBy("part").applyInArrow(reduce, ROW)


def hot_pairs(tables: DataFrame, deal: Deal) -> DataFrame:
    """Pairs of hot words summed over all parts, and sent to each part that has trigrams around the hot word; SIZES2 of them."""

    def reduce(t: pa.Table) -> pa.Table:
        b, w, n, c = _pairs(*_read(t, HOT_PAIRS))
        rows = _sizes(SIZES2, 0, n)
        for s, k in zip(*runs(b), strict=True):
            blobs = [*grouped(b[s : s + k], w[s : s + k]), squeeze(n[s : s + k]), squeeze(c[s : s + k])]
            rows += [(to, HOT_PAIRS, None, None, None, blobs) for to in deal.all_of(int(b[s]))]
        return pa.Table.from_batches([packed(rows)])

    return tables.where(F.col("kind") == HOT_PAIRS).groupBy("r").applyInArrow(reduce, ROW)


def discounts(n: dict[int, int]) -> dict[int, float]:
    """Katz's Good-Turing ratios for counts below TOP; a ratio that the counts of counts make senseless falls back to a plain one."""
    get = lambda r: float(n.get(r, 0))
    out = {}
    n1, top = get(1), get(TOP)
    a = TOP * top / n1 if n1 else 0.0
    for r in range(1, TOP):
        d = ((r + 1) * get(r + 1) / (r * get(r)) - a) / (1 - a) if get(r) and a < 1 else 0.0
        out[r] = d if 0.0 < d < 1.0 else r / (r + 1.0)
    return out


def context_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ts.splitmix(b << _HIGH | a)


def trigram_key(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ts.splitmix(context_key(a, b) * _K + w)


class Part:
    """One part of the model: log10 of what trigrams, pairs and contexts give over P(w), under sorted keys."""

    def __init__(self, table: list[np.ndarray], hot: list[np.ndarray], deal: Deal, ratio: dict[int, list[float]], total: float) -> None:
        """total: N + V + 1; ratio: by order, the factor of each count up to TOP."""
        b, a, w, n, c = table
        pb, pw, pn, pc = _pairs(b, w, n, c)
        if len(deal.hot):  # of hot words all pairs come from elsewhere
            cold = ~deal.is_hot(pb)
            pb, pw, pn, pc = (np.concatenate([x[cold], y]) for x, y in zip((pb, pw, pn, pc), hot, strict=True))
            o = np.argsort(pb << _HIGH | pw)
            pb, pw, pn, pc = pb[o], pw[o], pn[o], pc[o]
        p1 = (pc.astype(np.float64) + 1) / total
        share, weight, first = self._level([pb], pn, p1, ratio[2])
        self.word, self.word_weight = pb[first], np.log10(weight)
        self.pair = pb << _HIGH | pw
        self.pair_gain = np.log10(share) - np.log10(p1)
        # The lower order's probability of a word that was seen after a context is its pair's share.
        p2 = share[np.searchsorted(self.pair, b << _HIGH | w)] if len(b) else np.zeros(0)
        share3, weight3, first3 = self._level([b, a], n, p2, ratio[3])
        key = context_key(a[first3], b[first3])
        o = np.argsort(key)
        self.context, self.context_weight = key[o], np.log10(weight3)[o]
        key = trigram_key(a, b, w)
        o = np.argsort(key)
        self.trigram = key[o]
        self.trigram_gain = (np.log10(share3) - np.log10((c.astype(np.float64) + 1) / total))[o]

    @staticmethod
    def _level(head: list[np.ndarray], n: np.ndarray, below: np.ndarray, ratio: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Discounted shares of what was seen, the weight of each context, and where contexts begin. below: the lower order's probabilities."""
        first, size = runs(*head)
        if not len(n):
            return np.zeros(0), np.zeros(0), first
        m = n.astype(np.float64)
        share = np.asarray(ratio)[np.minimum(n, TOP).astype(np.int64)] * m / np.repeat(np.add.reduceat(m, first), size)
        mass = np.add.reduceat(share, first)
        # Where a context's words keep all its mass, a share is set aside so that backing off stays possible.
        scale = np.where(mass > 1 - 1e-6, (1 - 1 / (size + 1.0)) / mass, 1.0)
        share *= np.repeat(scale, size)
        rest = np.maximum(1 - np.add.reduceat(below, first), 1e-12)
        return share, (1 - mass * scale) / rest, first

    def gain(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 P(w | a b) - log10 P(w) of some tokens."""
        out = np.zeros(len(w))
        i, seen = ts.sorted_lookup(self.trigram, trigram_key(a, b, w))
        out[seen] = self.trigram_gain[i[seen]]
        rest = np.flatnonzero(~seen)
        i, known = ts.sorted_lookup(self.context, context_key(a[rest], b[rest]))
        out[rest[known]] = self.context_weight[i[known]]
        i, pair = ts.sorted_lookup(self.pair, b[rest] << _HIGH | w[rest])
        out[rest[pair]] += self.pair_gain[i[pair]]
        rest = rest[~pair]
        i, known = ts.sorted_lookup(self.word, b[rest])
        out[rest[known]] += self.word_weight[i[known]]
        return out


class Model:
    """Tables in parts (a bucketed table, and the pairs of hot words), discounts, N and V."""

    def __init__(self, spark: SparkSession, packs_: DataFrame, parts: int, n: int, v: int, hot: dict[int, int]) -> None:
        self.n, self.v = n, v
        self.deal = Deal(parts, hot)
        self.name = f"katz_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(spark)}/tractloom-{self.name}"
        buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        counted(packs_, self.deal).write.bucketBy(buckets, "part").option("path", self.path).saveAsTable(self.name)
        released(spark)
        self.tables = spark.table(self.name)
        self.hot = stored(hot_pairs(self.tables, self.deal), "katz-hot")
        sizes = self.tables.select("kind", "r", "x").union(self.hot.select("kind", "r", "x")).where(F.col("kind").isin(SIZES2, SIZES3))
        found: dict[int, dict[int, int]] = {SIZES2: {}, SIZES3: {}}
        for row in sizes.groupBy("kind", "r").agg(F.sum("x").alias("x")).collect():
            found[row["kind"]][row["r"]] = row["x"]
        self.ratio = {k: [1.0, *discounts(found[s]).values(), 1.0] for k, s in ((2, SIZES2), (3, SIZES3))}

    def drop(self) -> None:
        self.tables.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.tables._stored_path = self.path
        discarded(self.tables, self.hot)


def gains(model: Model, packs_: DataFrame) -> DataFrame:
    """For each pack and part, documents (c0) and what its tokens there add to their scores (c1)."""
    deal, ratio, total = model.deal, model.ratio, float(model.n + model.v + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            a, b, w, _, doc, _ = _trigrams(row)
            part = deal.of(a, b)
            o = _ordered(a, b, w, part)
            yield packed(_trigram_rows(TOKENS, row["pack"], part[o], a[o], b[o], [w[o], doc[o]]))

    def meet(table: pa.Table, asked: pa.Table) -> pa.Table:
        at = np.flatnonzero(asked.column("kind").to_numpy() == TOKENS).tolist()
        if not at:
            return pa.Table.from_batches([packed([])])
        known = Part(_read(table, TABLE), _read(asked, HOT_PAIRS), deal, ratio, total)
        rows = []
        blobs = [asked.column(c) for c in BLOBS]
        for k in at:
            raw = [x[k].as_py() for x in blobs[:5]]
            b, a = ungrouped(*raw[:3])
            doc = spread(raw[4]).astype(np.int64)
            here = np.flatnonzero(np.bincount(doc))
            sums = np.bincount(doc, known.gain(a, b, spread(raw[3])))[here]
            rows.append((None, TOKENS, asked.column("pack")[k].as_py(), None, None, [squeeze(np.diff(here, prepend=0)), sums_out(sums)]))
        return pa.Table.from_batches([packed(rows)])

    asked = packs_.mapInArrow(send, ROW).union(model.hot.where(F.col("kind") == HOT_PAIRS))
    return model.tables.where(F.col("kind") == TABLE).groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(meet, ROW)


RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"
DOCUMENTS = 20


def scored(model: Model, packs_: DataFrame) -> DataFrame:
    """One row for each document."""
    mass = float(np.log10(float(model.n) + model.v + 1))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            count, at = spread(row["count"]), spread(row["tokens"]).astype(np.int64)
            n = spread(row["sizes"]).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            base = np.bincount(doc, (np.log10(count.astype(np.float64) + 1) - mass)[at], len(n))
            known = np.bincount(doc, (count > 0)[at], len(n)).astype(np.int64)
            yield packed([(None, DOCUMENTS, row["pack"], None, None, [row["ids"], row["flags"], row["sizes"], squeeze(known), base.tobytes()])])

    def finish(t: pa.Table) -> pa.Table:
        kind, blobs = t.column("kind").to_numpy(), [t.column(c) for c in BLOBS]
        ids, flags, n, known, base = (blobs[k][int(np.flatnonzero(kind == DOCUMENTS)[0])].as_py() for k in range(5))
        base = np.frombuffer(base, np.float64)
        score = base.copy()
        parts = [(blobs[0][k].as_py(), blobs[1][k].as_py()) for k in np.flatnonzero(kind == TOKENS).tolist()]
        for docs, sums in sorted(parts):  # in one order, so that sums don't depend on how rows arrive
            score[np.cumsum(spread(docs)).astype(np.int64)] += sums_in(sums)
        none = (spread(flags) & np.uint64(2)) > 0
        return pa.table({
            "doc_id": pa.array(np.frombuffer(ids, np.int64), mask=none), "n_tokens": pa.array(spread(n).astype(np.int64)), "n_known": pa.array(spread(known).astype(np.int64)),
            "base_score": pa.array(base), "score": pa.array(score),
        })

    return packs_.mapInArrow(own, ROW).union(gains(model, packs_)).groupBy("pack").applyInArrow(finish, RESULT)


def encoded(docs: DataFrame) -> tuple[DataFrame, int, int, dict[int, int], int]:
    """Packs of numbers, N, V, the hot words with the number of parts that each is dealt to, and the number of parts."""
    spark = docs.sparkSession
    short_batches(spark)
    parts = parts_for(docs)
    found = stored(packs(docs), "katz-packs")
    answers = stored(numbered(found, parts), "katz-words")
    released(spark)
    total = answers.where(F.col("kind") == TOTALS).agg(F.coalesce(F.sum("r"), F.lit(0)).alias("n"), F.coalesce(F.sum("x"), F.lit(0)).alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    # A hot word has more than a part's share of all tokens, so there are fewer of them than parts.
    hot = {r["r"]: -(-int(r["x"]) * parts // max(n, 1)) for r in answers.where((F.col("kind") == FREQUENT) & (F.col("x") > n / parts)).select("r", "x").collect()}
    got = stored(coded(found, answers, parts), "katz-coded")
    discarded(found, answers)
    released(spark)
    return got, n, v, hot, parts


def language_model(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    A null or empty text has one token, its end. Documents without id are scored and never learned from. Repeated rows
    are scored each, and alike; texts of any length are scored whole; an empty table gives no rows, and without training
    tokens every token is unknown and all scores are those of the base. Other columns are not carried.
    """
    use = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out(7).alias("skip"))
    got, n, v, hot, parts = encoded(use)
    model = Model(docs.sparkSession, got, parts, n, v, hot)
    out = stored(scored(model, got), "katz-scores")
    model.drop()
    discarded(got)
    released(docs.sparkSession)
    return out.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
