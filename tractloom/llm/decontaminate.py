"""Benchmark decontamination: a prefix-filtered set join of item windows against document words.

Each benchmark item gives windows of 13 consecutive words (one shorter window where it has fewer). The words of
a window are ordered by rarity, counted over all documents. A document can only contain a window whole, so the
overlap it must reach is the full window, and the necessary prefix is the single rarest word. Document words are
joined with these prefix words; the place of the word in the window and the borders of the text bound where the
window would have to lie; what is left is verified word for word over the whole window.

The benchmark goes to the tasks in blocks of bounded size. One block is the rule; more blocks add one narrow
pass each, so a benchmark of any size is joined without a shuffle of the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractloom.llm import textscan as ts
from tractloom.llm.runtime import arrow_pass, flat, given_back, out_name

WINDOW = 13
#: Windows in one block: the size bound of what is broadcast (about 150 bytes a window).
BLOCK_WINDOWS = 200_000


class Block:
    """Windows of some items: word hashes (rows of WINDOW, zero beyond the length), lengths, items."""

    def __init__(self, texts: list[str], items: list[str | None], window: int = WINDOW) -> None:
        b = ts.as_bytes(pa.array(texts, pa.large_string()))
        w = ts.words(b, ts.ALNUM_WORDS)
        count = np.diff(w.first)
        starts, sizes, item = [], [], []
        for i, n in enumerate(count):
            if n:
                k = max(1, n - window + 1)
                starts.append(w.first[i] + np.arange(k))
                sizes.append(np.full(k, min(n, window)))
                item.append(np.full(k, i))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        start, self.size, self.item = cat(starts), cat(sizes), cat(item)
        at = start[:, None] + np.arange(window)
        real = np.arange(window) < self.size[:, None]
        self.words = np.where(real, w.hash[np.minimum(at, max(len(w.hash) - 1, 0))], 0) if len(start) else np.zeros((0, window), np.uint64)
        self.real = real
        self.items = items
        self.vocabulary = np.unique(w.hash)

    def choose_prefixes(self, counts: np.ndarray) -> None:
        """counts: how often each word of the vocabulary occurs in the documents. Ties fall to the first word."""
        n = counts[np.searchsorted(self.vocabulary, self.words)] if len(self.words) else np.zeros(self.words.shape, np.int64)
        self.place = np.argmin(np.where(self.real, n, np.iinfo(np.int64).max), axis=1) if len(n) else np.zeros(0, np.int64)
        key = self.words[np.arange(len(self.words)), self.place]
        order = np.argsort(key, kind="stable")
        for name in ("words", "size", "item", "place", "real"):
            setattr(self, name, getattr(self, name)[order])
        self.keys, self.key_first = np.unique(key[order], return_index=True)
        self.key_first = np.append(self.key_first, len(key))
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, w: ts.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each occurrence of a window: its first word's index, its size, its item."""
        maybe = np.flatnonzero(self.filter[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
        k, found = ts.sorted_lookup(self.keys, w.hash[maybe])
        at, k = maybe[found], k[found]
        many = self.key_first[k + 1] - self.key_first[k]
        at = np.repeat(at, many)
        win = np.repeat(self.key_first[k], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        start, doc = at - self.place[win], w.doc[at]
        ok = (start >= w.first[doc]) & (start + self.size[win] <= w.first[doc + 1])
        start, win = start[ok], win[ok]
        for j in range(self.words.shape[1]):
            same = ~self.real[win, j] | (w.hash[np.minimum(start + j, len(w.hash) - 1)] == self.words[win, j])
            start, win = start[same], win[same]
        return start, self.size[win], self.item[win]


def blocks(bench: DataFrame, limit: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """The benchmark item by item in blocks; the driver holds one block at a time."""
    texts, items, n = [], [], 0
    for row in bench.select(F.col("item_id").cast("string").alias("i"), F.coalesce(F.col("text"), F.lit("")).alias("t")).toLocalIterator(prefetchPartitions=False):
        texts.append(row["t"])
        items.append(row["i"])
        n += max(1, len(row["t"]) // 2)  # a bound on its words, and so on its windows
        if n >= limit:
            yield Block(texts, items)
            texts, items, n = [], [], 0
    if texts:
        yield Block(texts, items)


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences in all documents of each word of a (bounded) vocabulary; summed per task before the shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        total = np.zeros(len(vocab), np.int64)
        near = np.zeros(1 << 20, bool)
        near[(vocab & np.uint64(0xFFFFF)).astype(np.int64)] = True
        for batch in batches:
            b = ts.as_bytes(batch.column(0))
            for i, j in ts.slices(b):
                h = ts.words(ts.part(b, i, j), ts.ALNUM_WORDS).hash
                k, found = ts.sorted_lookup(vocab, h[near[(h & np.uint64(0xFFFFF)).astype(np.int64)]])
                total += np.bincount(k[found], minlength=len(vocab))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["word", "n"])

    got = docs.select("text").mapInArrow(given_back(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocabulary), np.int64)
    out[got["word"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


OUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def _found(block: Block, texts: pa.Array) -> dict[str, list]:
    """Of each text: its number of words, the word intervals that the block's windows cover (merged), and their items."""
    b = ts.as_bytes(texts)
    n_words, starts, ends, items = [np.zeros(0, np.int64)], [], [], []
    for i, j in ts.slices(b):
        w = ts.words(ts.part(b, i, j), ts.ALNUM_WORDS)
        n_words.append(np.diff(w.first))
        at, size, item = block.hits(w)
        s, e, it = [[] for _ in range(j - i)], [[] for _ in range(j - i)], [[] for _ in range(j - i)]
        if len(at):
            cover = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
            on = np.cumsum(cover)[:-1] > 0
            fresh = on.copy()
            fresh[1:] &= ~on[:-1] | (w.doc[1:] != w.doc[:-1])
            gone = on.copy()
            gone[:-1] &= ~on[1:] | (w.doc[1:] != w.doc[:-1])
            for a, z in zip(np.flatnonzero(fresh).tolist(), np.flatnonzero(gone).tolist(), strict=True):
                d = w.doc[a]
                s[d].append(a - int(w.first[d]))
                e[d].append(z + 1 - int(w.first[d]))
            for d, k in set(zip(w.doc[at].tolist(), item.tolist(), strict=True)):
                if block.items[k] is not None:
                    it[d].append(block.items[k])
        starts += s
        ends += e
        items += [sorted(set(x)) for x in it]
    return {"n_words": np.concatenate(n_words), "starts": starts, "ends": ends, "items": items}


def _pass(df: DataFrame, shared, carry: list[str]) -> DataFrame:
    """What one block finds, beside the carried columns."""

    def make() -> Callable:
        block: Block = shared.value
        return lambda batch: _found(block, batch.column(0))

    return arrow_pass(df, {"text": F.col("text")}, carry, make, OUT)


FINISH = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])


def _union(intervals: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for a, z in sorted(intervals):
        total += max(0, z - max(a, reach))
        reach = max(reach, z)
    return total


def _last_pass(df: DataFrame, shared, before: list[str]) -> DataFrame:
    """The last block's pass, which also sums up what the blocks before it found (before: their columns)."""

    def make() -> Callable:
        block: Block = shared.value

        def f(batch: pa.RecordBatch) -> dict:
            own = _found(block, batch.column(0))
            n_words, n = own["n_words"], batch.num_rows
            parts = [(own["starts"], own["ends"], own["items"])]
            parts += [tuple(batch.column(k).field(x).to_pylist() for x in ("starts", "ends", "items")) for k in range(1, len(before) + 1)]
            hit, n_items, sha = [0] * n, [0] * n, [_digest([])] * n
            for r in range(n):
                if any(s[r] for s, _, _ in parts):
                    hit[r] = _union([p for s, e, _ in parts for p in zip(s[r], e[r], strict=True)])
                    names = sorted({x for _, _, i in parts for x in i[r]})
                    n_items[r], sha[r] = len(names), _digest(names)
            return {"n_words": n_words, "n_hit": hit, "n_items": n_items, "items_sha256": sha, "contaminated": [h > 0 and 20 * h >= k for h, k in zip(hit, n_words.tolist(), strict=True)]}

        return f

    return arrow_pass(df, {"text": F.col("text"), **{k: F.col(k) for k in before}}, ["row"], make, FINISH)


def contamination(docs: DataFrame, bench: DataFrame, carry: list[str], limit: int = BLOCK_WINDOWS) -> DataFrame:
    """carry columns, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    A null or empty text has no words and is clean; a text of any length is matched whole; items without words match
    nothing; an item without id counts for n_hit and is left out of the items; repeated items count once by id; an empty
    benchmark hits nothing. Repeated documents get a result each, an empty table none.
    """
    spark = docs.sparkSession
    kept: list[str] = []
    df = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("row"))
    held = None
    for block in list_or_empty(blocks(bench, limit)):
        block.choose_prefixes(word_counts(docs, block.vocabulary))
        if held is not None:
            df = _pass(df, held, ["row", "text", *kept]).withColumnRenamed("_out", f"block{len(kept)}")
            kept.append(f"block{len(kept)}")
        held = spark.sparkContext.broadcast(block)
    done = _last_pass(df, held, kept)
    return done.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)], F.col("_out").alias(out_name(carry)))


def list_or_empty(found: Iterator[Block]) -> Iterator[Block]:
    """At least one block, so that an empty benchmark still gives every document its row."""
    some = False
    for b in found:
        some = True
        yield b
    if not some:
        yield Block([], [])


def _digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def contamination_table(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id and the results of contamination(), with its rules for odd rows; columns of docs that clash are not carried."""
    return flat(contamination(docs, bench, ["doc_id"]))
