"""Quality rules with an n-gram perplexity.

The model is an interpolated modified Kneser-Ney model of order 4 over the bytes of UTF-8, one for each language, so
that every script is told apart in full. Spark counts the n-grams over every document that passes the base rules and
works out discounts, contexts and probabilities from order to order by grouping and joining; n-grams that only rejected
documents hold are rows of count 0, so that every text can be scored. The result is kept as arrays sorted by the hash of
language and n-gram. A model of at most BROADCAST_GRAMS rows is broadcast to the tasks that read the texts; a larger one
stays partitioned: texts are cut into packs of PACK_BYTES, each pack asks for the n-grams that it holds, and the answers
meet it again.

Documents are scored whole. The bands are of each language: the median of log perplexity and the median distance
from it, read from a histogram over all documents, give an upper and a lower bound. Copies of a text count once there,
so that a large group of them doesn't narrow the band of its language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractloom.llm import textscan as ts
from tractloom.llm import textstats as st
from tractloom.llm.runtime import arrow_pass, discarded, short_batches, stored

ORDER = 4
BITS = 8
#: Stands before every text; no byte of UTF-8.
EDGE = 255
#: Rows of a model that may be collected and broadcast (16 bytes each), and the bytes of text in a pack beyond that.
BROADCAST_GRAMS = 4_000_000
PACK_BYTES = 16 << 20
#: Distinct n-grams that a counting task holds before it sends them on.
HELD = 1_000_000
#: Width of the bands in median distances, the text length (in bytes) from which they are that wide,
#: and the least half width in log10 units.
BAND, BAND_CHARS, BAND_LEAST = 7.0, 800.0, 0.03
BIN = 0.001
#: Languages whose bands may be broadcast (some 40 bytes each); with more, the join is a shuffled one.
BROADCAST_LANGS = 10_000
#: Discounts of counts 1, 2 and 3 or more where counts of counts are too few to estimate them, and their bounds.
PLAIN, LEAST, MOST = (0.5, 0.75, 0.9), (0.05, 0.1, 0.15), (0.95, 1.9, 2.85)


def gram_ids(b: ts.Bytes) -> np.ndarray:
    """The 4-gram that ends at each byte of each text, with what stands before the text as EDGE."""
    n, pad = len(b.data), ORDER - 1
    x = np.full(n + pad * b.n, EDGE, np.uint32)
    at = np.arange(n) + np.repeat(np.arange(1, b.n + 1) * pad, np.diff(b.offsets))
    x[at] = b.data
    ids = x[at]
    for k in range(1, ORDER):
        ids |= x[at - k] << np.uint32(BITS * k)
    return ids


def summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of what belongs to each."""
    k, c = np.concatenate(keys), np.concatenate(n)
    if not len(k):
        return k, c
    o = np.argsort(k)
    k = k[o]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c[o], first)


def lang_id() -> Column:
    return F.xxhash64("lang")


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang_id, gram, n) of every n-gram in docs (lang, text); documents that fail the base rules count nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[int, int] = {}
        keys, counts, size = [], [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            k, c = summed(keys, counts)
            langs = np.fromiter(index, np.int64, len(index))
            for i in range(0, len(k), 100_000):
                s = k[i : i + 100_000]
                cols = [langs[(s >> np.uint64(32)).astype(np.int64)], (s & np.uint64(0xFFFFFFFF)).astype(np.int64), c[i : i + 100_000]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["lang_id", "gram", "n"])

        for batch in batches:
            b = ts.as_bytes(batch.column(1))
            lang = np.array([index.setdefault(x, len(index)) for x in batch.column(0).to_pylist()], np.uint64)
            for i, j in ts.slices(b):
                p = ts.part(b, i, j)
                long = np.diff(p.offsets)
                ok = np.repeat(~st.base_rules(p, ts.words(p, ts.SPACE_WORDS, lower=False))["base_failed"], long)
                key = (np.repeat(lang[i:j], long) << np.uint64(32)) | gram_ids(p)
                k, c = np.unique(key[ok], return_counts=True)
                other = np.unique(key[~ok])
                keys += [k, other]
                counts += [c.astype(np.int64), np.zeros(len(other), np.int64)]
                size += len(k) + len(other)
                if size > HELD:
                    k, c = summed(keys, counts)
                    keys, counts, size = [k], [c], len(k)
                    if 2 * size > HELD:
                        yield from sent()
                        keys, counts, size = [], [], 0
        yield from sent()

    got = docs.select(lang_id().alias("lang_id"), "text").mapInArrow(run, "lang_id long, gram long, n long")
    return got.groupBy("lang_id", "gram").agg(F.sum("n").alias("n"))


def orders(counts: DataFrame) -> list[DataFrame]:
    """The counts of each order from the first on; below the highest they are of the distinct bytes to the left."""
    got = [counts]
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1))
        seen = F.sum((F.col("n") > 0).cast("long"))
        got.append(stored(got[-1].groupBy("lang_id", suffix.alias("gram")).agg(seen.alias("n")), f"grams{k}"))
    return got[::-1]


def contexts(counts: DataFrame) -> DataFrame:
    """lang_id, head, total, the discounts d1 to d3 and the weight that a context leaves to the order below."""
    n = [F.col(f"n{j}") for j in (1, 2, 3, 4)]
    y = F.try_divide(n[0], n[0] + 2 * n[1])
    raw = [F.lit(float(j + 1)) - (j + 2) * y * F.try_divide(n[j + 1], n[j]) for j in range(3)]
    few = F.coalesce(F.least(*n) < 1, F.lit(True))
    of_language = counts.where(F.col("n").between(1, 4)).groupBy("lang_id").agg(*[F.sum((F.col("n") == j).cast("double")).alias(f"n{j}") for j in (1, 2, 3, 4)])
    cut = [F.when(few, F.lit(PLAIN[j])).otherwise(F.least(F.greatest(raw[j], F.lit(LEAST[j])), F.lit(MOST[j]))).alias(f"d{j + 1}") for j in range(3)]
    head = F.shiftright("gram", BITS).alias("head")
    sums = [F.sum("n").alias("total"), *[F.sum((F.least("n", F.lit(3)) == j).cast("long")).alias(f"m{j}") for j in (1, 2, 3)]]
    got = counts.where("n > 0").groupBy("lang_id", head).agg(*sums).join(of_language, "lang_id", "left").select("*", *cut)
    return got.select("lang_id", "head", "total", "d1", "d2", "d3", ((F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total")).alias("weight"))


def probabilities(counts: DataFrame) -> DataFrame:
    """(lang_id, gram, p): the probability of the last byte of every 4-gram of counts, those of count 0 too.

    The joins are merge joins: these tables grow with the corpus, and the driver needn't hold them.
    """
    levels = orders(counts)
    below: list[DataFrame] = []
    n = F.col("n")
    cut = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    own = F.when(n > 0, F.greatest(n - cut, F.lit(0.0)) / F.col("total")).otherwise(0.0)
    for k, level in enumerate(levels, 1):
        x = level.withColumn("head", F.shiftright("gram", BITS)).join(contexts(level).hint("merge"), ["lang_id", "head"], "left")
        low = F.lit(1.0 / (1 << BITS))
        if below:
            rest = F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1))
            x = x.withColumn("rest", rest).join(below[-1].select("lang_id", F.col("gram").alias("rest"), F.col("p").alias("low")).hint("merge"), ["lang_id", "rest"])
            low = F.col("low")
        below.append(stored(x.select("lang_id", "gram", (own + F.coalesce("weight", F.lit(1.0)) * low).alias("p")), f"chances{k}"))
    discarded(*levels[:-1], *below[:-1])
    return below[-1]


def array_keys(lang: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The hash under which the n-gram of a language stands."""
    with np.errstate(over="ignore"):
        return ts.splitmix(ts.mix_seed(lang.astype(np.uint64), 5) + ids.astype(np.uint64))


class Chances:
    """log10 probabilities in arrays sorted by hash, and beside them a table of the n-grams met last."""

    SLOTS = 20

    def __init__(self, key: np.ndarray, log10: np.ndarray) -> None:
        self.key, self.log10 = key, log10
        self.met = (np.arange(1 << self.SLOTS, dtype=np.uint64) + np.uint64(1)) << np.uint64(64 - self.SLOTS)
        self.met_log10 = np.zeros(1 << self.SLOTS)

    def of(self, key: np.ndarray) -> np.ndarray:
        slot = (key >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        out = self.met_log10[slot]
        rest = np.flatnonzero(self.met[slot] != key)
        if len(rest):
            new, at = np.unique(key[rest], return_inverse=True)
            i, seen = ts.sorted_lookup(self.key, new)
            if not seen.all():
                raise ValueError("an n-gram is not in the model: it holds those of the documents that it was built from")
            slot = (new >> np.uint64(64 - self.SLOTS)).astype(np.int64)
            self.met[slot], self.met_log10[slot] = new, self.log10[i]
            out[rest] = self.log10[i][at]
        return out


OUT = T.StructType(
    [T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("log10_perplexity", T.DoubleType())]
)


def figures(b: ts.Bytes, lang: np.ndarray, chances: Chances) -> dict[str, np.ndarray]:
    """The columns of OUT for some texts."""
    got: list[dict] = [{k.name: np.zeros(0, bool if k.name == "base_failed" else np.float64 if k.name == "log10_perplexity" else np.int64) for k in OUT.fields}]
    for i, j in ts.slices(b):
        p = ts.part(b, i, j)
        r = st.base_rules(p, ts.words(p, ts.SPACE_WORDS, lower=False))
        size = np.diff(p.offsets)
        v = chances.of(array_keys(np.repeat(lang[i:j], size), gram_ids(p)))
        r["n_bytes"] = size
        r["log10_perplexity"] = np.zeros(p.n)
        if len(some := np.flatnonzero(size)):
            r["log10_perplexity"][some] = -np.add.reduceat(v, p.offsets[:-1][some]) / size[some]
        got.append(r)
    return {k.name: np.concatenate([r[k.name] for r in got]) for k in OUT.fields}


def sorted_arrays(lang: np.ndarray, gram: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = array_keys(lang, gram)
    o = np.argsort(key)
    return key[o], np.log10(np.maximum(p[o], 1e-12))


def score_by_broadcast(docs: DataFrame, model: DataFrame) -> DataFrame:
    """docs (doc_id, lang, text) scored in one narrow pass; only for a model whose rows were counted.

    Tasks turn the model's rows into bytes of keys and chances, 16 a row; the driver takes them partition by partition and sorts them once.
    """

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                key, p = sorted_arrays(*[b.column(k).to_numpy() for k in range(3)])
                yield pa.RecordBatch.from_arrays([pa.array([key.tobytes()]), pa.array([p.tobytes()])], names=["k", "p"])

    got = [(np.frombuffer(r.k, np.uint64), np.frombuffer(r.p, np.float64)) for r in model.select("lang_id", "gram", "p").mapInArrow(compact, "k binary, p binary").toLocalIterator()]
    key, p = (np.concatenate([np.zeros(0, t), *[g[c] for g in got]]) for c, t in enumerate((np.uint64, np.float64)))
    del got
    o = np.argsort(key)
    shared = docs.sparkSession.sparkContext.broadcast((key[o], p[o]))

    def make() -> Callable:
        chances = Chances(*shared.value)
        return lambda batch: figures(ts.as_bytes(batch.column(0)), batch.column(1).to_numpy(), chances)

    return arrow_pass(docs, {"text": F.col("text"), "lang_id": lang_id()}, ["doc_id", "lang"], make, OUT).select("doc_id", "lang", "_out.*")


def score_by_packs(docs: DataFrame, model: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """docs (doc_id, lang, text) scored against a model of any size, pack by pack; a text longer than a pack has one of its own."""
    short_batches(docs.sparkSession)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            off = ts.as_bytes(batch.column(batch.num_columns - 1)).offsets
            pack = first + (done + off[:-1]) // pack_bytes
            done += int(off[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pack, pa.int64())], names=[*batch.schema.names, "pack"])

    src = docs.select("doc_id", "lang", lang_id().alias("lang_id"), "text")
    texts = stored(src.mapInArrow(dealt, T.StructType([*src.schema.fields, T.StructField("pack", T.LongType())])), "packs")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pack, lang = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            b = ts.as_bytes(batch.column(2))
            for i, j in ts.slices(b):
                pairs, inv = np.unique(np.stack([pack[i:j], lang[i:j]]), axis=1, return_inverse=True)
                p = ts.part(b, i, j)
                k = np.unique((np.repeat(inv.reshape(-1).astype(np.uint64), np.diff(p.offsets)) << np.uint64(32)) | gram_ids(p))
                at = (k >> np.uint64(32)).astype(np.int64)
                cols = [pairs[0][at], pairs[1][at], (k & np.uint64(0xFFFFFFFF)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["pack", "lang_id", "gram"])

    wanted = texts.select("pack", "lang_id", "text").mapInArrow(asked, "pack long, lang_id long, gram long").join(model, ["lang_id", "gram"]).select("pack", "lang_id", "gram", "p")
    out = T.StructType([*docs.select("doc_id", "lang").schema.fields, *OUT.fields])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        chances = Chances(*sorted_arrays(*[right.column(c).to_numpy() for c in ("lang_id", "gram", "p")]))
        got = figures(ts.as_bytes(left.column("text")), left.column("lang_id").to_numpy(), chances)
        return pa.table({"doc_id": left.column("doc_id"), "lang": left.column("lang"), **{k: pa.array(v) for k, v in got.items()}})

    return texts.groupBy("pack").cogroup(wanted.groupBy("pack")).applyInArrow(met, out)


def score(docs: DataFrame, model: DataFrame, most: int = BROADCAST_GRAMS) -> DataFrame:
    model = stored(model, "model")
    return score_by_broadcast(docs, model) if model.count() <= most else score_by_packs(docs, model)


def bands(scored: DataFrame) -> DataFrame:
    """Per language (never null here), of different texts that pass the base rules: median of log10 perplexity and median distance, from a histogram."""

    def middle(h: DataFrame, value: str, out: str) -> DataFrame:
        w = Window.partitionBy("lang").orderBy(value)
        c = h.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
        return c.where(F.col("upto") * 2 >= F.col("all")).groupBy("lang").agg(F.min(value).alias(out))

    texts = scored.where(~F.col("base_failed")).select("lang", "n_bytes", "log10_perplexity").distinct()
    h = texts.groupBy("lang", F.floor(F.col("log10_perplexity") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    mid = middle(h, "bin", "mid")
    off = h.join(mid, "lang").groupBy("lang", F.abs(F.col("bin") - F.col("mid")).alias("off")).agg(F.sum("n").alias("n"))
    far = middle(off, "off", "mad")
    return mid.join(far, "lang").select("lang", (F.col("mid") * BIN).alias("mid"), (F.col("mad") * BIN).alias("mad"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_failed, log10_perplexity, the band and kept of every document.

    A null or empty text has no words and fails the base rules. A null lang is the language ''; texts of any
    length are scored whole; other columns are not carried. Ties at a
    band's edge are kept. Every row gets its own result, repeated or not; an empty table gives no rows.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("lang"), "text")
    counts = stored(count_grams(texts), "grams")
    scored = stored(score(texts, probabilities(counts)), "perplexity")
    b = stored(bands(scored), "bands")
    if b.count() <= BROADCAST_LANGS:
        b = F.broadcast(b)
    half = F.greatest(F.lit(BAND_LEAST), F.col("mad") * BAND) * F.sqrt(F.greatest(F.lit(1.0), F.lit(BAND_CHARS) / F.greatest(F.col("n_bytes"), F.lit(1))))
    got = scored.join(b, "lang", "left").withColumn("lower", F.col("mid") - half).withColumn("upper", F.col("mid") + half)
    verdict = F.col("log10_perplexity").between(F.col("lower"), F.col("upper"))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "log10_perplexity", F.col("lower").alias("band_lower"), F.col("upper").alias("band_upper"),
        (~F.col("base_failed") & F.coalesce(verdict, F.lit(False))).alias("kept"),
    )
