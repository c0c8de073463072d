"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document's set is its distinct three-word shingles. Equal sets are one class from the start, by a 128-bit sum of
the set, and only a class's first document goes on. The sketch has T coordinates. In each of T rounds every shingle
is hashed into one coordinate; from round T on, round T + i sends all shingles into coordinate i, so none stays
empty; an earlier round always wins over a later one. Documents meet where all coordinates of a band agree.

At the similarity asked for (0.85) two documents miss each other in every band with probability below 1e-6. Links
are confirmed on full sets. A bucket first links its members to its first document (never to each other, so that a
group of n copies costs n links). After the components of these links are known, members of the same bucket that
lie in different components are compared block by block, by sketch and then on full sets, and the links that join
components are added. So no link between components is lost to a bucket's size, and no cap is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractloom.llm import textscan as ts
from tractloom.llm import textstats as st
from tractloom.llm.components import components
from tractloom.llm.runtime import arrow_pass, given_back, stored

SHINGLE = 3
BANDS, ROWS = 24, 5
T_SKETCH = BANDS * ROWS
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 85
#: Agreeing coordinates (of T_SKETCH, each cut to 8 bits) below which a pair is no candidate: 5.6 standard deviations under the mean at 0.85.
LEAST_AGREE = 80
#: Members of a bucket that are compared in one task.
BLOCK = 2000
BLOCK_SHINGLES = 1_000_000
#: Ids that may be broadcast to pick documents (8 bytes each); beyond that the pick is a shuffled join.
BROADCAST_IDS = 2_000_000


def shingle_sets(b: ts.Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hashes, their text, and their number by text. Fewer words than a shingle make one shingle of all."""
    w = ts.words(b, ts.SPACE_WORDS)
    n = np.diff(w.first)
    h = ts.window_hash(w.hash, SHINGLE)
    ok = ts.inside(w, SHINGLE)
    parts_h, parts_d = [h[ok]], [w.doc[: len(h)][ok]]
    for k in range(1, SHINGLE):
        d = np.flatnonzero(n == k)
        x = ts.window_hash(w.hash, k)[w.first[d]] if len(d) else np.zeros(0, np.uint64)
        parts_h.append(ts.mix_seed(x, 100 + k))
        parts_d.append(d)
    h, doc = np.concatenate(parts_h), np.concatenate(parts_d)
    key = st.doc_keys(h, doc)
    rep = np.flatnonzero(st.repeated(key))
    if len(rep):
        _, one = np.unique(key[rep], return_index=True)
        keep = np.ones(len(h), bool)
        keep[rep] = False
        keep[rep[one]] = True
        h, doc = h[keep], doc[keep]
    order = np.argsort(doc, kind="stable")
    return h[order], doc[order], np.bincount(doc, minlength=b.n)


def sketches(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs x T_SKETCH; the round is in the top byte, so that earlier rounds win. Rows of empty sets stay at the maximum."""
    t = T_SKETCH
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    s = np.full(n_docs * t, top)
    base = doc * t
    for i in range(2 * t):
        if not len(h):
            break
        v = ts.mix_seed(h, i)
        place = base + ((v >> np.uint64(32)) % np.uint64(t)).astype(np.int64) if i < t else base + (i - t)
        np.minimum.at(s, place, (np.uint64(i) << np.uint64(56)) | (v >> np.uint64(8)))
        if i % 4 == 3 or i == 0 or i >= t:
            open_ = (s.reshape(n_docs, t) == top).any(1)
            on = open_[doc]
            if not on.all():
                h, doc, base = h[on], doc[on], base[on]
    return s.reshape(n_docs, t)


OUT = T.StructType([T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])


def describe(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Set size, set identity, band keys and cut sketch of each text."""

    def make() -> Callable:
        def f(batch: pa.RecordBatch) -> dict:
            b = ts.as_bytes(batch.column(0))
            got: dict[str, list] = {x.name: [] for x in OUT.fields}
            for i, j in ts.slices(b, (2 << 20) - 2):
                h, doc, n = shingle_sets(ts.part(b, i, j))
                first = np.concatenate([[0], np.cumsum(n)])
                with np.errstate(over="ignore"):
                    for name, seed in (("k1", 1), ("k2", 2)):
                        c = np.zeros(len(h) + 1, np.uint64)
                        np.cumsum(ts.mix_seed(h, seed), out=c[1:])
                        got[name].append((c[first[1:]] - c[first[:-1]]).view(np.int64))
                    s = sketches(h, doc, j - i)
                    x = s.reshape(j - i, BANDS, ROWS)
                    key = np.full((j - i, BANDS), np.uint64(0)) + np.arange(BANDS, dtype=np.uint64)
                    for r in range(ROWS):
                        key = ts.splitmix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, r])
                got["n"].append(n)
                got["bands"].append(key.view(np.int64).ravel())
                got["sketch"] += [r.tobytes() for r in (ts.splitmix(s) >> np.uint64(56)).astype(np.uint8)]
            bands = np.concatenate(got["bands"])
            return {
                **{k: np.concatenate(got[k]) for k in ("n", "k1", "k2")},
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS), pa.int32()), pa.array(bands)),
                "sketch": pa.array(got["sketch"], pa.binary()),
            }

        return f

    return arrow_pass(docs, {"text": F.col("text")}, carry, make, OUT)


def full_sets(docs: DataFrame) -> DataFrame:
    """(id, set) of documents."""

    def make() -> Callable:
        def f(batch: pa.RecordBatch) -> dict:
            b = ts.as_bytes(batch.column(0))
            hs, ns = [], []
            for i, j in ts.slices(b, (2 << 20) - 2):
                h, _, n = shingle_sets(ts.part(b, i, j))
                hs.append(h.view(np.int64))
                ns.append(n)
            off = np.concatenate([[0], np.cumsum(np.concatenate(ns))])
            return {"set": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(hs)))}

        return f

    out = T.StructType([T.StructField("set", T.ArrayType(T.LongType()))])
    return arrow_pass(docs, {"text": F.col("text")}, ["id"], make, out).select("id", "_out.set")


def agreeing(pairs: DataFrame) -> DataFrame:
    """Of (a, b, sa, sb), the pairs whose sketches agree in enough coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                s = [np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, T_SKETCH) for c in (2, 3)]
                ok = pa.array((s[0] == s[1]).sum(1) >= LEAST_AGREE)
                yield pa.RecordBatch.from_arrays([x.column(0).filter(ok), x.column(1).filter(ok)], names=["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(given_back(run), "a long, b long")


def picked_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the documents with these ids."""
    ids = stored(ids.distinct(), "ids")
    chosen = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return stored(full_sets(docs.join(chosen, "id", "left_semi")).dropDuplicates(["id"]), "sets")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    sets = picked_sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))))
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def links_between(t: pa.Table) -> pa.Table:
    """Links that join different components among some documents: a spanning set of them, verified on full sets.

    t: id, n, root, own (block), lo, hi, sketch, set. Where lo and hi differ, only pairs of different blocks are compared.
    """
    ids, n, root, own = (t.column(c).to_numpy() for c in ("id", "n", "root", "own"))
    across = len(ids) and t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
    s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, T_SKETCH)
    sets = t.column("set").combine_chunks()
    sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
    off, values = sets.offsets.to_numpy(), sets.values.to_numpy()
    _, comp = np.unique(root, return_inverse=True)
    a, b = [], []
    for i in range(len(ids) - 1):
        rest = np.arange(i + 1, len(ids))
        ok = (comp[rest] != comp[i]) & (100 * np.minimum(n[rest], n[i]) >= PERCENT * np.maximum(n[rest], n[i]))
        if across:
            ok &= own[rest] != own[i]
        rest = rest[ok]
        if not len(rest):
            continue
        rest = rest[(s[rest] == s[i]).sum(1) >= LEAST_AGREE]
        if not len(rest):
            continue
        mine = np.sort(values[off[i] : off[i + 1]])
        size = off[rest + 1] - off[rest]
        first = np.cumsum(size) - size
        other = values[np.arange(size.sum()) + np.repeat(off[rest] - first, size)]
        both = np.add.reduceat(ts.sorted_lookup(mine, other)[1].astype(np.int64), first)
        for j in rest[100 * both >= PERCENT * (len(mine) + size - both)]:
            if comp[j] != comp[i]:
                a.append(ids[i])
                b.append(ids[j])
                comp[comp == comp[j]] = comp[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def compared(members: DataFrame) -> DataFrame:
    """Links between components of the same bucket. members: key, m (members), size (shingles) of the bucket, id, n, root, sketch, set.

    Large buckets are cut into blocks, and each pair of blocks is a task's work; blocks are bounded in rows and in shingles.
    """
    parts = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int")
    x = members.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = x.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return x.select("key", "lo", "hi", "own", "id", "n", "root", "sketch", "set").groupBy("key", "lo", "hi").applyInArrow(links_between, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    An empty or null text has an empty set and is linked with nothing. Rows that repeat an id are one document. A
    row without id is linked with nothing, has no component and is kept. Empty tables give no rows.
    """
    src = docs.select("doc_id", "text")
    seen = stored(describe(src, ["doc_id"]).select("doc_id", "_out.*"), "sketches")
    real = seen.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    reps = stored(real.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("id")), "classes")
    sketch = stored(real.dropDuplicates(["doc_id", "k1", "k2"]).join(reps.select(F.col("id").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"]).select(F.col("doc_id").alias("id"), "n", "bands", "sketch"), "representatives")
    rows = sketch.select("id", "n", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("center"), F.count(F.lit(1)).alias("m")).where("m > 1")
    full = stored(rows.join(buckets, "key").select("key", "m", "center", "id"), "buckets")
    of = sketch.select("id", "n", "sketch")

    def with_sketch(pairs: DataFrame) -> DataFrame:
        a = of.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        b = of.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        return pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))

    texts = src.where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "id")
    star = full.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(verified(stored(agreeing(with_sketch(star)), "pairs"), texts), "verified")
    roots = components(links)
    member = full.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "m", "id", F.coalesce("root", "id").alias("root"))
    # Buckets that hold more than one component; of those with the same members, one.
    member = stored(member.drop("m").join(of, "id"), "members")
    mixed = member.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"), F.bit_xor(F.xxhash64("id")).alias("who"))
    mixed = mixed.where("r0 <> r1").groupBy("m", "size", "who").agg(F.min("key").alias("key")).drop("who")
    rest = stored(member.join(mixed, "key"), "mixed")
    more = stored(compared(rest.join(picked_sets(texts, rest.select("id")), "id")), "verified")
    if more.take(1):
        roots = components(links.union(more))
    per_class = reps.join(roots.withColumnRenamed("node", "id"), "id", "left").select("k1", "k2", "n", F.coalesce("root", "id").alias("component_id"))
    # Rows of one id with different texts are one document: it reaches what any of its texts reaches.
    got = real.select("doc_id", "n", "k1", "k2").join(per_class, ["k1", "k2", "n"])
    ids = got.groupBy("doc_id").agg(F.least(F.min("component_id"), F.col("doc_id")).alias("component_id"))
    out = seen.select("doc_id", F.col("n").alias("n_shingles")).join(ids, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
