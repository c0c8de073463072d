"""Removal of repeated passages: suffix arrays over shards of anchored segments.

A byte goes if a string of MATCH bytes that covers it also starts in a document with a smaller id. To bring equal
strings together without shuffling every suffix, each window of MATCH bytes is represented by its anchor: the leftmost
of its GRAM-byte strings with the smallest hash. Equal windows have equal anchors at equal places, so a segment (the
union of consecutive windows with one anchor) only has to meet the segments of the same anchor, and a shard is a set of
anchors. Segments overlap, windows do not: each lies in exactly one segment.

1. Exact copies: only the document with the smallest id of each text goes on; the others lose everything.
2. Segments travel as hashes. Equal segments of several documents are settled by the smallest id; a task settles those
   in its own texts first and sends one document's for each. Where an anchor has different segments with an equal
   neighbourhood to the left or right of the anchor (every common window has one), they are undecided.
3. The bytes of undecided segments are gathered in shards of whole anchors. A shard's suffix array is built by induced
   sorting; permuted common prefixes of at least MATCH tie windows together, and the smallest id of such a run decides.
4. Removed stretches are joined to the texts.

An anchor found in very many segments of a sample is hot: its windows stand for themselves (each an anchor and segment
of its own, in every text), so no task gets all segments of a frequent string. The sample decides only how segments are
dealt, not the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractloom.llm import textscan as ts
from tractloom.llm.runtime import arrow_pass, short_batches, stored
from tractloom.llm.suffix_array import common_prefixes, suffix_array

MATCH, GRAM = 50, 16
WINDOW = MATCH - GRAM + 1
#: Bytes on one side of the anchor that any window with it covers, on the left or on the right.
SIDE = WINDOW // 2
#: Bytes of text whose segments a task settles before it sends them; bytes of text whose segments make a part; bytes in one suffix array.
PACK_BYTES, PART_BYTES, ARRAY_BYTES = 16 << 20, 16 << 20, 1 << 20
#: Longer texts are read in pieces that overlap by MATCH - 1 bytes.
PIECE = 1 << 20
#: Bytes of text sampled for hot anchors, and segments of one anchor, over all texts, from which it is hot.
HOT_SAMPLE, HOT_SEGMENTS, HOT_SEEN = 64 << 20, 20_000, 8
_LOW = np.uint64((1 << 21) - 1)
#: What a segment carries: owner (row), id, place, length, anchor, identity, neighbourhoods left and right (0: none).
FIELDS = [("uid", np.int64), ("doc", np.int64), ("lo", np.uint32), ("size", np.uint8), ("key", np.uint32), ("same", np.uint64), ("left", np.uint16), ("right", np.uint16)]
SPAN_FIELDS = [("uid", np.int64), ("lo", np.uint32), ("hi", np.uint32)]
FOUND = "uid long, doc long, lo int, hi int, key long"


def pieces(b: ts.Bytes) -> tuple[ts.Bytes, np.ndarray, np.ndarray]:
    """Texts of at least MATCH bytes, the long ones cut into overlapping pieces; with the text and the place that each comes from."""
    size = np.diff(b.offsets)
    if (size >= MATCH).all() and (size <= PIECE).all():
        return b, np.arange(b.n), np.zeros(b.n, np.int64)
    doc, at, data = [], [], []
    for i in np.flatnonzero(size >= MATCH).tolist():
        for s in range(0, int(size[i]) - MATCH + 1, PIECE - MATCH + 1):
            doc.append(i)
            at.append(s)
            data.append(b.data[b.offsets[i] + s : min(b.offsets[i] + s + PIECE, b.offsets[i + 1])])
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data], dtype=np.int64)]) if data else np.zeros(1, np.int64)
    return ts.Bytes(np.concatenate(data) if data else np.zeros(0, np.uint8), offsets), np.array(doc, np.int64), np.array(at, np.int64)


def segments(b: ts.Bytes) -> dict[str, np.ndarray]:
    """Segments of some pieces: piece, lo (in the piece), size, key (64 bits), same, left, right; hashes of windows in a function of their own."""
    n = len(b.data)
    with np.errstate(over="ignore"):
        p, q = ts._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(ts._BYTE_CODE[b.data] * p[:n], out=sums[1:])

        def digest(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return ts.splitmix((sums[j] - sums[i]) * q[i] + (j - i).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

        m = n - GRAM + 1
        gram = ts.splitmix((sums[GRAM:] - sums[:m]) * q[:m])
    low = (gram & ~_LOW) | np.arange(m, dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - width)], low[WINDOW - width :])
    edge = np.zeros(n + 1, np.int32)
    edge[b.offsets[1:] - MATCH + 1] += 1
    edge[b.offsets[1:]] -= 1
    start = np.flatnonzero(np.cumsum(edge)[: n - MATCH + 1] == 0)
    anchor = (low[start] & _LOW).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new)
    anchor, lo = anchor[first], start[first]
    hi = start[np.append(first[1:], len(start)) - 1] + MATCH
    sides = []
    for i, j in ((anchor - SIDE, anchor), (anchor + GRAM, anchor + GRAM + SIDE)):
        inside = (i >= lo) & (j <= hi)
        tag = np.zeros(len(lo), np.uint16)
        tag[inside] = (digest(i[inside], j[inside]) >> np.uint64(49)).astype(np.uint16) + np.uint16(1)
        sides.append(tag)
    piece = np.searchsorted(b.offsets, lo, "right") - 1
    return {"piece": piece, "lo": lo, "size": (hi - lo).astype(np.uint8), "key": gram[anchor], "same": digest(lo, hi), "left": sides[0], "right": sides[1], "digest": digest}


def split_hot(s: dict, hot: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of hot anchors replaced by their windows, each with its own hash as anchor."""
    digest = s.pop("digest")
    if not len(hot):
        return s
    on = ts.sorted_lookup(hot, s["key"])[1]
    if not on.any():
        return s
    x = {k: v[on] for k, v in s.items()}
    times = x["size"].astype(np.int64) - MATCH + 1
    first = np.cumsum(times) - times
    lo = np.repeat(x["lo"] - first, times) + np.arange(times.sum())
    same = digest(lo, lo + MATCH)
    none = np.zeros(len(lo), np.uint16)
    more = {"piece": np.repeat(x["piece"], times), "lo": lo, "size": np.full(len(lo), MATCH, np.uint8), "key": ts.mix_seed(same, 7), "same": same, "left": none, "right": none}
    return {k: np.concatenate([s[k][~on], more[k]]) for k in s}


def all_segments(texts: pa.Array, hot: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Segments of the texts of a batch, some 1 MB at a time: row, lo in the text, and the rest."""
    b = ts.as_bytes(texts)
    for i, j in ts.slices(b):
        x, doc, at = pieces(ts.part(b, i, j))
        for u, v in ts.slices(x):
            s = split_hot(segments(ts.part(x, u, v)), hot)
            k = s.pop("piece")
            yield s | {"row": doc[u + k] + i, "lo": s["lo"] - (x.offsets[u + k] - x.offsets[u]) + at[u + k]}


def merged(uid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of each owner; touching ones become one."""
    if not len(uid):
        return uid, lo, hi
    order = np.lexsort((lo, uid))
    uid, lo, hi = uid[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    owner = np.concatenate([[0], np.cumsum(uid[1:] != uid[:-1])])
    base = owner * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(base + hi)
    new = np.ones(len(uid), bool)
    new[1:] = base[1:] + lo[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(uid)) - 1
    return uid[first], lo[first], reach[last] - base[last]


def group_min(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest value among the rows with the same key, for each row."""
    order = np.argsort(key, kind="stable")
    k, v = key[order], value[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(k)))
    out = np.empty((2, len(k)), value.dtype)
    for r, f in enumerate((np.minimum, np.maximum)):
        out[r, order] = np.repeat(f.reduceat(v, first), size) if len(first) else v
    return out[0], out[1]


def planes(fields: list, x: dict[str, np.ndarray], rows: np.ndarray) -> bytes:
    """Columns byte by byte, so that high bytes, mostly equal, compress to little."""
    return b"".join(np.ascontiguousarray(x[k][rows].astype(t)).view(np.uint8).reshape(len(rows), -1).T.tobytes() for k, t in fields)


def from_planes(fields: list, data: bytes) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in fields)
    n, at, out = len(data) // width, 0, {}
    for k, t in fields:
        w = np.dtype(t).itemsize
        out[k] = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T).view(t).reshape(n)
        at += n * w
    return out


def sent(texts: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """(part, spans, data): the segments of texts (uid, doc_id, text), packed for the parts of their anchors, and stretches settled within a task."""

    def flush(got: list[dict]) -> Iterator[pa.RecordBatch]:
        x = {k: np.concatenate([g[k] for g in got]) for k in got[0]}
        least, _ = group_min(x["same"], x["doc"])
        late = x["doc"] > least
        uid, lo, hi = merged(x["uid"][late], x["lo"][late].astype(np.int64), x["lo"][late].astype(np.int64) + x["size"][late])
        part, spans, data = [], [], []
        for fields, rows, where, is_span in ((SPAN_FIELDS, {"uid": uid, "lo": lo, "hi": hi}, uid.astype(np.uint64), True), (FIELDS, {k: v[~late] for k, v in x.items()}, x["part"][~late], False)):
            where = (where % np.uint64(parts)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            on, first = np.unique(where[order], return_index=True)
            for k, r in zip(on.tolist(), np.split(order, first[1:]), strict=True) if len(on) else ():
                part.append(k)
                spans.append(is_span)
                data.append(planes(fields, rows, r))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(spans, pa.bool_()), pa.array(data, pa.binary())], names=["part", "spans", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            uid, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s in all_segments(b.column(2), hot):
                row, key = s.pop("row"), s.pop("key")
                got.append(s | {"lo": s["lo"].astype(np.uint32), "uid": uid[row], "doc": doc[row], "part": key >> np.uint64(32), "key": key.astype(np.uint32)})
            size += b.column(2).nbytes
            if size >= PACK_BYTES and got:
                yield from flush(got)
                got, size = [], 0
        if got:
            yield from flush(got)

    short_batches(texts.sparkSession)
    return texts.select("uid", "doc_id", "text").mapInArrow(run, "part int, spans boolean, data binary")


def settled(t: pa.Table) -> pa.Table:
    """Of one part: stretches that are settled (key null), and undecided segments (key, doc)."""
    blobs = [(s, d) for s, d in zip(t.column("spans").to_pylist(), t.column("data").to_pylist(), strict=True)]
    done = [from_planes(SPAN_FIELDS, d) for s, d in blobs if s]
    some = [from_planes(FIELDS, d) for s, d in blobs if not s]
    out = [pa.table({"uid": d["uid"], "doc": pa.nulls(len(d["uid"]), pa.int64()), "lo": d["lo"].astype(np.int32), "hi": d["hi"].astype(np.int32), "key": pa.nulls(len(d["uid"]), pa.int64())}) for d in done]
    if some:
        x = {k: np.concatenate([s[k] for s in some]) for k, _ in FIELDS}
        least, _ = group_min(x["same"], x["doc"])
        late = x["doc"] > least
        uid, lo, hi = merged(x["uid"][late], x["lo"][late].astype(np.int64), x["lo"][late].astype(np.int64) + x["size"][late])
        out.append(pa.table({"uid": uid, "doc": pa.nulls(len(uid), pa.int64()), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "key": pa.nulls(len(uid), pa.int64())}))
        x = {k: v[~late] for k, v in x.items()}
        open_ = np.zeros(len(x["uid"]), bool)
        for side in ("left", "right"):
            on = np.flatnonzero(x[side] > 0)
            least, most = group_min((x["key"][on].astype(np.uint64) << np.uint64(16)) | x[side][on], x["doc"][on])
            open_[on[least < most]] = True
        x = {k: v[open_] for k, v in x.items()}
        part = int(t.column("part")[0].as_py())
        out.append(pa.table({"uid": x["uid"], "doc": x["doc"], "lo": x["lo"].astype(np.int32), "hi": x["lo"].astype(np.int32) + x["size"], "key": (np.int64(part) << 32) | x["key"].astype(np.int64)}))
    empty = pa.table({k: pa.array([], pa.int32() if k in ("lo", "hi") else pa.int64()) for k in ("uid", "doc", "lo", "hi", "key")})
    return pa.concat_tables([empty, *out])


def decided(t: pa.Table) -> pa.Table:
    """Of one shard (key, uid, doc, lo, data): stretches covered by windows that start in a document with a smaller id."""
    out = []
    key = t.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    t, key = t.take(pa.array(order)), key[order]
    data = t.column("data").combine_chunks()
    data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
    raw = ts.as_bytes(data.cast(pa.large_binary()).view(pa.large_string()))
    uid, doc, lo = (t.column(c).to_numpy() for c in ("uid", "doc", "lo"))
    # Anchors stay whole: an array ends where the next anchor would go over its bytes.
    bounds = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(raw.offsets[bounds], raw.offsets[bounds[i]] + ARRAY_BYTES, "right")) - 1)
        a, b = int(bounds[i]), int(bounds[j])
        out.append(repeated(ts.part(raw, a, b), uid[a:b], doc[a:b], lo[a:b]))
        i = j
    u, s, e = (np.concatenate([o[c] for o in out]) for c in range(3)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"uid": u, "lo": s.astype(np.int32), "hi": e.astype(np.int32)})


def repeated(b: ts.Bytes, uid: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of segments b whose windows also start in a segment of a smaller id, by one suffix array over all of them."""
    size = np.diff(b.offsets)
    owner = np.repeat(np.arange(b.n), size + 1)
    first = b.offsets[:-1] + np.arange(b.n)
    text = np.ones(len(owner) + 1, np.int64)  # 1 ends a segment, 0 ends the text
    inside = np.ones(len(owner), bool)
    inside[first + size] = False
    text[:-1][inside] = b.data.astype(np.int64) + 2
    text[-1] = 0
    place = np.arange(len(owner)) - first[owner]
    whole = place + MATCH <= size[owner]
    sa = suffix_array(text)
    prefix = common_prefixes(text, sa, MATCH)
    sa = sa[1:]
    run = np.cumsum(prefix[sa] < MATCH)
    good = whole[sa]
    sa, run = sa[good], run[good]
    id_ = doc[owner[sa]]
    least, _ = group_min(run, id_)
    hit = sa[id_ > least]
    at = lo[owner[hit]] + place[hit]
    return merged(uid[owner[hit]], at, at + MATCH)


def hot_anchors(texts: DataFrame, total: int) -> np.ndarray:
    """Anchors with very many different segments, judged by a sample of texts. At most HOT_SAMPLE / HOT_SEEN bytes' worth of anchors can be hot."""
    share = min(1.0, HOT_SAMPLE / max(total, 1))
    least = max(HOT_SEEN, HOT_SEGMENTS * share)
    some = texts.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in all_segments(b.column(0), np.zeros(0, np.uint64)) if b.num_rows else ():
                yield pa.RecordBatch.from_arrays([pa.array(s["key"].view(np.int64)), pa.array(s["same"].view(np.int64))], names=["key", "same"])

    seen = some.select("text").mapInArrow(run, "key long, same long").distinct().groupBy("key").count().where(F.col("count") >= least)
    return np.sort(np.array([r.key for r in seen.select("key").collect()], np.int64).view(np.uint64))


def cut_out(texts: DataFrame, need: DataFrame, shards: int) -> DataFrame:
    """(shard, key, uid, doc, lo, data) of undecided segments."""
    lists = need.groupBy("uid").agg(F.collect_list(F.struct("key", "doc", "lo", "hi")).alias("want"))
    both = texts.select("uid", "text").join(lists, "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            b = ts.as_bytes(x.column(1))
            want = x.column(2)
            row = np.repeat(np.arange(x.num_rows), want.value_lengths().to_numpy())
            w = want.flatten()
            key, doc, lo, hi = (w.field(i).to_numpy() for i in range(4))
            size = (hi - lo).astype(np.int64)
            off = np.concatenate([[0], np.cumsum(size)])
            take = np.arange(off[-1]) + np.repeat(b.offsets[row] + lo - off[:-1], size)
            data = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(b.data[take]))])
            yield pa.RecordBatch.from_arrays([pa.array((ts.mix_seed(key.view(np.uint64), 3) % np.uint64(shards)).astype(np.int32)), w.field(0), x.column(0).take(pa.array(row)), w.field(1), w.field(2), data], names=["shard", "key", "uid", "doc", "lo", "data"])

    return both.select("uid", "text", "want").mapInArrow(run, "shard int, key long, uid long, doc long, lo int, data binary")


KEPT = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


def without(texts: DataFrame, spans: DataFrame, carry: list[str]) -> DataFrame:
    """texts (uid, text and what is carried) with n_removed, n_spans and the kept bytes."""
    lists = spans.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def make() -> Callable:
        def f(batch: pa.RecordBatch) -> dict:
            b = ts.as_bytes(batch.column(0))
            v = batch.column(1)
            n = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.n), n)
            w = v.flatten()
            row, lo, hi = merged(row, w.field(0).to_numpy(zero_copy_only=False), w.field(1).to_numpy(zero_copy_only=False))
            gone = np.zeros(len(b.data) + 1, np.int32)
            gone[b.offsets[row] + lo] += 1
            gone[b.offsets[row] + hi] -= 1
            keep = np.cumsum(gone)[:-1] == 0
            left = np.concatenate([[0], np.cumsum(keep)])
            off = left[b.offsets]
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(b.data[keep]))]).cast(pa.binary())
            return {"n_removed": np.diff(b.offsets) - np.diff(off), "n_spans": np.bincount(row, minlength=b.n), "kept": kept}

        return f

    return arrow_pass(texts.join(lists, "uid", "left"), {"text": F.col("text"), "spans": F.col("spans")}, carry, make, KEPT)


def removed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (uid, doc_id: the smallest with that text, text), and stretches to remove from them (uid, lo, hi)."""
    long = docs.where((F.octet_length("text") >= MATCH) & F.col("doc_id").isNotNull())
    texts = stored(long.groupBy("text").agg(F.min(F.col("doc_id").cast("long")).alias("doc_id")).withColumn("uid", F.monotonically_increasing_id()), "texts")
    spark = docs.sparkSession
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = stored(sent(texts, hot_anchors(texts, total), parts).groupBy("part").applyInArrow(settled, FOUND), "settled")
    need = found.where(F.col("key").isNotNull())
    size = need.agg(F.sum((F.col("hi") - F.col("lo")).cast("long"))).first()[0] or 0
    shards = max(1, -(-size // (2 * ARRAY_BYTES)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    more = stored(cut_out(texts, need, shards).groupBy("shard").applyInArrow(decided, "uid long, lo int, hi int"), "decided")
    return texts, found.where(F.col("key").isNull()).select("uid", "lo", "hi").union(more)


def repeats_removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text).

    A null text is empty; texts below MATCH bytes lose nothing. Texts of any length are read whole, in overlapping
    pieces. Rows that repeat an id are one document: they take nothing from one another. A row without id has no place
    in the order: it loses nothing and takes nothing from others. Copies of a text lose all but in the smallest id; if
    rows repeat id and text, each keeps it. An empty table gives no rows. Other columns are not read.
    """
    texts, spans = removed(docs)
    done = without(texts, spans, ["doc_id", "text"])
    out = F.col(f"`{done.columns[-1]}`")
    done = done.select("doc_id", F.sha2("text", 256).alias("of_kept"), out["n_removed"].alias("r"), out["n_spans"].alias("s"), F.sha2(out["kept"], 256).alias("k"))
    done = stored(done, "kept")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.sha2(text, 256).alias("of"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.join(done.withColumnRenamed("doc_id", "id"), (F.col("doc_id") == F.col("id")) & (F.col("of") == F.col("of_kept")), "left")
    copy = F.col("id").isNull() & F.col("doc_id").isNotNull() & (F.col("n_bytes") >= MATCH)
    return rows.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("r", F.lit(0))).cast("long").alias("n_removed"), F.when(copy, 1).otherwise(F.coalesce("s", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("k", "of")).alias("kept_sha256"),
    )
