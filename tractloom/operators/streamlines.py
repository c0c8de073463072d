"""Paths in space: measures, filters, resampling, smoothing, comparison, quality checks and grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from tractloom.functions import geometry as g
from tractloom.functions import rng
from tractloom.operators import nearness as ne
from tractloom.operators import pairs as pr
from tractloom.sources.files import each_path, points_array


def with_length(lines: DataFrame) -> DataFrame:
    return lines.withColumn("length", g.path_length(F.col("points")))


def length_filter(lines: DataFrame, least: float, most: float) -> DataFrame:
    return with_length(lines).where(F.col("length").between(least, most))


def curvature_filter(lines: DataFrame, most: float) -> DataFrame:
    """Paths whose sharpest angle is at most this; paths of fewer than three points stay."""
    return lines.withColumn("max_curvature", F.coalesce(F.array_max(g.curvature(F.col("points"))), F.lit(0.0))).where(F.col("max_curvature") <= most)


def bundle_stats(lines: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return with_length(lines).agg(
        n.alias("n"), z(F.avg("length")).alias("mean_length"), z(F.stddev_pop("length")).alias("std_length"), z(F.min("length")).alias("min_length"), z(F.max("length")).alias("max_length"),
        z(F.percentile("length", 0.5)).alias("median_length"), z(F.avg(F.size("points"))).alias("mean_points"), z(F.sum("length")).alias("total_length"),
    )


def arc_lengths(points: Column) -> Column:
    """Cumulative length at each point, beginning with 0."""
    return F.aggregate(
        F.transform(g.steps(points), lambda v: g.norm(v["x"], v["y"], v["z"])),
        F.array(F.lit(0.0)),
        lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)),
    )


def resample(lines: DataFrame, n: int | None = None, step: float | None = None) -> DataFrame:
    """Points evenly spaced along each path, linear in arc length. Exactly one of n and step is given; a step gives ceil(length / step) + 1 points, two at least."""
    if (n is None) == (step is None):
        raise ValueError("give either n or step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("points")
            out = points_array([resampled(p, n, step) for p in each_path(batch.column(at))])
            yield batch.set_column(at, batch.schema.field(at), out.cast(batch.schema.field(at).type))

    return lines.mapInArrow(run, lines.schema)


def resampled(p: np.ndarray, n: int | None = None, step: float | None = None) -> np.ndarray:
    if len(p) < 2:
        return p
    at = np.concatenate([[0.0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))])
    k = n if n is not None else max(2, int(np.ceil(at[-1] / step)) + 1)
    want = np.linspace(0, at[-1], k)
    return np.stack([np.interp(want, at, p[:, c]) for c in range(3)], axis=1)


def evenly(lines: DataFrame, n: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(also, sl_id, points): every whole path at n points, as distances need them; a path of one point repeats it."""
    x = resample(lines.select(*also, "sl_id", "points").where(F.size("points") > 0), n=n)
    return x.select(*also, "sl_id", F.when(F.size("points") == 1, F.array_repeat(F.col("points")[0], n)).otherwise(F.col("points")).alias("points"))


def smooth(points: DataFrame, sigma: float) -> DataFrame:
    """Gaussian smoothing of exploded points (sl_id, pos, x, y, z) along each path; ends are repeated. Weights reach int(4 sigma + 0.5) points."""
    radius = int(4 * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = weight / weight.sum()
    ends = Window.partitionBy("sl_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.partitionBy("sl_id").orderBy("pos")

    def moved(c: str) -> Column:
        total = F.lit(0.0)
        for k, w in zip(range(-radius, radius + 1), weight, strict=True):
            v = F.lag(c, -k).over(order) if k < 0 else F.lead(c, k).over(order)
            total = total + float(w) * F.coalesce(v, F.first(c).over(ends) if k < 0 else F.last(c).over(ends))
        return total

    return points.select("sl_id", "pos", *[moved(c).alias(c) for c in "xyz"])


#: Blocks that paths are dealt to: a path travels once for each.
PATH_BLOCKS = 8


def mdf_pairs(lines: DataFrame, most: float | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, mdf) of pairs of paths with equally many points, rounded if digits are given.

    Without a bound, all pairs are formed by blocks; of paths with different numbers of points, or with unknown ones, mdf is null. With a bound, only pairs leave a task that are nearer (near_pairs).
    """
    if most is None:
        whole = ~F.exists("points", lambda p: p["x"].isNull() | p["y"].isNull() | p["z"].isNull())
        return pr.all_pairs(lines.select("sl_id", "points", F.coalesce(whole, F.lit(False)).alias("whole")), "sl_id", _paths, lambda a, b: [_mdf_of_parts(a, b, digits)], ["mdf"], blocks=PATH_BLOCKS)
    near = near_pairs(lines, None, most)
    return near if digits is None else near.withColumn("mdf", F.round("mdf", digits))


def _paths(t: pa.Table) -> list[np.ndarray]:
    """Points as given and from the end (points beyond a path's last are 0), numbers of points; 0 where a point isn't known."""
    paths = [p for batch in t.to_batches() for p in each_path(batch.column("points"))]
    n = np.array([len(p) for p in paths])
    out = np.zeros((2, len(paths), n.max(initial=0), 3))
    for k, p in enumerate(paths):
        out[0, k, : len(p)], out[1, k, : len(p)] = p, p[::-1]
    return [*out, np.where(t["whole"].to_numpy(), n, 0)]


def _mdf_of_parts(a: list[np.ndarray], b: list[np.ndarray], digits: int | None) -> np.ma.MaskedArray:
    """As geometry.mdf, of all paths of two parts."""
    (u, _, n), (v, back, m) = a, b
    u, v, back = (np.ascontiguousarray(w.transpose(1, 2, 0)) for w in (u, v, back))
    total, x, y = np.zeros((2, len(n), len(m))), *np.empty((2, len(n), len(m)))
    for k in range(len(u)):
        for t, w in zip(total, (v, back), strict=True):
            np.subtract(u[k, 0][:, None], w[k, 0], out=x)
            x *= x
            for c in (1, 2):
                np.subtract(u[k, c][:, None], w[k, c], out=y)
                y *= y
                x += y
            t += np.sqrt(x, out=x)
    same = (n[:, None] == m[None]) & (n > 0)[:, None]
    return np.ma.array(pr.rounded(np.fmin(*total) / np.maximum(n, 1)[:, None], digits), mask=~same)


def _met(first: DataFrame, second: DataFrame | None, most: float) -> GroupedData:
    """Rows (sl_id, points, cx, cy, cz, side, own, i, j) of every two blocks: the numbers of all points in a row, and the grid cell of the middle point. Without a second set, blocks of the first meet in one order."""
    flat = F.concat(*[F.col("points")[c] for c in "xyz"])
    mean = lambda c: F.try_divide(F.aggregate(F.col("points")[c], F.lit(0.0), lambda s, v: s + v), F.size("points"))
    cells = [F.floor(mean(c) / most).alias("c" + c) for c in "xyz"]
    own = F.pmod(F.xxhash64("sl_id"), F.lit(PATH_BLOCKS)).cast("int").alias("own")
    put = lambda df, side: df.where(F.col("sl_id").isNotNull()).select("sl_id", flat.alias("points"), *cells, F.lit(side).alias("side"), own)
    rows = put(first, 0) if second is None else put(first, 0).unionByName(put(second, 1))
    to = [(0, k, min(k, o), max(k, o)) for k in range(PATH_BLOCKS) for o in range(PATH_BLOCKS)]
    if second is not None:
        to = [(side, (i, j)[side], i, j) for i in range(PATH_BLOCKS) for j in range(PATH_BLOCKS) for side in (0, 1)]
    dealt = rows.join(F.broadcast(first.sparkSession.createDataFrame(to, "side int, own int, i int, j int")), ["side", "own"])
    # Twice as many partitions as groups: few rows make much work, so parts mustn't be joined by their bytes.
    return dealt.repartition(2 * len({x[2:] for x in to}), "i", "j").groupBy("i", "j")


def near_pairs(first: DataFrame, second: DataFrame | None, most: float) -> DataFrame:
    """(a, b, mdf) of paths of two sets, or of one (second is None, a < b), that are nearer than a bound.

    Paths meet by blocks, so what is dealt grows with the paths, not with the pairs; in a task equal paths are one, and only tiles
    of paths are measured whose middle points can be near enough (nearness).
    """
    kinds = [df.schema["sl_id"].dataType.simpleString() for df in (first, second or first)]
    same = second is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        alike = same and t["i"][0] == t["j"][0]
        a, b = _sides(t, same)
        for k in a.keys() & b.keys():
            for x, y, d in ne.pairs(a[k], b[k], most, same, alike):
                yield pa.record_batch([pa.array(v, t.schema.field("sl_id").type) for v in (x, y)] + [pa.array(d)], names=["a", "b", "mdf"])

    return _met(first, second, most).applyInArrow(run, f"a {kinds[0]}, b {kinds[1]}, mdf double")


def _sides(t: pa.Table, same: bool) -> tuple[dict[int, ne.Paths], dict[int, ne.Paths]]:
    if not same:
        return tuple(ne.Paths.of(t.filter(pc.equal(t["side"], side))) for side in (0, 1))
    a = ne.Paths.of(t.filter(pc.equal(t["own"], t["i"])))
    return a, a if t["i"][0] == t["j"][0] else ne.Paths.of(t.filter(pc.equal(t["own"], t["j"])))


def any_near(first: DataFrame, second: DataFrame, most: float) -> DataFrame:
    """(sl_id, hit): whether a path of the first set has one of the second nearer than a bound. A path that has one is done with in its task."""
    kind = first.schema["sl_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        a, b = _sides(t, False)
        ids = t.filter(pc.equal(t["side"], 0))["sl_id"].combine_chunks()
        found = [a[k].ids[ne.reached(*ne.blocks(a[k], b[k]), most)[a[k].kind]] for k in a.keys() & b.keys()]
        hit = np.isin(ids.to_numpy(zero_copy_only=False), np.concatenate(found)) if found else np.zeros(len(ids), bool)
        yield pa.record_batch([ids, pa.array(hit)], names=["sl_id", "hit"])

    return _met(first, second, most).applyInArrow(run, f"sl_id {kind}, hit boolean").groupBy("sl_id").agg(F.bool_or("hit").alias("hit"))


def consistency(lines: DataFrame, run: str) -> DataFrame:
    """Variation of counts and lengths between runs; passes below 0.2 and 0.3."""
    per = with_length(lines).groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
    cv = lambda c: F.coalesce(F.try_divide(F.stddev_pop(c), F.avg(c)), F.lit(0.0))
    return per.agg(F.count(F.lit(1)).alias("runs"), F.avg("n").alias("mean_count"), cv("n").alias("cv_count"), F.avg("mean_length").alias("mean_length"), cv("mean_length").alias("cv_length")).withColumn("consistent", (F.col("cv_length") < 0.2) & (F.col("cv_count") < 0.3))


def reproducibility(first: DataFrame, second: DataFrame, near: float = 5.0, sample: int = 1000, seed: int = 42, n_points: int | None = None) -> DataFrame:
    """Share of a sample of the first set that has a path of the second within a distance; agreement of counts and lengths.

    With n_points, whole paths are given: distances are those of the paths resampled to so many points, lengths those of the whole paths.
    """
    # Points follow the ids that were chosen, so that no task holds the sample's points.
    some = first.join(first.select("sl_id").orderBy(rng.order_key(seed, "sl_id"), "sl_id").limit(sample), "sl_id", "left_semi")
    evened = lambda df: df if n_points is None else evenly(df, n_points)
    best = any_near(evened(some), evened(second), near).agg(F.avg(F.col("hit").cast("double")).alias("overlap"))
    stat = lambda df, k: with_length(df).agg(F.count(F.lit(1)).alias("n" + k), F.avg("length").alias("l" + k))
    got = best.crossJoin(stat(first, "1")).crossJoin(stat(second, "2"))
    dice = F.coalesce(F.try_divide(2.0 * F.least("n1", "n2"), F.col("n1") + F.col("n2")), F.lit(0.0))
    diff = F.coalesce(F.try_divide(F.abs(F.col("l1") - F.col("l2")), F.greatest("l1", "l2")), F.lit(0.0))
    return got.select(F.coalesce("overlap", F.lit(0.0)).alias("overlap"), dice.alias("dice"), diff.alias("length_difference")).withColumn("reproducible", (F.col("overlap") > 0.5) & (F.col("dice") > 0.7))


def plausibility(points: DataFrame, volume: DataFrame, mask: DataFrame, shape: tuple[int, int, int], least_fa: float = 0.2) -> DataFrame:
    """First violation of each path (outside, off_mask, low_fa), looked up at truncated voxels, and the rate of violations."""
    p = points.select("sl_id", "pos", *[g.vox_trunc(F.col(c)).alias(c) for c in "xyz"])
    inside = F.lit(True)
    for c, n in zip("xyz", shape, strict=True):
        inside = inside & F.col(c).between(0, n - 1)
    got = p.join(mask.select("x", "y", "z", F.lit(True).alias("m")), ["x", "y", "z"], "left").join(volume.select("x", "y", "z", "value"), ["x", "y", "z"], "left")
    kind = F.when(~inside, "outside").when(F.col("m").isNull(), "off_mask").when(F.coalesce("value", F.lit(0.0)) < least_fa, "low_fa")
    first = got.withColumn("kind", kind).groupBy("sl_id").agg(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("pos"))).alias("kind"))
    n = F.count(F.lit(1))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("outside", "off_mask", "low_fa")]
    return first.agg(n.alias("n"), *counts, F.coalesce(F.try_divide(F.count("kind").cast("double"), n), F.lit(0.0)).alias("rate")).withColumn("plausible", F.col("rate") < 0.1)


def coverage(points: DataFrame, mask: DataFrame) -> DataFrame:
    """Visits of each mask voxel."""
    v = points.select(*[g.vox_trunc(F.col(c)).alias(c) for c in "xyz"]).groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("visits"))
    return mask.join(v, ["x", "y", "z"], "left").select("x", "y", "z", F.coalesce("visits", F.lit(0)).alias("visits"))


def coverage_summary(visits: DataFrame, least: float = 0.3) -> DataFrame:
    got = visits.agg(F.count(F.lit(1)).alias("voxels"), F.count_if(F.col("visits") > 0).alias("covered"), F.avg(F.when(F.col("visits") > 0, F.col("visits"))).alias("mean_visits"), F.max("visits").alias("max_visits"))
    return got.withColumn("fraction", F.coalesce(F.try_divide(F.col("covered").cast("double"), F.col("voxels")), F.lit(0.0))).withColumn("sufficient", F.col("fraction") >= least)


def length_check(lines: DataFrame, least: float, most: float) -> DataFrame:
    s = with_length(lines).agg(F.avg("length").alias("mean_length"), F.stddev_pop("length").alias("std_length"))
    return s.withColumn("plausible", F.col("mean_length").between(least, most) & (F.col("std_length") < F.col("mean_length")))


def bounds(lines: DataFrame) -> DataFrame:
    p = lines.select(F.explode("points").alias("p")).select("p.*")
    return p.agg(F.count(F.lit(1)).alias("n_points"), *[f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max))])


def subsample(lines: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k paths chosen by a hash, the same ones in any partitioning."""
    return lines.orderBy(rng.order_key(seed, "sl_id"), "sl_id").limit(k)


def colours(lines: DataFrame) -> DataFrame:
    """Length of each path on a scale from 0 to 1, orientation and its colour."""
    x = with_length(lines)
    top = x.agg(F.min("length").alias("lo"), F.max("length").alias("hi"))
    o = g.orientation(F.col("points"))
    got = x.crossJoin(F.broadcast(top)).select("sl_id", "length", F.coalesce(F.try_divide(F.col("length") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)).alias("shade"), o.alias("o"))
    return got.select("sl_id", "length", "shade", *[F.col("o")[k].alias("d" + c) for k, c in enumerate("xyz")], *[F.abs(F.col("o")[k]).alias(c) for k, c in enumerate(("red", "green", "blue"))])


# Grouping of paths, one subject in one task.


def _mdf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of one path to many."""
    one = np.linalg.norm(b - a, axis=2).mean(1)
    return np.minimum(one, np.linalg.norm(b - a[::-1], axis=2).mean(1))


def quick_bundles(p: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy grouping in order: the nearest centroid within a distance takes a path, else it founds a group. Group of each path, and the member nearest to each centroid."""
    total, size, group = [], [], np.zeros(len(p), np.int64)
    centre = np.empty((64, *p.shape[1:]))
    for k, x in enumerate(p):
        if total:
            d = _mdf(x, centre[: len(total)])
            j = int(np.argmin(d))
            if d[j] < near:
                total[j] = total[j] + x
                size[j] += 1
                centre[j] = total[j] / size[j]
                group[k] = j
                continue
        if len(total) == len(centre):
            centre = np.concatenate([centre, np.empty_like(centre)])
        centre[len(total)] = x
        total.append(x.copy())
        size.append(1)
        group[k] = len(total) - 1
    medoid = np.zeros(len(total), np.int64)
    for j in range(len(total)):
        own = np.flatnonzero(group == j)
        medoid[j] = own[np.argmin(_mdf(total[j] / size[j], p[own]))]
    return group, medoid


def average_linkage(d: np.ndarray, near: float, size: np.ndarray | None = None) -> np.ndarray:
    """Groups of a distance matrix: the two groups nearest on average merge while that is at most near. A row may stand for several equal ones.

    Each row's nearest is kept, and looked for again only where a merge touched it.
    """
    d = d.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n) if size is None else size.astype(float), np.arange(n)
    at = d.argmin(1) if n else label
    least = d[np.arange(n), at]
    while n > 1:
        a = int(np.argmin(least))
        b = int(at[a])
        if not least[a] <= near:
            break
        d[a] = d[:, a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[b] = d[:, b] = np.inf
        d[a, a] = np.inf
        size[a] += size[b]
        label[label == b] = a
        least[b] = np.inf
        for k in {a, *np.flatnonzero((at == a) | (at == b)).tolist()} - {b}:
            at[k] = d[k].argmin()
            least[k] = d[k, at[k]]
        # a may have come nearer to others than what they knew, or as near with a smaller number.
        closer = (d[:, a] < least) | ((d[:, a] == least) & (a < at) & np.isfinite(least))
        at[closer], least[closer] = a, d[closer, a]
    return np.unique(label, return_inverse=True)[1]


def linked(p: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """average_linkage() of paths, and the member of each group that is nearest to all. Group and medoid of each path.

    Equal paths merge first, so they are one row with its number. Groups are found by links of at most near (nearness.Linkage);
    where those are many, by a matrix of each set of linked paths: groups never merge across a gap wider than near.
    """
    _, first, of = np.unique(p.reshape(len(p), -1) + 0.0, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    of, first = place[of.ravel()], first[order]
    q, many = p[first], np.bincount(of)
    label, medoid = np.arange(len(q)), np.arange(len(q))
    fine = np.flatnonzero(np.isfinite(q).all((1, 2)))
    for x, found in zip((label, medoid), _by_links(q[fine], many[fine], near), strict=True):
        x[fine] = fine[found]
    return np.unique(label, return_inverse=True)[1][of], first[medoid][of]


def _by_links(q: np.ndarray, many: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """The first path of each path's group, and its medoid."""
    if len(q) and (found := ne.linked(np.ascontiguousarray(q.transpose(0, 2, 1)), many, near)):
        return found
    part = np.arange(len(q))
    for k, x in enumerate(q):
        met = np.unique(part[k + np.flatnonzero(_mdf(x, q[k:]) <= near)])
        if len(met) > 1:
            part[np.isin(part, met)] = met[0]
    label, medoid = np.arange(len(q)), np.arange(len(q))
    for k in np.unique(part):
        own = np.flatnonzero(part == k)
        d = np.stack([_mdf(x, q[own]) for x in q[own]])
        group = average_linkage(d, near, many[own])
        for j in range(group.max() + 1):
            mine = np.flatnonzero(group == j)
            label[own[mine]] = own[mine[0]]
            medoid[own[mine]] = own[mine[np.argmin(d[np.ix_(mine, mine)] @ many[own[mine]])]]
    return label, medoid


def cluster(lines: DataFrame, key: str, near: float, n_points: int = 20, method: str = "quickbundles") -> DataFrame:
    """(key, sl_id, cluster, medoid). Paths are taken in the order of their ids."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("sl_id")
        p = np.stack([q for c in t.column("points").chunks for q in each_path(c)])
        if method == "quickbundles":
            group, medoid = quick_bundles(p, near)
            medoid = medoid[group]
        elif method == "hierarchical":
            group, medoid = linked(p, near)
        else:
            raise ValueError(f"unknown method {method}")
        return pa.table({key: t.column(key), "sl_id": t.column("sl_id"), "cluster": pa.array(group), "medoid": t.column("sl_id").take(medoid)})

    # Whole paths are resampled in passing; a subject's task holds n_points of each.
    kinds = dict(lines.dtypes)
    return evenly(lines, n_points, (key,)).groupBy(key).applyInArrow(run, f"`{key}` {kinds[key]}, sl_id {kinds['sl_id']}, cluster long, medoid {kinds['sl_id']}")


def roi_pass(points: DataFrame, roi: DataFrame) -> DataFrame:
    """Ids of the paths with any point in a voxel of the region. points (sl_id, x, y, z), voxels by truncation."""
    at = points.select("sl_id", *[g.vox_trunc(F.col(c)).alias(c) for c in "xyz"]).distinct()
    return at.join(roi.select("x", "y", "z").distinct(), ["x", "y", "z"], "left_semi").select("sl_id").distinct()


def verdict(plausible: DataFrame, covered: DataFrame, lengths: DataFrame, consistent: DataFrame) -> DataFrame:
    """The four checks of a set of paths (one row each), and whether all of them passed."""
    checks = plausible.select("plausible").crossJoin(covered.select("sufficient")).crossJoin(lengths.select(F.col("plausible").alias("usual"))).crossJoin(consistent.select("consistent"))
    every = [F.coalesce(c, F.lit(False)) for c in ("plausible", "sufficient", "usual", "consistent")]
    return checks.select(*[x.alias(n) for x, n in zip(every, ("plausible", "covered", "lengths", "consistent"), strict=True)], (every[0] & every[1] & every[2] & every[3]).alias("passed"))
