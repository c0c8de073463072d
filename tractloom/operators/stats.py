"""Group statistics. Resampling is a pure function of a seed and ids, so results don't depend on partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractloom.functions import rng
from tractloom.functions.digests import Names, uniforms
from tractloom.functions.ordered import running
from tractloom.session import checkpoint_folder


def permuted_groups(subjects: DataFrame, n_perm: int, seed: int = 42) -> DataFrame:
    """(perm, id, group): groups dealt anew in each permutation, with their sizes kept. perm 0 is the observed one. subjects (id, group 0/1)."""
    n1 = F.sum(F.when(F.col("group") == 0, 1).otherwise(0)).over(Window.partitionBy("perm"))
    x = subjects.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm))))
    w = Window.partitionBy("perm").orderBy(rng.order_key(seed, "perm", "id"), "id")
    x = x.withColumn("n0", n1).withColumn("k", F.row_number().over(w))
    return x.select("perm", "id", F.when(F.col("perm") == 0, F.col("group")).otherwise(F.when(F.col("k") <= F.col("n0"), 0).otherwise(1)).alias("group"))


def mean_difference(values: DataFrame, groups: DataFrame) -> DataFrame:
    """(perm, feature, stat): mean of group 0 minus mean of group 1. values (id, feature, value)."""
    x = values.join(groups, "id")
    mean = lambda k: F.avg(F.when(F.col("group") == k, F.col("value")))
    return x.groupBy("perm", "feature").agg((mean(0) - mean(1)).alias("stat"))


def tail(null: Column, observed: Column, alternative: str) -> Column:
    return {"two-sided": F.abs(null) >= F.abs(observed), "greater": null >= observed, "less": null <= observed}[alternative]


def permutation_test(values: DataFrame, subjects: DataFrame, n_perm: int = 1000, alternative: str = "two-sided", seed: int = 42) -> DataFrame:
    """(feature, observed, p): share of permutations at least as extreme, without correction. One value per id is one feature."""
    s = mean_difference(values, permuted_groups(subjects, n_perm, seed))
    obs = s.where("perm = 0").select("feature", F.col("stat").alias("observed"))
    return s.where("perm > 0").join(obs, "feature").groupBy("feature", "observed").agg(F.avg(tail(F.col("stat"), F.col("observed"), alternative).cast("double")).alias("p"))


#: Numbers of a group that a task holds as a matrix; larger groups go the way by rows.
MATRIX = 32_000_000


def matrices(values: DataFrame, keys: list[str], shared: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows (keys, shared, id, names, v) with all features of an id, of the groups that are matrices of bounded size; and the keys of the other groups.

    A group is a matrix if all its ids have the same features, each once and not null. shared are columns that an id has once.
    """
    cell = F.struct("feature", F.col("value").cast("double").alias("value"))
    x = values.groupBy(*keys, *shared, "id").agg(F.sort_array(F.collect_list(cell)).alias("x"))
    x = x.select(*keys, *shared, "id", F.col("x.feature").alias("names"), F.col("x.value").alias("v"))
    whole = F.min((F.size(F.array_distinct("names")) == F.size("names")) & ~F.exists("v", F.isnull) & ~F.exists("names", F.isnull))
    sizes = x.groupBy(*keys).agg((whole & (F.min("names") == F.max("names"))).alias("_whole"), F.sum(F.size("v").cast("long")).alias("_n"))
    other = sizes.where(~F.col("_whole") | (F.col("_n") > MATRIX)).select(*[F.col(k).alias(f"_{k}") for k in keys], "_n")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return x.join(other, same if same else F.lit(True), "left_anti"), other


def matrix(t: pa.Table) -> np.ndarray:
    v = t.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def permutation_test_in_batches(values: DataFrame, subjects: DataFrame, n_perm: int = 10000, batch: int = 200, seed: int = 42) -> DataFrame:
    """permutation_test() of both sides with the same groups, as matrix products: each task does a share of the permutations, at most batch at once.

    Values that are no matrix of at most MATRIX numbers go the way by rows. Statistics that differ by rounding alone are equal.
    """
    kind, parts = dict(values.dtypes)["feature"], DEALT
    x, other = matrices(values.join(subjects, "id"), [], ("group",))
    if not other.isEmpty():
        return permutation_test(values, subjects, n_perm, seed=seed)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        m, on = matrix(t), (t.column("group").to_numpy() == 0).astype(float)
        names, n, n0 = Names([i.encode() for i in t.column("_name").to_pylist()]), len(m), int(on.sum())
        stat = lambda on: (on @ m) / n0 - ((1 - on) @ m) / (n - n0)
        with np.errstate(all="ignore"):
            seen = stat(on[None])[0]
            hits = np.zeros(m.shape[1], np.int64)
            perms = range(t.column("_chunk")[0].as_py() + 1, n_perm + 1, parts)
            step = max(1, min(batch, HELD // n))
            for k in range(0, len(perms), step):
                some = perms[k : k + step]
                on = np.zeros((len(some), n))
                for row, perm in enumerate(some):
                    on[row, shuffled(seed, perm, names)[:n0]] = 1
                hits += (np.abs(stat(on)) >= np.abs(seen) * (1 - 1e-12)).sum(0)
        return pa.table({"feature": t.column("names")[0].values, "observed": pa.array(seen), "hits": pa.array(hits)})

    x = x.withColumn("_name", F.col("id").cast("string"))
    got = dealt(x, [], parts).groupBy("_chunk").applyInArrow(run, f"feature {kind}, observed double, hits long")
    return got.groupBy("feature").agg(F.max("observed").alias("observed"), (F.sum("hits") / F.lit(float(n_perm))).alias("p"))


def fdr(p: DataFrame, alpha: float = 0.05, method: str = "bh", keys: tuple[str, ...] = ()) -> DataFrame:
    """p (id, p) with rank, adjusted p and rejection. Ranks are over all rows (or over those of a key); ties in p are ordered by id."""

    def spread(n: Column) -> Column:
        return F.lit(1.0) if method == "bh" else F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, k: s + F.lit(1.0) / k)

    raw = F.col("p") * F.col("n") / F.col("rank") * F.col("c")
    ok = F.col("p") <= F.col("rank") / F.col("n") * alpha / F.col("c")
    if keys:
        part = Window.partitionBy(*keys)
        x = p.withColumn("rank", F.row_number().over(part.orderBy("p", "id"))).withColumn("n", F.count(F.lit(1)).over(part)).withColumn("c", spread(F.col("n")))
        back = part.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn("low", F.min(raw).over(back)).withColumn("last", F.max(F.when(ok, F.col("rank"))).over(part))
    else:
        # p is often made of sums, whose last digits change as rows arrive: it is worked out once, so that ranks and buckets are of the same numbers.
        checkpoint_folder(p.sparkSession)
        p = p.checkpoint()
        total = p.agg(F.count(F.lit(1)).alias("n")).withColumn("c", spread(F.col("n")))
        x = running(p, "p", {"rank": F.lit(1)}, ties=("id",)).crossJoin(F.broadcast(total))
        last = x.agg(F.max(F.when(ok, F.col("rank"))).alias("last"))
        x = running(x.withColumn("raw", raw), "p", {"low": F.col("raw")}, ties=("id",), descending=True, kind="min").crossJoin(F.broadcast(last))
    return x.select(*keys, "id", "p", "rank", F.least(F.lit(1.0), F.col("low")).alias("adjusted"), (F.col("rank") <= F.coalesce("last", F.lit(0))).alias("rejected"))


def bonferroni(p: DataFrame, alpha: float = 0.05) -> DataFrame:
    n = p.agg(F.count(F.lit(1)).alias("n"))
    return p.crossJoin(F.broadcast(n)).select("id", "p", F.least(F.lit(1.0), F.col("p") * F.col("n")).alias("adjusted"), (F.col("p") * F.col("n") <= alpha).alias("rejected"))


def pooled_spread() -> Column:
    return F.sqrt(F.try_divide((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1"), F.col("n0") + F.col("n1") - 2))


def cohens_d() -> Column:
    """Of columns n0, n1 (rows), m0, m1 (means), v0, v1 (variances)."""
    return F.coalesce(F.try_divide(F.col("m0") - F.col("m1"), pooled_spread()), F.lit(0.0))


def effect_sizes(values: DataFrame, keys: list[str]) -> DataFrame:
    """Cohen's d (pooled), Hedges' g, Glass' delta (spread of group 1), t of equal variances. values (keys, group 0/1, value)."""
    of = lambda f, k: f(F.when(F.col("group") == k, F.col("value")))
    a = values.groupBy(*keys).agg(*[of(f, k).alias(f"{n}{k}") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)) for k in (0, 1)])
    df = F.col("n0") + F.col("n1") - 2
    pooled = pooled_spread()
    diff = F.col("m0") - F.col("m1")
    d = cohens_d()
    t = F.coalesce(F.try_divide(diff, pooled * F.sqrt(F.try_divide(F.lit(1.0), F.col("n0")) + F.try_divide(F.lit(1.0), F.col("n1")))), F.lit(0.0))
    return a.select(*keys, "n0", "n1", diff.alias("difference"), d.alias("cohens_d"), (d * (1 - 3.0 / (4 * df - 1))).alias("hedges_g"), F.coalesce(F.try_divide(diff, F.sqrt("v1")), F.lit(0.0)).alias("glass_delta"), t.alias("t"), df.alias("df"))


#: Replicates whose sums are columns of one row.
REPLICATES = 50


def picks(values: DataFrame, keys: list[str], n_boot: int, seed: int) -> DataFrame:
    """(n, k, chunk, times): how often the replicates of a chunk take place k of a group of n rows, for each size that a group has.

    Joins with it are told how to go: the planner takes exploded rows for as few as there were before, and would broadcast them.
    """
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select("n").distinct()
    places = sizes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    # Dealt anew before the replicates are drawn: a few sizes would be the work of a few tasks.
    slots = places.repartition("n", "k").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    picked = slots.select("n", F.floor(rng.uniform(seed, "r", "k") * F.col("n")).cast("long").alias("k"), F.floor((F.col("r") - 1) / REPLICATES).cast("int").alias("chunk"), ((F.col("r") - 1) % REPLICATES).alias("r"))
    return picked.groupBy("n", "k", "chunk").agg(F.array(*[F.count_if(F.col("r") == i) for i in range(REPLICATES)]).alias("times"))


def bootstrap(values: DataFrame, keys: list[str], n_boot: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean. Slot k of replicate r takes the row at floor(u(r, k) n) of the group's order by id. values (keys, id, value).

    Picks depend on replicate, slot and n alone, so they are drawn once for each size that a group has, as how often each
    place is taken by the replicates of a chunk. A value then adds to all means of a chunk at once, on the map side.
    """
    order = Window.partitionBy(*keys).orderBy("id")
    x = values.withColumn("k", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    times = picks(values, keys, n_boot, seed)
    sums = x.withColumn("k", F.col("k").cast("long")).join(times.hint("merge"), ["n", "k"]).groupBy(*keys, "n", "chunk").agg(F.array(*[F.sum(F.col("value") * F.col("times")[i]) for i in range(REPLICATES)]).alias("s"))
    mean = sums.select(*keys, "chunk", F.posexplode("s").alias("i", "s"), "n").where(F.col("chunk") * REPLICATES + F.col("i") < n_boot).select(*keys, (F.col("s") / F.col("n")).alias("mean"))
    low = (1 - level) / 2
    ci = mean.groupBy(*keys).agg(F.percentile("mean", low).alias("low"), F.percentile("mean", 1 - low).alias("high"))
    return values.groupBy(*keys).agg(F.avg("value").alias("estimate")).join(ci, keys)


def bootstrap_in_batches(values: DataFrame, key: str, n_boot: int = 10000, level: float = 0.95, batch: int = 200, seed: int = 42) -> DataFrame:
    """bootstrap() of many features of each group of a key with the same picks: a task does a share of a group's replicates as matrix products, at most batch at once.

    values (key, feature, id, value). Groups that are no matrix of at most MATRIX numbers go the way by rows.
    """
    kinds, parts = dict(values.dtypes), DEALT
    x, other = matrices(values, [key])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        m = matrix(t)
        n, places = len(m), Names([str(k).encode() for k in range(len(m))])
        reps, step, means = range(t.column("_chunk")[0].as_py() + 1, n_boot + 1, parts), max(1, min(batch, HELD // n)), []
        for k in range(0, len(reps), step):
            times = np.stack([np.bincount((uniforms(seed, r, places) * n).astype(np.int64), minlength=n) for r in reps[k : k + step]])
            means.append(times.astype(float) @ m / n)
        mean = np.concatenate(means) if means else np.zeros((0, m.shape[1]))
        group = pa.chunked_array([t.column(key).slice(0, 1).combine_chunks().take(np.zeros(mean.size, np.int64))])
        return pa.table({key: group, "feature": t.column("names")[0].values.take(np.tile(np.arange(m.shape[1]), len(mean))), "mean": pa.array(mean.ravel())})

    mean = dealt(x, [key], parts).groupBy(key, "_chunk").applyInArrow(run, f"`{key}` {kinds[key]}, feature {kinds['feature']}, mean double")
    low = (1 - level) / 2
    ci = mean.groupBy(key, "feature").agg(F.percentile("mean", low).alias("low"), F.percentile("mean", 1 - low).alias("high"))
    got = values.groupBy(key, "feature").agg(F.avg("value").alias("estimate")).join(ci, [key, "feature"])
    if other.isEmpty():
        return got
    rest = values.join(other, F.col(key).eqNullSafe(F.col(f"_{key}")), "left_semi")
    return got.unionByName(bootstrap(rest, [key, "feature"], n_boot, level, seed))


def average_ranks(df: DataFrame, value: str, out: str, keys: list[str]) -> DataFrame:
    """Ranks with ties averaged, by counts of equal values."""
    w = Window.partitionBy(*keys).orderBy(value)
    same = Window.partitionBy(*keys, value)
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2.0)


def correlation(pairs: DataFrame, keys: list[str], method: str = "pearson") -> DataFrame:
    """pairs (keys, a, b); 0 where a side has no variance."""
    if method == "spearman":
        pairs = average_ranks(average_ranks(pairs, "a", "ra", keys), "b", "rb", keys).select(*keys, F.col("ra").alias("a"), F.col("rb").alias("b"))
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.nanvl(F.corr("a", "b"), F.lit(0.0)), F.lit(0.0)).alias("r"))


def correlation_permutation(pairs: DataFrame, n_perm: int = 500, method: str = "pearson", seed: int = 42, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, r, p) of pairs (keys, id, a, b): b is dealt out anew to the ids of a key in each permutation."""
    a = Window.partitionBy(*keys, "perm").orderBy("id")
    b = Window.partitionBy(*keys, "perm").orderBy(rng.order_key(seed, "perm", "id"), "id")
    x = pairs.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm))))
    left = x.withColumn("k", F.row_number().over(a)).select(*keys, "perm", "k", "a")
    right = x.withColumn("k", F.when(F.col("perm") == 0, F.row_number().over(a)).otherwise(F.row_number().over(b))).select(*keys, "perm", "k", "b")
    # Exploded rows look small to the planner; neither side may be broadcast.
    c = correlation(left.join(right.hint("merge"), [*keys, "perm", "k"]), [*keys, "perm"], method)
    obs = c.where("perm = 0").select(*keys, F.col("r").alias("observed"), "n")
    null = c.where("perm > 0").select(*keys, "r")
    both = null.join(obs, list(keys)) if keys else null.crossJoin(F.broadcast(obs))
    return both.groupBy(*keys, "n", "observed").agg(F.avg((F.abs("r") >= F.abs("observed")).cast("double")).alias("p")).select(*keys, "n", F.col("observed").alias("r"), "p")


#: Rows of a group that a task holds at once; larger groups go the way by rows.
GROUP_ROWS = 1_000_000
#: Batches of replicates that a group is dealt to, and numbers that a batch holds besides the group.
DEALT, HELD = 16, 4_000_000


def dealt(rows: DataFrame, keys: list[str], parts: int = DEALT) -> DataFrame:
    """rows once for each batch of replicates (_chunk), each group's batch in one partition."""
    x = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return x.repartition(4 * parts, *keys, "_chunk")


def by_size(values: DataFrame, keys: list[str], most: int, rows: Column | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """The groups of at most so many rows, and those of more; None where there are none."""
    n = F.count(F.lit(1)) if rows is None else rows
    sizes = values.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(n.alias("_n"))
    big, small = sizes.where(F.col("_n") > most), sizes.where(F.col("_n") <= most)
    if big.isEmpty():
        return values, None
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    part = lambda s: None if s.isEmpty() else values.join(s, same if same else F.lit(True), "left_semi")
    return part(small), part(big)


def shuffled(seed: int, perm: int, names: Names) -> np.ndarray:
    """Places in the order of rng.order_key(seed, perm, name), ties in the order given."""
    high, low = names.after(f"{seed}:{perm}:".encode())
    order = np.argsort(high, kind="stable")
    return np.lexsort((low, high)) if (np.diff(high[order]) == 0).any() else order


def correlation_permutation_in_batches(pairs: DataFrame, n_perm: int = 10000, method: str = "pearson", seed: int = 42, keys: tuple[str, ...] = ()) -> DataFrame:
    """correlation_permutation() with the same orders: a group's pairs go to a few tasks, each of which does a batch of its permutations.

    A group of more than GROUP_ROWS pairs goes the way by rows. Correlations that differ by rounding alone are equal.
    """
    few, many = by_size(pairs, list(keys), GROUP_ROWS)
    rest = correlation_permutation(many, n_perm, method, seed, keys) if many is not None else None
    if few is None:
        return rest
    kinds, names, parts = dict(pairs.dtypes), list(keys), DEALT
    if method == "spearman":
        few = average_ranks(average_ranks(few, "a", "ra", names), "b", "rb", names).select(*names, "id", F.col("ra").alias("a"), F.col("rb").alias("b"))
    x = few.select(*names, "id", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("_name"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))

    def r(a: np.ndarray, b: np.ndarray) -> float:
        a, b = a - a.mean(), b - b.mean()
        d = np.sqrt((a @ a) * (b @ b))
        return float(a @ b / d) if d > 0 else 0.0

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("id", "ascending")], null_placement="at_start"))
        ids = Names([n.encode() for n in t.column("_name").to_pylist()])
        a, b = (t.column(c).to_numpy() for c in "ab")
        there = [~t.column(c).combine_chunks().is_null().to_numpy(zero_copy_only=False) for c in "ab"]
        whole = there[0].all() and there[1].all()

        def of(order: np.ndarray) -> float:
            if whole:
                return r(a, b[order])
            on = there[0] & there[1][order]
            return r(a[on], b[order][on]) if on.any() else 0.0

        with np.errstate(all="ignore"):
            seen = of(np.arange(t.num_rows))
            least = abs(seen) * (1 - 1e-12)
            first = t.column("_chunk")[0].as_py()
            hits = sum(abs(of(shuffled(seed, perm, ids))) >= least for perm in range(first + 1, n_perm + 1, parts))
        return pa.table({**{c: t.column(c).slice(0, 1) for c in names}, "n": pa.array([t.num_rows], pa.int64()), "r": pa.array([seen]), "hits": pa.array([int(hits)], pa.int64())})

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "n long, r double, hits long"])
    got = dealt(x, names, parts).groupBy(*names, "_chunk").applyInArrow(run, schema)
    got = got.groupBy(*names).agg(F.max("n").alias("n"), F.max("r").alias("r"), (F.sum("hits") / F.lit(float(n_perm))).alias("p"))
    return got if rest is None else got.unionByName(rest)


# Student's t distribution.


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by the modified Lentz continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    from math import lgamma

    lg = np.vectorize(lgamma)
    front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(np.maximum(y, 1e-300)) + q * np.log(np.maximum(1 - y, 1e-300))) / p
    tiny = 1e-30
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 200):
        for t in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + t / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
    got = np.where(y <= 0, 0.0, front * f)
    return np.where(flip, 1 - got, got)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def mass_univariate(values: DataFrame, correction: str = "fdr", alpha: float = 0.05) -> DataFrame:
    """Per feature: t, p, effect size, adjusted p. values (feature, group 0/1, value)."""

    @F.pandas_udf("double")
    def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided(t.to_numpy(), df.to_numpy()))

    e = effect_sizes(values, ["feature"]).select("feature", "t", "df", "cohens_d").withColumn("p", p_value("t", "df"))
    p = e.select(F.col("feature").alias("id"), "p")
    if correction == "none":
        return e.select("feature", "t", "cohens_d", "p", F.col("p").alias("adjusted"), (F.col("p") <= alpha).alias("rejected"))
    adj = fdr(p, alpha) if correction == "fdr" else bonferroni(p, alpha)
    return e.join(adj.select(F.col("id").alias("feature"), "adjusted", "rejected"), "feature").select("feature", "t", "cohens_d", "p", "adjusted", "rejected")


# Network-based statistic.


def edge_t(values: DataFrame, groups: DataFrame) -> DataFrame:
    """(perm, i, j, t) of equal variances per edge. values (id, i, j, value): absent edges must be given as zeros."""
    x = values.join(groups, "id").withColumnRenamed("group", "group")
    return effect_sizes(x, ["perm", "i", "j"]).select("perm", "i", "j", "t")


def largest_component(edges: DataFrame) -> DataFrame:
    """(perm, size): nodes of the largest component of each permutation's graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        a, b = at[: len(i)], at[len(i) :]
        label = np.arange(len(nodes))
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            new = new[new]
            if (new == label).all():
                break
            label = new
        return pd.DataFrame({"perm": [pdf["perm"].iloc[0]], "size": [int(np.bincount(label).max())]})

    return edges.groupBy("perm").applyInPandas(run, "perm int, size long")


def nbs(values: DataFrame, subjects: DataFrame, threshold: float, n_perm: int = 100, seed: int = 42) -> DataFrame:
    """(observed, p): nodes of the largest component of edges with |t| over a threshold (1 without such edges), and the share of permutations that reach it."""
    g = permuted_groups(subjects, n_perm, seed)
    kept = edge_t(values, g).where(F.abs("t") > threshold)
    perms = values.sparkSession.range(n_perm + 1).select(F.col("id").cast("int").alias("perm"))
    size = perms.join(largest_component(kept), "perm", "left").select("perm", F.coalesce("size", F.lit(1)).alias("size"))
    obs = size.where("perm = 0").select(F.col("size").alias("observed"))
    return size.where("perm > 0").crossJoin(F.broadcast(obs)).groupBy("observed").agg(F.avg((F.col("size") >= F.col("observed")).cast("double")).alias("p"))


def nbs_in_batches(wide: DataFrame, subjects: DataFrame, n_nodes: int, threshold: float, n_perm: int = 5000, batch: int = 200, seed: int = 42) -> DataFrame:
    """The same for many permutations: the subject-by-edge matrix is broadcast if it is below 64 MB, and each task does a batch of permutations as matrix products. wide (id, group, features)."""
    spark = wide.sparkSession
    x = wide.join(subjects, "id").orderBy("id")
    n, width = x.count(), len(x.first()["features"])
    if n * width * 8 > 64 << 20:
        raise ValueError("the matrix is too large to broadcast; use nbs()")
    rows = x.collect()
    data = spark.sparkContext.broadcast((np.array([r["features"] for r in rows]), np.array([r["group"] for r in rows])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, group = data.value
        i, j = np.triu_indices(n_nodes, 1)
        for pdf in batches:
            sizes = []
            for perm in pdf["perm"]:
                lab = group if perm == 0 else np.random.default_rng([seed, int(perm)]).permutation(group)
                a, b = m[lab == 0], m[lab == 1]
                v = ((len(a) - 1) * a.var(0, ddof=1) + (len(b) - 1) * b.var(0, ddof=1)) / (len(a) + len(b) - 2)
                se = np.sqrt(v * (1 / len(a) + 1 / len(b)))
                t = np.where(se > 0, (a.mean(0) - b.mean(0)) / np.where(se > 0, se, 1), 0)
                on = np.abs(t) > threshold
                label = np.arange(n_nodes)
                while on.any():
                    new = label.copy()
                    np.minimum.at(new, i[on], label[j[on]])
                    np.minimum.at(new, j[on], label[i[on]])
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                sizes.append(int(np.bincount(label).max()))
            yield pd.DataFrame({"perm": pdf["perm"], "size": sizes})

    perms = spark.range(0, n_perm + 1, 1, max(1, n_perm // batch)).select(F.col("id").cast("int").alias("perm"))
    return perms.mapInPandas(run, "perm int, size long")


def effect_size_interval(values: DataFrame, keys: list[str], n_boot: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Cohen's d with its percentile interval: both groups are drawn anew, each by its own order of ids. values (keys, group 0/1, id, value).

    As in bootstrap(), picks are drawn once for each size of a group; a value adds to the sums of a chunk's replicates at once.
    Sums are of what lies over the group's mean, so that squares lose no digits.
    """
    by = [*keys, "group"]
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    x = values.select(*by, "value", (F.row_number().over(w.orderBy("id")) - 1).cast("long").alias("k"), n.alias("n"), F.avg("value").over(w).alias("m")).withColumn("v", F.col("value") - F.col("m"))
    times = picks(values, by, n_boot, seed)
    there = F.col("v").isNotNull().cast("double")
    sums = x.join(times.hint("merge"), ["n", "k"]).groupBy(*by, "m", "chunk").agg(*[F.array(*[F.sum(c * F.col("times")[i]) for i in range(REPLICATES)]).alias(s) for s, c in (("s0", there), ("s1", F.col("v")), ("s2", F.col("v") * F.col("v")))])
    one = sums.select(*by, "m", "chunk", F.posexplode(F.arrays_zip("s0", "s1", "s2")).alias("i", "s")).where(F.col("chunk") * REPLICATES + F.col("i") < n_boot)
    n, s1, s2 = (F.col(f"s.s{k}") for k in range(3))
    one = one.select(*by, "chunk", "i", F.col("s.s0").alias("n"), (F.col("m") + F.try_divide(s1, n)).alias("mean"), F.greatest(F.try_divide(s2 - F.try_divide(s1 * s1, n), n - 1), F.lit(0.0)).alias("var"))
    of = lambda c, g: F.max(F.when(F.col("group") == g, F.col(c)))
    d = one.groupBy(*keys, "chunk", "i").agg(*[of(c, g).alias(f"{s}{g}") for c, s in (("n", "n"), ("mean", "m"), ("var", "v")) for g in (0, 1)])
    tail = (1 - level) / 2
    d = d.withColumn("d", cohens_d())
    ci = d.groupBy(*keys).agg(F.percentile("d", tail).alias("low"), F.percentile("d", 1 - tail).alias("high"))
    return effect_sizes(values, keys).select(*keys, "cohens_d").join(ci, keys)
