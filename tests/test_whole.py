"""Queries over whole tables, worked out by brute force."""

from __future__ import annotations

from hashlib import md5
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tractloom.functions.digests import Names
from tractloom.operators import graph as gr
from tractloom.operators import harmonize as hz
from tractloom.operators import stats as st
from tractloom.operators import streamlines as sl
from tractloom.plans import catalogue
from tractloom.plans import inputs as inp

SF = "/root/testdata/sf0.001"


def got(spark, name, sf=SF):
    return catalogue.queries()[name](spark, sf).toPandas()


def even(p, n=20):
    """Written again, one coordinate at a time."""
    if len(p) == 1:
        return np.repeat(p, n, 0)
    at = np.concatenate([[0], np.cumsum(np.sqrt(((p[1:] - p[:-1]) ** 2).sum(1)))])
    return np.array([[np.interp(at[-1] * k / (n - 1), at, p[:, c]) for c in range(3)] for k in range(n)])


def mdf(a, b):
    return min(np.sqrt(((a - q) ** 2).sum(1)).mean() for q in (b, b[::-1]))


@pytest.fixture(scope="module")
def lines(spark):
    return {r["sl_id"]: np.array([list(q) for q in r["points"]], float) for r in inp.streamlines(spark, SF).collect()}


def test_mdf_of_whole_paths(spark, lines):
    p = {k: even(v) for k, v in lines.items()}
    want = {(a, b): mdf(p[a], p[b]) for a, b in combinations(sorted(p), 2)}
    assert any(len(v) != 20 for v in lines.values())
    every = {(r.a, r.b): r.mdf for r in got(spark, "mdf_pairs").itertuples()}
    assert set(every) == set(want)
    assert every == pytest.approx(want, abs=1e-4)
    near = {(r.a, r.b): r.mdf for r in got(spark, "mdf_pairs_near").itertuples()}
    assert near == pytest.approx({k: v for k, v in want.items() if v < 60}, abs=1e-4)


def test_reproducibility_of_whole_paths(spark, lines):
    p = {k: even(v) for k, v in lines.items()}
    length = {k: np.sqrt((np.diff(v, axis=0) ** 2).sum(1)).sum() for k, v in lines.items()}
    one, two = [k for k in p if k % 2 == 0], [k for k in p if k % 2 == 1]
    overlap = np.mean([min(mdf(p[a], p[b]) for b in two) < 60 for a in one])
    l1, l2 = (np.mean([length[k] for k in x]) for x in (one, two))
    r = got(spark, "reproducibility").iloc[0]
    assert r.overlap == pytest.approx(overlap, abs=1e-6) and r.length_difference == pytest.approx(abs(l1 - l2) / max(l1, l2), abs=1e-6)
    assert r.dice == pytest.approx(2 * min(len(one), len(two)) / len(p), abs=1e-6)


def test_short_paths_keep_their_links(spark):
    s = spark.createDataFrame([(1, [(0.0, 0.0, 0.0)]), (2, [(3.0, 4.0, 0.0)] * 2), (3, [(0.0, 0.0, 0.0), (19.0, 0.0, 0.0)])], "sl_id long, points array<struct<x: double, y: double, z: double>>")
    m = {(r["a"], r["b"]): r["mdf"] for r in sl.mdf_pairs(sl.evenly(s, 20)).collect()}
    assert m[1, 2] == pytest.approx(5) and m[1, 3] == pytest.approx(9.5) and len(m) == 3


def test_statistics_take_all_features_and_labels(spark):
    x = inp.table(spark, SF, "embeddings").toPandas()
    width, labels = len(x["embedding"].iloc[0]), set(x["label"])
    assert len(got(spark, "combat_standardize")) == len(x) * width
    assert set(got(spark, "permutation_mean_diff_whole")["feature"]) == set(range(width))
    b = got(spark, "bootstrap_ci_whole")
    assert set(zip(b["label"], b["feature"], strict=True)) == {(k, f) for k in labels for f in range(width)}
    assert (b["low"] <= b["estimate"]).all() and (b["estimate"] <= b["high"]).all()
    assert set(got(spark, "corr_permutation_whole")["label"]) == labels
    p = got(spark, "nbs")["p"].iloc[0]
    assert p * 5000 == pytest.approx(round(p * 5000), abs=0.01)


def numbers(df, *by):
    return df.orderBy(*by).toPandas().astype(float).to_numpy()


def test_batches_equal_rows(spark):
    e = inp.features(spark, SF).where("feature < 3")
    two = e.where("label IN (0, 1)")
    s = two.select("id", F.col("label").alias("group")).distinct()
    v = two.select("id", "feature", "value")
    cols = ["feature", "observed", "p"]
    assert numbers(st.permutation_test_in_batches(v, s, 50, 7).select(cols), "feature") == pytest.approx(numbers(st.permutation_test(v, s, 50).select(cols), "feature"))
    v = e.select("label", "feature", "id", "value")
    cols = ["label", "feature", "estimate", "low", "high"]
    a, b = st.bootstrap_in_batches(v, "label", 40, batch=7), st.bootstrap(v, ["label", "feature"], 40)
    assert numbers(a.select(cols), "label", "feature") == pytest.approx(numbers(b.select(cols), "label", "feature"))


def test_correlation_by_label_equals_one_label_alone(spark):
    p = spark.createDataFrame([(k % 2, k, float(k * 7 % 11), float(k * k % 13)) for k in range(24)], "label int, id long, a double, b double")
    by = {r["label"]: (r["n"], r["r"], r["p"]) for r in st.correlation_permutation(p, 60, keys=("label",)).collect()}
    for k in (0, 1):
        alone = st.correlation_permutation(p.where(F.col("label") == k), 60).first()
        assert by[k] == pytest.approx((alone["n"], alone["r"], alone["p"]))


def test_every_row_is_gradient_vertex_or_seed(spark):
    n, voxels = inp.table(spark, SF, "embeddings").count(), inp.volume(spark, SF).count()
    g = got(spark, "gradient_quality").iloc[0]
    assert g["n_b0"] + g["n_dwi"] == n == len(got(spark, "bval_rounding"))
    assert len(got(spark, "vertex_curvature")) == n and len(got(spark, "face_areas")) == n - 2
    assert got(spark, "track_probabilistic")["seed_id"].nunique() == voxels
    assert got(spark, "track_relational_k_steps")["seed_id"].nunique() == voxels


def test_vulnerability_is_degree_times_betweenness(spark):
    e = inp.graph(spark, SF).toPandas()
    g = gr.Graph(e["i"].to_numpy(), e["j"].to_numpy(), e["weight"].to_numpy())
    want = sorted((g.betweenness() * g.adj.sum(1)).tolist(), reverse=True)[:15]
    assert got(spark, "vulnerability_top")["vulnerability"].tolist() == pytest.approx(want, abs=1e-6)


def test_resilience_is_what_is_left_after_removal(spark):
    e = inp.per_subject_edges(spark, SF)
    half = []
    for _, x in e.toPandas().groupby("subject"):
        g = gr.Graph(x["i"].to_numpy(), x["j"].to_numpy(), x["weight"].to_numpy())
        half.append((g.efficiency(), g.resilience(10)[0][5]))
    from tractloom.plans import services

    s = services._summary(spark, SF)
    found = [(r["global_efficiency"], r["resilience_half"]) for r in s.collect()]
    assert np.array(sorted(found)) == pytest.approx(np.array(sorted(half)))
    assert any(a != b for a, b in found)


def test_a_star_is_efficient_but_not_resilient(spark):
    from tractloom.plans import services

    star = spark.createDataFrame([("s", 0, k, 1.0) for k in range(1, 11)], "subject string, i int, j int, weight double")
    keep, services.inp.per_subject_edges = services.inp.per_subject_edges, lambda *_: star
    try:
        assert "low_resilience" in got(spark, "pathology_indicators")["indicator"].tolist()
        assert "low_efficiency" not in got(spark, "pathology_indicators")["indicator"].tolist()
    finally:
        services.inp.per_subject_edges = keep


def test_levels_beyond_the_bound_are_refused(spark):
    s = spark.range(1001).select("id", F.concat(F.lit("site"), "id").alias("site"), F.col("id").cast("double").alias("age"))
    with pytest.raises(ValueError, match="site"):
        hz.design(s, ["site", "age"])
    assert len(hz.design(s.where("id < 1000"), ["site", "age"]).first()["x"]) == 1 + 999 + 1
    assert len(hz.design(s.where("id < 9"), ["age"]).first()["x"]) == 9 and len(hz.design(s.where("id < 10"), ["age"]).first()["x"]) == 2


def _random_pairs(spark, n=70):
    g = np.random.default_rng(5)
    rows = [(int(k), int(k) % 3, float(x), None if k == 9 else float(y)) for k, (x, y) in enumerate(g.normal(size=(n, 2)))]
    return spark.createDataFrame([*rows, (1000, 7, 1.0, 2.0), (1001, 7, 2.0, 5.0)], "id long, g int, a double, b double")


@pytest.mark.parametrize("most", [1_000_000, 23, 1])
def test_correlations_in_batches_are_those_by_rows(spark, monkeypatch, most):
    monkeypatch.setattr(st, "GROUP_ROWS", most)
    p = _random_pairs(spark)
    by = lambda d: {r["g"]: (r["n"], round(r["r"], 9), round(r["p"], 9)) for r in d.collect()}
    assert by(st.correlation_permutation_in_batches(p, 40, keys=("g",))) == by(st.correlation_permutation(p, 40, keys=("g",)))


def _broadcast_explosions(df):
    """Broadcasts of rows that were exploded and not summed up since."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [lines[k + 1 :] for k, x in enumerate(lines) if "BroadcastExchange" in x]
    upto = [next((j for j, x in enumerate(b) if "Aggregate" in x or "Scan" in x), len(b)) for b in below]
    return [b for b, j in zip(below, upto, strict=True) if any("Generate" in x for x in b[:j])]


def test_permutations_are_not_broadcast(spark):
    assert not _broadcast_explosions(st.correlation_permutation(inp.table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b")), 100, keys=("label",)))
    assert not _broadcast_explosions(catalogue.queries()["corr_permutation_whole"](spark, SF))


def test_draws_of_effect_sizes_are_not_broadcast(spark):
    assert not _broadcast_explosions(catalogue.queries()["effect_size_ci"](spark, SF))


def test_effect_sizes_drawn_with_nulls(spark):
    p = _random_pairs(spark).where("id < 1000").select("id", F.lit(0).alias("feature"), (F.col("id") % 2).cast("int").alias("group"), (F.col("b") + 1e6).alias("value"))
    x = p.toPandas().sort_values("id")
    d = []
    for r in range(1, 61):
        part = []
        for k in (0, 1):
            v = x[x["group"] == k]["value"].to_numpy(float)
            u = np.array([int(md5(f"3:{r}:{j}".encode()).hexdigest()[:12], 16) / 16**12 for j in range(len(v))])
            w = v[(u * len(v)).astype(int)]
            part.append(w[~np.isnan(w)])
        a, b = part
        d.append((a.mean() - b.mean()) / np.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)))
    r = st.effect_size_interval(p, ["feature"], 60, seed=3).collect()[0]
    assert [r["low"], r["high"]] == pytest.approx(np.quantile(d, [0.025, 0.975]).tolist(), abs=1e-6)


def test_digests_are_those_of_md5():
    names = [b"", b"7", b"12345", "ä".encode() * 9, b"x" * 30] * 3
    for start in (b"42:1:", b"42:10000:", b"s" * 30):
        high, low = Names(names).after(start)
        assert [f"{h:016x}{v:016x}" for h, v in zip(high.tolist(), low.tolist(), strict=True)] == [md5(start + n).hexdigest() for n in names]


@pytest.mark.parametrize("most", [32_000_000, 20])
def test_bootstrap_in_batches_passes_nothing_through_the_driver(spark, monkeypatch, most):
    """Groups that are no bounded matrix (label 7 lacks a value, or most is small) go by rows; nothing is collected on the way."""
    monkeypatch.setattr(st, "MATRIX", most)
    monkeypatch.setattr("pyspark.sql.DataFrame.toPandas", None)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toPandas", None)
    g = np.random.default_rng(8)
    rows = [(k % 2 + 6, f, k, float(g.normal())) for k in range(14) for f in range(2) if (k, f) != (3, 1)]
    v = spark.createDataFrame(rows, "label int, feature int, id long, value double")
    by = lambda d: {(r["label"], r["feature"]): (r["estimate"], r["low"], r["high"]) for r in d.collect()}
    got, want = by(st.bootstrap_in_batches(v, "label", 40)), by(st.bootstrap(v, ["label", "feature"], 40))
    assert set(got) == set(want) and len(got) == 4
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)


def test_ranks_hold_where_p_is_never_the_same_twice(spark):
    """p from sums that arrive in another order each time: every use sees other last digits."""

    @F.udf("double")
    def shaken(p):
        from random import random

        return p * (1 + 1e-9 * random())

    p = spark.range(400).select("id", (F.col("id") / 400.0 + 0.001).alias("p")).withColumn("p", shaken.asNondeterministic()("p"))
    x = st.fdr(p, 0.2).toPandas()
    assert sorted(x["rank"]) == list(range(1, 401))


def test_rows_without_points_are_resampled_to_none(spark):
    s = spark.createDataFrame([(1, None), (2, [(0.0, 0.0, 0.0), (2.0, 0.0, 0.0)]), (3, [])], "sl_id long, points array<struct<x: double, y: double, z: double>>")
    got = {r["sl_id"]: [q["x"] for q in r["points"]] for r in sl.resample(s, n=3).collect()}
    assert got == {1: [], 2: [0.0, 1.0, 2.0], 3: []}


def test_groups_of_paths_are_resampled_before_they_meet(spark):
    assert "MapInArrow" in catalogue.queries()["quickbundles"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def _linkage_by_brute_force(d, near):
    d, size, label = d.copy(), np.ones(len(d)), np.arange(len(d))
    live = list(range(len(d)))
    while len(live) > 1:
        best, a, b = min((d[a, b], a, b) for a, b in combinations(live, 2))
        if best > near:
            break
        d[a] = d[:, a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        size[a] += size[b]
        live.remove(b)
        label[label == b] = a
    return np.unique(label, return_inverse=True)[1]


@pytest.mark.parametrize("seed", range(6))
def test_linkage_of_copies_and_parts(seed):
    g = np.random.default_rng(seed)
    p = g.normal(size=(40, 5, 3)) + g.integers(0, 4, (40, 1, 1)) * 3
    p = p[g.integers(0, 40, 90)]
    d = np.array([[mdf(a, b) for b in p] for a in p])
    near = [1.2, 2.0, 2.6][seed % 3]
    want = _linkage_by_brute_force(d, near)
    group, medoid = sl.linked(p, near)
    assert group.tolist() == want.tolist() == sl.average_linkage(d, near).tolist()
    for j in range(want.max() + 1):
        own = np.flatnonzero(want == j)
        s = d[np.ix_(own, own)].sum(1)
        assert s[own == medoid[own[0]]][0] == pytest.approx(s.min()) and len(set(medoid[own])) == 1


def test_linkage_holds_no_matrix_of_all_paths(monkeypatch):
    """4000 copies of 40 paths: a matrix of all has 16,000,000 numbers."""
    most = []
    kept = sl.average_linkage
    monkeypatch.setattr(sl, "average_linkage", lambda d, *x: most.append(d.size) or kept(d, *x))
    p = np.tile(np.random.default_rng(1).normal(size=(40, 5, 3)), (100, 1, 1))
    group, _ = sl.linked(p, 1.5)
    assert sum(most) <= 1600 and (group[:40] == group[40:80]).all()


def _near(spark):
    """Three copies of 30 paths, by their ids."""
    g = np.random.default_rng(2)
    p = g.normal(size=(30, 4, 3)) * 2
    rows = [(30 * c + k, [tuple(map(float, q)) for q in p[k]]) for c in range(3) for k in range(30)]
    return p, spark.createDataFrame(rows, "sl_id long, points array<struct<x: double, y: double, z: double>>")


def test_near_pairs_of_copies(spark):
    p, s = _near(spark)
    got = {(r["a"], r["b"]): r["mdf"] for r in sl.mdf_pairs(s, most=3.0).collect()}
    want = {(a, b): m for a, b in combinations(range(90), 2) if (m := mdf(p[a % 30], p[b % 30])) < 3.0}
    assert got == pytest.approx(want, abs=1e-9) and len(want) > 100


def test_points_of_paths_are_not_dealt_by_pairs(spark):
    """Points meet by cells; only ids and distances are dealt after that."""
    plan = sl.near_pairs(_near(spark)[1], _near(spark)[1], 3.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1


def test_reproducibility_forms_no_cross_product(spark):
    plan = catalogue.queries()["reproducibility"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join Cross" in x and "mdf" in x] and "cx" in plan
