"""The fitted form of harmonisation against numpy and against the one-step form."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tractloom.operators import harmonize as hz
from tractloom.operators.harmonizer import Harmonizer, HarmonizerModel


def frame(spark, ids, seed=0, batches="abc"):
    rng = np.random.default_rng(seed)
    rows = [(int(i), batches[i % len(batches)], f, float(rng.normal(f, 1 + i % len(batches)) + 3 * (i % len(batches)))) for i in ids for f in range(4)]
    return spark.createDataFrame(rows, "id long, batch string, feature int, value double")


def plain(fit, new, location):
    """The formulas on dicts: means, shrunk locations and scales of fit, applied to new."""
    fit, new = fit.toPandas(), new.toPandas()
    stand = fit.groupby("feature")["value"].mean()
    mean = fit.groupby(["feature", "batch"])["value"].mean()
    par = {}
    for b in sorted(set(fit.batch)):
        x = {f: (fit[(fit.batch == b) & (fit.feature == f)]["value"] - mean[f, b] + stand[f]).to_numpy() for f in stand.index}
        g, d = {f: v.mean() for f, v in x.items()}, {f: v.var(ddof=1) for f, v in x.items()}
        gb, t2, mu, v2 = np.mean(list(g.values())), np.var(list(g.values())), np.mean(list(d.values())), np.var(list(d.values()))
        for f, v in x.items():
            k = t2 * len(v) / d[f]
            gs = (k * g[f] + gb) / (k + 1)
            r = mu * mu / v2
            par[f, b] = gs, (mu * (r + 1) + ((v - gs) ** 2).sum() / 2) / (r + 2 + len(v) / 2 - 1)
    own = new.groupby(["feature", "batch"])["value"].mean()
    out = {}
    for r in new.itertuples():
        gs, ds = par[r.feature, r.batch]
        level = np.mean([par[r.feature, b][1] for b in sorted(set(fit.batch))])
        z = r.value - (own if location == "own" else mean)[r.feature, r.batch] + stand[r.feature]
        out[r.id, r.feature] = (z - gs) / max(np.sqrt(ds / level), 1e-8) + stand[r.feature]
    return out


@pytest.mark.parametrize("location", ["own", "fitted"])
def test_fit_save_load_and_apply(spark, tmp_path, location):
    fit, new = frame(spark, range(60), 1), frame(spark, range(60, 97), 2)
    Harmonizer(location=location).fit(fit).write().overwrite().save(str(tmp_path / "m"))
    model = HarmonizerModel.load(str(tmp_path / "m"))
    assert model.getOrDefault("location") == location
    got = {(r.id, r.feature): r.value for r in model.transform(new.withColumn("n", F.lit("x"))).collect()}
    assert got == pytest.approx(plain(fit, new, location))


def test_own_rows_give_the_one_step_form(spark):
    fit = frame(spark, range(50))
    for location in ("own", "fitted"):
        for choice in ({}, {"meanOnly": True}, {"shrink": False}):
            got = {(r.id, r.feature): r.value for r in Harmonizer(location=location, **choice).fit(fit).transform(fit).collect()}
            want = hz.combat(fit, choice.get("meanOnly", False), choice.get("shrink", True))
            assert got == pytest.approx({(r.id, r.feature): r.value for r in want.collect()})


def test_strangers_are_refused_and_odd_rows_pass(spark):
    fit = frame(spark, range(30)).union(spark.createDataFrame([(90 + k, None, f, float(k * f)) for k in range(4) for f in range(4)], "id long, batch string, feature int, value double"))
    model = Harmonizer().fit(fit)
    for bad in (frame(spark, range(5), batches="az"), frame(spark, range(3)).withColumn("feature", F.lit(99))):
        with pytest.raises(Exception, match="not in the fit"):
            model.transform(bad).collect()
    odd = spark.createDataFrame([(1, "a", 0, None), (2, None, 1, 3.0)], "id long, batch string, feature int, value double")
    got = {r.id: r.value for r in model.transform(odd).collect()}
    assert got[1] is None and got[2] is not None
    assert model.transform(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Harmonizer(location="elsewhere")


def test_in_a_pipeline(spark, tmp_path):
    fit = frame(spark, range(30))
    whole = Pipeline(stages=[Harmonizer(meanOnly=True)]).fit(fit)
    whole.save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    a, b = ({(r.id, r.feature): r.value for r in m.transform(fit).collect()} for m in (whole, again))
    assert a == pytest.approx(b)
