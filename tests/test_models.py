"""Grouped models, feature scores and paired tests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerfline.operators import models, training

G = np.random.default_rng(9)


@pytest.fixture(scope="module")
def rows(spark):
    x = G.normal(size=(240, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.05 * G.normal(size=240)
    data = [(f"g{i % 12}", float(y[i]), float(x[i, 0]), None if i % 50 == 7 else float(x[i, 1]), float(x[i, 2])) for i in range(240)]
    return spark.createDataFrame(data, "run string, y double, a double, b double, noise double").cache()


def test_folds_keep_groups_whole(rows):
    f = models.with_folds(rows, "run", 4)
    assert f.groupBy("run").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert sorted(r["count"] for r in f.groupBy("fold").count().collect()) == [60] * 4
    with pytest.raises(ValueError, match="folds"):
        models.with_folds(rows, "run", 13)


def test_candidates_of_a_grid():
    s = models.Spec("m", object, {}, {"p": [1, 2, 3], "q": [4, 5]})
    assert len(s.candidates()) == 6 and len(s.candidates(4)) == 4 and s.candidates()[0] == {"p": 1, "q": 4}


def test_nested_search_finds_the_smaller_penalty(rows):
    spec = models.Spec("ridge", models.LinearRegression, {}, {"regParam": [0.001, 50.0]})
    got = models.nested(rows, (spec,), ["a", "b", "noise"], "y", "run", outer=2, inner=2)
    assert [r.settings for r in got.collect()] == ["{'regParam': 0.001}"] * 2
    s = models.summary(got, 0.5, 0.1).first()
    assert s.mae_mean < 0.3 and s.goal_met and s.r2_mean > 0.9


def test_nested_ridges_come_from_sums(spark, rows, monkeypatch):
    """a fit and a scoring pass for each candidate and fold; now no model is fitted, and results are those of fitted ones."""
    spec, names = models.Spec("ridge", models.LinearRegression, {"elasticNetParam": 0.0}, {"regParam": [0.01, 1.0, 30.0]}), ["a", "b", "noise", "flat"]
    more = rows.withColumn("flat", F.lit(1.5)).withColumn("noise", F.when(F.col("a") < 1.2, F.col("noise") + 1e4).otherwise(float("nan"))).withColumn("y", F.when(F.col("a") < 2, F.col("y")))
    more = more.unionByName(more.limit(30).withColumn("run", F.lit(None).cast("string"))).cache()
    with monkeypatch.context() as m:
        m.setattr(models, "_ridge", lambda *_: False)
        want = models.nested(more, (spec,), names, "y", "run", outer=3, inner=2).collect()
    monkeypatch.setattr(models, "fit", None)
    got = models.nested(more, (spec,), names, "y", "run", outer=3, inner=2).collect()
    assert [(r.model, r.fold, r.settings) for r in got] == [(r.model, r.fold, r.settings) for r in want]
    for a, b in zip(got, want, strict=True):
        assert tuple(a)[3:] == pytest.approx(tuple(b)[3:], rel=1e-9)
    with pytest.raises(ValueError, match="folds"):
        models.nested(more, (spec,), names, "y", "run", outer=3, inner=9)


def test_prediction_needs_its_columns(rows):
    spec = models.SPECS["fast"][0]
    model, held = models.fit(rows, spec, {"regParam": 0.01}, ["a", "b"], "y")
    assert models.predict(rows, model, held).where("y_pred IS NULL").isEmpty()
    with pytest.raises(ValueError, match="b"):
        models.predict(rows.drop("b"), model, held)
    assert models.importance(model, ["a", "b"])["a"] > models.importance(model, ["a", "b"])["b"]
    with pytest.raises(ValueError, match="without values"):
        models.fit(rows.withColumn("b", F.lit(None).cast("double")), spec, {}, ["a", "b"], "y")


def test_consensus_and_sweep(rows):
    c = {r.feature: r.consensus for r in models.consensus(rows, ["a", "b", "noise"], "y").collect()}
    assert c["a"] == pytest.approx(1) and c["a"] > c["b"] > c["noise"]
    n, table = models.sweep(rows, ["a", "b", "noise"], "y", "run", [1, 2, 3], folds=2)
    assert n == 2 and table.count() == 6


def test_uncertainty_adds_the_validation_error(spark):
    r = models.uncertainty(spark.createDataFrame([(1.0, 3.0)], "p double, q double"), ["p", "q"], 0.5).first()
    assert (r.y_pred, r.sigma) == (2.0, pytest.approx(np.sqrt(1.25)))


def test_principal_components_equal_numpy(spark):
    x = G.normal(size=(60, 4)) * [3, 2, 1, 0.5]
    got = models.principal(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>"), "v").orderBy("i").collect()
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs([r.components for r in got]), np.abs(want), atol=1e-6)


def test_student_distribution_equals_its_integral():
    from math import lgamma

    for df in (1, 3, 10, 200):
        t = np.linspace(-60, 60, 1_200_001)
        p = np.exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / np.sqrt(df * np.pi) * (1 + t * t / df) ** (-(df + 1) / 2)
        for q in (-2.5, -0.3, 0.0, 1.0, 2.2):
            tail = 0.5 + np.sign(q) * np.trapezoid(p[(t >= min(0, q)) & (t <= max(0, q))], dx=t[1] - t[0])
            assert training.t_cdf(q, df) == pytest.approx(tail, abs=2e-4)


def test_paired_tests(spark):
    a, b = G.normal(size=80), G.normal(size=80) * 0.2
    d = np.round(a - b, 6)
    data = [("x", float(v), 0.0) for v in d] + [("same", 1.0 + 0.001 * (i % 3), 1.0) for i in range(30)]
    got = {r.g: r for r in training.paired_tests(spark.createDataFrame(data, "g string, a double, b double"), "a", "b", 0.01, "g").collect()}
    order = np.argsort(np.argsort(np.abs(d))) + 1
    assert got["x"].w == pytest.approx(min(order[d > 0].sum(), order[d < 0].sum()))
    assert 0 < got["x"].w_p <= 1 and 0 < got["x"].p < 1 and not got["x"].equivalent
    assert got["same"].equivalent and got["same"].tost_p2 < 0.001


def test_bootstrap_interval_covers_the_mean(spark):
    v = G.normal(3, 2, 400)
    r = training.bootstrap_mean(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", draws=300).first()
    half = 1.96 * v.std() / 20
    assert r.low == pytest.approx(v.mean() - half, abs=0.06) and r.high == pytest.approx(v.mean() + half, abs=0.06)


def test_predict_and_fuse(spark):
    from kerfline.operators import jobs

    rows = []
    for i in range(120):
        x = float(G.normal())
        rows.append((f"run__seg{i:03d}__step{i:03d}__A{i % 7 + 1}__depth0.1", i, 3 * x + 1, x, float(G.normal())))
    a = spark.createDataFrame(rows, "record_name string, row_idx long, depth_mm double, f double, noise double")
    b = a.withColumn("f", F.col("f") * 2)
    spec = models.SPECS["fast"][0]
    members = tuple(jobs.Member(m, (models.fit(d, spec, {"regParam": 0.01}, ["f", "noise"], "depth_mm"), models.fit(d, spec, {"regParam": 0.1}, ["f", "noise"], "depth_mm")), mae) for m, d, mae in (("airborne", a, 0.01), ("structure", b, 0.03)))
    got = jobs.predict_and_fuse({"airborne": a, "structure": b}, members).orderBy("record_name").collect()
    assert len(got) == 120 and got[7].record_name == "step=007__hole=A1"
    assert max(r.abs_residual_mm for r in got) < 0.6 and all(r.sigma > 0 and r.confidence_label in ("high", "medium", "low") for r in got)
    with pytest.raises(ValueError, match="noise"):
        jobs.predict_and_fuse({"airborne": a.drop("noise"), "structure": b}, members)
