"""Training as stages that are not done twice."""

from dataclasses import replace

import numpy as np
import pytest

from kerfline.operators import driver, models, registry

G = np.random.default_rng(51)


def test_stages_are_kept_and_resumed(spark, tmp_path, monkeypatch):
    x = G.normal(size=(240, 4))
    y = 2 * x[:, 0] - x[:, 1] + 0.05 * G.normal(size=240)
    rows = spark.createDataFrame([(f"g{i % 8}", float(y[i]), *map(float, x[i, :3]), float(x[i, 0] + 0.01 * x[i, 3])) for i in range(240)], "run string, y double, a double, b double, noise double, twin double").cache()
    held = spark.createDataFrame([("g7",)], "run string")
    root = f"file://{tmp_path}/work"
    specs = (models.Spec("ridge", models.LinearRegression, {}, {"regParam": [0.001, 10.0]}), models.Spec("mean", models.LinearRegression, {"regParam": 1e6}))
    plan = driver.Plan(("a", "b", "noise", "twin"), "y", "run", specs, outer=2, inner=2, members=2, goal=0.5)

    real = registry.publish

    def fails(spark, root, name, *rest, **more):
        if name == "mean":
            raise RuntimeError("lost")
        return real(spark, root, name, *rest, **more)

    monkeypatch.setattr(registry, "publish", fails)
    with pytest.raises(RuntimeError, match="lost"):
        driver.train(spark, root, rows, plan, held)
    monkeypatch.setattr(registry, "publish", real)
    got = driver.train(spark, root, rows.repartition(5), plan, held)
    assert got.ran == ["refit-mean", "holdout"]  # what was finished is read, also with rows in another order
    assert set(got.selected) in ({"a", "b"}, {"twin", "b"}) and list(got.versions) == ["ridge", "mean"]
    e = {r.model: r for r in got.holdout.collect()}
    assert e["ridge"].mae < 0.1 < e["ensemble"].mae < e["mean"].mae and e["ridge"].goal_met
    model, saved, version = registry.load(spark, f"{root}/models", "ridge")
    assert version == got.versions["ridge"] and saved.settings == {"regParam": 0.001} and list(saved.held) == got.selected
    assert driver.train(spark, root, rows, plan, held).ran == []
    assert driver.train(spark, root, rows, replace(plan, goal=0.01), held).ran == ["holdout"]
    with pytest.raises(ValueError, match="no feature"):
        driver.train(spark, root, rows, replace(plan, features=("noise",), least=0.9))
