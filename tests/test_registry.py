"""Models come back as they were saved."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerfline.operators import models, registry
from kerfline.operators.forests import ExtraTrees

G = np.random.default_rng(41)


@pytest.fixture(scope="module")
def rows(spark):
    x = G.normal(size=(200, 2))
    return spark.createDataFrame([(float(a), None if i % 40 == 3 else float(b), float(2 * a - b)) for i, (a, b) in enumerate(x)], "a double, b double, y double").cache()


def predictions(rows, model, held):
    return [r.y_pred for r in models.predict(rows, model, held).orderBy("a", "y").collect()]


@pytest.mark.parametrize("spec", [models.SPECS["fast"][0], models.SPECS["fast"][1], models.Spec("extra", ExtraTrees, {"numTrees": 5, "maxDepth": 4})])
def test_round_trip(spark, rows, tmp_path, spec):
    root = f"file://{tmp_path}/models"
    model, held = models.fit(rows, spec, {}, ["a", "b"], "y")
    version = registry.publish(spark, root, spec.name, model, registry.Saved(held, {"alpha": 0.5}, {"mae": 0.01}, {"extractor": "v2"}))
    other = spark.newSession()
    back, saved, got = registry.load(other, root, spec.name)
    assert got == version and saved == registry.Saved(held, {"alpha": 0.5}, {"mae": 0.01}, {"extractor": "v2"}) and list(saved.held) == ["a", "b"]
    assert np.allclose(predictions(rows, back, saved.held), predictions(rows, model, held))
    assert models.importance(back, ["a", "b"]) == pytest.approx(models.importance(model, ["a", "b"]))


def test_versions_pointer_and_drift(spark, rows, tmp_path):
    root, spec = f"file://{tmp_path}/models", models.SPECS["fast"][0]
    assert registry.versions(spark, root).count() == 0
    fitted = [models.fit(rows, spec, {"regParam": r}, ["a", "b"], "y") for r in (0.01, 5.0)]
    first, second = (registry.publish(spark, root, "ridge", m, registry.Saved(h, {"regParam": r})) for (m, h), r in zip(fitted, (0.01, 5.0), strict=True))
    assert first != second and registry.current(spark, root, "ridge") == second
    third = registry.publish(spark, root, "ridge", fitted[0][0], registry.Saved(fitted[0][1]), current=False)
    assert registry.current(spark, root, "ridge") == second and third != first
    registry.point(spark, root, "ridge", first)
    assert registry.load(spark, root, "ridge")[2] == first
    seen = {r.version: (r.is_current, r.settings) for r in registry.versions(spark, root).collect()}
    assert seen == {first: (True, '{"regParam":0.01}'), second: (False, '{"regParam":5.0}'), third: (False, "{}")}
    kinds = {r.key: r.kind for r in registry.drift(spark, root, "ridge", second).collect()}
    assert kinds["model.json"] == "changed" and "same" in kinds.values()
    with pytest.raises(ValueError, match="no version"):
        registry.point(spark, root, "ridge", "nothing")
    with pytest.raises(ValueError, match="no current"):
        registry.current(spark, root, "forest")


def test_changed_files_are_refused(spark, rows, tmp_path):
    root, spec = f"file://{tmp_path}/models", models.SPECS["fast"][0]
    model, held = models.fit(rows, spec, {}, ["a", "b"], "y")
    version = registry.publish(spark, root, "ridge", model, registry.Saved(held))
    target = tmp_path / "models/ridge" / version / "model.json"
    target.write_text(target.read_text().replace("facts", "fact5"))
    (tmp_path / "models/ridge" / version / ".model.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="model.json"):
        registry.load(spark, root, "ridge")
    assert not [p for p in (tmp_path / "models").iterdir() if p.name.startswith("_")]
    assert rows.agg(F.count("a")).first()[0] == 200
