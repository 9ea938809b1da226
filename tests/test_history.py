"""Run folders: where results lie, what is missing, and what the reports say."""

import json
import os

import pytest
from pyspark.sql import functions as F

from kerfline.operators import history


@pytest.fixture()
def root(tmp_path):
    def put(path, text, at):
        p = tmp_path / "runs" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
        os.utime(p, (at, at))

    put("r1/final/final_predictions.csv", "a\n1\n", 100)
    put("r1/final/single_prediction_report.json", json.dumps({"prediction": {"depth": 0.5, "label": "high"}, "models": [{"mae": 0.1}, {"mae": 0.2}]}), 100)
    put("r1/airborne/features_1.csv", "x", 100)
    put("r1/structure/deep/segments_manifest.csv", "x", 100)
    put("r2/old/final/final_predictions.csv", "a", 100)
    put("r2/new/final/final_predictions.csv", "a", 300)
    put("r2/new/final/batch_quality_report.json", json.dumps({"prediction": {"depth": "deep"}}), 200)
    put("r2/other/notes.txt", "no results", 900)
    put("r3/final/batch_quality_report.json", "{broken", 100)
    put("r4/airborne/x.csv", "x", 100)
    return f"{tmp_path}/runs"


RUNS = [(1, "r1", "single", "succeeded", 10), (2, "r2", "batch", "succeeded", 30), (3, "r3", "batch", "failed", 40), (4, "r4", "single", "running", 20), (5, "r5", "single", "queued", 50)]


def test_folders_and_reports(spark, root):
    runs = spark.createDataFrame(RUNS, "run_id long, folder string, mode string, status string, created_at long")
    found = history.files(spark, root)
    at = history.resolved(runs, found)
    got = {r.run_id: r for r in history.complete(at, found).collect()}
    assert {k: r.base for k, r in got.items()} == {1: "", 2: "new/", 3: "", 4: None, 5: None}
    assert [got[k].missing for k in (1, 2, 3)] == [[], [], ["final_predictions.csv"]] and len(got[4].missing) == 2
    assert got[1].modalities == ["airborne", "structure"] and got[2].modalities == []
    said = history.fields(history.reports(spark, at, found), {"depth": ("$.prediction.depth", "double"), "label": ("$.prediction.label", "string"), "second": ("$.models[1].mae", "double")}, "run_id", "report")
    rows = {r.run_id: tuple(r)[1:] for r in said.collect()}
    assert rows == {1: ("single_prediction_report", 0.5, "high", 0.2), 2: ("batch_quality_report", None, None, None), 3: ("batch_quality_report", None, None, None)}
    assert history.reports(spark, at.where("run_id = 4"), found).count() == 0
    assert [r.run_id for r in history.listed(runs, 2).collect()] == [5, 3]
    assert [r.run_id for r in history.last_succeeded(runs).collect()] == [2]
    assert {r.run_id for r in history.last_succeeded(runs, "mode").collect()} == {1, 2}


def test_states_and_segment_files(spark):
    log = spark.createDataFrame([(1, 1, "queued"), (1, 3, "succeeded"), (1, 2, "running"), (2, 1, "queued")], "run_id long, seq long, status string")
    assert {r.run_id: (r.status, r.n_events) for r in history.states(log, "status").collect()} == {1: ("succeeded", 3), 2: ("queued", 1)}
    rows = [(1, 1, "7", "B2", "a.wav"), (1, 2, "7.0", "B2", "b.wav"), (1, 3, None, "B2", "c.wav"), (1, 4, "8", " ", "d.wav"), (1, 5, "9", "C1", " ")]
    got = history.segment_files(spark.createDataFrame(rows, "run_id long, pos int, step string, hole_id string, output_path string"), "airborne").collect()
    assert [(r.key, r.path) for r in got] == [("step=007__hole=B2", "b.wav")]
    assert history.fields(log.select("run_id", F.expr("parse_json('{}')").alias("body")), {"a": ("$.a", "int")}, "run_id").where("a IS NULL").count() == 4
