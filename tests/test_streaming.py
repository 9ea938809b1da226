"""Streams give what the batch forms give."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from kerfline.streaming import pipeline

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(spark, n=400):
    rng = np.random.default_rng(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=3 * i), int(rng.integers(4)), "ab"[int(rng.integers(2))], float(rng.random())) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_tumbling_stream_equals_batch(spark, tmp_path):
    e = events(spark)
    for k in range(4):
        e.where(F.col("event_id").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = pipeline.event_stream(spark, str(tmp_path / "in"), SCHEMA)
    pipeline.run_to_end(pipeline.tumbling(s, "1 hour", "30 minutes", "event_type"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.event_type): r.n for r in pipeline.tumbling(e, "1 hour", "30 minutes", "event_type").collect()}
    assert got and all(want[k] == n for k, n in got.items())
    assert len(got) >= len(want) - 4  # the last windows are not closed by a watermark yet


def test_segments_across_batches(spark, tmp_path):
    x = [0, 0, 5, 5, 5, 5, 5, 0, 0, 0, 5, 5, 5, 0, 0, 0]
    for k in range(4):
        spark.createDataFrame([(1, i, float(x[i])) for i in range(4 * k, 4 * k + 4)], "rec long, i long, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("rec long, i long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pipeline.run_to_end(pipeline.segmenter(s, 3, 1, 2, 2), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.start, r.stop) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(2, 6), (10, 12)]


def test_random_segments_in_batches_equal_the_batch_form(spark, tmp_path):
    from kerfline.functions import bursts

    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=60), rng.integers(1, 5, 60))[:120]
    for k in range(6):
        rows = [(1, i, float(x[i])) for i in range(20 * k, 20 * k + 20)] + ([(1, 120, None)] if k == 5 else [])
        spark.createDataFrame(rows, "rec long, i long, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("rec long, i long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pipeline.run_to_end(pipeline.segmenter(s, 0.3, -0.2, 2, 3), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.start, r.stop) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [tuple(v) for v in bursts.hysteresis(x, 0.3, -0.2, 2, 3).tolist()]


def test_sliding_and_session_streams_equal_batch(spark, tmp_path):
    e = events(spark)
    for k in range(3):
        e.where(F.col("event_id").between(140 * k, 140 * k + 139)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    forms = {"sliding": lambda s: pipeline.sliding(s, "2 hours", "1 hour", "30 minutes", "event_type"), "sessions": lambda s: pipeline.sessions(s, "10 minutes", "30 minutes", "user_id")}
    for name, form in forms.items():
        pipeline.run_to_end(form(pipeline.event_stream(spark, str(tmp_path / "in"), SCHEMA)), str(tmp_path / name), str(tmp_path / f"cp-{name}"))
        key = lambda r: (r.start, r["event_type"] if name == "sliding" else r["user_id"])  # noqa: E731, B023
        got, want = ({key(r): r.n for r in d.collect()} for d in (spark.read.parquet(str(tmp_path / name)), form(e)))
        assert len(got) > 10 and all(want[k] == n for k, n in got.items())


def test_ledger_batches_can_run_again(spark, tmp_path):
    columns = "path string, modality string, size long, mtime_ns long, seen_at timestamp"
    sink = pipeline.bucketed_sink(str(tmp_path / "ledger"), buckets=2)
    a = spark.createDataFrame([("f1", "air", 1, 1, dt.datetime(2024, 1, 1))], columns)
    b = spark.createDataFrame([("f1", "air", 2, 2, dt.datetime(2024, 1, 2)), ("f2", "air", 3, 3, dt.datetime(2024, 1, 3))], columns)
    for batch, k in ((a, 0), (b, 1), (b, 1)):
        sink(batch, k)
    got = {r.path: (r["size"], r.status, r.is_latest) for r in pipeline.current(spark, str(tmp_path / "ledger")).collect()}
    assert got == {"f1": (2, "ready", False), "f2": (3, "ready", True)}
    again = pipeline.bucketed_sink(str(tmp_path / "ledger"), buckets=2, first=pipeline.versions(spark, str(tmp_path / "ledger"))[-1] + 1, keep=2)
    for k in range(2):
        again(a, k)
    assert pipeline.versions(spark, str(tmp_path / "ledger"))[-1] == 3 and pipeline.current(spark, str(tmp_path / "ledger")).count() == 2
