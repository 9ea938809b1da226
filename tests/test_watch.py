"""Files that have settled, and the ledger they go to."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from kerfline.streaming import pipeline, watch

START = dt.datetime(2024, 1, 1)


@pytest.fixture()
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", watch.STORE)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def sight(spark, folder, k, rows):
    """Listing ``k`` at second ``k``: ``(path, size)``."""
    made = [(p, s, 7 if s is None else s * 10, START + dt.timedelta(seconds=k)) for p, s in rows]
    spark.createDataFrame(made, watch.SIGHTING).coalesce(1).write.mode("append").parquet(folder)


def listed(spark, tmp_path, **options):
    s = spark.readStream.schema(watch.SIGHTING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pipeline.run_to_end(watch.settled(s, **options), str(tmp_path / "out"), str(tmp_path / "cp"))
    return sorted((r.path, r["size"], (r.seen_at - START).total_seconds()) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_growing_files_settle_once_also_over_a_restart(spark, store, tmp_path):
    here = str(tmp_path / "in")
    sizes = {"steady": [5] * 12, "growing": [1, 2, 3, 4, 5, 5, 5, 5, 5, 5, 5, 5], "again": [1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2], "gone": [9, 9] + [None] * 10, "last": [None] * 10 + [3, 3]}
    for k in range(6):
        sight(spark, here, k, [(p, s[k]) for p, s in sizes.items() if s[k] is not None])
    first = listed(spark, tmp_path, quiet=3, forget=60)
    assert [f[:2] for f in first] == [("again", 1), ("steady", 5)]
    for k in range(6, 12):  # a new query goes on from the checkpoint
        sight(spark, here, k, [(p, s[k]) for p, s in sizes.items() if s[k] is not None])
    got = listed(spark, tmp_path, quiet=3, forget=60)
    assert [f[:2] for f in got] == [("again", 1), ("again", 2), ("growing", 5), ("steady", 5)]
    assert all(at >= {"again": 3, "steady": 3, "growing": 7}[p] for p, _, at in got)


def test_a_file_that_comes_back_after_it_was_forgotten_counts_anew(spark, store, tmp_path):
    here = str(tmp_path / "in")
    for k in range(26):
        sight(spark, here, k, [("clock", k)] + [("file", 4)] * (k < 5 or k > 18))
    assert [f[:2] for f in listed(spark, tmp_path, quiet=2, forget=6) if f[0] == "file"] == [("file", 4), ("file", 4)]


def test_folder_stream_with_a_growing_file(spark, store, tmp_path):
    inbox = tmp_path / "inbox"
    (inbox / "airborne").mkdir(parents=True)
    (inbox / "airborne" / "done.wav").write_bytes(b"x" * 10)
    (inbox / "airborne" / "notes.txt").write_bytes(b"x")
    (inbox / "other.wav").write_bytes(b"x")
    files = watch.detected(watch.settled(watch.sightings(spark, f"file://{inbox}", (".WAV",)), quiet=2.0))
    sink = pipeline.bucketed_sink(str(tmp_path / "ledger"), buckets=4)
    q = files.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").foreachBatch(sink).start()
    try:
        end, grown = time.time() + 90, 0
        while time.time() < end:
            if grown < 12:
                grown += 1
                (inbox / "airborne" / "growing.wav").write_bytes(b"y" * grown)
            time.sleep(0.5)
            got = {r.path.rpartition("/")[2]: r for r in pipeline.current(spark, str(tmp_path / "ledger")).collect()}
            if set(got) == {"done.wav", "growing.wav"}:
                break
    finally:
        q.stop()
    assert set(got) == {"done.wav", "growing.wav"} and got["growing.wav"]["size"] == 12 and got["growing.wav"].is_latest
    assert got["done.wav"].modality == "airborne" and not got["done.wav"].is_latest and got["done.wav"].path == f"file://{inbox}/airborne/done.wav"


def test_settings_are_checked(spark, tmp_path):
    s = spark.readStream.schema(watch.SIGHTING).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="providerClass"):
        watch.settled(s, 3)


SEEN = "path string, modality string, size long, mtime_ns long, seen_at timestamp"


def test_ledger_rewrites_only_what_a_batch_touches(spark, tmp_path):
    path = str(tmp_path / "ledger")
    sink = pipeline.bucketed_sink(path, buckets=8, keep=2)
    one = spark.createDataFrame([(f"f{i}", "ab"[i % 2], i, i, START + dt.timedelta(seconds=i)) for i in range(200)], SEEN)
    two = one.where("path = 'f3'").withColumns({"size": F.lit(99).cast("long"), "seen_at": F.col("seen_at") + F.expr("INTERVAL 1 HOUR")})
    for batch, k in ((one, 0), (two, 1), (two, 1)):
        sink(batch, k)
    assert len(list((tmp_path / "ledger/v=0").glob("bucket=*"))) == 8 and len(list((tmp_path / "ledger/v=1").glob("bucket=*"))) == 1
    got = {r.path: r for r in pipeline.current(spark, path).collect()}
    assert len(got) == 200 and got["f3"]["size"] == 99 and {p for p, r in got.items() if r.is_latest} == {"f3", "f198"}
    assert {r.path: r["size"] for r in pipeline.current(spark, path, version=0).collect()}["f3"] == 3
    sink(two.limit(0), 2)
    sink(two, 3)
    assert len(list((tmp_path / "ledger/v=0").glob("bucket=*"))) == 7  # what f3 was before is two versions old
    assert pipeline.current(spark, path).count() == 200 and pipeline.versions(spark, path)[-1] == 3
