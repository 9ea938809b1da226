"""Structured Streaming jobs. Over all windows that a watermark has closed, and all recordings that were ended, each has the result of its batch form;
checkpoints make them safe to restart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from kerfline.operators import ledger


def event_stream(spark: SparkSession, path: str, schema, files_at_once: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive; event time as a zoned timestamp, which watermarks need."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str, *by: str) -> DataFrame:
    """Count, sum and mean a window; rows later than ``late`` are dropped."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    out = w.groupBy(F.window("ts", width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *by, "n", "total", "mean")


def sliding(events: DataFrame, width: str, hop: str, late: str, *by: str) -> DataFrame:
    w = events.withWatermark("ts", late) if events.isStreaming else events
    out = w.groupBy(F.window("ts", width, hop), *by).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), *by, "rms", "n")


def sessions(events: DataFrame, gap: str, late: str, by: str) -> DataFrame:
    """Bursts of events less than ``gap`` apart: merging of close intervals in event time."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    out = w.groupBy(F.session_window("ts", gap), by).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), by, "n", "peak")


def _ends(ok: np.ndarray, need: int, carried: int) -> np.ndarray:
    """Where runs of true reach ``need``, the first run being ``carried`` longer than seen here."""
    at = np.arange(len(ok))
    since = np.maximum.accumulate(np.where(ok, -1, at))
    length = np.where(since < 0, at + 1 + carried, at - since)
    return np.flatnonzero(ok & (length >= need))


def segmenter(frames: DataFrame, on: float, off: float, on_frames: int, off_frames: int) -> DataFrame:
    """``rec, i, x`` in order to segments ``rec, start, stop`` by the two-threshold machine, state kept a record.

    A row whose x is null ends its record: a segment still open stops at the sample before, as in the batch form, and the state is dropped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, run, start = state.get if state.exists else (False, 0, 0)
        rows = pd.concat(list(batches)).sort_values("i")
        i, x = rows["i"].to_numpy(), rows["x"].to_numpy(float)
        over = np.isnan(x)
        closes = int(i[over][0]) if over.any() else None
        i, x = i[~over], x[~over]
        up, down = _ends(x > on, on_frames, 0 if active else run), _ends(x < off, off_frames, run if active else 0)
        done, at = [], 0
        while True:
            marks = down if active else up
            k = np.searchsorted(marks, at)
            if k == len(marks):
                break
            here = int(marks[k])
            if active:
                done.append((key[0], start, int(i[here]) - off_frames))
            else:
                start = int(i[here]) - on_frames + 1
            active, at, run = not active, here + 1, 0
        if closes is not None:
            if active:
                done.append((key[0], start, closes - 1))
            state.remove()
        else:
            tail = (x < off) if active else (x > on)
            rest = tail[at:]
            run = len(rest) - (int(np.flatnonzero(~rest)[-1]) + 1 if (~rest).any() else 0) + (run if at == 0 and rest.all() else 0)
            state.update((bool(active), int(run), int(start)))
        yield pd.DataFrame(done, columns=["rec", "start", "stop"])

    return frames.groupBy("rec").applyInPandasWithState(step, "rec long, start long, stop long", "active boolean, run long, start long", "append", "NoTimeout")


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", batch=None) -> None:
    """Process what is there and stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", out)).start()
    query.awaitTermination()


LEDGER = "path string, modality string, size long, mtime_ns long, status string, seen_at timestamp, is_latest boolean"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a ledger that are complete."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0]))


def _buckets(spark: SparkSession, path: str, version: int | None = None) -> dict[int, list[int]]:
    """Complete versions of each bucket of a ledger, up to a version."""
    out: dict[int, list[int]] = {}
    for v in versions(spark, path):
        if version is None or v <= version:
            at, fs = _folder(spark, f"{path}/v={v}")
            for f in fs.listStatus(at):
                if f.getPath().getName().startswith("bucket="):
                    out.setdefault(int(f.getPath().getName()[7:]), []).append(v)
    return out


def _read(spark: SparkSession, path: str, newest: dict[int, int]) -> DataFrame:
    schema = ", ".join(LEDGER.split(", ")[:-1])
    return spark.read.schema(schema).parquet(*(f"{path}/v={v}/bucket={b}" for b, v in sorted(newest.items()))) if newest else spark.createDataFrame([], schema)


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A ledger's rows as of its last version, or of an earlier one that is still kept."""
    return ledger.with_latest(_read(spark, path, {b: vs[-1] for b, vs in _buckets(spark, path, version).items()}))


def bucketed_sink(path: str, buckets: int = 64, first: int = 0, keep: int = 3):
    """``foreachBatch`` function that applies sightings of files to a ledger table.

    Paths are dealt to buckets by hash. Batch b writes version ``first + b``, which holds only the buckets it touches, each made from its version before; a bucket's rows are
    those of its newest version. One write, one commit a batch: a version counts when it is complete, and a batch that runs again writes the same again. What the last ``keep`` versions do not
    need goes. A new checkpoint goes on from an old ledger with ``first`` one above its last version (see ``versions``)."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, first + batch_id
        bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
        seen = batch.persist()
        try:
            touched = [r[0] for r in seen.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
            before = {b: vs[-1] for b, vs in _buckets(spark, path, now - 1).items() if b in touched}
            rows = ledger.merged_files(_read(spark, path, before), seen)
            rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={now}")
        finally:
            seen.unpersist()
        for b, vs in _buckets(spark, path).items():
            old = [v for v in vs if v <= now - keep + 1]
            for v in old[:-1]:
                at, fs = _folder(spark, f"{path}/v={v}/bucket={b}")
                fs.delete(at, True)

    return apply
