"""File and run ledgers as event logs: latest state wins, and a batch can be applied again without effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# States of a run and of a file, and the moves a run may make.
MOVES = {"queued": ("running", "failed"), "running": ("succeeded", "failed"), "succeeded": (), "failed": ()}
BUSY = ("queued", "running")


def latest(events: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Last values by ``order`` of each key: an upsert's outcome."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("r")).select(key, *(F.col(f"r.{v}").alias(v) for v in values))


def merged_files(known: DataFrame, seen: DataFrame) -> DataFrame:
    """``path, modality, size, mtime_ns, status, seen_at``: a path seen again takes the new data; its status stays while
    it is busy and else becomes ``ready``."""
    new = latest(seen.withColumn("_o", F.struct("seen_at", "mtime_ns")), "path", "_o", "modality", "size", "mtime_ns", "seen_at")
    old = known.select(F.col("path"), *(F.col(c).alias(f"_{c}") for c in ("modality", "size", "mtime_ns", "status", "seen_at")))
    both = old.join(new, "path", "full_outer")
    status = F.when(F.col("seen_at").isNull(), F.col("_status")).when(F.col("_status").isin(*BUSY), F.col("_status")).otherwise("ready")
    return both.select("path", *(F.coalesce(c, f"_{c}").alias(c) for c in ("modality", "size", "mtime_ns")), status.alias("status"), F.coalesce("seen_at", "_seen_at").alias("seen_at"))


def with_latest(files: DataFrame) -> DataFrame:
    """Marks the newest path of each modality."""
    top = files.groupBy("modality").agg(F.max(F.struct("seen_at", "path")).alias("top"))
    return files.join(top, "modality").withColumn("is_latest", F.struct("seen_at", "path") == F.col("top")).drop("top")


def upsert_files(known: DataFrame, seen: DataFrame) -> DataFrame:
    """``merged_files`` with ``is_latest``."""
    return with_latest(merged_files(known, seen))


def illegal_moves(log: DataFrame) -> DataFrame:
    """``run_id, seq, status`` rows whose status may not follow the one before."""
    w = W.partitionBy("run_id").orderBy("seq")
    allowed = F.lit(False)
    for state, following in MOVES.items():
        allowed = F.when(F.col("before") == state, F.col("status").isin(*following) if following else F.lit(False)).otherwise(allowed)
    return log.withColumn("before", F.lag("status").over(w)).where(F.when(F.col("before").isNull(), F.col("status") != "queued").otherwise(~allowed))


def active_runs(log: DataFrame) -> DataFrame:
    """Runs that are queued or running: with any, no other may start."""
    return latest(log, "run_id", "seq", "status").where(F.col("status").isin(*BUSY))


def worklist(found: DataFrame, done: DataFrame) -> DataFrame:
    """Files not processed yet, or changed since."""
    return found.join(done.select("path", "mtime_ns"), ["path", "mtime_ns"], "left_anti")


def drift(now: DataFrame, before: DataFrame) -> DataFrame:
    """Key by key: added, missing, changed or same."""
    both = now.select("key", F.col("sha").alias("now")).join(before.select("key", F.col("sha").alias("before")), "key", "full_outer")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("before"), "changed").otherwise("same")
    return both.select("key", kind.alias("kind"))
