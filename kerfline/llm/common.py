"""Shared helpers: the folder every executor can see, and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as a Java regular expression class body.
BLANK = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where none is named, a temporary one if all runs on this machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kerfline-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Spark's setting to remove an execution's shuffle files as soon as it has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder of any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written to the shared folder and read back: lineage ends there, so a lost executor costs the reading stage only.

    The first table switches the session's ``TIDY`` on for good. ``keep`` removes tables that nothing reads any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, fresh_path(spark, label)
        self.tables: list[tuple[DataFrame, str]] = []
        self.made = 0

    def written(self, df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
        if self.spark.conf.get(TIDY, "false") != "true":
            self.spark.conf.set(TIDY, "true")
        path = f"{self.path}/{self.made}-{label}"
        self.made += 1
        df.write.parquet(path, compression=codec)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((back, path))
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Remove these tables."""
        self.keep(*(t for t, _ in self.tables if all(t is not x for x in tables)))

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables but these."""
        stay = [(t, p) for t, p in self.tables if any(t is x for x in tables)]
        for _, path in self.tables:
            if all(path != p for _, p in stay):
                removed(self.spark, path)
        self.tables = stay


def written(df: DataFrame, label: str) -> DataFrame:
    """One table by itself."""
    return Scratch(df.sparkSession, label).written(df, label)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
