"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per digest,
deduplicated by a sort-merge anti-join with the index (no exchange on the index side) and appended.

Defined results: a null text counts as empty; a null ``doc_id`` takes part and only wins where a group has no
other; of rows that repeat both id and text, which nothing tells apart, any one is the kept row; texts may be of any length; an
empty table gives an empty result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kerfline.llm.common import BLANK, Scratch, fresh_path, removed, text_or_empty


def digest(column: str = "text"):
    """SHA-256 of the text with each run of ASCII white space replaced by one space."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(column), f"[{BLANK}]+", " "), 256))


class DigestIndex:
    """Bucketed, sorted table of every digest seen: ``digest, keep_id, batch``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, name: str | None = None):
        self.spark, self.path, self.buckets, self.scratch = spark, path, buckets, Scratch(spark, "exact-dedup")
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, firsts: DataFrame, batch: str) -> None:
        """Add the digests of ``firsts(digest, keep_id)`` that the index lacks; safe to repeat."""
        known = self.rows().select("digest").hint("merge")
        new = firsts.select("digest", "keep_id", F.lit(batch).alias("batch")).join(known, "digest", "left_anti")
        (
            new.repartition(self.buckets, "digest")
            .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path)
            .mode("append").saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def resolve(self, docs: DataFrame, batch: str) -> DataFrame:
        """Append a batch ``docs(doc_id, text)`` and return, per row, the document that stays for its digest
        and the number of rows of this batch that share it."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"))
        again = W.partitionBy("digest", "doc_id").orderBy("digest")  # repeats of one row
        seen = self.scratch.written(rows.withColumn("copy", F.row_number().over(again)), "digests")
        firsts = self.scratch.written(seen.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "firsts")
        self.append(firsts, batch)
        # A table again, so that the last join is one between two plain exchanges, whose hot digests AQE can split.
        kept = self.scratch.written(firsts.select("digest", "group_size").join(self.rows().select("digest", "keep_id"), "digest"), "kept")
        return seen.join(kept, "digest").select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, index_path: str | None = None, buckets: int | None = None, batch: str = "0") -> DataFrame:
    spark = docs.sparkSession
    n = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = DigestIndex(spark, index_path or fresh_path(spark, "digest-index"), n)
    out = index.resolve(docs, batch)  # reads two tables of its own, not the index
    spark.sql(f"DROP TABLE {index.name}")  # the files of a table with a location stay
    if index_path is None:
        removed(spark, index.path)
    return out
