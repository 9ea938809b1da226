"""Views that give the driver's tables the shape of the operators' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kerfline.functions import names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SCALE = 499979.0


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two prediction bundles over ``orders``, with missing rows, values and sigmas, and records of the second that come again."""
    o = table(spark, sf_dir, "orders")
    k, c, t = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice") / SCALE
    a = o.select(F.lit("a").alias("modality"), F.lit(0.0163).alias("validation_mae"), k.cast("string").alias("record_name"), k.alias("row_idx"), F.when(k % 11 != 0, t + ((k % 7) - 3) * 0.0613).alias("y_pred"), F.lit(0.02).alias("sigma"), t.alias("y_true"))
    b = o.where(k % 13 != 0).select(F.lit("b"), F.lit(0.0182), k.cast("string"), k, t + ((c % 5) - 2) * 0.1477, F.when(c % 3 != 0, F.lit(0.03)), t)
    again = o.where(k % 17 == 0).select(F.lit("b"), F.lit(0.0182), k.cast("string"), k + 10_000_000, F.when(k % 11 != 0, t + 0.0131), F.lit(0.04), t)
    return a.union(b).union(again)


BUNDLES = f"""
b AS (
  SELECT 'a' AS modality, 0.0163::DOUBLE AS validation_mae, CAST(o_orderkey AS VARCHAR) AS record_name, o_orderkey AS row_idx,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / {SCALE}::DOUBLE + ((o_orderkey % 7) - 3) * 0.0613::DOUBLE END AS y_pred, 0.02::DOUBLE AS sigma, o_totalprice / {SCALE}::DOUBLE AS y_true FROM orders
  UNION ALL
  SELECT 'b', 0.0182::DOUBLE, CAST(o_orderkey AS VARCHAR), o_orderkey, o_totalprice / {SCALE}::DOUBLE + ((o_custkey % 5) - 2) * 0.1477::DOUBLE, CASE WHEN o_custkey % 3 <> 0 THEN 0.03::DOUBLE END, o_totalprice / {SCALE}::DOUBLE FROM orders WHERE o_orderkey % 13 <> 0
  UNION ALL
  SELECT 'b', 0.0182::DOUBLE, CAST(o_orderkey AS VARCHAR), o_orderkey + 10000000, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / {SCALE}::DOUBLE + 0.0131::DOUBLE END, 0.04::DOUBLE, o_totalprice / {SCALE}::DOUBLE FROM orders WHERE o_orderkey % 17 = 0),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY modality, record_name ORDER BY row_idx DESC) AS rn FROM b) WHERE rn = 1),
al AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY record_name) AS n FROM u) WHERE n = 2)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bundle with its run, level, truth, prediction and sigma."""
    o = table(spark, sf_dir, "orders")
    k, t = F.col("o_orderkey"), F.col("o_totalprice") / SCALE
    return o.select(
        k.alias("record"), (k % 9).alias("run"), F.rint(t * 10).cast("int").alias("level"), t.alias("y_true"),
        F.when(k % 19 != 0, t + ((F.col("o_custkey") % 21) - 10) * 0.0137).alias("y_pred"), (((k % 5) + 1) * 0.0271).alias("sigma"),
    )


PREDICTIONS = f"""
p AS (SELECT o_orderkey AS record, o_orderkey % 9 AS run, CAST(round_even(o_totalprice / {SCALE}::DOUBLE * 10, 0) AS INTEGER) AS level, o_totalprice / {SCALE}::DOUBLE AS y_true,
             CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice / {SCALE}::DOUBLE + ((o_custkey % 21) - 10) * 0.0137::DOUBLE END AS y_pred, ((o_orderkey % 5) + 1) * 0.0271::DOUBLE AS sigma FROM orders)"""


def record_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as record names: run, segment, step, hole and depth; some parts missing, some numbers beyond three digits, some holes
    that need a slug, and a fifth of all records in one run, step and hole."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    run = F.when(k % 5 == 0, 0).otherwise(F.col("o_custkey") % 7)
    step = F.when(k % 5 == 0, 12).when(k % 23 != 0, (k % 1040).cast("int"))
    hole = F.when(k % 5 == 0, "D1").when(k % 41 == 0, "d 4").when(k % 29 != 0, F.concat(F.element_at(F.array(*map(F.lit, "ABC")), ((k % 3) + 1).cast("int")), ((k % 8) + 1).cast("string")))
    depth = F.when(k % 31 != 0, (k % 11) / F.lit(8.0))
    stem = F.concat(F.lit("run_"), run.cast("string"), F.when(k % 43 == 0, "_hole_e5").otherwise(""))
    return o.select(k.alias("row_idx"), names.file_name(stem, (k % 1250).cast("int"), step, hole, depth, ".flac").alias("record_name"))


RECORD_NAMES = """
rn AS (SELECT o_orderkey AS row_idx, 'run_' || CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_custkey % 7 END || CASE WHEN o_orderkey % 43 = 0 THEN '_hole_e5' ELSE '' END ||
         '__seg' || printf('%03d', o_orderkey % 1250) || '__step' ||
         CASE WHEN o_orderkey % 5 = 0 THEN '012' WHEN o_orderkey % 23 <> 0 THEN printf('%03d', o_orderkey % 1040) ELSE 'NA' END || '__' ||
         CASE WHEN o_orderkey % 5 = 0 THEN 'D1' WHEN o_orderkey % 41 = 0 THEN 'd_4' WHEN o_orderkey % 29 <> 0 THEN substr('ABC', CAST(o_orderkey % 3 AS INTEGER) + 1, 1) || ((o_orderkey % 8) + 1) ELSE 'NA' END || '__depth' ||
         CASE WHEN o_orderkey % 31 <> 0 THEN printf('%.3f', (o_orderkey % 11) / 8.0::DOUBLE) ELSE 'NA' END || '.flac' AS record_name FROM orders)"""


#: A record name's hole, by the three patterns in their order.
HOLE_SQL = r"""upper(coalesce(nullif(regexp_extract(record_name, '(?i)hole_([A-Z]\d+)', 1), ''), nullif(regexp_extract(record_name, '(?i)__([A-Z]\d+)__', 1), ''), nullif(regexp_extract(record_name, '(?i)\b([A-Z]\d+)\b', 1), '')))"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as one signal a user: ``rec, i, t, x``; i runs from 0 by (ts, event_id)."""
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("rec"), (F.row_number().over(w) - 1).alias("i"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("x"))


SIGNALS = """
sig AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) AS us, value AS x FROM events)"""


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a classification result: truth, prediction, run."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), table(spark, sf_dir, "labels")
    return lab.join(d, "doc_id").select("doc_id", F.col("source").alias("run"), (F.col("quality") + 2 * F.col("toxic")).alias("truth"), ((F.col("n_chars") % 3) + (F.col("doc_id") % 2)).cast("int").alias("pred"))


CLASSED = """
cl AS (SELECT doc_id, source AS run, quality + 2 * toxic AS truth, CAST((n_chars % 3) + (doc_id % 2) AS INTEGER) AS pred FROM labels JOIN documents USING (doc_id))"""


FEATURES = ("f_quantity", "f_discount", "f_tax", "f_noise", "f_flat")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a feature table: run, target, five features, one of them with gaps and one constant."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("run"), F.col("l_extendedprice").alias("target"), F.col("l_quantity").alias("f_quantity"), F.col("l_discount").alias("f_discount"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_tax")).alias("f_tax"), (F.col("l_partkey") % 97).cast("double").alias("f_noise"), F.lit(1.5).alias("f_flat"),
    )


FEATURE_SQL = """
ft AS (SELECT l_suppkey AS run, l_extendedprice AS target, l_quantity AS f_quantity, l_discount AS f_discount, CASE WHEN l_partkey % 5 <> 0 THEN l_tax END AS f_tax,
              CAST(l_partkey % 97 AS DOUBLE) AS f_noise, 1.5::DOUBLE AS f_flat FROM lineitem)"""
