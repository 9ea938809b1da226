"""Lookups, enrichment and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerfline.functions import names
from kerfline.operators import fusion, selection
from kerfline.plans import views
from kerfline.plans.catalog import query
from kerfline.plans.fusion import rounded
from kerfline.sources import tables


@query("geometry_features", """
WITH h AS (SELECT 'S' || s_suppkey AS hole, (s_suppkey % 13) * 1.5::DOUBLE AS x, (s_suppkey % 7) * 2.5::DOUBLE AS y FROM supplier WHERE s_suppkey <= 60), r AS (SELECT s_suppkey AS rec, 'S' || (s_suppkey % 80) AS hole FROM supplier)
SELECT rec, round(x - 4, 6) AS mic_dx, round(y - 5, 6) AS mic_dy, round(sqrt(pow(x - 4, 2) + pow(y - 5, 2)), 6) AS mic_r, round(CASE WHEN x IS NOT NULL THEN ln(greatest(sqrt(pow(x - 4, 2) + pow(y - 5, 2)), 1e-6)) END, 6) AS mic_log_r, round(atan2(y - 5, x - 4), 6) AS mic_angle FROM r LEFT JOIN h ON r.hole = h.hole
""")
def geometry_features(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    holes = s.where(k <= 60).select(F.concat(F.lit("S"), k.cast("string")).alias("HoleID"), ((k % 13) * 1.5).alias("X_mm"), ((k % 7) * 2.5).alias("Y_mm"))
    rows = s.select(k.alias("rec"), F.concat(F.lit("S"), (k % 80).cast("string")).alias("hole_id"))
    return tables.with_geometry(rows, tables.hole_positions(holes), 4.0, 5.0).select("rec", *rounded("mic_dx", "mic_dy", "mic_r", "mic_log_r", "mic_angle"))


@query("model_quality", f"""
WITH {views.PREDICTIONS}, {views.BUNDLES.strip()}, q AS (SELECT 'run ' || run AS model, avg(abs(y_pred - y_true)) AS mae, count(y_pred) AS n FROM p GROUP BY run UNION ALL SELECT 'bundle ' || modality, avg(abs(y_pred - y_true)), count(y_pred) FROM b GROUP BY modality)
SELECT model, round(mae, 6) AS mae, n FROM q
""")
def model_quality(spark, sf_dir):
    err = [F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"), F.count("y_pred").alias("n")]
    runs = views.predictions(spark, sf_dir).groupBy("run").agg(*err).select(F.concat(F.lit("run "), F.col("run").cast("string")).alias("model"), "mae", "n")
    parts = views.bundles(spark, sf_dir).groupBy("modality").agg(*err).select(F.concat(F.lit("bundle "), "modality").alias("model"), "mae", "n")
    return runs.unionByName(parts).orderBy("mae", "model").select("model", *rounded("mae"), "n")


@query("reference_error_fallback", f"""
WITH {views.PREDICTIONS}, m AS (SELECT run, CASE WHEN run % 3 = 0 THEN NULL ELSE avg(abs(y_pred - y_true)) END AS measured FROM p GROUP BY run) SELECT run, round(coalesce(measured, 0.03415::DOUBLE), 6) AS reference_mae FROM m
""")
def reference_error_fallback(spark, sf_dir):
    m = views.predictions(spark, sf_dir).groupBy("run").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("m"))
    measured = F.when(F.col("run") % 3 != 0, F.col("m")).otherwise(F.lit(float("nan")))
    return m.select("run", F.round(fusion.reference_mae(measured, F.lit(0.03415)), 6).alias("reference_mae"))


@query("scaled_mean_ranking", """
WITH s AS (SELECT p_brand AS feature, avg(p_retailprice) AS a, avg(p_size) AS b FROM part GROUP BY p_brand)
SELECT feature, round(((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ())) / 2, 6) AS consensus FROM s
""")
def scaled_mean_ranking(spark, sf_dir):
    s = views.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("a"), F.avg("p_size").alias("b"))
    return selection.ranked(s, ["a", "b"]).select("feature", *rounded("consensus"))


@query("hole_keys", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE upper(regexp_extract('step=' || lpad(CAST(o_orderkey % 40 AS VARCHAR), 3, '0') || '__hole=' || chr(CAST(97 + o_orderkey % 3 AS INTEGER)) || (o_orderkey % 8), 'hole=([A-Za-z][0-9]+)', 1)) END AS hole FROM orders
""")
def hole_keys(spark, sf_dir):
    k = F.col("o_orderkey")
    key = F.when(k % 6 != 0, F.concat(F.lit("step="), F.lpad((k % 40).cast("string"), 3, "0"), F.lit("__hole="), F.chr(97 + k % 3), (k % 8).cast("string")))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", F.upper(names.found(key, r"hole=([A-Za-z]\d+)")).alias("hole"))


@query("fusion_report", f"""
WITH {views.PREDICTIONS} SELECT count(*) AS n, round(avg(abs(y_pred - y_true)), 6) AS mae, round(sqrt(avg(pow(y_pred - y_true, 2))), 6) AS rmse, round(avg(sigma), 6) AS sigma_mean, round(min(sigma), 6) AS sigma_min, round(max(sigma), 6) AS sigma_max FROM p
""")
def fusion_report(spark, sf_dir):
    return tables.report(views.predictions(spark, sf_dir)).select("n", *rounded("mae", "rmse", "sigma_mean", "sigma_min", "sigma_max"))
