"""Names, alignment, fusion and error reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kerfline.functions import names
from kerfline.operators import fusion, metrics
from kerfline.plans import views
from kerfline.plans.catalog import query


def rounded(*columns: str, digits: int = 6):
    return [F.round(c, digits).alias(c) for c in columns]


@query("flagship_fusion", f"""
WITH {views.BUNDLES},
rw AS (SELECT *, greatest(1 / (validation_mae + 1e-9::DOUBLE), 0.05::DOUBLE) AS rw FROM al WHERE y_pred IS NOT NULL),
w AS (SELECT *, rw / sum(rw) OVER (PARTITION BY record_name) AS w FROM rw),
mu AS (SELECT *, sum(w * y_pred) OVER (PARTITION BY record_name) AS mu FROM w),
f AS (SELECT record_name, max(mu) AS y_pred, sqrt(greatest(sum(w * (pow(y_pred - mu, 2) + pow(coalesce(sigma, 0), 2))), 0)) AS sigma, sum(w * validation_mae) AS reference_mae, count(*) AS members FROM mu GROUP BY record_name),
t AS (SELECT record_name, max(y_true) AS y_true FROM al GROUP BY record_name)
SELECT t.record_name, round(t.y_true, 6) AS y_true, round(f.y_pred, 6) AS y_pred, round(f.sigma, 6) AS sigma, round(f.reference_mae, 6) AS reference_mae, coalesce(members, 0) AS members,
       CASE WHEN f.sigma IS NULL THEN NULL WHEN f.sigma < 0.05 THEN 'high' WHEN f.sigma < 0.15 THEN 'medium' ELSE 'low' END AS confidence_label,
       round(f.y_pred - t.y_true, 6) + 0.0 AS residual_mm, round(abs(f.y_pred - t.y_true) / nullif(f.sigma, 0), 5) AS z_score,
       coalesce(abs(f.y_pred - t.y_true) <= f.sigma, false) AS within_1sigma, coalesce(abs(f.y_pred - t.y_true) <= 2 * f.sigma, false) AS within_2sigma
FROM t LEFT JOIN f USING (record_name)
""")  # fmt: skip
def flagship_fusion(spark, sf_dir):
    out = fusion.with_residuals(fusion.fuse(views.bundles(spark, sf_dir), members=2))
    return out.select("record_name", *rounded("y_true", "y_pred", "sigma", "reference_mae"), F.coalesce("members", F.lit(0)).alias("members"), "confidence_label", (F.round("residual_mm", 6) + 0.0).alias("residual_mm"), *rounded("z_score", digits=5), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("within_1sigma", "within_2sigma")))


@query("fusion_aligned_members", f"WITH {views.BUNDLES} SELECT modality, record_name, row_idx, round(y_pred, 6) AS y_pred, sigma FROM al")
def fusion_aligned_members(spark, sf_dir):
    return fusion.aligned(views.bundles(spark, sf_dir), 2).select("modality", "record_name", "row_idx", *rounded("y_pred"), "sigma")


@query("fusion_disagreement", f"""
WITH {views.BUNDLES}, w AS (SELECT *, (1 / (validation_mae + 1e-9::DOUBLE)) / sum(1 / (validation_mae + 1e-9::DOUBLE)) OVER (PARTITION BY record_name) AS w FROM al WHERE y_pred IS NOT NULL),
mu AS (SELECT *, sum(w * y_pred) OVER (PARTITION BY record_name) AS mu FROM w)
SELECT record_name, round(max(mu), 6) AS y_pred, round(sqrt(sum(w * pow(y_pred - mu, 2))), 6) AS sigma FROM mu GROUP BY record_name
""")
def fusion_disagreement(spark, sf_dir):
    return fusion.disagreement(views.bundles(spark, sf_dir), 2).select("record_name", *rounded("y_pred", "sigma"))


@query("weight_normalisation", """
WITH s AS (SELECT s_nationkey AS grp, s_suppkey AS member, CASE WHEN s_suppkey % 23 = 0 THEN NULL WHEN s_suppkey % 37 = 0 THEN -1.0::DOUBLE ELSE s_acctbal + 2000 END AS weight FROM supplier)
SELECT grp, member, round(CASE WHEN max(CASE WHEN weight IS NULL OR weight <= 0 THEN 1 ELSE 0 END) OVER w = 1 THEN 1.0::DOUBLE / count(*) OVER w ELSE weight / sum(weight) OVER w END, 6) AS share FROM s WINDOW w AS (PARTITION BY grp)
""")
def weight_normalisation(spark, sf_dir):
    k = F.col("s_suppkey")
    s = views.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), k.alias("member"), F.when(k % 23 == 0, None).when(k % 37 == 0, -1.0).otherwise(F.col("s_acctbal") + 2000).alias("weight"))
    return s.select("grp", "member", F.round(fusion.normalised(F.col("weight"), W.partitionBy("grp")), 6).alias("share"))


@query("names_parse", f"""
WITH {views.RECORD_NAMES}
SELECT row_idx, record_name, split_part(record_name, '__seg', 1) AS recording_root,
       try_cast(replace(nullif(regexp_extract(record_name, '(?i)depth([0-9]+(?:[.,][0-9]+)?)', 1), ''), ',', '.') AS DOUBLE) AS depth_mm,
       coalesce(try_cast(nullif(regexp_extract(record_name, '(?i)__step([0-9]+)__', 1), '') AS INTEGER), -1) AS step_idx,
       {views.HOLE_SQL} AS hole_id
FROM rn
""")
def names_parse(spark, sf_dir):
    n = F.col("record_name")
    return views.record_names(spark, sf_dir).select("row_idx", "record_name", names.root(n).alias("recording_root"), names.depth(n).alias("depth_mm"), F.coalesce(names.step(n), F.lit(-1)).alias("step_idx"), names.hole(n).alias("hole_id"))


_KEY = """CASE WHEN try_cast(regexp_extract(record_name, '__step([^_]*)__', 1) AS INTEGER) IS NULL THEN 'hole=' || regexp_extract(record_name, '__step[^_]*__(.+)__depth', 1)
  ELSE 'step=' || printf('%03d', CAST(regexp_extract(record_name, '__step([^_]*)__', 1) AS INTEGER)) || '__hole=' || regexp_extract(record_name, '__step[^_]*__(.+)__depth', 1) END"""


@query("fusion_keys", f"WITH {views.RECORD_NAMES} SELECT row_idx, {_KEY} AS key FROM rn")
def fusion_keys(spark, sf_dir):
    return views.record_names(spark, sf_dir).select("row_idx", names.fusion_key(F.col("record_name")).alias("key"))


@query("canonical_long_keys", f"""
WITH {views.RECORD_NAMES},
k AS (SELECT row_idx, 'run=' || printf('%03d', dense_rank() OVER (ORDER BY split_part(record_name, '__seg', 1))) || '__' || {_KEY} AS key FROM rn),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_idx) AS nth FROM k)
SELECT row_idx, CASE WHEN nth = 1 THEN key ELSE key || '__occ' || printf('%03d', nth) END AS key_long FROM n
""")
def canonical_long_keys(spark, sf_dir):
    return names.long_keys(views.record_names(spark, sf_dir), "record_name", "row_idx").select("row_idx", "key_long")


@query("name_slugs", """
SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(p_name || ' / ' || p_type || '!', '[^a-zA-Z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'NA') AS slug,
       CASE WHEN p_size % 7 = 0 THEN 'NA' ELSE replace(printf('%.3f', (p_size - 25) / 8.0::DOUBLE), '-', 'm') END AS shown FROM part
""")
def name_slugs(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    size = F.when(F.col("p_size") % 7 != 0, (F.col("p_size") - 25) / F.lit(8.0))
    return p.select("p_partkey", names.slug(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"), names.number_in_name(size).alias("shown"))


@query("snap_to_grid", f"""
WITH {views.PREDICTIONS}
SELECT record, round(round_even(y_pred / 0.1::DOUBLE, 0) * 0.1::DOUBLE, 6) + 0.0 AS snapped, CASE WHEN y_pred IS NOT NULL THEN round(least(greatest(round_even(y_pred / 0.1::DOUBLE, 0) * 0.1::DOUBLE, 0.1), 1.0), 6) END AS clamped FROM p
""")
def snap_to_grid(spark, sf_dir):
    s = names.snapped(F.col("y_pred"), 0.1)
    clamped = F.when(F.col("y_pred").isNotNull(), F.least(F.greatest(s, F.lit(0.1)), F.lit(1.0)))
    return views.predictions(spark, sf_dir).select("record", (F.round(s, 6) + 0.0).alias("snapped"), F.round(clamped, 6).alias("clamped"))


@query("regression_report", f"""
WITH {views.PREDICTIONS}, e AS (SELECT *, y_pred - y_true AS e FROM p)
SELECT round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias, count(e) AS n, round(1 - sum(e * e) / (count(e) * var_pop(y_true) FILTER (e IS NOT NULL)), 6) AS r2,
       round(quantile_cont(abs(e), 0.5), 6) AS p50, round(quantile_cont(abs(e), 0.9), 6) AS p90, round(quantile_cont(abs(e), 0.95), 6) AS p95, avg(abs(e)) < 0.05 AS goal_met, count(DISTINCT run) AS runs, count(*) AS rows
FROM e
""")
def regression_report(spark, sf_dir):
    p = views.predictions(spark, sf_dir)
    out = p.agg(*metrics.errors("y_true", "y_pred"), *metrics.error_quantiles("y_true", "y_pred", {"p50": 0.5, "p90": 0.9, "p95": 0.95}), F.count_distinct("run").alias("runs"), F.count(F.lit(1)).alias("rows"))
    return out.select(*rounded("mae", "rmse", "bias"), "n", *rounded("r2", "p50", "p90", "p95"), (F.col("mae") < 0.05).alias("goal_met"), "runs", "rows")


_RELIABLE = """round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias, count(e) AS n, round(quantile_cont(abs(e), 0.5), 6) AS p50, round(quantile_cont(abs(e), 0.75), 6) AS p75,
 round(quantile_cont(abs(e), 0.9), 6) AS p90, round(quantile_cont(abs(e), 0.95), 6) AS p95, round(max(abs(e)), 6) AS worst,
 round(avg(CASE WHEN abs(e) <= 0.05 THEN 1.0 ELSE 0 END), 6) AS within_05, round(avg(CASE WHEN abs(e) <= 0.1 THEN 1.0 ELSE 0 END), 6) AS within_10, round(avg(CASE WHEN abs(e) <= 0.15 THEN 1.0 ELSE 0 END), 6) AS within_15"""
_MEASURES = ("mae", "rmse", "bias", "p50", "p75", "p90", "p95", "worst", "within_05", "within_10", "within_15")


def _reliability(by, sql_by):
    name = f"reliability_by_{by}" if by else "reliability_overall"
    sql = f"WITH {views.PREDICTIONS}, e AS (SELECT *, y_pred - y_true AS e FROM p) SELECT {sql_by}{_RELIABLE} FROM e" + (f" GROUP BY {by}" if by else "")

    @query(name, sql)
    def run(spark, sf_dir):
        p = views.predictions(spark, sf_dir)
        grouped = p.groupBy(by) if by else p.groupBy()
        return grouped.agg(*metrics.reliability("y_true", "y_pred")).select(*([by] if by else []), "n", *rounded(*_MEASURES))


_reliability(None, "")
_reliability("level", "level, ")
_reliability("run", "run, ")


@query("sigma_coverage", f"""
WITH {views.PREDICTIONS}, e AS (SELECT *, y_pred - y_true AS e FROM p)
SELECT run, round(avg(CASE WHEN abs(e) <= sigma THEN 1.0 WHEN e IS NOT NULL THEN 0 END), 6) AS coverage_1sigma, round(avg(CASE WHEN abs(e) <= 2 * sigma THEN 1.0 WHEN e IS NOT NULL THEN 0 END), 6) AS coverage_2sigma,
       round(avg(sigma), 6) AS mean_sigma, count(*) AS n_sigma, round(avg(e), 6) AS bias, round(corr(y_pred, y_true), 6) AS correlation FROM e GROUP BY run
""")
def sigma_coverage(spark, sf_dir):
    p = views.predictions(spark, sf_dir).withColumn("e", F.col("y_pred") - F.col("y_true"))
    out = p.groupBy("run").agg(*metrics.coverage("e", "sigma"), F.avg("e").alias("bias"), F.corr("y_pred", "y_true").alias("correlation"))
    return out.select("run", *rounded("coverage_1sigma", "coverage_2sigma", "mean_sigma"), "n_sigma", *rounded("bias", "correlation"))


@query("reference_against_batch", f"""
WITH {views.PREDICTIONS}, m AS (SELECT run, avg(abs(y_pred - y_true)) AS mae FROM p GROUP BY run)
SELECT run, round(mae, 6) AS mae, round(mae - 0.0163, 6) AS delta, round(mae / nullif(0.0163::DOUBLE, 0), 5) AS ratio FROM m
""")
def reference_against_batch(spark, sf_dir):
    m = views.predictions(spark, sf_dir).groupBy("run").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"))
    return m.select("run", *rounded("mae"), F.round(F.col("mae") - 0.0163, 6).alias("delta"), F.round(F.try_divide("mae", F.lit(0.0163)), 5).alias("ratio"))


@query("class_report", f"""
WITH {views.CLASSED}, c AS (SELECT truth AS class FROM cl UNION SELECT pred FROM cl),
n AS (SELECT class, (SELECT count(*) FROM cl WHERE truth = class) AS support, (SELECT count(*) FROM cl WHERE pred = class) AS predicted, (SELECT count(*) FROM cl WHERE truth = class AND pred = class) AS hits FROM c),
m AS (SELECT class, support, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM n)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, support FROM m
""")
def class_report(spark, sf_dir):
    return metrics.per_class(views.classed(spark, sf_dir), "truth", "pred").select("class", *rounded("precision", "recall", "f1"), "support")


@query("class_report_by_run", f"""
WITH {views.CLASSED}, c AS (SELECT run, truth AS class FROM cl UNION SELECT run, pred FROM cl),
n AS (SELECT c.run, c.class, count(*) FILTER (truth = class) AS support, count(*) FILTER (pred = class) AS predicted, count(*) FILTER (truth = class AND pred = class) AS hits FROM c JOIN cl ON c.run = cl.run GROUP BY ALL),
m AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM n)
SELECT run, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)), 6) AS macro_f1, CAST(sum(support) AS BIGINT) AS n FROM m GROUP BY run
""")
def class_report_by_run(spark, sf_dir):
    return metrics.classification(views.classed(spark, sf_dir), "truth", "pred", ("run",)).select("run", *rounded("accuracy", "balanced_accuracy", "macro_f1"), "n")


@query("confusion_matrix", f"""
WITH {views.CLASSED} SELECT truth, count(*) FILTER (pred = 0) AS "0", count(*) FILTER (pred = 1) AS "1", count(*) FILTER (pred = 2) AS "2", count(*) FILTER (pred = 3) AS "3" FROM cl GROUP BY truth
""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(views.classed(spark, sf_dir), "truth", "pred", [0, 1, 2, 3])


@query("class_weights", f"""
WITH {views.CLASSED}, c AS (SELECT truth, count(*) AS n FROM cl GROUP BY truth) SELECT truth, n, round((1.0::DOUBLE / n) / avg(1.0::DOUBLE / n) OVER (), 6) AS weight FROM c
""")
def class_weights(spark, sf_dir):
    return metrics.class_weights(views.classed(spark, sf_dir), "truth").select("truth", "n", *rounded("weight"))


@query("error_histogram", f"""
WITH {views.PREDICTIONS}, e AS (SELECT y_pred - y_true AS e FROM p WHERE y_pred IS NOT NULL)
SELECT CAST(least(floor((e + 0.1501) / (0.3002::DOUBLE / 25)) + 1, 25) AS INTEGER) AS bin, count(*) AS n FROM e WHERE e BETWEEN -0.1501 AND 0.1501 GROUP BY 1
""")
def error_histogram(spark, sf_dir):
    p = views.predictions(spark, sf_dir).select((F.col("y_pred") - F.col("y_true")).alias("e"))
    return metrics.histogram(p, "e", -0.1501, 0.1501, 25)
