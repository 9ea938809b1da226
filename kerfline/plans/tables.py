"""Joins, aggregates, top-k, ledgers, selection and splits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kerfline.functions import names
from kerfline.operators import ledger, metrics, selection, splits
from kerfline.plans import views
from kerfline.plans.catalog import query
from kerfline.plans.fusion import rounded

# Joins.


@query("run_file_joins", """
SELECT r.event_id AS run_id, a.event_id AS airborne_id, b.event_id AS structure_id, round(a.value + b.value, 4) AS total
FROM events r JOIN events a ON a.event_id = r.event_id - 1 JOIN events b ON b.event_id = r.event_id - 2 WHERE r.event_type = 'purchase'
""")
def run_file_joins(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    r, a, b = e.alias("r"), e.alias("a"), e.alias("b")
    out = r.where("event_type = 'purchase'").join(a, F.col("a.event_id") == F.col("r.event_id") - 1).join(b, F.col("b.event_id") == F.col("r.event_id") - 2)
    return out.select(F.col("r.event_id").alias("run_id"), F.col("a.event_id").alias("airborne_id"), F.col("b.event_id").alias("structure_id"), F.round(F.col("a.value") + F.col("b.value"), 4).alias("total"))


@query("incremental_worklist", """
WITH f AS (SELECT 'raw/' || o_orderkey AS path, epoch_us(o_orderdate) AS mtime_ns FROM orders),
d AS (SELECT 'raw/' || o_orderkey AS path, epoch_us(o_orderdate) + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS mtime_ns FROM orders WHERE o_orderkey % 3 <> 0)
SELECT path, mtime_ns FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.path = f.path AND d.mtime_ns = f.mtime_ns)
""")
def incremental_worklist(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    key = F.concat(F.lit("raw/"), F.col("o_orderkey").cast("string")).alias("path")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    done = o.where("o_orderkey % 3 <> 0").select(key, (at + F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0)).alias("mtime_ns"))
    return ledger.worklist(o.select(key, at.alias("mtime_ns")), done)


_LOCKS = """n AS (SELECT p_partkey AS key, sha256(p_name) AS sha FROM part WHERE p_partkey % 10 <> 3), b AS (SELECT p_partkey AS key, sha256(CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE p_name END) AS sha FROM part WHERE p_partkey % 10 <> 4)"""


@query("lock_drift", f"""
WITH {_LOCKS} SELECT coalesce(n.key, b.key) AS key, CASE WHEN b.sha IS NULL THEN 'added' WHEN n.sha IS NULL THEN 'missing' WHEN n.sha <> b.sha THEN 'changed' ELSE 'same' END AS kind FROM n FULL JOIN b ON n.key = b.key
""")
def lock_drift(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    now = p.where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("key"), F.sha2("p_name", 256).alias("sha"))
    before = p.where("p_partkey % 10 <> 4").select(F.col("p_partkey").alias("key"), F.sha2(F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).otherwise(F.col("p_name")), 256).alias("sha"))
    return ledger.drift(now, before)


@query("control_pairing", """
WITH t AS (SELECT o_custkey % 200 AS hole, min_by(o_orderkey, o_orderkey) AS seg FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
c AS (SELECT o_custkey % 200 AS hole, min_by(o_orderkey, o_orderkey) AS seg FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey % 5 <> 0 GROUP BY 1)
SELECT coalesce(t.hole, 199 - c.hole) AS hole, coalesce(t.seg, -1) AS treated, coalesce(c.seg, -1) AS control, CASE WHEN c.seg IS NULL THEN 'no control' WHEN t.seg IS NULL THEN 'no treatment' ELSE 'paired' END AS status FROM t FULL JOIN c ON t.hole = 199 - c.hole
""")
def control_pairing(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").withColumn("hole", F.col("o_custkey") % 200)
    t = o.where("o_orderkey % 2 = 0").groupBy("hole").agg(F.min_by("o_orderkey", "o_orderkey").alias("t"))
    c = o.where("o_orderkey % 2 = 1 AND o_custkey % 5 <> 0").groupBy((199 - F.col("hole")).alias("hole")).agg(F.min_by("o_orderkey", "o_orderkey").alias("c"))
    status = F.when(F.col("c").isNull(), "no control").when(F.col("t").isNull(), "no treatment").otherwise("paired")
    return t.join(c, "hole", "full_outer").select("hole", F.coalesce("t", F.lit(-1)).alias("treated"), F.coalesce("c", F.lit(-1)).alias("control"), status.alias("status"))


LEVELS = tuple(i / 10 for i in range(1, 11))


@query("step_decision", f"""
WITH {views.PREDICTIONS}, l AS (SELECT unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]::DOUBLE[]) AS level), q AS (SELECT * FROM p WHERE y_pred IS NOT NULL),
n AS (SELECT record, any_value(y_true) AS y_true, arg_min(l.level, (round(abs(l.level - y_true), 9), l.level)) AS true_step, arg_min(l.level, (round(abs(l.level - y_pred), 9), l.level)) AS pred_step, min(abs(l.level + 0.05 - y_pred)) FILTER (l.level < 1.0) AS margin FROM q, l GROUP BY record)
SELECT true_step, count(*) AS n, round(avg(CASE WHEN margin > 0.015 THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(CASE WHEN pred_step = true_step THEN 1.0 ELSE 0 END), 6) AS forced_accuracy,
       round(avg(CASE WHEN pred_step = true_step THEN 1.0 ELSE 0 END) FILTER (margin > 0.015), 6) AS confident_accuracy, round(avg(CASE WHEN abs(pred_step - true_step) BETWEEN 0.05 AND 0.15 THEN 1.0 ELSE 0 END), 6) AS off_by_one FROM n GROUP BY true_step
""")
def step_decision(spark, sf_dir):
    p = views.predictions(spark, sf_dir).where("y_pred IS NOT NULL")
    levels = F.array(*map(F.lit, LEVELS))
    nearest = lambda v: F.array_min(F.transform(levels, lambda x: F.struct(F.round(F.abs(x - v), 9).alias("d"), x.alias("x"))))["x"]
    margin = F.array_min(F.transform(F.array(*(F.lit(x + 0.05) for x in LEVELS[:-1])), lambda b: F.abs(b - F.col("y_pred"))))
    n = p.select(nearest(F.col("y_true")).alias("true_step"), nearest(F.col("y_pred")).alias("pred_step"), (margin > 0.015).alias("sure"))
    hit = (F.col("pred_step") == F.col("true_step")).cast("double")
    return n.groupBy("true_step").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("sure").cast("double")), 6).alias("coverage"), F.round(F.avg(hit), 6).alias("forced_accuracy"),
        F.round(F.avg(F.when(F.col("sure"), hit)), 6).alias("confident_accuracy"), F.round(F.avg(F.abs(F.col("pred_step") - F.col("true_step")).between(0.05, 0.15).cast("double")), 6).alias("off_by_one"),
    )


# Aggregates.


@query("windows_to_files", "SELECT user_id AS file_id, count(*) AS windows, round(quantile_cont(value, 0.5), 6) AS y_pred, arg_min(value, event_id) AS y_true FROM events GROUP BY user_id")
def windows_to_files(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("file_id")).agg(F.count(F.lit(1)).alias("windows"), F.round(F.percentile("value", 0.5), 6).alias("y_pred"), F.min_by("value", "event_id").alias("y_true"))


@query("windows_to_classes", """
WITH w AS (SELECT label AS file_id, embedding[1] + 0.5 AS p0, embedding[2] + 0.5 AS p1, embedding[3] + 0.5 AS p2 FROM embeddings), m AS (SELECT file_id, avg(CAST(p0 AS DOUBLE)) AS p0, avg(CAST(p1 AS DOUBLE)) AS p1, avg(CAST(p2 AS DOUBLE)) AS p2 FROM w GROUP BY file_id)
SELECT file_id, round(greatest(p0, p1, p2), 5) AS confidence, CASE greatest(p0, p1, p2) WHEN p0 THEN 0 WHEN p1 THEN 1 ELSE 2 END AS class_idx, CASE greatest(p0, p1, p2) WHEN p0 THEN 0.1 WHEN p1 THEN 0.2 ELSE 0.3 END::DOUBLE AS depth_mm FROM m
""")
def windows_to_classes(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    m = e.groupBy(F.col("label").alias("file_id")).agg(F.array(*(F.avg((F.col("embedding")[i] + F.lit(0.5).cast("float")).cast("double")) for i in range(3))).alias("p"))
    best = (F.array_position("p", F.array_max("p")) - 1).cast("int")
    return m.select("file_id", F.round(F.array_max("p"), 5).alias("confidence"), best.alias("class_idx"), F.element_at(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3)), best + 1).alias("depth_mm"))


@query("confidence_columns", """
WITH e AS (SELECT vec_id, list_reverse_sort(embedding[1:8]) AS s FROM embeddings) SELECT vec_id, round(CAST(s[1] AS DOUBLE), 5) AS top1, round(CAST(s[1] AS DOUBLE) - CAST(s[2] AS DOUBLE), 5) AS gap FROM e
""")
def confidence_columns(spark, sf_dir):
    s = views.table(spark, sf_dir, "embeddings").select("vec_id", F.array_sort(F.slice("embedding", 1, 8)).alias("s"))
    top, second = F.element_at("s", -1).cast("double"), F.element_at("s", -2).cast("double")
    return s.select("vec_id", F.round(top, 5).alias("top1"), F.round(top - second, 5).alias("gap"))


@query("cv_summary", """
WITH f AS (SELECT l_suppkey % 11 AS model, l_linenumber AS fold, avg(abs(l_discount - l_tax)) AS mae, sqrt(avg(pow(l_discount - l_tax, 2))) AS rmse FROM lineitem GROUP BY 1, 2)
SELECT model, round(avg(mae), 7) AS mae_mean, round(stddev_samp(mae), 7) AS mae_std, round(avg(rmse), 7) AS rmse_mean, round(stddev_pop(rmse), 7) AS rmse_pop FROM f GROUP BY model
""")
def cv_summary(spark, sf_dir):
    e = F.col("l_discount") - F.col("l_tax")
    f = views.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 11).alias("model"), "l_linenumber").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(F.pow(e, 2))).alias("rmse"))
    out = f.groupBy("model").agg(F.avg("mae").alias("mae_mean"), F.stddev_samp("mae").alias("mae_std"), F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_pop"))
    return out.select("model", *rounded("mae_mean", "mae_std", "rmse_mean", "rmse_pop", digits=7)).orderBy("mae_mean", "rmse_mean", F.desc("model"))


@query("sample_rate_mode", "WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY p_size) SELECT p_size AS sr, n FROM c ORDER BY n DESC, p_size LIMIT 1")
def sample_rate_mode(spark, sf_dir):
    return views.table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("sr")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sr").limit(1)


@query("confidence_mix", f"""
WITH {views.PREDICTIONS}, l AS (SELECT unnest(['high', 'medium', 'low', 'unknown']) AS label), c AS (SELECT CASE WHEN sigma < 0.05 THEN 'high' WHEN sigma < 0.15 THEN 'medium' ELSE 'low' END AS label, count(*) AS n FROM p GROUP BY 1) SELECT label, coalesce(n, 0) AS n FROM l LEFT JOIN c USING (label)
""")
def confidence_mix(spark, sf_dir):
    c = views.predictions(spark, sf_dir).groupBy(names.confidence(F.col("sigma")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, ("high", "medium", "low", "unknown")))).alias("label"))
    return every.join(c, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


@query("hole_grid", f"""
WITH {views.RECORD_NAMES}, h AS (SELECT {views.HOLE_SQL} AS hole, row_idx FROM rn)
SELECT substr(hole, 1, 1) AS "row", round(avg(row_idx) FILTER (substr(hole, 2) = '1'), 4) AS "1", round(avg(row_idx) FILTER (substr(hole, 2) = '2'), 4) AS "2", round(avg(row_idx) FILTER (substr(hole, 2) = '3'), 4) AS "3", round(avg(row_idx) FILTER (substr(hole, 2) = '4'), 4) AS "4" FROM h WHERE hole IS NOT NULL GROUP BY 1
""")
def hole_grid(spark, sf_dir):
    h = views.record_names(spark, sf_dir).withColumn("hole", names.hole(F.col("record_name"))).where("hole IS NOT NULL")
    return h.select(F.substring("hole", 1, 1).alias("row"), F.substring("hole", 2, 9).alias("col"), "row_idx").groupBy("row").pivot("col", ["1", "2", "3", "4"]).agg(F.round(F.avg("row_idx"), 4))


@query("run_kpis", f"""
WITH {views.PREDICTIONS} SELECT run, count(*) AS n, round(avg(sigma), 6) AS sigma_mean, round(quantile_cont(sigma, 0.5), 6) AS sigma_median, max(sigma) AS sigma_max, count(*) FILTER (sigma >= 0.135) AS low_confidence FROM p GROUP BY run
""")
def run_kpis(spark, sf_dir):
    return views.predictions(spark, sf_dir).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sigma"), 6).alias("sigma_mean"), F.round(F.percentile("sigma", 0.5), 6).alias("sigma_median"), F.max("sigma").alias("sigma_max"), F.count(F.when(F.col("sigma") >= 0.135, 1)).alias("low_confidence"))


@query("feature_profile", f"""
WITH {views.FEATURE_SQL}, l AS (UNPIVOT (SELECT f_quantity, f_discount, coalesce(f_tax, -999) AS f_tax, f_noise, f_flat FROM ft) ON f_quantity, f_discount, f_tax, f_noise, f_flat INTO NAME feature VALUE v), n AS (SELECT feature, CASE WHEN v = -999 THEN NULL ELSE v END AS v FROM l)
SELECT feature, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END), 6) AS missing, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_pop(v), 6) AS std FROM n GROUP BY feature
""")
def feature_profile(spark, sf_dir):
    long = selection.long_form(views.features(spark, sf_dir), list(views.FEATURES), "target")
    return selection.profile(long).select("feature", *rounded("missing", "median", "std"))


def _ranked_sql(feature: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
    return f"SELECT '{feature}' AS feature, {rank(feature)} AS x, {rank('target')} AS y, {rank('f_noise')} AS z FROM ft WHERE {feature} IS NOT NULL"


#: All features that vary; rank correlation with a constant one is not defined.
_VARYING = tuple(f for f in views.FEATURES if f != "f_flat")
_RANKED = " UNION ALL ".join(map(_ranked_sql, _VARYING))


@query("spearman_filter", f"WITH {views.FEATURE_SQL}, r AS ({_RANKED}) SELECT feature, round(corr(x, y), 6) AS r FROM r GROUP BY feature")
def spearman_filter(spark, sf_dir):
    long = selection.long_form(views.features(spark, sf_dir), list(_VARYING), "target")
    return selection.spearman(long, "target").select("feature", *rounded("r"))


@query("partial_rank_correlation", f"""
WITH {views.FEATURE_SQL}, r AS ({_RANKED}), c AS (SELECT feature, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz, sum(x * z) / sum(z * z) AS bx, sum(y * z) / sum(z * z) AS b_y FROM r WHERE feature <> 'f_noise' GROUP BY feature),
o AS (SELECT r.feature, corr(x - bx * z, y - b_y * z) AS r FROM r JOIN c USING (feature) GROUP BY r.feature)
SELECT feature, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS with_intercept, round(o.r, 6) AS through_origin, n FROM c JOIN o USING (feature)
""")
def partial_rank_correlation(spark, sf_dir):
    long = selection.long_form(views.features(spark, sf_dir).withColumn("held", F.col("f_noise")), [f for f in _VARYING if f != "f_noise"], "target", "held")
    a = selection.partial_spearman(long, "target", "held").withColumnRenamed("r", "with_intercept")
    b = selection.partial_spearman(long, "target", "held", intercept=False).select("feature", F.col("r").alias("through_origin"))
    return a.join(b, "feature").select("feature", *rounded("with_intercept", "through_origin"), "n")


@query("feature_diagnostics", f"""
WITH {views.FEATURE_SQL}, r AS ({_RANKED}), c AS (SELECT feature, count(*) AS n_used, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r WHERE feature <> 'f_noise' GROUP BY feature), p AS (SELECT *, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS pr FROM c)
SELECT feature, round(xy, 6) AS raw_r, round(xz, 6) AS control_r, round(pr, 6) AS partial_r, n_used, round(abs(xy) - abs(pr), 6) AS delta, abs(pr) > 0.15 AS survived_015, abs(pr) > 0.2 AS survived_020 FROM p
""")
def feature_diagnostics(spark, sf_dir):
    long = selection.long_form(views.features(spark, sf_dir).withColumn("held", F.col("f_noise")), [f for f in _VARYING if f != "f_noise"], "target", "held")
    return selection.diagnostics(long, "target", "held").select("feature", *rounded("raw_r", "control_r", "partial_r"), "n_used", *rounded("delta"), "survived_015", "survived_020")


_PAIRS = [(a, b) for i, a in enumerate(_VARYING) for b in _VARYING[i + 1 :]]


@query("feature_correlations", f"WITH {views.FEATURE_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM ft" for a, b in _PAIRS))
def feature_correlations(spark, sf_dir):
    return selection.correlations(views.features(spark, sf_dir), list(_VARYING)).select("a", "b", *rounded("r"))


@query("variance_between_runs", f"WITH {views.FEATURE_SQL}, g AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, run, var_samp({f}) AS v, avg({f}) AS m FROM ft GROUP BY run" for f in views.FEATURES) + """)
SELECT feature, round(avg(v), 5) AS within, round(var_samp(m), 5) AS between, round(var_samp(m) / nullif(avg(v), 0), 6) AS ratio FROM g GROUP BY feature
""")
def variance_between_runs(spark, sf_dir):
    long = selection.long_form(views.features(spark, sf_dir), list(views.FEATURES), "run")
    return selection.variance_split(long, "run").select("feature", *rounded("within", "between", digits=5), *rounded("ratio"))


@query("feature_families", """
WITH f AS (SELECT p_brand || '_' || p_partkey AS feature, p_size > 20 AS kept, (p_retailprice - 1300) / 1000.0::DOUBLE AS r FROM part)
SELECT split_part(feature, '_', 1) AS family, count(*) AS n, CAST(sum(CASE WHEN kept THEN 1 ELSE 0 END) AS BIGINT) AS kept, round(avg(CASE WHEN kept THEN 1.0 ELSE 0 END), 6) AS rate, round(quantile_cont(abs(r), 0.5), 6) AS median_r, round(max(abs(r)), 6) AS max_r FROM f GROUP BY 1
""")
def feature_families(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("_"), F.col("p_partkey").cast("string")).alias("feature"), (F.col("p_size") > 20).alias("kept"), ((F.col("p_retailprice") - 1300) / 1000).alias("r"))
    return selection.families(p).select("family", "n", "kept", *rounded("rate", "median_r", "max_r"))


@query("step_inference", """
WITH l AS (SELECT DISTINCT p_size / 10.0::DOUBLE AS level FROM part WHERE p_size % 3 <> 0), d AS (SELECT level - lag(level) OVER (ORDER BY level) AS d FROM l) SELECT round(quantile_cont(d, 0.5), 4) AS step FROM d WHERE d > 0
""")
def step_inference(spark, sf_dir):
    level = views.table(spark, sf_dir, "part").where("p_size % 3 <> 0").select((F.col("p_size") / F.lit(10.0)).alias("level")).distinct()
    return level.select((F.col("level") - F.lag("level").over(W.orderBy("level"))).alias("d")).where("d > 0").agg(F.round(F.percentile("d", 0.5), 4).alias("step"))


@query("level_summary", f"""
WITH {views.SIGNALS}, m AS (SELECT rec, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak FROM sig GROUP BY rec) SELECT rec, round(rms, 5) AS rms, round(20 * log10(rms + 1e-12::DOUBLE), 5) AS dbfs, peak, round(peak / nullif(rms, 0), 5) AS crest FROM m
""")
def level_summary(spark, sf_dir):
    m = views.signals(spark, sf_dir).groupBy("rec").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"))
    return m.select("rec", *rounded("rms", digits=5), F.round(20 * F.log10(F.col("rms") + 1e-12), 5).alias("dbfs"), "peak", F.round(F.try_divide("peak", "rms"), 5).alias("crest"))


# Top-k.


@query("latest_orders", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def latest_orders(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(25).select("o_orderkey", "o_orderdate")


@query("latest_by_type", "SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY event_type")
def latest_by_type(spark, sf_dir):
    return views.table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("succeeded_within_history", "WITH h AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200) SELECT o_orderkey FROM h WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def succeeded_within_history(spark, sf_dir):
    h = views.table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200)
    return h.where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey")


@query("worst_cases", f"WITH {views.PREDICTIONS} SELECT record, round(abs(y_pred - y_true), 6) AS err FROM p WHERE y_pred IS NOT NULL ORDER BY round(abs(y_pred - y_true), 6) DESC, record LIMIT 20")
def worst_cases(spark, sf_dir):
    err = F.round(F.abs(F.col("y_pred") - F.col("y_true")), 6).alias("err")
    return views.predictions(spark, sf_dir).where("y_pred IS NOT NULL").select("record", err).orderBy(F.desc("err"), "record").limit(20)


@query("best_and_worst", f"""
WITH {views.PREDICTIONS}, e AS (SELECT run, record, round(abs(y_pred - y_true), 6) AS err FROM p WHERE y_pred IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY err, record) AS best, row_number() OVER (PARTITION BY run ORDER BY err DESC, record) AS worst FROM e) SELECT run, record, err FROM r WHERE best <= 3 OR worst <= 3
""")
def best_and_worst(spark, sf_dir):
    e = views.predictions(spark, sf_dir).where("y_pred IS NOT NULL").select("run", "record", F.round(F.abs(F.col("y_pred") - F.col("y_true")), 6).alias("err"))
    w = W.partitionBy("run")
    return e.withColumn("b", F.row_number().over(w.orderBy("err", "record"))).withColumn("w", F.row_number().over(w.orderBy(F.desc("err"), "record"))).where("b <= 3 OR w <= 3").select("run", "record", "err")


# Ledgers.

_LOG = """lg AS (SELECT user_id AS run_id, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' ELSE 'failed' END AS status FROM events)"""


def _log(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "succeeded", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return views.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), status.alias("status"))


@query("run_states", f"WITH {_LOG} SELECT run_id, arg_max(status, seq) AS status FROM lg GROUP BY run_id")
def run_states(spark, sf_dir):
    return ledger.latest(_log(spark, sf_dir), "run_id", "seq", "status")


@query("illegal_run_moves", f"""
WITH {_LOG}, b AS (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY seq) AS before FROM lg)
SELECT run_id, seq, status FROM b WHERE CASE WHEN before IS NULL THEN status <> 'queued' WHEN before = 'queued' THEN status NOT IN ('running', 'failed') WHEN before = 'running' THEN status NOT IN ('succeeded', 'failed') ELSE true END
""")
def illegal_run_moves(spark, sf_dir):
    return ledger.illegal_moves(_log(spark, sf_dir)).select("run_id", "seq", "status")


@query("active_runs", f"WITH {_LOG}, s AS (SELECT run_id, arg_max(status, seq) AS status FROM lg GROUP BY run_id) SELECT run_id, status FROM s WHERE status IN ('queued', 'running')")
def active_runs(spark, sf_dir):
    return ledger.active_runs(_log(spark, sf_dir))


_FILES = """nw AS (SELECT 'f' || user_id AS path, event_type AS modality, CAST(floor(value) AS BIGINT) AS size, event_id AS mtime_ns, ts AS seen_at FROM events),
ls AS (SELECT path, arg_max(modality, (seen_at, mtime_ns)) AS modality, arg_max(size, (seen_at, mtime_ns)) AS size, arg_max(mtime_ns, (seen_at, mtime_ns)) AS mtime_ns, max(seen_at) AS seen_at FROM nw GROUP BY path),
od AS (SELECT 'f' || c_custkey AS path, 'view' AS modality, c_custkey AS size, c_custkey AS mtime_ns, CASE c_custkey % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'done' ELSE 'running' END AS status, TIMESTAMP '2024-01-01' AS seen_at FROM customer)"""


@query("file_upserts", f"""
WITH {_FILES}, m AS (SELECT coalesce(ls.path, od.path) AS path, coalesce(ls.modality, od.modality) AS modality, coalesce(ls.size, od.size) AS size, coalesce(ls.mtime_ns, od.mtime_ns) AS mtime_ns, coalesce(ls.seen_at, od.seen_at) AS seen_at,
  CASE WHEN ls.seen_at IS NULL THEN od.status WHEN od.status IN ('queued', 'running') THEN od.status ELSE 'ready' END AS status FROM od FULL JOIN ls ON od.path = ls.path)
SELECT *, (seen_at, path) = max((seen_at, path)) OVER (PARTITION BY modality) AS is_latest FROM m
""")
def file_upserts(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    seen = e.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("modality"), F.floor("value").alias("size"), F.col("event_id").alias("mtime_ns"), F.col("ts").alias("seen_at"))
    k = F.col("c_custkey")
    old = views.table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), F.lit("view").alias("modality"), k.alias("size"), k.alias("mtime_ns"), F.element_at(F.array(F.lit("queued"), F.lit("done"), F.lit("running")), (k % 3 + 1).cast("int")).alias("status"), F.lit("2024-01-01").cast("timestamp_ntz").alias("seen_at"))
    return ledger.upsert_files(old, seen)


# Splits.


@query("group_split", """
WITH g AS (SELECT DISTINCT l_suppkey AS run FROM lineitem), o AS (SELECT run, row_number() OVER (ORDER BY md5('0:' || run), run) AS p, count(*) OVER () AS n FROM g),
s AS (SELECT run, CASE WHEN p <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'test' WHEN p <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) + greatest(1, round_even(n * 0.1::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS split FROM o)
SELECT split, count(DISTINCT l_suppkey) AS runs, count(*) AS rows FROM lineitem JOIN s ON l_suppkey = run GROUP BY split
""")
def group_split(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"))
    return splits.by_group(li, "run", 0.7, 0.1).groupBy("split").agg(F.count_distinct("run").alias("runs"), F.count(F.lit(1)).alias("rows"))


@query("stratified_split", """
WITH r AS (SELECT doc_id, quality, percent_rank() OVER (PARTITION BY quality ORDER BY md5('4:' || doc_id), doc_id) AS pr FROM labels) SELECT doc_id, quality, CASE WHEN pr < 0.7 THEN 'train' WHEN pr < 0.85 THEN 'val' ELSE 'test' END AS split FROM r
""")
def stratified_split(spark, sf_dir):
    return splits.stratified(views.table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.7, 0.15, 4)


@query("split_overlap", """
WITH r AS (SELECT CAST(floor(c_acctbal) AS BIGINT) AS v, CASE c_custkey % 7 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM customer), f AS (SELECT v, max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS a, max(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS b, max(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS c FROM r GROUP BY v)
SELECT CAST(sum(a * b) AS BIGINT) AS train_val, CAST(sum(a * c) AS BIGINT) AS train_test, CAST(sum(b * c) AS BIGINT) AS val_test, CAST(sum(a * b * c) AS BIGINT) AS all_splits FROM f
""")
def split_overlap(spark, sf_dir):
    k = F.col("c_custkey") % 7
    r = views.table(spark, sf_dir, "customer").select(F.floor("c_acctbal").alias("v"), F.when(k == 0, "val").when(k == 1, "test").otherwise("train").alias("split"))
    return splits.overlap(r, "v")


@query("class_labels", "SELECT p_partkey, p_size / 100.0::DOUBLE AS depth_mm, dense_rank() OVER (ORDER BY p_size) - 1 AS class_idx FROM part")
def class_labels(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / F.lit(100.0)).alias("depth_mm"))
    return splits.labels(p, "depth_mm").withColumn("class_idx", F.col("class_idx").cast("long"))


@query("holdout_runs", """
WITH h AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 = 0) SELECT 'holdout' AS part, count(*) AS rows FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM h) UNION ALL SELECT 'rest', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM h)
""")
def holdout_runs(spark, sf_dir):
    held = views.table(spark, sf_dir, "supplier").where("s_suppkey % 9 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    a, b = splits.holdout(views.table(spark, sf_dir, "lineitem").select("l_suppkey"), "l_suppkey", held)
    return a.agg(F.lit("holdout").alias("part"), F.count(F.lit(1)).alias("rows")).unionByName(b.agg(F.lit("rest").alias("part"), F.count(F.lit(1)).alias("rows")))
