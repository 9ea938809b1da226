"""Queries over record tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kerfline.functions import names
from kerfline.operators import metrics, records
from kerfline.plans import views
from kerfline.plans.catalog import query
from kerfline.plans.fusion import _KEY, rounded


@query("step_hole_keys", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN 'step=' || printf('%03d', o_orderkey % 1300) || '__hole=' || chr(CAST(65 + o_orderkey % 3 AS INTEGER)) || (o_orderkey % 8) END AS key FROM orders
""")
def step_hole_keys(spark, sf_dir):
    k = F.col("o_orderkey")
    step = F.when(k % 7 != 0, F.concat((k % 1300).cast("string"), F.when(k % 2 == 0, ".0").otherwise("")))
    hole = F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), F.chr(65 + k % 3), (k % 8).cast("string")))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", records.step_key(step, hole).alias("key"))


@query("mirrored_holes", """
WITH h AS (SELECT p_partkey, substr('ABCDEFG', CAST(p_partkey % 7 AS INTEGER) + 1, 1) AS l, CAST(p_size % 7 AS INTEGER) + 1 AS n FROM part)
SELECT p_partkey, substr('GFEDCBA', CAST(p_partkey % 7 AS INTEGER) + 1, 1) || (8 - n) AS rot180, l || (8 - n) AS mirror_col4, l || n AS same FROM h
""")
def mirrored_holes(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    hole = F.concat(F.lit(" "), F.lower(F.substring(F.lit("ABCDEFG"), (F.col("p_partkey") % 7 + 1).cast("int"), F.lit(1))), (F.col("p_size") % 7 + 1).cast("string"))
    return p.select("p_partkey", *(records.mirrored_hole(hole, m).alias(m) for m in ("rot180", "mirror_col4", "same")))


@query("file_modalities", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'airborne' WHEN 1 THEN 'structure' END AS modality FROM part
""")
def file_modalities(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    folder = F.element_at(F.array(F.lit("Airborne"), F.lit("structure"), F.lit("other")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select("p_partkey", records.modality_of(F.concat(F.lit("/data/raw/"), folder, F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".wav"))).alias("modality"))


@query("resolved_paths", """
WITH f AS (SELECT '/a/' || s_suppkey AS path FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT '/b/' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0),
r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '/x/' || s_suppkey WHEN s_suppkey % 7 = 0 THEN '' ELSE CAST(s_suppkey AS VARCHAR) END AS raw FROM supplier)
SELECT s_suppkey, CASE WHEN raw = '' THEN NULL WHEN raw LIKE '/%' THEN raw ELSE coalesce(a.path, b.path, '/b/' || raw) END AS resolved
FROM r LEFT JOIN f a ON a.path = '/a/' || raw LEFT JOIN f b ON b.path = '/b/' || raw
""")
def resolved_paths(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    files = s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("/a/"), k).alias("path")).union(s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("/b/"), k)))
    raw = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("/x/"), k)).when(F.col("s_suppkey") % 7 == 0, " ").otherwise(k)
    return records.resolved(s.select("s_suppkey", raw.alias("raw")), "raw", ["/a", "/b"], files).select("s_suppkey", "resolved")


@query("left_join_chain", """
SELECT o_orderkey, round(w.total, 2) AS total, w.windows, c.c_mktsegment, n.n_name FROM orders
LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS total, count(*) AS windows FROM lineitem WHERE l_linenumber > 2 GROUP BY l_orderkey) w ON o_orderkey = w.l_orderkey
LEFT JOIN customer c ON o_custkey = c.c_custkey AND c.c_custkey % 3 <> 0 LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
""")
def left_join_chain(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    w = views.table(spark, sf_dir, "lineitem").where("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("total"), F.count(F.lit(1)).alias("windows"))
    c = views.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    out = records.enriched(records.enriched(records.enriched(o, "o_orderkey", w), "c_custkey", c), "n_nationkey", views.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return out.select("o_orderkey", F.round("total", 2).alias("total"), "windows", "c_mktsegment", "n_name")


@query("step_timeline", f"""
WITH {views.RECORD_NAMES}, s AS (SELECT *, split_part(record_name, '__seg', 1) AS run, try_cast(nullif(regexp_extract(record_name, '(?i)__step([0-9]+)__', 1), '') AS INTEGER) AS step FROM rn)
SELECT row_idx, run, coalesce(CAST(step AS DOUBLE), CAST(row_number() OVER (PARTITION BY run ORDER BY step NULLS LAST, record_name, row_idx) AS DOUBLE)) AS position FROM s
""")
def step_timeline(spark, sf_dir):
    n = F.col("record_name")
    s = views.record_names(spark, sf_dir).withColumn("run", names.root(n)).withColumn("step", names.step(n)).withColumn("at", F.struct("record_name", "row_idx"))
    return records.timeline(s, "step", "at", "run").select("row_idx", "run", "position")


@query("best_candidate", """
WITH m AS (SELECT l_suppkey AS run, l_linenumber AS model, avg(abs(l_discount - l_tax)) AS mae, avg(l_quantity) AS cv, sqrt(avg(pow(l_discount - l_tax, 2))) AS rmse, max(l_extendedprice) AS r2 FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(mae, 9), round(cv, 9), round(rmse, 9), r2 DESC, model) AS rn FROM m)
SELECT run, model, round(mae, 7) AS mae, round(rmse, 7) AS rmse FROM r WHERE rn <= 2
""")
def best_candidate(spark, sf_dir):
    e = F.col("l_discount") - F.col("l_tax")
    m = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("model"))
    m = m.agg(F.avg(F.abs(e)).alias("mae"), F.avg("l_quantity").alias("cv"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max("l_extendedprice").alias("r2"))
    order = [F.round("mae", 9), F.round("cv", 9), F.round("rmse", 9), F.desc("r2"), F.col("model")]
    return records.best(m, order, 2, "run").select("run", "model", *rounded("mae", "rmse", digits=7))


@query("newest_files", "SELECT user_id AS folder, arg_max(event_id, (ts, event_id)) AS newest FROM events GROUP BY user_id")
def newest_files(spark, sf_dir):
    return views.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("folder")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))


@query("source_comparison", f"""
WITH {views.BUNDLES}, r AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY CASE WHEN record_name = '130' THEN 0 ELSE 1 END, row_idx) AS rn FROM b)
SELECT modality, record_name, round(y_pred, 4) AS y_pred, sigma FROM r WHERE rn = 1
""")
def source_comparison(spark, sf_dir):
    return records.chosen_source(views.bundles(spark, sf_dir), "130", "modality").select("modality", "record_name", F.round("y_pred", 4).alias("y_pred"), "sigma")


@query("holdout_evaluation", f"""
WITH {views.PREDICTIONS}, s AS (SELECT run, y_true, y_pred AS raw, round_even(y_pred / 0.1::DOUBLE, 0) * 0.1::DOUBLE AS snapped FROM p WHERE y_pred IS NOT NULL)
SELECT run, round(avg(abs(snapped - y_true)), 6) AS mae, round(avg(abs(raw - y_true)), 6) AS mae_raw, round(sqrt(avg(pow(snapped - y_true, 2))), 6) AS rmse, round(1 - sum(pow(snapped - y_true, 2)) / (count(*) * var_pop(y_true)), 6) AS r2,
       count(*) AS rows, avg(abs(snapped - y_true)) < 0.06 AS goal_met, round(avg(abs(snapped - y_true)) / 0.1, 6) AS fraction_of_step FROM s GROUP BY run
""")
def holdout_evaluation(spark, sf_dir):
    p = views.predictions(spark, sf_dir).where("y_pred IS NOT NULL").withColumn("snapped", names.snapped(F.col("y_pred"), 0.1))
    return metrics.holdout(p, "y_true", "y_pred", "snapped", 0.06, 0.1, "run").select("run", *rounded("mae", "mae_raw", "rmse", "r2"), "rows", "goal_met", *rounded("fraction_of_step"))


@query("step_decision_overall", f"""
WITH {views.PREDICTIONS}, l AS (SELECT unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]::DOUBLE[]) AS level), q AS (SELECT * FROM p WHERE y_pred IS NOT NULL),
n AS (SELECT record, arg_min(l.level, (round(abs(l.level - y_true), 9), l.level)) AS t, arg_min(l.level, (round(abs(l.level - y_pred), 9), l.level)) AS d, min(abs(l.level + 0.05 - y_pred)) FILTER (l.level < 1.0) > 0.015 AS sure FROM q, l GROUP BY record),
o AS (SELECT *, CASE WHEN t = d THEN 1.0 ELSE 0 END AS hit, round_even(abs(t - d) / 0.1, 0) AS off FROM n)
SELECT count(*) AS n, count(*) FILTER (sure) AS n_confident, round(avg(CASE WHEN sure THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(CASE WHEN sure THEN 0.0 ELSE 1 END), 6) AS abstention, round(avg(hit), 6) AS forced_accuracy, round(avg(hit) FILTER (sure), 6) AS confident_accuracy,
       round(avg(CASE WHEN sure THEN hit ELSE 0 END), 6) AS decided_accuracy, round(avg(CASE WHEN off >= 1 THEN 1.0 ELSE 0 END) FILTER (sure), 6) AS off_by_1, round(avg(CASE WHEN off >= 2 THEN 1.0 ELSE 0 END) FILTER (sure), 6) AS off_by_2 FROM o
""")
def step_decision_overall(spark, sf_dir):
    levels = tuple(i / 10 for i in range(1, 11))
    p = views.predictions(spark, sf_dir).where("y_pred IS NOT NULL")
    return metrics.step_decisions(p, "y_true", "y_pred", levels, 0.1, 0.015)


@query("final_predictions", f"""
WITH {views.PREDICTIONS} SELECT record, round(y_pred, 6) AS y_pred, round(y_true, 6) AS y_true, round(y_pred - y_true, 6) + 0.0 AS residual_mm, round(abs(y_pred - y_true), 6) AS abs_residual_mm, sigma,
  CASE WHEN sigma < 0.05 THEN 'high' WHEN sigma < 0.15 THEN 'medium' ELSE 'low' END AS confidence_label, round(abs(y_pred - y_true) / sigma, 5) AS z_abs, abs(y_pred - y_true) <= sigma AS within_1sigma, abs(y_pred - y_true) <= 2 * sigma AS within_2sigma FROM p
""")
def final_predictions(spark, sf_dir):
    p = views.predictions(spark, sf_dir).select("record", "y_pred", "sigma", F.lit(None).cast("double").alias("y_true"), F.col("y_true").alias("depth_mm"), F.lit("old").alias("residual"))
    out = records.with_truth(p, sigma=True)
    return out.select("record", *rounded("y_pred", "y_true"), (F.round("residual_mm", 6) + 0.0).alias("residual_mm"), *rounded("abs_residual_mm"), "sigma", "confidence_label", *rounded("z_abs", digits=5), "within_1sigma", "within_2sigma")


@query("loaded_bundle", f"""
WITH {views.RECORD_NAMES} SELECT 'airborne' AS modality, 0.0163::DOUBLE AS validation_mae, {_KEY} AS record_name, row_idx, round((row_idx % 97) / 97.0::DOUBLE, 6) AS y_pred, 0.0::DOUBLE AS sigma, CASE WHEN row_idx % 31 <> 0 THEN (row_idx % 11) / 8.0::DOUBLE END AS y_true FROM rn
""")
def loaded_bundle(spark, sf_dir):
    r = views.record_names(spark, sf_dir).withColumn("y_pred", F.round((F.col("row_idx") % 97) / F.lit(97.0), 6)).withColumn("depth_mm", names.depth(F.col("record_name")))
    return records.bundle(r, "airborne", 0.0163)


@query("expected_segments", """
SELECT CAST(s_suppkey AS VARCHAR) AS stem, CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey ELSE 25 END AS INTEGER) AS expected FROM supplier
""")
def expected_segments(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier")
    stem = F.col("s_suppkey").cast("string").alias("stem")
    counts = s.where("s_suppkey % 3 = 0").select(stem, F.col("s_nationkey").cast("int").alias("expected"))
    return records.expected_counts(s.select(stem), counts).select("stem", "expected")


@query("position_holdout", """
WITH r AS (SELECT o_orderkey, o_orderkey % 12 AS step, o_orderpriority AS label FROM orders),
k AS (SELECT *, CAST('0x' || substr(md5('7:' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS draw FROM r WHERE step NOT IN (3, 7))
SELECT o_orderkey, CASE WHEN step IN (3, 7) THEN 'test' WHEN draw < 0.2 THEN 'val' ELSE 'train' END AS split FROM r LEFT JOIN k USING (o_orderkey, step, label)
""")
def position_holdout(spark, sf_dir):
    from kerfline.operators import splits

    o = views.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 12).alias("step"))
    return splits.by_position(o, "step", [3, 7], "o_orderkey", 0.2, 7).select("o_orderkey", "split")


@query("training_windows", """
WITH f AS (SELECT user_id AS file_id, count(*) AS n FROM events GROUP BY user_id), w AS (SELECT file_id, unnest(range(0, greatest(1, n - 16 + 1), 8)) AS start FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY md5('5:' || (file_id * 1000003 + start)), start) AS rn FROM w)
SELECT file_id, start FROM r WHERE rn <= 4
""")
def training_windows(spark, sf_dir):
    from kerfline.operators import splits

    files = views.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("file_id")).agg(F.count(F.lit(1)).alias("frames"))
    return splits.windows(files, "file_id", "frames", 16, 8, most=4, seed=5).select("file_id", "start")


@query("final_epochs", "SELECT CAST(floor(quantile_cont(p_size, 0.5)) AS INTEGER) AS epochs FROM part")
def final_epochs(spark, sf_dir):
    return records.epochs(views.table(spark, sf_dir, "part"), "p_size")


@query("rounded_numbers", "SELECT s_suppkey, round_even(s_acctbal / 7.0::DOUBLE, 4) AS share, s_name FROM supplier")
def rounded_numbers(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier")
    return records.rounded(s.select("s_suppkey", (F.col("s_acctbal") / F.lit(7.0)).alias("share"), "s_name"))


@query("localised_codes", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Bau' WHEN 'MACHINERY' THEN 'Maschinen' ELSE c_mktsegment END AS label FROM customer
""")
def localised_codes(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select("c_custkey", records.localised(F.col("c_mktsegment"), {"BUILDING": "Bau", "MACHINERY": "Maschinen"}).alias("label"))


@query("run_ensemble", """
WITH m AS (SELECT l_suppkey % 13 AS model, avg(abs(l_discount - l_tax)) AS mae, avg(l_quantity) AS y FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY mae, model) AS rn FROM m)
SELECT count(*) AS members, round(avg(y), 6) AS y_pred FROM r WHERE rn <= 3
""")
def run_ensemble(spark, sf_dir):
    m = views.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 13).alias("model")).agg(F.avg(F.abs(F.col("l_discount") - F.col("l_tax"))).alias("mae"), F.avg("l_quantity").alias("y"))
    return m.orderBy("mae", "model").limit(3).agg(F.count(F.lit(1)).alias("members"), F.round(F.avg("y"), 6).alias("y_pred"))  # one row a model


@query("control_files", f"""
WITH {views.RECORD_NAMES}, c AS (SELECT row_idx, record_name, '(?i)^.*?_seg(\\d+).*?step(\\d+).*?__([A-G][1-7])__depth(\\d+\\.\\d+)\\.flac$' AS p FROM rn)
SELECT row_idx, CAST(regexp_extract(record_name, '(?i)^.*?_seg(\\d+).*?step(\\d+).*?__([A-G][1-7])__depth(\\d+\\.\\d+)\\.flac$', 1) AS INTEGER) AS seg, CAST(regexp_extract(record_name, '(?i)^.*?_seg(\\d+).*?step(\\d+).*?__([A-G][1-7])__depth(\\d+\\.\\d+)\\.flac$', 2) AS INTEGER) AS step,
       upper(regexp_extract(record_name, '(?i)^.*?_seg(\\d+).*?step(\\d+).*?__([A-G][1-7])__depth(\\d+\\.\\d+)\\.flac$', 3)) AS hole, CAST(regexp_extract(record_name, '(?i)^.*?_seg(\\d+).*?step(\\d+).*?__([A-G][1-7])__depth(\\d+\\.\\d+)\\.flac$', 4) AS DOUBLE) AS depth
FROM c WHERE regexp_matches(record_name, '(?i)^.*?_seg(\\d+).*?step(\\d+).*?__([A-G][1-7])__depth(\\d+\\.\\d+)\\.flac$')
""")
def control_files(spark, sf_dir):
    return records.control_files(views.record_names(spark, sf_dir), "record_name").select("row_idx", "seg", "step", "hole", "depth")


@query("segment_manifest", """
WITH s AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), g AS (SELECT rec, i / 4.0::DOUBLE AS start, i / 4.0::DOUBLE + 1.3 AS stop FROM s WHERE i % 9 = 0),
n AS (SELECT user_id AS rec, 50 AS sr, count(*) * 12 AS n FROM events GROUP BY user_id), d AS (SELECT p_partkey AS pos, CAST(p_size AS INTEGER) AS step, 'B' || (p_partkey % 8) AS hole_id, (p_size % 11) / 10.0::DOUBLE AS depth_mm FROM part WHERE p_partkey <= 5),
p AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY start) AS pos FROM g)
SELECT CAST(p.rec AS VARCHAR) || '__seg' || printf('%03d', p.pos) || '__step' || CASE WHEN d.step IS NULL THEN 'NA' ELSE printf('%03d', d.step) END || '__' || coalesce(hole_id, 'NA') || '__depth' || CASE WHEN depth_mm IS NULL THEN 'NA' ELSE printf('%.3f', depth_mm) END || '.wav' AS file_name,
       CAST(greatest(least(round_even(start * sr, 0), n), 0) AS BIGINT) AS first_sample, CAST(greatest(least(round_even(stop * sr, 0), n), 0) AS BIGINT) AS last_sample, CASE WHEN d.step IS NULL THEN 'extra_segment' ELSE 'matched' END AS status
FROM p LEFT JOIN d USING (pos) JOIN n ON p.rec = n.rec
""")
def segment_manifest(spark, sf_dir):
    from kerfline.operators import segmentation

    s = views.signals(spark, sf_dir).withColumn("rec", F.col("rec").cast("string"))
    spans = s.where("i % 9 = 0").select("rec", (F.col("i") / F.lit(4.0)).alias("start"), (F.col("i") / F.lit(4.0) + 1.3).alias("stop"))
    plan = views.table(spark, sf_dir, "part").where("p_partkey <= 5").select(F.col("p_partkey").alias("pos"), F.col("p_size").cast("int").alias("step"), F.concat(F.lit("B"), (F.col("p_partkey") % 8).cast("string")).alias("hole_id"), ((F.col("p_size") % 11) / F.lit(10.0)).alias("depth_mm"))
    recordings = s.groupBy("rec").agg(F.lit(50).alias("sr"), (F.count(F.lit(1)) * 12).alias("n"))
    return segmentation.manifest(spans, plan, recordings).select("file_name", "first_sample", "last_sample", "status")
