"""Ordered-sequence and segmentation queries over one signal a user."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kerfline.operators import segmentation, windows
from kerfline.plans import views
from kerfline.plans.catalog import query
from kerfline.plans.fusion import rounded

WIN = "(PARTITION BY rec ORDER BY i)"


@query("signal_sample_rate", f"""
WITH {views.SIGNALS}, d AS (SELECT rec, (us - lag(us) OVER (PARTITION BY rec ORDER BY us)) / 1e6::DOUBLE AS d FROM sig),
m AS (SELECT rec, quantile_cont(d, 0.5) AS dt, max(d) AS most, min(d) AS least FROM d WHERE d > 0 GROUP BY rec)
SELECT rec, CAST(round_even(1 / dt, 0) AS BIGINT) AS sr, round(dt, 2) AS dt, round(greatest(abs(most - dt), abs(least - dt)) / dt, 6) AS jitter FROM m
""")
def signal_sample_rate(spark, sf_dir):
    return windows.sample_rate(views.signals(spark, sf_dir).select("rec", (F.col("us") / 1e6).alias("t"))).select("rec", "sr", *rounded("dt", digits=2), *rounded("jitter"))


@query("first_difference", f"""
WITH {views.SIGNALS}, d AS (SELECT rec, x - lag(x) OVER {WIN} AS d, CASE WHEN sign(x - 250) <> sign(lag(x) OVER {WIN} - 250) THEN 1 ELSE 0 END AS z FROM sig)
SELECT rec, round(sum(abs(d)), 4) AS waveform_length, CAST(sum(z) AS BIGINT) AS crossings FROM d GROUP BY rec
""")
def first_difference(spark, sf_dir):
    s = views.signals(spark, sf_dir)
    z = F.when(F.signum(F.col("x") - 250) != F.signum(F.lag("x").over(windows.along("rec")) - 250), 1).otherwise(0)
    return s.select("rec", windows.difference().alias("d"), z.alias("z")).groupBy("rec").agg(F.round(F.sum(F.abs("d")), 4).alias("waveform_length"), F.sum("z").alias("crossings"))


@query("rolling_quantile", f"""
WITH {views.SIGNALS}, q AS (SELECT rec, i, CASE WHEN count(x) OVER w >= 5 THEN quantile_cont(x, 0.2) OVER w END AS q FROM sig WINDOW w AS (PARTITION BY rec ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
SELECT rec, i, round(q, 6) AS q FROM q
""")
def rolling_quantile(spark, sf_dir):
    half_wide = views.signals(spark, sf_dir).withColumn("q", F.when(F.count("x").over(windows.along("rec").rowsBetween(-4, 4)) >= 5, windows.rolling_quantile(0.2, 9)))
    return half_wide.select("rec", "i", *rounded("q"))


@query("filled_gaps", f"""
WITH {views.SIGNALS}, g AS (SELECT rec, i, CASE WHEN i % 5 IN (0, 3) THEN NULL ELSE x END AS x FROM sig),
e AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY rec ORDER BY i) AS a, min(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM g)
SELECT e.rec, e.i, round(coalesce(e.x, l.x + (r.x - l.x) * (e.i - a) / nullif(b - a, 0), l.x, r.x), 6) AS x FROM e LEFT JOIN g l ON l.rec = e.rec AND l.i = a LEFT JOIN g r ON r.rec = e.rec AND r.i = b
""")
def filled_gaps(spark, sf_dir):
    s = views.signals(spark, sf_dir).withColumn("x", F.when(~(F.col("i") % 5).isin(0, 3), F.col("x")))
    return s.select("rec", "i", F.round(windows.filled("x"), 6).alias("x"))


@query("median_filter", f"""
WITH {views.SIGNALS}, k AS (SELECT unnest(range(-2, 3)) AS k), n AS (SELECT rec, max(i) AS last FROM sig GROUP BY rec),
p AS (SELECT s.rec, s.i, least(greatest(s.i + k, 0), last) AS at FROM sig s JOIN n USING (rec), k)
SELECT p.rec, p.i, quantile_disc(s.x, 0.5) AS y FROM p JOIN sig s ON s.rec = p.rec AND s.i = p.at GROUP BY p.rec, p.i
""")
def median_filter(spark, sf_dir):
    return views.signals(spark, sf_dir).select("rec", "i", windows.median_filter(5).alias("y"))


@query("asymmetric_smoothing", f"""
WITH RECURSIVE {views.SIGNALS}, f AS (
  SELECT rec, i, x, x AS y FROM sig WHERE i = 0
  UNION ALL
  SELECT s.rec, s.i, s.x, f.y + (CASE WHEN s.x > f.y THEN 0.0625::DOUBLE ELSE 0.25::DOUBLE END) * (s.x - f.y) FROM f JOIN sig s ON s.rec = f.rec AND s.i = f.i + 1)
SELECT rec, i, round(y, 6) AS y FROM f
""")
def asymmetric_smoothing(spark, sf_dir):
    return windows.smoothed(views.signals(spark, sf_dir), 0.0625, 0.25).select("rec", "i", *rounded("y"))


@query("moving_rms", f"""
WITH {views.SIGNALS} SELECT rec, i, round(sqrt(avg(x * x) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), 6) AS rms FROM sig
""")
def moving_rms(spark, sf_dir):
    return views.signals(spark, sf_dir).select("rec", "i", F.round(windows.moving_rms(7), 6).alias("rms"))


@query("cumulative_rolloff", f"""
WITH {views.SIGNALS}, c AS (SELECT rec, i, sum(x) OVER (PARTITION BY rec ORDER BY i ROWS UNBOUNDED PRECEDING) AS c, sum(x) OVER (PARTITION BY rec) AS t FROM sig)
SELECT rec, min(i) FILTER (c >= 0.85 * t) AS at_85, min(i) FILTER (c >= 0.95 * t) AS at_95 FROM c GROUP BY rec
""")
def cumulative_rolloff(spark, sf_dir):
    c = views.signals(spark, sf_dir).select("rec", "i", F.sum("x").over(windows.along("rec").rowsBetween(W.unboundedPreceding, 0)).alias("c"), F.sum("x").over(W.partitionBy("rec")).alias("t"))
    return c.groupBy("rec").agg(*(F.min(F.when(F.col("c") >= q * F.col("t"), F.col("i"))).alias(f"at_{round(q * 100)}") for q in (0.85, 0.95)))


_FRAMED = f"""WITH {views.SIGNALS}, n AS (SELECT rec, count(*) AS n FROM sig GROUP BY rec),
fr AS (SELECT rec, unnest(range(0, (n - 16) // 8 + 1)) AS frame FROM n WHERE n >= 16),
s AS (SELECT f.rec, f.frame, g.i - f.frame * 8 AS j, g.x FROM fr f JOIN sig g ON g.rec = f.rec AND g.i BETWEEN f.frame * 8 AND f.frame * 8 + 15)"""


@query("frame_statistics", f"""
{_FRAMED}, m AS (SELECT rec, frame, avg(x) AS mean, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, kurtosis_pop(x) AS kurtosis FROM s GROUP BY rec, frame)
SELECT rec, frame, round(mean, 6) AS mean, round(rms, 6) AS rms, round(peak / nullif(rms, 0), 6) AS crest, round(kurtosis, 6) AS kurtosis FROM m
""")
def frame_statistics(spark, sf_dir):
    m = windows.frames(views.signals(spark, sf_dir), 16, 8).groupBy("rec", "frame").agg(F.avg("x").alias("mean"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"), F.kurtosis("x").alias("kurtosis"))
    return m.select("rec", "frame", *rounded("mean", "rms"), F.round(F.try_divide("peak", "rms"), 6).alias("crest"), *rounded("kurtosis"))


@query("frame_trends", f"""
{_FRAMED}, m AS (SELECT rec, frame, sqrt(avg(x * x)) AS rms FROM s GROUP BY rec, frame)
SELECT rec, round(avg(rms), 6) AS mean, round(stddev_pop(rms), 6) AS std, round(quantile_cont(rms, 0.5), 6) AS median, round(quantile_cont(rms, 0.75) - quantile_cont(rms, 0.25), 6) AS iqr, round(regr_slope(rms, frame), 6) AS slope, round(max(rms) - min(rms), 6) AS spread FROM m GROUP BY rec
""")
def frame_trends(spark, sf_dir):
    m = windows.frames(views.signals(spark, sf_dir), 16, 8).groupBy("rec", "frame").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    out = m.groupBy("rec").agg(F.avg("rms").alias("mean"), F.stddev_pop("rms").alias("std"), F.percentile("rms", 0.5).alias("median"), (F.percentile("rms", 0.75) - F.percentile("rms", 0.25)).alias("iqr"), F.regr_slope("rms", "frame").alias("slope"), (F.max("rms") - F.min("rms")).alias("spread"))
    return out.select("rec", *rounded("mean", "std", "median", "iqr", "slope", "spread"))


@query("tied_ranks", f"""
WITH {views.SIGNALS}, y AS (SELECT rec, i, floor(x / 10) AS y FROM sig)
SELECT rec, i, rank() OVER (PARTITION BY rec ORDER BY y) + (count(*) OVER (PARTITION BY rec, y) - 1) / 2.0::DOUBLE AS rank FROM y
""")
def tied_ranks(spark, sf_dir):
    return views.signals(spark, sf_dir).withColumn("y", F.floor(F.col("x") / 10)).select("rec", "i", windows.average_rank("y", ("rec",)).cast("double").alias("rank"))


@query("false_discovery_rate", """
WITH t AS (SELECT o_custkey % 20 AS family, o_orderkey AS test, (o_totalprice / 499979.0::DOUBLE) * (o_totalprice / 499979.0::DOUBLE) AS p FROM orders),
r AS (SELECT *, p * count(*) OVER (PARTITION BY family) / count(*) OVER (PARTITION BY family ORDER BY p) AS raw FROM t)
SELECT family, test, round(least(1.0, min(raw) OVER (PARTITION BY family ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r
""")
def false_discovery_rate(spark, sf_dir):
    u = F.col("o_totalprice") / views.SCALE
    t = views.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("family"), F.col("o_orderkey").alias("test"), (u * u).alias("p"))
    return windows.benjamini_hochberg(t, "p", ("family",)).select("family", "test", *rounded("q"))


@query("equal_count_parts", f"""
WITH {views.SIGNALS}, p AS (SELECT rec, x, ntile(10) OVER {WIN} AS part FROM sig), m AS (SELECT rec, part, sqrt(avg(x * x)) AS rms FROM p GROUP BY rec, part)
SELECT rec, count(*) AS parts, round(stddev_pop(rms) / nullif(avg(rms), 0), 6) AS cv FROM m GROUP BY rec
""")
def equal_count_parts(spark, sf_dir):
    p = views.signals(spark, sf_dir).select("rec", "x", F.ntile(10).over(windows.along("rec")).alias("part"))
    m = p.groupBy("rec", "part").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    return m.groupBy("rec").agg(F.count(F.lit(1)).alias("parts"), F.round(F.try_divide(F.stddev_pop("rms"), F.avg("rms")), 6).alias("cv"))


@query("lag_autocorrelation", f"""
WITH {views.SIGNALS}, l AS (SELECT rec, x, lag(x, 10) OVER {WIN} AS lagged FROM sig) SELECT rec, round(sum(x * lagged) / nullif(sum(x * x), 0), 6) AS autocorr_10 FROM l GROUP BY rec
""")
def lag_autocorrelation(spark, sf_dir):
    s = views.signals(spark, sf_dir).withColumn("lagged", F.lag("x", 10).over(windows.along("rec")))
    return s.groupBy("rec").agg(*windows.autocorrelation(10)).select("rec", *rounded("autocorr_10"))


_HYST = """machine AS (
  SELECT rec, i, 0 AS active, 0 AS ups, 0 AS downs, CAST(NULL AS BIGINT) AS opened, CAST(NULL AS BIGINT) AS closed FROM (SELECT DISTINCT rec, CAST(-1 AS BIGINT) AS i FROM sig)
  UNION ALL
  SELECT s.rec, s.i,
    CASE WHEN m.active = 0 AND s.x > 40 AND m.ups + 1 >= 2 THEN 1 WHEN m.active = 1 AND s.x < 25 AND m.downs + 1 >= 2 THEN 0 ELSE m.active END,
    CASE WHEN m.active = 0 AND s.x > 40 AND m.ups + 1 < 2 THEN m.ups + 1 ELSE 0 END,
    CASE WHEN m.active = 1 AND s.x < 25 AND m.downs + 1 < 2 THEN m.downs + 1 ELSE 0 END,
    CASE WHEN m.active = 0 AND s.x > 40 AND m.ups + 1 >= 2 THEN s.i - 1 END,
    CASE WHEN m.active = 1 AND s.x < 25 AND m.downs + 1 >= 2 THEN s.i - 2 END
  FROM machine m JOIN sig s ON s.rec = m.rec AND s.i = m.i + 1)"""


@query("hysteresis_segments", f"""
WITH RECURSIVE {views.SIGNALS}, {_HYST},
o AS (SELECT rec, opened AS start, row_number() OVER (PARTITION BY rec ORDER BY i) - 1 AS seg FROM machine WHERE opened IS NOT NULL),
c AS (SELECT rec, closed AS stop, row_number() OVER (PARTITION BY rec ORDER BY i) - 1 AS seg FROM machine WHERE closed IS NOT NULL)
SELECT o.rec, o.seg, o.start, coalesce(c.stop, (SELECT max(i) FROM sig WHERE sig.rec = o.rec)) AS stop FROM o LEFT JOIN c ON c.rec = o.rec AND c.seg = o.seg
""")
def hysteresis_segments(spark, sf_dir):
    return segmentation.hysteresis(views.signals(spark, sf_dir), 40, 25, 2, 2)


_SPANS = f"""{views.SIGNALS}, iv AS (SELECT rec, i + 0.5::DOUBLE AS start, i + 0.5::DOUBLE + x / 100 AS stop FROM sig WHERE x > 200)"""


def _spans(spark, sf_dir):
    return views.signals(spark, sf_dir).where("x > 200").select("rec", (F.col("i") + 0.5).alias("start"), (F.col("i") + 0.5 + F.col("x") / 100).alias("stop"))


@query("merged_intervals", f"""
WITH {_SPANS}, n AS (SELECT *, CASE WHEN start - max(stop) OVER (PARTITION BY rec ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1.0 THEN 0 ELSE 1 END AS new FROM iv),
g AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM n), m AS (SELECT rec, min(start) AS start, max(stop) AS stop FROM g GROUP BY rec, island)
SELECT rec, round(start, 6) AS start, round(stop, 6) AS stop FROM m WHERE stop - start >= 4
""")
def merged_intervals(spark, sf_dir):
    return segmentation.long_enough(segmentation.merged(_spans(spark, sf_dir), 1.0), 4.0).select("rec", *rounded("start", "stop"))


@query("padded_intervals", f"""
WITH {_SPANS} SELECT rec, round(greatest(start - 0.75, 0), 6) AS start, round(least(stop + 0.75, 40.0), 6) AS stop FROM iv WHERE least(stop + 0.75, 40.0) > greatest(start - 0.75, 0)
""")
def padded_intervals(spark, sf_dir):
    return segmentation.padded(_spans(spark, sf_dir).withColumn("length", F.lit(40.0)), 0.75, 0.75, "length").select("rec", *rounded("start", "stop"))


_DOE = "doe AS (SELECT row_number() OVER (ORDER BY p_partkey) AS pos, p_size AS step, chr(CAST(65 + p_partkey % 4 AS INTEGER)) || (p_partkey % 9) AS hole_id, round(p_retailprice / 1000, 3) AS depth_mm FROM part WHERE p_partkey <= 12)"


def _doe(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").where("p_partkey <= 12")
    return p.select(F.row_number().over(W.orderBy("p_partkey")).alias("pos"), F.col("p_size").alias("step"), F.concat(F.chr(65 + F.col("p_partkey") % 4), (F.col("p_partkey") % 9).cast("string")).alias("hole_id"), F.round(F.col("p_retailprice") / 1000, 3).alias("depth_mm"))


@query("doe_positional_join", f"""
WITH {_SPANS}, {_DOE}, n AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY start) AS pos FROM iv)
SELECT rec, n.pos, round(start, 6) AS start, coalesce(step, -1) AS step, hole_id, depth_mm, CASE WHEN step IS NULL THEN 'extra_segment' ELSE 'matched' END AS status FROM n LEFT JOIN doe ON n.pos = doe.pos
""")
def doe_positional_join(spark, sf_dir):
    out = segmentation.numbered(_spans(spark, sf_dir), _doe(spark, sf_dir))
    return out.select("rec", "pos", *rounded("start"), F.coalesce("step", F.lit(-1)).alias("step"), "hole_id", "depth_mm", "status")


@query("band_fallback", f"""
WITH {views.SIGNALS}, b AS (SELECT unnest([100, 200, 300, 400]) AS level), a AS (SELECT rec, CAST(level / 100 AS INTEGER) AS attempt, count(*) FILTER (x > level) AS found FROM sig, b GROUP BY rec, level),
r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY abs(found - 20), attempt) AS rn FROM a) SELECT rec, attempt, found FROM r WHERE rn = 1
""")
def band_fallback(spark, sf_dir):
    a = views.signals(spark, sf_dir).withColumn("level", F.explode(F.array(*map(F.lit, (100, 200, 300, 400))))).groupBy("rec", (F.col("level") / 100).cast("int").alias("attempt")).agg(F.count(F.when(F.col("x") > F.col("level"), 1)).alias("found"))
    return segmentation.best_band(a.withColumn("expected", F.lit(20)), "expected").select("rec", "attempt", "found")


@query("detected_bursts")
def detected_bursts(spark, sf_dir):
    """Each user's events as an envelope of 20 values a second, three bursts expected. A search by bisection, which SQL has no words for."""
    s = views.signals(spark, sf_dir)
    envelope = s.select("rec", F.lit(1).alias("band"), (F.col("i") / F.lit(20.0)).alias("t"), F.col("x").alias("db"))
    expected = s.groupBy("rec").agg(F.lit(3).alias("expected"), (F.max("i") / F.lit(20.0)).alias("duration"))
    return segmentation.detected(envelope, expected)
