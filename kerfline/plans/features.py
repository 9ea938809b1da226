"""Feature queries: over samples in SQL where SQL can say it, else through the array kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerfline.operators import features, windows
from kerfline.plans import views
from kerfline.plans.catalog import query
from kerfline.plans.fusion import rounded

_SAMPLES = """sm AS (SELECT vec_id AS rec, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


def _samples(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("rec"), F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


@query("time_features", f"""
WITH {_SAMPLES}, d AS (SELECT *, x - lag(x) OVER (PARTITION BY rec ORDER BY i) AS d, CASE WHEN sign(x) <> sign(lag(x) OVER (PARTITION BY rec ORDER BY i)) THEN 1 ELSE 0 END AS z FROM sm),
m AS (SELECT rec, count(*) AS n, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, avg(abs(x)) AS mean, sum(abs(d)) AS length, kurtosis_pop(x) AS kurtosis, sum(x * x) AS energy, sum(z) AS z,
  quantile_cont(abs(x), 0.1) AS p10, quantile_cont(abs(x), 0.25) AS p25, quantile_cont(abs(x), 0.75) AS p75, quantile_cont(abs(x), 0.99) AS p99, avg(sqrt(abs(x))) AS root FROM d GROUP BY rec)
SELECT rec, round(rms, 6) AS rms, round(peak, 6) AS peak, round(mean, 6) AS mean, round(length, 5) AS waveform_length, round(peak / (rms + 1e-10::DOUBLE), 5) AS crest, round(rms / (mean + 1e-10::DOUBLE), 5) AS shape, round(peak / (mean + 1e-10::DOUBLE), 5) AS impulse,
  round(peak / (root * root + 1e-10::DOUBLE), 4) AS clearance, round(kurtosis, 5) AS kurtosis, round(ln(energy + 1e-10::DOUBLE), 5) + 0.0 AS log_energy, round(z / (2.0::DOUBLE * n), 6) AS zcr, round(p75 - p25, 6) AS iqr, round(20 * log10(p99 / (p10 + 1e-10::DOUBLE)), 4) AS dynamic_range_db FROM m
""")
def time_features(spark, sf_dir):
    w = windows.along("rec")
    before = F.lag("x").over(w)
    d = _samples(spark, sf_dir).select("rec", "x", (F.col("x") - before).alias("d"), F.when(F.signum("x") != F.signum(before), 1).otherwise(0).alias("z"))
    size = F.abs("x")
    m = d.groupBy("rec").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(size).alias("peak"), F.avg(size).alias("mean"), F.sum(F.abs("d")).alias("length"), F.kurtosis("x").alias("kurtosis"),
        F.sum(F.col("x") * F.col("x")).alias("energy"), F.sum("z").alias("z"), F.percentile(size, F.array(*map(F.lit, (0.1, 0.25, 0.75, 0.99)))).alias("p"), F.avg(F.sqrt(size)).alias("root"),
    )
    c, p = F.col, lambda i: F.col("p")[i]
    return m.select(
        "rec", *rounded("rms", "peak", "mean"), F.round("length", 5).alias("waveform_length"), F.round(c("peak") / (c("rms") + 1e-10), 5).alias("crest"), F.round(c("rms") / (c("mean") + 1e-10), 5).alias("shape"), F.round(c("peak") / (c("mean") + 1e-10), 5).alias("impulse"),
        F.round(c("peak") / (c("root") * c("root") + 1e-10), 4).alias("clearance"), F.round("kurtosis", 5).alias("kurtosis"), (F.round(F.log(c("energy") + 1e-10), 5) + 0.0).alias("log_energy"), F.round(c("z") / (2.0 * c("n")), 6).alias("zcr"),
        F.round(p(2) - p(1), 6).alias("iqr"), F.round(20 * F.log10(p(3) / (p(0) + 1e-10)), 4).alias("dynamic_range_db"),
    )


@query("hjorth_parameters", f"""
WITH {_SAMPLES}, d AS (SELECT *, x - lag(x) OVER (PARTITION BY rec ORDER BY i) AS d FROM sm), e AS (SELECT *, d - lag(d) OVER (PARTITION BY rec ORDER BY i) AS e FROM d),
m AS (SELECT rec, var_pop(x) AS activity, stddev_pop(d) / stddev_pop(x) AS mobility, stddev_pop(e) / stddev_pop(d) AS inner_mobility FROM e GROUP BY rec)
SELECT rec, round(activity, 6) AS activity, round(mobility, 5) AS mobility, round(inner_mobility / mobility, 5) AS complexity FROM m
""")
def hjorth_parameters(spark, sf_dir):
    d = _samples(spark, sf_dir).withColumn("d", windows.difference())
    e = d.withColumn("e", windows.difference("d"))
    m = e.groupBy("rec").agg(F.var_pop("x").alias("activity"), (F.stddev_pop("d") / F.stddev_pop("x")).alias("mobility"), (F.stddev_pop("e") / F.stddev_pop("d")).alias("inner"))
    return m.select("rec", *rounded("activity"), F.round("mobility", 5).alias("mobility"), F.round(F.col("inner") / F.col("mobility"), 5).alias("complexity"))


@query("permutation_entropy", f"""
WITH {_SAMPLES}, w AS (SELECT rec, x AS a, lead(x, 1) OVER (PARTITION BY rec ORDER BY i) AS b, lead(x, 2) OVER (PARTITION BY rec ORDER BY i) AS c FROM sm),
k AS (SELECT rec, (CASE WHEN a < b THEN 1 ELSE 0 END) + 2 * (CASE WHEN a < c THEN 1 ELSE 0 END) + 4 * (CASE WHEN b < c THEN 1 ELSE 0 END) AS motif FROM w WHERE c IS NOT NULL),
p AS (SELECT rec, motif, count(*) / sum(count(*)) OVER (PARTITION BY rec) AS p FROM k GROUP BY rec, motif)
SELECT rec, round(-sum(p * log2(p)) / log2(6), 5) AS entropy FROM p GROUP BY rec
""")
def permutation_entropy(spark, sf_dir):
    w = windows.along("rec")
    n = _samples(spark, sf_dir).select("rec", F.col("x").alias("a"), F.lead("x", 1).over(w).alias("b"), F.lead("x", 2).over(w).alias("c")).where("c IS NOT NULL")
    bit = lambda x, y: (F.col(x) < F.col(y)).cast("int")
    c = n.groupBy("rec", (bit("a", "b") + 2 * bit("a", "c") + 4 * bit("b", "c")).alias("motif")).agg(F.count(F.lit(1)).alias("n"))
    # one pass over a record's six motifs at most
    t = c.groupBy("rec").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return t.select("rec", F.round((F.log2("t") - F.col("s") / F.col("t")) / F.log2(F.lit(6.0)), 5).alias("entropy"))


@query("signal_similarity", """
WITH m AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) - CAST(list_avg(embedding) AS DOUBLE)) AS v FROM embeddings),
f AS (SELECT label, arg_min(v, vec_id) AS v FROM m GROUP BY label) SELECT m.vec_id, round(list_cosine_similarity(m.v, f.v), 5) AS cosine FROM m JOIN f USING (label)
""")
def signal_similarity(spark, sf_dir):
    mean = F.aggregate("e", F.lit(0.0), lambda a, x: a + x) / F.size("e")
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e")).withColumn("mean", mean)
    v = e.select("vec_id", "label", F.transform("e", lambda x: x - F.col("mean")).alias("v"))
    first = v.groupBy("label").agg(F.min_by("v", "vec_id").alias("f"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return v.join(first, "label").select("vec_id", F.round(dot("v", "f") / F.sqrt(dot("v", "v") * dot("f", "f")), 5).alias("cosine"))


@query("kernel_features")
def kernel_features(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return features.long(features.extract(e, "vec_id", "embedding", 64.0), "vec_id")


@query("spectrogram_images")
def spectrogram_images(spark, sf_dir):
    """Log-mel images of the vectors as signals; a front end's kernel, which SQL has no words for."""
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return features.images(e, "vec_id", "embedding", 64.0, 16, 4, bands=6, low=1.0)


@query("echo_reduction", """
SELECT user_id AS rec, round(10 * log10((avg(value * value) + 1e-12) / (avg(pow(value - 5, 2)) + 1e-12)), 5) AS erle_db FROM events GROUP BY user_id
""")
def echo_reduction(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), F.col("value").alias("d"), (F.col("value") - 5).alias("e"))
    power = lambda c: F.avg(F.col(c) * F.col(c)) + 1e-12
    return e.groupBy("rec").agg(F.round(10 * F.log10(power("d") / power("e")), 5).alias("erle_db"))


@query("window_deltas", f"""
WITH {views.SIGNALS}, w AS (SELECT rec, i // 8 AS win, avg(x) AS m FROM sig GROUP BY 1, 2), a AS (SELECT *, m - lag(m) OVER (PARTITION BY rec ORDER BY win) AS d FROM w), b AS (SELECT *, d - lag(d) OVER (PARTITION BY rec ORDER BY win) AS dd FROM a)
SELECT rec, CASE WHEN count(d) >= 2 THEN round(avg(d), 5) END AS d_mean, CASE WHEN count(d) >= 2 THEN round(stddev_pop(d), 5) END AS d_std, CASE WHEN count(d) >= 2 THEN round(max(d), 5) END AS d_max,
       CASE WHEN count(dd) >= 2 THEN round(avg(dd), 5) END AS dd_mean, CASE WHEN count(dd) >= 2 THEN round(stddev_pop(dd), 5) END AS dd_std, CASE WHEN count(dd) >= 2 THEN round(max(dd), 5) END AS dd_max FROM b GROUP BY rec
""")
def window_deltas(spark, sf_dir):
    w = views.signals(spark, sf_dir).groupBy("rec", F.floor(F.col("i") / 8).alias("win")).agg(F.avg("x").alias("m"))
    d = w.withColumn("d", windows.difference("m", by=("rec",), order="win"))
    d = d.withColumn("dd", windows.difference("d", by=("rec",), order="win"))
    enough = lambda f, c, name: F.when(F.count(c) >= 2, F.round(f(c), 5)).alias(name)
    stats = [enough(f, c, f"{c}_{n}") for c in ("d", "dd") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max))]
    return d.groupBy("rec").agg(*stats)
