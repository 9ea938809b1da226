"""Queries over long signals in chunks: decimation and scalograms of each user's events."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kerfline.functions import filters, scalograms as kernels
from kerfline.operators import chunks, decimation, inference, scalograms
from kerfline.plans import views
from kerfline.plans.catalog import query
from kerfline.plans.fusion import rounded

Q, CHUNK = 4, 64


def _recursion(name: str, source: str) -> str:
    """A pass of the filter in its transposed form over ``source(rec, idx, u)``, sample by sample."""
    sections = filters.chebyshev(filters.ORDER, filters.RIPPLE, filters.SHARE / Q)
    b, a = np.ones(1), np.ones(1)
    for s in sections:
        b, a = np.convolve(b, s[:3]), np.convolve(a, s[3:])
    gain, z = b.sum() / a.sum(), [0.0]
    for k in range(filters.ORDER, 0, -1):
        z.insert(0, b[k] - a[k] * gain + z[0])
    values = lambda v: "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in v) + "]"
    return f"""
{name} AS (
  SELECT rec, CAST(-1 AS BIGINT) AS idx, list_transform({values(z[:-1])}, lambda v: v * u) AS z, CAST(NULL AS DOUBLE) AS y FROM {source} WHERE idx = 0
  UNION ALL
  SELECT s.rec, s.idx, list_transform(range(2, {filters.ORDER + 2}), lambda i: {values(b)}[i] * s.u + coalesce(f.z[i], 0) - {values(a)}[i] * ({float(b[0])!r}::DOUBLE * s.u + f.z[1])), {float(b[0])!r}::DOUBLE * s.u + f.z[1]
  FROM {name} f JOIN {source} s ON s.rec = f.rec AND s.idx = f.idx + 1)"""


@query("decimated_signals", f"""
WITH RECURSIVE {views.SIGNALS}, n AS (SELECT rec, max(i) + 1 AS n FROM sig GROUP BY rec HAVING max(i) + 1 > {filters.EDGE}),
ends AS (SELECT n.rec, n, a.x AS first, b.x AS last FROM n JOIN sig a ON a.rec = n.rec AND a.i = 0 JOIN sig b ON b.rec = n.rec AND b.i = n - 1),
ext AS (
  SELECT s.rec, i + {filters.EDGE} AS idx, x AS u FROM sig s JOIN ends USING (rec)
  UNION ALL SELECT s.rec, {filters.EDGE} - i, 2 * first - x FROM sig s JOIN ends USING (rec) WHERE i BETWEEN 1 AND {filters.EDGE}
  UNION ALL SELECT s.rec, {filters.EDGE} + 2 * (n - 1) - i, 2 * last - x FROM sig s JOIN ends USING (rec) WHERE i BETWEEN n - 1 - {filters.EDGE} AND n - 2),
{_recursion("fwd", "ext")},
rev AS (SELECT f.rec, n + {2 * filters.EDGE} - 1 - idx AS idx, y AS u FROM fwd f JOIN n USING (rec) WHERE idx >= 0),
{_recursion("bwd", "rev")},
o AS (SELECT b.rec, n + {filters.EDGE} - 1 - idx AS i, y FROM bwd b JOIN n USING (rec) WHERE idx >= 0)
SELECT rec, i // {Q} AS i, round(y, 4) AS y FROM o JOIN n USING (rec) WHERE i BETWEEN 0 AND n - 1 AND i % {Q} = 0
""")
def decimated_signals(spark, sf_dir):
    """A quarter of the rate, by zero-phase low-pass filtering over chunks of 64 samples."""
    s = chunks.cut(views.signals(spark, sf_dir).select("rec", "i", "x"), CHUNK)
    return decimation.samples(decimation.decimated(s, Q, CHUNK)).select("rec", "i", F.round("x", 4).alias("y"))


BANK = kernels.Bank(1.0, 0.023, 0.41, 4)
_SCALES = ", ".join(f"({k}, {float(kernels.central_frequency() / f)!r}::DOUBLE)" for k, f in enumerate(BANK.frequencies))


@query("scalogram_images", f"""
WITH {views.SIGNALS}, b(band, s) AS (VALUES {_SCALES}), p AS (SELECT k, -8 + 16.0::DOUBLE * k / 1023 AS x FROM range(1024) t(k)),
g AS (SELECT k, sum(exp(-x * x / 2) * cos(5 * x)) OVER (ORDER BY k) * (16.0::DOUBLE / 1023) AS v FROM p),
a AS (SELECT band, s, unnest(range(CAST(ceil(s * 16 + 1) AS BIGINT))) AS j FROM b),
h AS (SELECT band, s, count(*) OVER (PARTITION BY band) - 1 - j AS m, v, count(*) OVER (PARTITION BY band) AS len FROM (SELECT * FROM a WHERE floor(j / (s * (16.0::DOUBLE / 1023))) < 1024) a JOIN g ON g.k = CAST(floor(j / (s * (16.0::DOUBLE / 1023))) AS BIGINT)),
d AS (SELECT band, m, sqrt(s) * v AS v, len FROM h UNION ALL SELECT band, m + 1, -sqrt(s) * v, len FROM h),
taps AS (SELECT band, m, -sum(v) AS w, (max(len) - 2) // 2 + 1 AS ahead FROM d GROUP BY band, m),
n AS (SELECT rec, max(i) + 1 AS n FROM sig GROUP BY rec),
c AS (SELECT s.rec, band, i - ahead + m AS t, sum(w * x) AS c FROM sig s JOIN n USING (rec) JOIN taps ON i - ahead + m BETWEEN 0 AND n - 1 GROUP BY ALL),
db AS (SELECT *, 20 * log10(greatest(abs(c), 1e-6::DOUBLE)) AS db FROM c),
z AS (SELECT rec, band, (db - avg(db) OVER (PARTITION BY rec)) / greatest(coalesce(stddev_samp(db) OVER (PARTITION BY rec), 0), 1e-6::DOUBLE) AS z FROM db)
SELECT rec, CAST(band AS INTEGER) AS band, count(*) AS n, round(avg(z), 4) + 0.0 AS mean, round(max(z), 4) AS most FROM z GROUP BY rec, band
""")
def scalogram_images(spark, sf_dir):
    """Mean and maximum of each band of the standardised image, over blocks shorter than the longest filter."""
    s = chunks.cut(views.signals(spark, sf_dir).select("rec", "i", "x"), CHUNK)
    image = scalograms.standardised(scalograms.scalogram(s, BANK, CHUNK)).select("rec", "band", F.explode("db").alias("z"))
    return image.groupBy("rec", "band").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean"), F.max("z").alias("most")).select("rec", "band", "n", (F.round("mean", 4) + 0.0).alias("mean"), *rounded("most", digits=4))


@query("mel_pictures")
def mel_pictures(spark, sf_dir):
    """The dashboard's picture of each embedding, taken as a signal of 8 kHz. Spectra, which SQL has no words for; tested against sums spelled out."""
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec"), F.col("embedding").alias("y"))
    return scalograms.pictures(e, "rec", "y", 8000.0, kernels.Picture(32, 24, 6, low=150, high=3500)).select("rec", "bands", "frames", "image", "error")


WINDOW, HOP, FILTERS, TAPS = 16, 8, 3, 4


def _network() -> inference.Convolutional:
    f, k = np.arange(FILTERS)[:, None], np.arange(TAPS)[None]
    return inference.Convolutional(((f + 2) * (k + 1) % 7 - 3) / 8.0, (np.arange(FILTERS)[:, None] + 1) / 4.0, np.array([-0.5]))


@query("window_predictions", f"""
WITH {views.SIGNALS}, n AS (SELECT rec, max(i) + 1 AS n FROM sig GROUP BY rec),
w AS (SELECT rec, unnest(range(0, greatest(n - {WINDOW}, 0) + 1, {HOP})) AS start FROM n),
t AS (SELECT rec, start, t, f, k FROM w, range({WINDOW - TAPS + 1}) a(t), range({FILTERS}) b(f), range({TAPS}) c(k)),
c AS (SELECT t.rec, start, f, t, sum(coalesce(x, 0) * (((f + 2) * (k + 1)) % 7 - 3) / 8.0::DOUBLE) AS v FROM t LEFT JOIN sig ON sig.rec = t.rec AND sig.i = start + t + k GROUP BY ALL),
p AS (SELECT rec, start, f, avg(greatest(v, 0)) AS h FROM c GROUP BY ALL), y AS (SELECT rec, start, sum(h * (f + 1) / 4.0::DOUBLE) - 0.5 AS y FROM p GROUP BY ALL)
SELECT rec, count(*) AS n_windows, round(quantile_cont(y, 0.5), 4) AS y_pred FROM y GROUP BY rec
""")
def window_predictions(spark, sf_dir):
    """A small convolutional network over windows of 16 samples, cut from chunks of 64; the median of each recording."""
    s = chunks.cut(views.signals(spark, sf_dir).select("rec", "i", "x"), CHUNK)
    out = inference.by_recording(inference.predict(inference.windows(s, WINDOW, HOP), _network()))
    return out.select("rec", "n_windows", F.round("y_pred", 4).alias("y_pred"))
