"""Finding bursts: kernels against plain forms, and whole recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerfline.functions import bursts
from kerfline.operators import segmentation

SR = 16_000


def recording(seconds=6.0, at=((1.0, 1.6), (2.6, 3.2), (4.3, 4.9))):
    g, t = np.random.default_rng(0), np.arange(int(seconds * SR)) / SR
    y = 0.01 * g.normal(size=len(t))
    for a, b in at:
        on = (t >= a) & (t < b)
        y[on] += np.sin(2 * np.pi * 3000 * t[on])
    return y.astype("f4")


def plain_hysteresis(d, on, off, n_on, n_off):
    out, state, run, start = [], 0, 0, 0
    for i, v in enumerate(d):
        ok = v > on if state == 0 else v < off
        run = run + 1 if ok else 0
        if state == 0 and run == n_on:
            state, run, start = 1, 0, i - n_on + 1
        elif state == 1 and run == n_off:
            state, run = 0, 0
            if i - n_off >= start:
                out.append((start, i - n_off))
    return out + ([(start, len(d) - 1)] if state else [])


@pytest.mark.parametrize("seed", range(30))
def test_hysteresis_equals_the_plain_form(seed):
    g = np.random.default_rng(seed)
    d = np.repeat(g.normal(size=60), g.integers(1, 5, 60))
    for n_on, n_off in ((1, 1), (2, 3), (4, 2)):
        assert [tuple(x) for x in bursts.hysteresis(d, 0.4, -0.2, n_on, n_off).tolist()] == plain_hysteresis(d, 0.4, -0.2, n_on, n_off)


def test_running_quantile_equals_pandas():
    import pandas as pd

    x = np.random.default_rng(3).normal(size=200)
    for width in (7, 10, 31):
        s = pd.Series(x).rolling(width, center=True, min_periods=max(3, width // 5)).quantile(0.1).interpolate(limit_direction="both").bfill().ffill()
        assert np.allclose(bursts.running_quantile(x, 0.1, width), s)


def test_a_span_is_halved_at_the_valley():
    d = np.concatenate([np.full(10, 5.0), [6, 5], np.full(6, 0.5), [5, 7], np.full(10, 4.0)])
    (a, b), (c, e) = bursts.halved(d, (0, len(d) - 1), 1.0, 3)
    assert (a, e) == (0, len(d) - 1) and c == b + 1 and d[b] == 0.5
    assert bursts.halved(d, (0, len(d) - 1), 0.1, 3) == [(0, len(d) - 1)]
    assert bursts.halved(d, (0, len(d) - 1), 1.0, 25) == [(0, len(d) - 1)]


def test_counts_are_refined_both_ways():
    t = np.arange(60) / 10
    d = np.full(60, 0.0)
    for a, b in ((2, 8), (12, 40), (50, 53)):
        d[a : b + 1] = 5
    d[20], d[33], d[27] = 6, 7, -1
    spans = np.array([(2, 8), (12, 40), (50, 53)])
    assert bursts.to_count(spans, d, t, 2).tolist() == [[2, 8], [12, 40]]
    assert bursts.to_count(spans, d, t, 4).tolist() == [[2, 8], [12, 27], [28, 40], [50, 53]]


def test_envelope_does_not_depend_on_chunks(spark):
    y = recording()
    whole = bursts.band_envelope(y, SR, 2000, 5000)
    rows = [("r", s, p.tolist(), SR) for s, p in segmentation.stretches(y, SR, 1.3)]
    got = segmentation.envelopes(spark.createDataFrame(rows, "rec string, start long, y array<float>, sr int"), [(2000.0, 5000.0)]).orderBy("t").toPandas()
    assert np.allclose(got.t, whole[0]) and np.allclose(got.db, whole[1], atol=1e-6)


def test_three_bursts_by_the_fallback_band(spark):
    y = recording()
    rows = [(r, s, p.tolist(), SR) for r in ("a", "b") for s, p in segmentation.stretches(y, SR, 2.0)]
    chunks = spark.createDataFrame(rows, "rec string, start long, y array<float>, sr int")
    expected = spark.createDataFrame([("a", 3, 6.0), ("b", 3, 6.0)], "rec string, expected int, duration double")
    got = segmentation.segmented(chunks, expected, [(50.0, 60.0), (2000.0, 5000.0)]).orderBy("rec", "seg").collect()
    assert len(got) == 6 and all(r.matched for r in got)
    for r, (a, b) in zip(got[:3], ((1.0, 1.6), (2.6, 3.2), (4.3, 4.9)), strict=True):
        assert r.band == 2 and r.start < a + 0.1 and r.stop > b - 0.1 and r.stop - r.start < 1.5
        assert r.padded_start == pytest.approx(max(0, r.core_start - 0.2)) and r.core_stop > r.core_start
    assert all(x.stop <= y.start + 1e-9 for x, y in zip(got[:2], got[1:3], strict=True))


def test_a_recording_without_expected_count_fails(spark):
    env = spark.range(50).select(F.lit("x").alias("rec"), F.lit(1).alias("band"), (F.col("id") / 10.0).alias("t"), F.lit(0.0).alias("db"))
    none = spark.createDataFrame([], "rec string, expected int, duration double")
    with pytest.raises(Exception, match="no expected count"):
        segmentation.detected(env, none).collect()
