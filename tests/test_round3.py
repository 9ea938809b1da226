"""Findings of FINDINGS_r03.md: what failed before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerfline.functions import names
from kerfline.operators import selection, training, windows


def windowed(spark, df) -> bool:
    """Whether a window looks forward to the end of its partition, which costs the square of its rows."""
    return "UNBOUNDED FOLLOWING" in df._jdf.queryExecution().optimizedPlan().toString().upper().replace("UNBOUNDEDFOLLOWING$", "UNBOUNDED FOLLOWING")


def test_false_discovery_rate_in_buckets(spark):
    rng = np.random.default_rng(1)
    p = {g: np.round(rng.random(n) ** 2, 2 if g == "a" else 9) for g, n in (("a", 900), ("b", 3000), (None, 5))}
    rows = [(g, i, float(x)) for g, v in p.items() for i, x in enumerate(v)] + [("a", -1, None)]
    t = spark.createDataFrame(rows, "g string, i long, p double")
    out = windows.benjamini_hochberg(t, "p", ("g",))
    assert not windowed(spark, out) and out.columns == ["g", "i", "p", "q"]
    got = {(r.g, r.i): r.q for r in out.collect()}
    assert len(got) == len(rows)
    for g, v in p.items():
        n = len(v) + (g == "a")
        order = np.argsort(v, kind="stable")
        last = np.searchsorted(v[order], v[order], "right")
        q = np.minimum(1, np.minimum.accumulate((v[order] * n / last)[::-1])[::-1])
        assert all(got[g, int(i)] == pytest.approx(x, abs=1e-12) for i, x in zip(order, q, strict=True))
    assert got["a", -1] == 1
    assert windows.benjamini_hochberg(t.where("g = 'b'"), "p").count() == 3000


def test_runs_of_four_digits_are_shown_as_sql_does(spark, tmp_path):
    from kerfline.plans import recordings as plan

    events = spark.createDataFrame([(i, 1000 + i % 2, float(10 + i)) for i in range(8)], "event_id long, user_id long, value double").withColumn("ts", F.timestamp_seconds("event_id").cast("timestamp_ntz"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert [(r.run, r.part, r.n) for r in plan.recorded_levels(spark, str(tmp_path)).collect()] == [("run100", 0, 400)] * 2


def test_variance_of_a_constant_in_parts_is_none(spark):
    n = next(n for n in range(2, 999) if 1.5 / n * n != 1.5)  # parts of so many rows leave a rest when they are added up
    rows = spark.range(2 * n, numPartitions=2).select(F.lit(0).alias("run"), F.lit("c").alias("feature"), F.lit(1.5).alias("value"))
    rows = rows.unionByName(rows.withColumn("run", F.lit(1)))
    (r,) = selection.variance_split(rows, "run").collect()
    assert (r.within, r.between, r.ratio) == (0.0, 0.0, None)


def test_hole_names_its_text_once(spark):
    made = F.concat(F.lit("run__"), F.col("id").cast("string"), F.lit("__B"), F.col("id").cast("string"), F.lit("__"))
    plan = spark.range(9).select(made.alias("n")).select(names.hole(F.col("n")).alias("h")).where("h IS NOT NULL")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("run__") <= 2
    assert [r.h for r in plan.collect()] == [f"B{i}" for i in range(9)]
    texts = ["hole_c7__A1__", "x__d2__", "an E3 b", "none", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, n string").withColumn("h", names.hole(F.col("n"))).orderBy("i").collect()
    assert [r.h for r in got] == ["C7", "D2", "E3", None, None, None]
    assert [r[0] for r in spark.createDataFrame([("a//b",), ("__",), ("",), (None,)], "t string").select(names.slug(F.col("t"))).collect()] == ["a_b", "NA", "NA", "NA"]


def ranks(v):
    order = np.sort(v)
    return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2


def test_rank_correlations_join_counts_not_rows(spark):
    rng = np.random.default_rng(2)
    n = 4000
    x, y, z = rng.integers(0, 5, n).astype(float), np.round(rng.random(n), 2), rng.integers(0, 9, n).astype(float)
    y, z = np.round(y + 0.1 * x, 2), z + x
    gap = rng.random(n) < 0.1
    rows = [("f", None if g else float(a), float(b), float(c)) for a, b, c, g in zip(x, y, z, gap, strict=True)]
    long = spark.createDataFrame(rows, "feature string, value double, target double, held double")
    rx, ry, rz = (ranks(v[~gap]) for v in (x, y, z))
    assert selection.spearman(long, "target").first().r == pytest.approx(np.corrcoef(rx, ry)[0, 1], abs=1e-12)
    for intercept in (True, False):
        base = np.stack([rz, np.ones(len(rz))], 1) if intercept else rz[:, None]
        rest = lambda v, base=base: v - base @ np.linalg.lstsq(base, v, rcond=None)[0]
        got = selection.partial_spearman(long, "target", "held", intercept).first()
        assert (got.n, got.r) == (len(rx), pytest.approx(np.corrcoef(rest(rx), rest(ry))[0, 1], abs=1e-9))
    flat = long.withColumn("value", F.lit(1.0))
    assert selection.spearman(flat, "target").first().r is None
    # A row is counted before anything is joined: rows reach no join as they are.
    joined = selection.spearman(long.repartition(2), "target")
    joined.collect()
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "_k" in plan


def test_signed_ranks_by_counts(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 500) / 10, rng.integers(0, 9, 500) / 10
    got = training.paired_tests(spark.createDataFrame([(1, float(i), float(j)) for i, j in zip(a, b, strict=True)], "g int, a double, b double"), "a", "b", 0.1, "g").first()
    d = np.round(a - b, 12)
    d = d[d != 0]
    r = ranks(np.abs(d))
    assert got.w == pytest.approx(min(r[d > 0].sum(), r[d < 0].sum()))


def test_amplitudes_beyond_full_scale_are_kept(spark, tmp_path):
    from kerfline.plans import recordings as plan

    events = spark.createDataFrame([(i, 7, 560.2) for i in range(3)], "event_id long, user_id long, value double").withColumn("ts", F.timestamp_seconds("event_id").cast("timestamp_ntz"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    (r,) = plan.recorded_levels(spark, str(tmp_path)).collect()
    assert (r.run, r.peak, r.rms, r.level) == ("run007", *[round(33612 / 32768, 6)] * 3)


def test_running_quantile_takes_all_frames_at_once(monkeypatch):
    from kerfline.functions import bursts

    x = np.random.default_rng(4).normal(size=(300, 41))
    x[:20, 30:] = np.nan
    assert np.array_equal(bursts.quantiles(x, 0.1), np.nanquantile(x, 0.1, axis=1)) and np.array_equal(bursts.quantiles(x, 0.63), np.nanquantile(x, 0.63, axis=1))
    monkeypatch.setattr(np, "nanquantile", lambda *a, **k: pytest.fail("one frame after another"))
    bursts.running_quantile(x[50], 0.1, 9)


def test_kernels_take_pieces_of_batches(spark):
    import pyarrow as pa

    from kerfline.operators import features

    batch = pa.RecordBatch.from_pydict({"id": list(range(1000))})
    cut = list(features.pieces(iter([batch])))
    assert max(b.num_rows for b in cut) <= features.ROWS and sum(b.num_rows for b in cut) == 1000
    rows = spark.range(300, numPartitions=1).select("id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.sin(i * (F.col("id") + 1))).alias("y"))
    got = features.extract(rows, "id", "y", 64.0, ("time", "hjorth")).collect()
    (one,) = features.extract(rows.where("id = 299"), "id", "y", 64.0, ("time", "hjorth")).collect()
    assert len(got) == 300 and {r.id: r.features for r in got}[299] == one.features


def test_envelopes_travel_as_arrays(spark):
    from kerfline.operators import segmentation

    y = np.sin(np.arange(4000)) * np.repeat(np.random.default_rng(5).random(40), 100)
    chunks = spark.createDataFrame([("a", s, c.tolist(), 2000) for s, c in segmentation.stretches(y, 2000, 0.5)], "rec string, start long, y array<double>, sr int")
    expected = spark.createDataFrame([("a", 3, 2.0)], "rec string, expected int, duration double")
    packed = segmentation.packed_envelopes(chunks, [(100, 900)])
    assert packed.count() == chunks.count()
    rows = segmentation.envelopes(chunks, [(100, 900)])
    assert sorted(segmentation.detected(packed, expected).collect()) == sorted(segmentation.detected(rows, expected).collect())
