"""Recordings read in ranges against whole reads."""

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerfline.operators import segmentation
from kerfline.sources import ranges, recordings

RNG = np.random.default_rng(5)


def write(path, x, sr=8000, width=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(width)
        w.setframerate(sr)
        if width == 3:
            w.writeframes(x.astype("<i4").reshape(-1, 1).view("u1").reshape(-1, 4)[:, :3].tobytes())
        else:
            w.writeframes((x + 128 if width == 1 else x).astype({1: "u1", 2: "<i2", 4: "<i4"}[width]).tobytes())


def whole(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.start):
        out.setdefault(r.path.rpartition("/")[2], []).append(np.array(r.y, "f4"))
    return {k: np.concatenate(v) for k, v in out.items()}


@pytest.mark.parametrize("width,channels", [(1, 1), (2, 2), (3, 1), (4, 3)])
def test_ranges_equal_the_whole_file(spark, tmp_path, width, channels):
    top = 1 << (8 * width - 1)
    for name, n in (("a.wav", 50_001), ("sub/b.wav", 7), ("c.wav", 0)):
        write(tmp_path / name, RNG.integers(-top, top, (n, channels)), width=width)
    (tmp_path / "note.txt").write_text("no recording")
    df = ranges.chunked(spark, f"file://{tmp_path}", seconds=0.5, range_mb=0.02)
    rows = df.collect()
    assert -(-(50_001 * channels * width + 44) // 20_000) <= df.rdd.getNumPartitions() <= 2 + -(-(50_001 * channels * width + 44) // 20_000)
    assert all(len(r.y) <= 4000 and r.start % 4000 == 0 and r.error is None for r in rows)
    got = whole(rows)
    for name in ("a.wav", "sub/b.wav", "c.wav"):
        want, sr = recordings.read_wav((tmp_path / name).read_bytes())
        assert np.array_equal(got[name.rpartition("/")[2]], want) and sr == 8000
    assert {r.n for r in rows} == {50_001, 7, 0}


def test_envelopes_of_ranges_equal_those_of_the_recording(spark, tmp_path):
    sr, t = 8000, np.arange(8000 * 6) / 8000
    x = 0.01 * RNG.standard_normal(len(t))
    for at in (0.9, 2.5, 4.1):
        x += 0.5 * np.sin(2 * np.pi * 1000 * t) * ((t > at) & (t < at + 0.5))
    write(tmp_path / "r.wav", np.round(x * 20_000)[:, None], sr)
    y = recordings.read_wav((tmp_path / "r.wav").read_bytes())[0]
    parts = ranges.chunked(spark, str(tmp_path), seconds=0.7, win_ms=21, hop_ms=5, range_mb=0.03).select(F.col("path").alias("rec"), "start", "y", "sr")
    made = spark.createDataFrame([("r", s, c.tolist(), sr) for s, c in segmentation.stretches(y, sr, 0.7)], "rec string, start long, y array<float>, sr int")
    assert sorted((r.start, len(r.y)) for r in parts.collect()) == sorted((r.start, len(r.y)) for r in made.collect())
    key = lambda df: sorted((r.t, r.db) for r in segmentation.envelopes(df, [(500, 2000)]).collect())
    assert key(parts) == key(made)
    expected = parts.select("rec").distinct().withColumns({"expected": F.lit(3), "duration": F.lit(6.0)})
    found = segmentation.segmented(parts, expected, [(500, 2000)]).orderBy("seg").collect()
    assert [round(r.core_start, 1) for r in found] == [0.9, 2.5, 4.1] and found[0].matched


def test_broken_files_say_so(spark, tmp_path):
    write(tmp_path / "good.wav", RNG.integers(-99, 99, (9000, 1)))
    whole_file = (tmp_path / "good.wav").read_bytes()
    (tmp_path / "cut.wav").write_bytes(whole_file[:9000])
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "noise.wav").write_bytes(b"x" * 500)
    rows = ranges.chunked(spark, str(tmp_path), seconds=0.25).collect()
    bad = {r.path.rpartition("/")[2] for r in rows if r.error}
    assert bad == {"cut.wav", "empty.wav", "noise.wav"}
    assert sum(len(r.y) for r in rows if r.path.endswith("good.wav")) == 9000
    with pytest.raises(Exception, match="nowhere"):
        ranges.chunked(spark, f"{tmp_path}/nowhere").count()


def test_filters_reach_files_and_chunks(spark, tmp_path):
    for name in "abc":
        write(tmp_path / f"{name}.wav", RNG.integers(-99, 99, (40_000, 1)))
    reader = ranges.FilteringReader({"path": str(tmp_path), "seconds": "1"})
    filters = [ranges.In(("path",), (f"{tmp_path}/a.wav", f"{tmp_path}/c.wav")), ranges.GreaterThanOrEqual(("start",), 16_000), ranges.LessThan(("start",), 32_000)]
    assert list(reader.pushFilters(filters)) == filters
    assert [q.path[-5] for p in reader.partitions() for q in p.parts] == ["a", "c"] and len(reader.partitions()) == 1
    assert [b.column(2)[0].as_py() for p in reader.partitions() for b in reader.read(p)] == [16_000, 24_000] * 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = ranges.chunked(spark, str(tmp_path), seconds=1).where(F.col("path") == f"{tmp_path}/b.wav").where("start >= 16000")
        assert df.rdd.getNumPartitions() == 1 and df.count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert ranges.chunked(spark, str(tmp_path), pattern="[ab].wav").select("path").distinct().count() == 2


def test_centred_and_saved(spark, tmp_path):
    write(tmp_path / "a.wav", RNG.integers(0, 99, (30_000, 1)))
    y = np.concatenate([np.array(r.y) for r in ranges.centred(ranges.chunked(spark, str(tmp_path), seconds=1)).orderBy("start").collect()])
    want = recordings.read_wav((tmp_path / "a.wav").read_bytes())[0]
    assert np.allclose(y, want - want.mean(dtype=float), atol=1e-7)
    files = spark.range(20).selectExpr("concat('d', id % 3, '/', id, '.bin') AS name", "cast(repeat('z', cast(id AS int)) AS binary) AS content")
    for _ in range(2):
        out = {r.name: r.size for r in ranges.saved(files, f"file://{tmp_path}/out").collect()}
    assert {str(p.relative_to(tmp_path / "out")): p.stat().st_size for p in (tmp_path / "out").rglob("*") if p.is_file()} == out


def test_rate_of_times():
    assert ranges.rate(np.array([0, 0.5, 1.0, 1.5, 1.4, 2.4]))[:2] == (2, 0.5)
    for bad in (np.zeros(3), np.zeros(1), np.zeros((2, 2))):
        with pytest.raises(ValueError):
            ranges.rate(bad)


def test_recorded_bursts_equal_those_of_whole_files(spark):
    from kerfline.plans import recordings as plan

    data = "/root/testdata/sf0.001"
    files = {r.name: recordings.read_wav(bytes(r.content)) for r in plan.waves(spark, data).collect()}
    rows = [(name.removesuffix(".wav"), s, c.tolist(), sr) for name, (y, sr) in files.items() for s, c in segmentation.stretches(y, sr, 1e6)]
    made = spark.createDataFrame(rows, "rec string, start long, y array<float>, sr int")
    expected = spark.createDataFrame([(name.removesuffix(".wav"), 3, len(y) / sr) for name, (y, sr) in files.items()], "rec string, expected int, duration double")
    want = segmentation.segmented(made, expected, [(400, 600), (100, 900)])
    got = plan.recorded_bursts(spark, data)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 10
