"""Names, fusion, segmentation, selection, splits, ledgers and sources on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerfline.functions import names
from kerfline.operators import features, fusion, ledger, segmentation, selection, splits, windows
from kerfline.sources import recordings, tables

BUNDLE = "modality string, validation_mae double, record_name string, row_idx long, y_pred double, sigma double, y_true double"


def test_name_parts(spark):
    rows = [("0503_1_2_4532__seg001__step001__B2__depth0.500",), ("depth1,000",), ("no_depth_here",), ("run__step007__hole",)]
    n = F.col("n")
    got = spark.createDataFrame(rows, "n string").select(names.depth(n), names.step(n), names.root(n), names.hole(n), names.fusion_key(n)).collect()
    assert [r[0] for r in got] == [0.5, 1.0, None, None]
    assert [r[1] for r in got] == [1, None, None, 7]
    assert got[0][2] == "0503_1_2_4532" and got[2][2] == "no_depth_here"
    assert got[0][3] == "B2" and got[0][4] == "step=001__hole=B2" and got[2][4] == "no_depth_here"


def test_long_keys_are_unique(spark):
    rows = [(0, "runB__seg001__step001__A1__depth0.1"), (1, "runA__seg001__step001__A1__depth0.1"), (2, "runA__seg002__step001__A1__depth0.1")]
    got = {r.row_idx: r.key_long for r in names.long_keys(spark.createDataFrame(rows, "row_idx long, n string"), "n", "row_idx").collect()}
    assert got == {0: "run=002__step=001__hole=A1", 1: "run=001__step=001__hole=A1", 2: "run=001__step=001__hole=A1__occ002"}


def test_missing_member_and_sigma(spark):
    rows = [("a", 0.1, "r1", 0, 1.0, None, None), ("a", 0.1, "r2", 1, None, None, None), ("b", 0.2, "r1", 0, 3.0, None, None), ("b", 0.2, "r2", 1, 5.0, None, None)]
    got = {r.record_name: r for r in fusion.fuse(spark.createDataFrame(rows, BUNDLE), 2).collect()}
    assert got["r1"].y_pred == pytest.approx(5 / 3) and got["r1"].sigma == pytest.approx(2 * 2**0.5 / 3)
    assert got["r2"].y_pred == 5.0 and got["r2"].sigma == 0


def test_partial_overlap_and_last_rows(spark):
    rows = [("a", 0.1, f"seg{i:03d}", i, float(i), 0.1, None) for i in range(10)] + [("b", 0.2, f"seg{i:03d}", i, float(i), 0.1, None) for i in range(5, 15)]
    rows += [("b", 0.2, "seg007", 99, 70.0, 0.1, None), ("a", 0.1, "all_null", 50, None, None, 1.0), ("b", 0.2, "all_null", 50, None, None, 1.0)]
    got = {r.record_name: r for r in fusion.fuse(spark.createDataFrame(rows, BUNDLE), 2).collect()}
    assert sorted(got) == ["all_null", *(f"seg{i:03d}" for i in range(5, 10))]
    assert got["seg007"].y_pred == pytest.approx((7 * 2 + 70) / 3, rel=1e-6)
    assert got["all_null"].y_pred is None and got["all_null"].y_true == 1.0


def test_padding_clips(spark):
    iv = spark.createDataFrame([("a", 1.0, 2.0, 5.0), ("a", 3.0, 4.8, 5.0)], "rec string, start double, stop double, length double")
    got = sorted((r.start, r.stop) for r in segmentation.padded(iv, 0.5, 0.5, "length").collect())
    assert got == [(0.5, 2.5), (2.5, 5.0)]


def machine(x, on, off, n_on, n_off):
    out, active, ups, downs, start = [], False, 0, 0, 0
    for i, v in enumerate(x):
        if not active:
            ups = ups + 1 if v > on else 0
            if ups >= n_on:
                active, downs, start = True, 0, i - n_on + 1
        else:
            downs = downs + 1 if v < off else 0
            if downs >= n_off:
                out.append((start, i - n_off))
                active, ups = False, 0
    return [*out, (start, len(x) - 1)] if active else out


def test_hysteresis_equals_the_machine(spark):
    rng = np.random.default_rng(3)
    x = {r: rng.normal(size=300).cumsum() % 10 for r in range(6)}
    df = spark.createDataFrame([(r, i, float(v)) for r, s in x.items() for i, v in enumerate(s)], "rec long, i long, x double")
    got = {}
    for r in segmentation.hysteresis(df, 6, 3, 2, 3).orderBy("rec", "seg").collect():
        got.setdefault(r.rec, []).append((r.start, r.stop))
    assert got == {r: machine(s, 6, 3, 2, 3) for r, s in x.items() if machine(s, 6, 3, 2, 3)}


def test_chunks_give_the_same_moving_rms(spark):
    x = np.random.default_rng(0).normal(size=200)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "rec long, i long, x double")
    whole = {r.i: r.y for r in df.withColumn("y", windows.moving_rms(7)).collect()}
    parts = windows.chunked(df, 50, 3).withColumn("y", windows.moving_rms(7, by=("rec", "chunk"))).where("own")
    assert {r.i: r.y for r in parts.collect()} == pytest.approx(whole)


def test_pruning_and_folds():
    assert selection.prune([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", 0.1)], {"a": 0.5, "b": 0.4, "c": 0.3}) == ["a", "c"]
    assert selection.prune([("a", "b", 0.9), ("a", "c", 0.9), ("b", "c", 0.0)], {"a": 0.1, "b": 0.4, "c": 0.05}) == ["b"]
    folds = splits.folds([("a", 9), ("b", 5), ("c", 4), ("d", 1)], 2)
    assert folds == {"a": 0, "b": 1, "c": 1, "d": 0}
    out = splits.greedy_stratified({f"g{i}": {"x": 3, "y": 3} for i in range(10)}, {"train": 0.6, "val": 0.2, "test": 0.2})
    assert sorted(out.values()).count("train") == 6


def test_selection_finds_the_informative_feature(spark):
    rng = np.random.default_rng(1)
    t = rng.random(200)
    rows = [(float(a), float(a + e), float(a * 2 + e), float(n), 1.0) for a, e, n in zip(t, rng.normal(0, 0.1, 200), rng.random(200), strict=True)]
    got = selection.select(spark.createDataFrame(rows, "y double, f1 double, f2 double, noise double, flat double"), ["f1", "f2", "noise", "flat"], "y", least=0.3)
    assert got in (["f1"], ["f2"])


def test_group_split_keeps_groups_whole(spark):
    rows = spark.createDataFrame([(f"g{i % 10}", i) for i in range(100)], "run string, x long")
    got = splits.by_group(rows, "run", 0.7, 0.1)
    assert got.groupBy("run").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert {r.split for r in got.collect()} == {"train", "val", "test"}


def test_ledger_moves(spark):
    log = spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (1, 3, "succeeded"), (2, 1, "running"), (3, 1, "queued"), (3, 2, "succeeded")], "run_id long, seq long, status string")
    assert {(r.run_id, r.seq) for r in ledger.illegal_moves(log).collect()} == {(2, 1), (3, 2)}
    assert [r.run_id for r in ledger.active_runs(log).collect()] == [2]


def test_feature_rows_say_what_failed(spark):
    df = spark.createDataFrame([(1, [0.1, -0.1, 0.2]), (2, [float(i % 7) for i in range(64)]), (3, None), (4, [1.0])], "id long, y array<double>")
    got = {r.id: r for r in features.extract(df, "id", "y", 64.0, ("time", "statistics", "shape")).collect()}
    assert got[1].error is None and got[2].features["rms"] > 0
    assert "too few" in got[3].error and "too few" in got[4].error


def test_wav_round_trip(spark, tmp_path):
    x = (0.5 * np.sin(np.arange(4800) / 10)).astype("f4")
    (tmp_path / "run__seg001__step001__B2__depth0.500.wav").write_bytes(recordings.write_wav(x, 48_000))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[1]: r for r in recordings.signals(spark, str(tmp_path)).collect()}
    good = got["run__seg001__step001__B2__depth0.500.wav"]
    assert good.sr == 48_000 and np.allclose(good.y, x, atol=1e-4) and good.duration_s == pytest.approx(0.1)
    assert got["bad.wav"].error
    named = recordings.labelled(recordings.listing(spark, str(tmp_path), "run*")).first()
    assert (named.depth_mm, named.hole_id, named.step_idx, named.kind) == (0.5, "B2", 1, "audio")


def test_geometry(spark):
    holes = spark.createDataFrame([("A1", 3.0, 4.0)], tables.HOLES)
    got = {r.hole_id: r for r in tables.with_geometry(spark.createDataFrame([("A1",), ("Z9",)], "hole_id string"), holes, 0.0, 0.0).collect()}
    assert got["A1"].mic_r == 5.0 and got["A1"].mic_log_r == pytest.approx(np.log(5))
    assert got["Z9"].mic_r is None and got["Z9"].mic_log_r is None


def test_names_follow_the_naming_rules(spark):
    rows = [
        ("hole_B2__C3__x", "B2"), ("run_A1_x", None), ("a__c3__b", "C3"), ("a-d4-b", "D4"), ("hole=E5", "E5"), (None, None),
    ]
    got = spark.createDataFrame(rows, "name string, want string").withColumn("got", names.hole(F.col("name"))).collect()
    assert all(r.got == r.want for r in got), got
    keys = {
        "r__seg1__step7__B2__d": "step=007__hole=B2", "r__step1234__B2": "step=1234__hole=B2", "r__stepNA__B2": "hole=B2", "r__step5": "step=005", "r__STEP6__": "step=006__hole=", "plain": "plain", "a___step7__B": "a___step7__B",
    }
    got = spark.createDataFrame([(k,) for k in keys], "name string").withColumn("got", names.fusion_key(F.col("name"))).collect()
    assert {r.name: r.got for r in got} == keys
    one = spark.range(1).select(
        names.file_name(F.lit("r"), F.lit(1200), F.lit(1001), F.lit("b 2"), F.lit(-1.5), ".wav").alias("a"), names.file_name(F.lit("r"), F.lit(2), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(float("inf")), "").alias("b"),
    ).first()
    assert one.a == "r__seg1200__step1001__b_2__depthm1.500.wav" and one.b == "r__seg002__stepNA__NA__depthNA"


def test_long_keys_are_unique_beyond_a_thousand_repeats(spark):
    rows = spark.range(1200).select(F.col("id"), F.lit("run__seg001__step003__A1__depth1").alias("name"))
    got = [r.key_long for r in names.long_keys(rows, "name", "id").collect()]
    assert len(set(got)) == 1200 and "run=001__step=003__hole=A1" in got and "run=001__step=003__hole=A1__occ1200" in got


def test_recordings_are_probed_resampled_and_exported(spark, tmp_path):
    t = np.arange(8000) / 8000
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.wav").write_bytes(recordings.write_wav(0.5 * np.sin(2 * np.pi * 100 * t), 8000))
    (tmp_path / "in/bad.wav").write_bytes(b"RIFF")
    got = {r.path.rpartition("/")[2]: r for r in recordings.probed(spark, str(tmp_path / "in")).collect()}
    assert (got["one.wav"].n, got["one.wav"].sr, got["one.wav"].channels, got["one.wav"].duration_s) == (8000, 8000, 1, 1.0) and got["bad.wav"].error
    low = recordings.signals(spark, str(tmp_path / "in"), "one.wav", target_sr=2000)
    r = low.first()
    assert r.sr == 2000 and len(r.y) == 2000 and max(r.y[100:-100]) == pytest.approx(0.5, abs=0.01)
    spans = low.select("path", F.lit(1).alias("seg"), F.lit(0.25).alias("start"), F.lit(0.75).alias("stop"))
    recordings.exported(recordings.segments(low, spans), str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out")).first()
    x, sr = recordings.read_wav(bytes(out.content))
    assert (out.n, len(x), sr, out.stem) == (1000, 1000, 2000, "one")


def test_numbers_within_groups(spark):
    sizes = {"large": 900, "small": 3, "one": 1}
    rows = spark.createDataFrame([(g, 7 * i % (7 * n)) for g, n in sizes.items() for i in range(n)], "g string, o long").repartition(5)
    got = windows.numbered(rows, "g", "o", "n", 8)
    assert {(r.g, r.o): r.n for r in got.collect()} == {(g, 7 * i): i + 1 for g, n in sizes.items() for i in range(n)}


def test_fusion_key_of_odd_names(spark):
    odd = ["a___step003__B1", "a__Step7__", "step9", "x__stepNA__C2__depth1", "__step12__D4", "a__step__E1", "İ__step4__F5", "none", "a__step1__b__step2__c", ""]
    slow = {"a___step003__B1": "a___step003__B1", "a__Step7__": "step=007__hole=", "step9": "step=009", "x__stepNA__C2__depth1": "hole=C2", "__step12__D4": "step=012__hole=D4", "a__step__E1": "hole=E1", "İ__step4__F5": "step=004__hole=F5", "none": "none", "a__step1__b__step2__c": "step=001__hole=b", "": ""}
    got = {r.n: r.k for r in spark.createDataFrame([(n,) for n in odd], "n string").select("n", names.fusion_key(F.col("n")).alias("k")).collect()}
    assert got == slow
