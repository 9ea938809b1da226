import json

from kerfline.sources import config


def test_settings(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"split": {"n": 3, "bands": [1, 2]}, "x": 1}))
    base = config.load(spark, str(tmp_path / "a.json"))
    got = config.with_values(config.merged(base, {"split": {"n": 4}}, {"y": None}), ["split.pad=0.5", "name=run one", "deep.er.still=[1]"])
    assert got == {"split": {"n": 4, "bands": [1, 2], "pad": 0.5}, "x": 1, "y": None, "name": "run one", "deep": {"er": {"still": [1]}}}
    assert base["split"]["n"] == 3
    assert config.read(got, "split.pad") == 0.5 and config.read(got, "split.pad.more", 7) == 7 and config.read(got, "none") is None
    assert config.replayed("a.b", None, {"a": {}}, {"a": {"b": 2}}, {"a": {"b": 3}}) == 2 and config.replayed("q", {}, default="d") == "d"
    got = config.with_values({}, ["--a.b", "--c=No", "d=none", "e=1e-4", "f=.5", "g=~", "h=TRUE", "i=[1, 2]", "j=12", "k=1=2"])
    assert got == {"a": {"b": True}, "c": False, "d": None, "e": 1e-4, "f": 0.5, "g": None, "h": True, "i": [1, 2], "j": 12, "k": "1=2"}
    assert config.flat({"a": {"b": 1}}) == {"a": {"b": 1}, "a.b": 1}


def test_extractor_by_columns():
    assert config.extractor(["wpd_1", "ss_centroid", "rms"]) == "v2"
    assert config.extractor(["spectral_centroid", "crest_factor"]) == "v1"
    assert config.extractor(["cwt_s12", "dwt_x"]) is None and config.extractor([]) is None
