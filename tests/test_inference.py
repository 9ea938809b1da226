"""Network predictions over windows of chunks against whole signals."""

import numpy as np
import pytest

from kerfline.operators import inference

RNG = np.random.default_rng(29)


def recorded(spark, lengths):
    x = {f"r{n}": RNG.standard_normal(n) for n in lengths}
    x["r40"][7] = np.nan
    made = [(k, s, v[s : s + 13].tolist()) for k, v in x.items() for s in range(0, len(v), 13)]
    return x, spark.createDataFrame(made, "rec string, start long, y array<double>")


@pytest.mark.parametrize("length,hop", [(16, 16), (16, 5), (30, 7)])
def test_windows_and_predictions(spark, length, hop):
    x, df = recorded(spark, (1, 15, 16, 17, 40, 200))
    cut = inference.windows(df, length, hop)
    want = {}
    for k, v in x.items():
        wide = np.concatenate([np.nan_to_num(v), np.zeros(length)])
        for s in range(0, max(0, len(v) - length) + 1, hop):
            want[k, s] = wide[s : s + length]
    got = {(r.rec, r.start): np.array(r.x) for r in cut.collect()}
    assert got.keys() == want.keys() and all(np.array_equal(got[w], want[w]) for w in want)
    for classes in (False, True):
        net = inference.Convolutional(RNG.normal(size=(4, 3)), RNG.normal(size=(4, 3 if classes else 1)), RNG.normal(size=3 if classes else 1), classes)
        rows = {(r.rec, r.start): r for r in inference.predict(cut, net, at_once=3).collect()}
        files = {r.rec: r for r in inference.by_recording(inference.predict(cut, net)).collect()}
        for k in x:
            mine = sorted(s for r, s in want if r == k)
            out = net(np.stack([want[k, s] for s in mine]))
            assert files[k].n_windows == len(mine) and np.allclose(files[k].embedding, out["embedding"].mean(0))
            if classes:
                assert np.allclose([rows[k, s].probs for s in mine], out["class_probs"]) and rows[k, mine[0]].pred_class == out["class_probs"][0].argmax()
                assert files[k].pred_class == out["class_probs"].mean(0).argmax() and files[k].y_pred is None
            else:
                assert np.allclose([rows[k, s].y_pred for s in mine], out["regression"]) and files[k].probs is None and files[k].pred_class is None
                assert files[k].y_pred == pytest.approx(np.median(out["regression"]))


def test_predictions_that_are_not_finite_fail_by_name(spark):
    _, df = recorded(spark, (40,))
    with pytest.raises(Exception, match="not finite: r40 at"):
        inference.predict(inference.windows(df, 16, 16), lambda x: {"regression": np.full(len(x), np.nan)}).collect()
    with pytest.raises(ValueError):
        inference.windows(df, 4, 5)
