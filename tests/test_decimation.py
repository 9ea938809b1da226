"""Zero-phase decimation over chunks against one array."""

import numpy as np
import pytest

from kerfline.functions import dsp, filters
from kerfline.operators import chunks, decimation

RNG = np.random.default_rng(9)


def stepwise(sections, x, states):
    y = np.array(x, float)
    for (b0, b1, b2, _, a1, a2), (s1, s2) in zip(sections, states, strict=True):
        for t, v in enumerate(y.copy()):
            y[t] = b0 * v + s1
            s1, s2 = b1 * v - a1 * y[t] + s2, b2 * v - a2 * y[t]
    return y


@pytest.mark.parametrize("q", [2, 4, 10])
def test_design(q):
    s = filters.chebyshev(8, 0.05, 0.8 / q)
    w = np.exp(-1j * np.pi * np.linspace(0, 1, 4001))
    h = np.prod([(b0 + b1 * w + b2 * w**2) / (1 + a1 * w + a2 * w**2) for b0, b1, b2, _, a1, a2 in s], axis=0)
    db, f = 20 * np.log10(np.abs(h) + 1e-300), np.linspace(0, 1, 4001)
    inside = f <= 0.8 / q
    assert db[inside].max() < 1e-6 and db[inside].min() > -0.0501 and abs(db[0] + 0.05) < 1e-6  # ripples touch 0 and -0.05 dB, at 0 the lower one
    assert np.sum(np.diff(np.sign(np.diff(db[inside]))) != 0) == 7  # as many turns as an equal-ripple filter of order 8 has
    assert db[f >= 1.2 / q].max() < -40


def test_blocks_of_the_system_equal_single_steps():
    s = filters.chebyshev(8, 0.05, 0.2)
    system, x = filters.System.of(s), RNG.standard_normal(1000)
    y, z = system.run(x, np.zeros(8))
    assert np.allclose(y, stepwise(s, x, [(0, 0)] * 4), atol=1e-12) and np.allclose(system.end(x), z, atol=1e-12)
    part, between = system.run(x[:333], np.zeros(8))
    assert np.allclose(np.concatenate([part, system.run(x[333:], between)[0]]), y, atol=1e-12)
    assert np.allclose(system.power(333) @ z + system.end(x[:333]), system.run(x[:333], z)[1])
    assert np.allclose(system.run(np.ones(200), system.steady)[0], 10 ** (-0.05 / 20))


def rows(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.start):
        y = out.setdefault(r.rec, [])
        assert len(y) == r.start
        y += r.y
    return {k: np.array(v) for k, v in out.items()}


def recorded(spark, lengths, cut):
    x = {f"r{n}": RNG.standard_normal(n) + np.sin(np.arange(n) / 30) for n in lengths}
    made = [(k, s, v[s : s + cut].tolist()) for k, v in x.items() for s in range(0, len(v), cut)]
    RNG.shuffle(made)
    return x, spark.createDataFrame([(k, int(s), y) for k, s, y in made], "rec string, start long, y array<double>")


@pytest.mark.parametrize("q,size", [(4, 100), (10, 257)])
def test_decimated_chunks_equal_the_whole(spark, q, size):
    x, df = recorded(spark, (27, 28, 99, 100, 101, 256, 600, 2000), 73)
    got, system = rows(decimation.decimated(df, q, size)), filters.antialias(q)
    assert set(got) == set(x) - {"r27"}
    for k in got:
        assert np.allclose(got[k], filters.zero_phase(x[k], system)[::q], atol=1e-9), k


def test_zero_phase_keeps_slow_waves_and_places():
    t = np.arange(4000)
    y = np.sin(2 * np.pi * t / 200)
    assert np.abs(filters.zero_phase(y, filters.antialias(10)) - y * 10 ** (-0.1 / 20))[300:-300].max() < 0.02
    fast = filters.zero_phase(np.sin(2 * np.pi * t / 7), filters.antialias(10))
    assert np.abs(fast[300:-300]).max() < 1e-3
    with pytest.raises(ValueError, match="too few"):
        filters.zero_phase(y[:27], filters.antialias(2))


def test_rates_over_chunks(spark):
    x, df = recorded(spark, (5000, 12_345), 1000)
    got = rows(decimation.at_rate(df, 48_000, 2000, size=1500))
    for k, v in x.items():
        want = dsp.resampled(filters.zero_phase(v, filters.antialias(10))[::10][None], 2000, 4800)[0]
        assert np.allclose(got[k], want, atol=1e-9), k
    by_steps = rows(decimation.cascade(df, 20, size=1100))
    for k, v in x.items():
        want = v
        for q in dsp.stages(20):
            want = filters.zero_phase(want, filters.antialias(q))[::q]
        assert np.allclose(by_steps[k], want, atol=1e-9)


def test_blocks_with_halos(spark):
    x, df = recorded(spark, (1, 10, 64, 65, 300), 50)
    got = chunks.blocks(df, 64, 9, 20).collect()
    for r in got:
        wide = np.concatenate([np.zeros(9), x[r.rec], np.zeros(100)])
        assert np.array_equal(r.y, wide[r.start : r.start + r.n + 29])
    assert sorted((r.rec, r.start, r.n) for r in got) == sorted((k, s, min(64, len(v) - s)) for k, v in x.items() for s in range(0, len(v), 64))
    again = chunks.cut(decimation.samples(df), 40)
    assert all(np.array_equal(v, x[k]) for k, v in rows(again).items())
    assert chunks.blocks(df.limit(0), 64, 3, 3).count() == 0
