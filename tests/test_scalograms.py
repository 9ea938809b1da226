"""Scalograms over chunks against whole signals, and against the transform spelled out."""

import numpy as np
import pytest

from kerfline.functions import scalograms as kernels
from kerfline.operators import scalograms

RNG = np.random.default_rng(14)


def spelled(y, sr, f, precision=10):
    """The difference of the full convolution with the integral at one scale, cut to the signal's length in the middle."""
    x = np.linspace(-8, 8, 2**precision)
    integral = np.cumsum(np.exp(-(x**2) / 2) * np.cos(5 * x)) * (x[1] - x[0])
    s = kernels.central_frequency(precision) * sr / f
    at = [int(np.floor(k / (s * (x[1] - x[0])))) for k in range(int(np.ceil(s * 16 + 1)))]
    h = np.array([integral[k] for k in at if k < len(integral)])[::-1]
    w = -np.sqrt(s) * np.diff(np.convolve(y, h))
    first = int(np.floor((len(h) - 2) / 2))
    return w[first : first + len(y)]


def test_transform_spelled_out():
    bank, y = kernels.Bank(8000, 60, 3500, 9), RNG.standard_normal(700)
    got = kernels.convolved(y, list(bank.scales), 0, 700)
    for k, f in enumerate(bank.frequencies):
        assert np.allclose(got[k], spelled(y, 8000, f), atol=1e-9)
    assert kernels.central_frequency() == 13 / 16


def test_a_tone_stands_out_at_its_frequency():
    bank, t = kernels.Bank(8000, 100, 3000, 40), np.arange(4000) / 8000
    w = kernels.convolved(np.sin(2 * np.pi * 700 * t), list(bank.scales), 0, 4000)
    assert abs(bank.frequencies[(w[:, 1000:-1000] ** 2).mean(1).argmax()] / 700 - 1) < 0.1


@pytest.mark.parametrize("size", [64, 1000])
def test_blocks_equal_the_whole_signal(spark, size):
    bank = kernels.Bank(8000, 30, 3500, 12)  # filters of up to 3,500 samples, chunks of 90
    assert max(len(s.taps) for s in bank.scales) > 3000
    x = {f"r{n}": RNG.standard_normal(n) for n in (1, 50, 2000, 9001)}
    made = spark.createDataFrame([(k, s, v[s : s + 90].tolist()) for k, v in x.items() for s in range(0, len(v), 90)], "rec string, start long, y array<double>")
    images = scalograms.standardised(scalograms.scalogram(made, bank, size)).collect()
    for k, v in x.items():
        rows = sorted((r.band, r.start, r.db) for r in images if r.rec == k)
        got = np.array([np.concatenate([d for b, _, d in rows if b == band]) for band in range(12)])
        assert got.shape == (12, len(v))
        assert np.allclose(got, kernels.scalogram_image(v, bank), atol=1e-6), k


def test_mel_picture_by_its_rule(spark):
    p = kernels.Picture(512, 400, 20, low=150, high=3000, top_db=60)
    y = RNG.standard_normal(5000) * np.linspace(0.001, 1, 5000)
    centres, times, db = kernels.mel_picture(y, 8000, p)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(512) / 512)
    f = np.arange(257) * 8000 / 512
    there = [k for k in range(257) if 150 <= f[k] <= 3000]
    mel = np.linspace(2595 * np.log10(1 + 150 / 700), 2595 * np.log10(1 + 3000 / 700), 22)
    hz = 700 * (10 ** (mel / 2595) - 1)
    want = []
    for s in range(0, 5000 - 512 + 1, 112):
        part = y[s : s + 512] - y[s : s + 512].mean()
        power = [abs((part * w * np.exp(-2j * np.pi * k * np.arange(512) / 512)).sum() / w.sum()) ** 2 for k in there]
        want.append([sum(max(0, min((f[k] - hz[i]) / (hz[i + 1] - hz[i]), (hz[i + 2] - f[k]) / (hz[i + 2] - hz[i + 1]))) * 2 / (hz[i + 2] - hz[i]) * q for k, q in zip(there, power, strict=True)) for i in range(20)])
    want = 10 * np.log10(np.maximum(np.array(want).T, 1e-12))
    assert np.allclose(db, np.clip(want, want.max() - 60, want.max()), atol=1e-8)
    assert np.allclose(centres, hz[1:-1]) and np.allclose(times, (np.arange(db.shape[1]) * 112 + 256) / 8000)
    rows = scalograms.pictures(spark.createDataFrame([(1, y.tolist()), (2, None), (3, [0.5] * 4)], "id int, y array<double>"), "id", "y", 8000, p).collect()
    by = {r.id: r for r in rows}
    assert (by[1].bands, by[1].frames) == db.shape and np.allclose(by[1].image, db.ravel(), atol=1e-4)
    assert by[2].error == "no samples" and "four bins" in by[3].error
