"""Exact signed ranks, p of correlations, and the counted bootstrap."""

from itertools import product

import numpy as np
import pytest

from kerfline.operators import training

G = np.random.default_rng(23)


def test_signed_ranks_by_all_signs():
    for m in (1, 2, 5, 9):
        sums = [sum(r for r, s in zip(range(1, m + 1), signs, strict=True) if s) for signs in product((0, 1), repeat=m)]
        for w in range(m * (m + 1) // 4 + 1):
            assert training.signed_rank_p(w, m) == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / 2**m))
    assert training.signed_rank_p(0, 50) == pytest.approx(2.0**-49)


def test_small_groups_have_exact_p(spark):
    d = [0.3, -0.1, 0.7, 1.1, -0.2, 0.5]
    data = [("few", v, 0.0) for v in d] + [("tied", v, 0.0) for v in (1.0, 1.0, -2.0, 3.0)]
    got = {r.g: r for r in training.paired_tests(spark.createDataFrame(data, "g string, a double, b double"), "a", "b", 0.01, "g").collect()}
    assert got["few"].w == 3 and got["few"].w_p == pytest.approx(2 * 5 / 64)  # {}, {1}, {2}, {3}, {1, 2}
    assert got["tied"].w_p != training.signed_rank_p(got["tied"].w, 4)


def test_p_of_correlations(spark):
    rows = spark.createDataFrame([(0.5, 27), (-0.5, 27), (0.0, 10), (1.0, 10), (0.9, 3)], "r double, n long")
    got = [r.p for r in training.correlation_p(rows, "r", "n").collect()]
    assert got[0] == got[1] == pytest.approx(0.007906, abs=2e-5) and got[2] == pytest.approx(1) and got[3] == 0
    assert training.correlation_p(rows, "r", "n", 1).collect()[4].p is None or np.isnan(training.correlation_p(rows, "r", "n", 1).collect()[4].p)


def test_bootstrap_over_blocks(spark):
    v = G.exponential(2, 900).round(2)
    rows = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    one = training.bootstrap_mean(rows, "v", draws=4000, seed=3, block=64).first()
    again = training.bootstrap_mean(rows.repartition(7), "v", draws=4000, seed=3, block=64).first()
    assert tuple(one) == pytest.approx(tuple(again), abs=1e-12)
    means = v[G.integers(0, 900, (4000, 900))].mean(1)
    assert one.low == pytest.approx(np.quantile(means, 0.025), abs=0.02) and one.high == pytest.approx(np.quantile(means, 0.975), abs=0.02)
    assert training.bootstrap_mean(rows.limit(0), "v").first().low is None
    same = training.bootstrap_mean(spark.createDataFrame([(4.0,)] * 5, "v double"), "v", draws=100).first()
    assert (same.low, same.high) == (4.0, 4.0)
