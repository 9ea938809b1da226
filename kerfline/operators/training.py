"""Linear models from sums of products: one pass over the rows gives every fold's normal equations.

A fold's training sums are the totals less its own, so grouped cross-validation costs no further pass. What reaches the
driver is one square matrix of the features a fold.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Linear:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def prediction(self) -> Column:
        out = F.lit(self.intercept)
        for f, w in zip(self.features, self.weights, strict=True):
            out = out + F.col(f) * w
        return out


def sums(rows: DataFrame, features: list[str], target: str, fold: str) -> dict[object, np.ndarray]:
    """Per fold the matrix of products of (1, features, target) over complete rows."""
    names = [F.lit(1.0), *map(F.col, features), F.col(target)]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = rows.dropna(subset=[*features, target]).groupBy(fold).agg(*(F.sum(names[i] * names[j]).alias(f"s{i}_{j}") for i, j in pairs)).collect()
    out = {}
    for r in got:
        m = np.zeros((len(names), len(names)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out[r[fold]] = m
    return out


def ridge(m: np.ndarray, features: list[str], alpha: float) -> Linear:
    """Standardised features (population deviation), penalty ``alpha`` on their weights, none on the intercept."""
    n = m[0, 0]
    mean = m[0, 1:-1] / n
    cov = m[1:-1, 1:-1] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    right = (m[1:-1, -1] / n - mean * m[0, -1] / n) / scale
    w = np.linalg.solve(cov / np.outer(scale, scale) + alpha / n * np.eye(len(features)), right) / scale
    return Linear(tuple(features), tuple(map(float, w)), float(m[0, -1] / n - w @ mean))


def fit(rows: DataFrame, features: list[str], target: str, alpha: float = 0.0) -> Linear:
    return ridge(next(iter(sums(rows.withColumn("_all", F.lit(0)), features, target, "_all").values())), features, alpha)


def out_of_fold(rows: DataFrame, features: list[str], target: str, fold: str, alpha: float = 0.0) -> DataFrame:
    """Adds ``y_pred``: each row by the model of all other folds."""
    own = sums(rows, features, target, fold)
    total = sum(own.values())
    pred = F.lit(None).cast("double")
    for f, m in own.items():
        pred = F.when(F.col(fold) == F.lit(f), ridge(total - m, features, alpha).prediction()).otherwise(pred)
    return rows.withColumn("y_pred", pred)


def ensemble(rows: DataFrame, members: list[str]) -> DataFrame:
    """Unweighted mean of the members' predictions, and the spread between them."""
    mean = sum((F.col(m) for m in members[1:]), F.col(members[0])) / len(members)
    return rows.withColumn("y_pred", mean).withColumn("sigma", F.sqrt(sum(((F.col(m) - F.col("y_pred")) ** 2 for m in members[1:]), (F.col(members[0]) - F.col("y_pred")) ** 2) / len(members)))


def paired(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Mean difference, t statistic and standardised effect of pairs."""
    d = F.col(a) - F.col(b)
    out = rows.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    return out.withColumn("t", F.try_divide(F.col("mean") * F.sqrt("n"), F.col("sd"))).withColumn("dz", F.try_divide("mean", "sd"))


def t_cdf(t: float, df: float) -> float:
    """Student's distribution function, by the continued fraction of the incomplete beta function."""
    if t == 0 or df <= 0:
        return 0.5
    x, a, b = df / (df + t * t), df / 2, 0.5
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(max(x, 1e-300)) + b * log(max(1 - x, 1e-300))) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or 1e-300)
        c = 1 + step / c or 1e-300
        f *= c * d
        if i and abs(1 - c * d) < 1e-14:
            break
    part = front * (f - 1)
    part = 1 - part if flip else part
    return 1 - part / 2 if t > 0 else part / 2


EXACT = 50  # pairs up to which signed ranks have their exact p
AT_ONCE = 500  # resamples drawn together


def paired_tests(rows: DataFrame, a: str, b: str, delta: float, by: str, alpha: float = 0.05) -> DataFrame:
    """Per group: mean difference, t with its two-sided p, effect size, the two one-sided tests against ``delta`` and whether they agree on equivalence, and Wilcoxon's signed-rank
    statistic (ties averaged, zeros left out), its p exact for at most ``EXACT`` pairs without ties or zeros and else that of its normal form. Sums come from Spark; one row a group is finished here."""
    from kerfline.operators.windows import counted_ranks

    d = rows.select(by, (F.col(a) - F.col(b)).alias("d")).dropna()
    signed = d.where("d <> 0").withColumn("size", F.round(F.abs("d"), 12))
    up = F.col("d") > 0
    counts = signed.groupBy(by, "size").agg(F.count(F.when(up, 1)).alias("_up"), F.count(F.lit(1)).alias("_n")).withColumn("_g", F.col(by).cast("string"))
    ranks = counted_ranks(counts.select("_g", "size", "_n"), "size", "_g")
    ranked = counts.join(ranks, ["_g", "size"])  # one row a size
    n = F.col("n")
    ties = ranked.groupBy(by).agg(F.sum(n * (n * n - 1)).alias("ties"))
    w = ranked.groupBy(by).agg(F.sum(F.col("_up") * F.col("rank")).alias("up"), F.sum((n - F.col("_up")) * F.col("rank")).alias("down"), F.sum("n").alias("m"))
    sums = paired(rows, a, b, by).join(w, by, "left").join(ties, by, "left")
    m = F.col("m").cast("double")
    z = F.try_divide(F.least("up", "down") - m * (m + 1) / 4, F.sqrt((m * (m + 1) * (2 * m + 1) - F.col("ties") / 2) / 24))
    sums = sums.withColumns({"w": F.least("up", "down"), "w_z": z, "se": F.col("sd") / F.sqrt("n")})

    def finished(batches):
        import pandas as pd
        from math import erfc, sqrt

        for batch in batches:
            r: pd.DataFrame = batch
            df = r["n"] - 1
            p = [2 * (1 - t_cdf(abs(t), k)) if t == t else None for t, k in zip(r["t"], df, strict=True)]
            low = [1 - t_cdf((x + delta) / s, k) if s and s == s else None for x, s, k in zip(r["mean"], r["se"], df, strict=True)]
            high = [t_cdf((x - delta) / s, k) if s and s == s else None for x, s, k in zip(r["mean"], r["se"], df, strict=True)]
            same = [None if x is None else x < alpha and y < alpha for x, y in zip(low, high, strict=True)]
            exact = (r["m"] <= EXACT) & (r["ties"] == 0) & (r["m"] == r["n"])
            w_p = [signed_rank_p(w, int(m)) if e else erfc(abs(x) / sqrt(2)) if x == x and x is not None else None for x, w, m, e in zip(r["w_z"], r["w"], r["m"], exact, strict=True)]
            yield r[[by, "n", "mean", "t", "dz", "w"]].assign(p=p, tost_p1=low, tost_p2=high, equivalent=same, w_p=w_p)

    kind = rows.schema[by].dataType.simpleString()
    return sums.select(by, "n", "mean", "t", "dz", "w", "w_z", "se", "m", "ties").mapInPandas(finished, f"{by} {kind}, n long, mean double, t double, dz double, w double, p double, tost_p1 double, tost_p2 double, equivalent boolean, w_p double")


def bootstrap_mean(rows: DataFrame, value: str, draws: int = 20_000, alpha: float = 0.05, seed: int = 0, block: int = 2048) -> DataFrame:
    """``low, high`` of the mean over resamples of as many rows, drawn with replacement.

    Values are counted, and the counts dealt to blocks. A resample deals its rows to the blocks by one multinomial draw, which every task makes anew from the same seed, and a block's rows to its
    values by another, so no resample and no list of rows is ever gathered: a task holds one block and ``AT_ONCE`` resamples. The interval depends on the values and the seed only."""
    counts = rows.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    distinct = counts.count()
    if not distinct:
        return rows.sparkSession.createDataFrame([(None, None)], "low double, high double")
    blocks = -(-distinct // block)
    dealt = counts.withColumn("b", F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(blocks)).cast("int"))
    sizes = np.zeros(blocks, "i8")
    for b, n in dealt.groupBy("b").agg(F.sum("n")).collect():  # one row a block
        sizes[b] = n
    share = sizes / sizes.sum()

    def drawn(key: tuple, table: pa.Table) -> pa.Table:
        b, v, n = key[0].as_py(), table.column("v").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(v)
        v, own = v[order], n[order] / n.sum()
        out = []
        for s in range(0, draws, AT_ONCE):
            k = min(AT_ONCE, draws - s)
            mine = np.random.default_rng([seed, s]).multinomial(int(sizes.sum()), share, size=k)[:, b]
            out.append(np.random.default_rng([seed, s, b + 1]).multinomial(mine, own) @ v)
        return pa.table({"k": pa.array(np.arange(draws)), "s": pa.array(np.concatenate(out))})

    sums = dealt.groupBy("b").applyInArrow(drawn, "k long, s double").groupBy("k").agg((F.sum("s") / float(sizes.sum())).alias("m"))
    return sums.agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"))


def signed_rank_p(w: float, m: int) -> float:
    """Two-sided p of the smaller rank sum ``w`` of ``m`` pairs without ties: how many of the 2**m choices of signs give no more, counted by sums."""
    ways = [1]
    for rank in range(1, m + 1):
        wider = ways + [0] * rank
        for k, n in enumerate(ways):
            wider[k + rank] += n
        ways = wider
    return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**m)


def correlation_p(rows: DataFrame, r: str, n: str, controls: int = 0, name: str = "p") -> DataFrame:
    """Adds the two-sided p of correlations of ``n`` rows with so many controls taken out, by Student's t."""

    @F.pandas_udf("double")
    def p(r, n):
        out = []
        for x, m in zip(r, n, strict=True):
            df = m - 2 - controls
            out.append(None if x != x or df < 1 else 0.0 if abs(x) >= 1 else 2 * (1 - t_cdf(abs(x) * (df / (1 - x * x)) ** 0.5, df)))
        return r.__class__(out, dtype="float64")

    return rows.withColumn(name, p(F.col(r), F.col(n)))
