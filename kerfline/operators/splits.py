"""Splitting by groups, labels and folds. The order of groups is a hash, so a split is the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def draw(column: str, seed: int) -> Column:
    """Reproducible order key that other engines can compute too."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string")).cast("binary"))


def by_group(rows: DataFrame, group: str, train: float, val: float, seed: int = 0) -> DataFrame:
    """Adds ``split``; whole groups go to train, val or test by count of groups. At least three groups are needed."""
    groups = rows.select(group).distinct().withColumn("_p", F.row_number().over(W.orderBy(draw(group, seed), group))).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy()))
    tests = F.greatest(F.lit(1), F.rint(F.col("_n") * (1 - train - val)))
    vals = F.greatest(F.lit(1), F.rint(F.col("_n") * val))
    split = F.when(F.col("_p") <= tests, "test").when(F.col("_p") <= tests + vals, "val").otherwise("train")
    return rows.join(groups.select(group, split.alias("split"), F.assert_true(F.col("_n") >= 3, "a split needs three groups").isNull().alias("_ok")), group).drop("_ok")


def stratified(rows: DataFrame, label: str, key: str, train: float, val: float, seed: int = 0) -> DataFrame:
    """Shares within each label, by hash order."""
    at = F.percent_rank().over(W.partitionBy(label).orderBy(draw(key, seed), key))
    return rows.withColumn("split", F.when(at < train, "train").when(at < train + val, "val").otherwise("test"))


def share_of(key: str, seed: int) -> Column:
    """A number in [0, 1) by the key, for splits that need no order and so no shuffle."""
    return F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def by_position(rows: DataFrame, step: str, held: list[int], key: str, val: float, seed: int = 0) -> DataFrame:
    """Adds ``split``: rows of the held steps are the test, of the others a share is for validation."""
    if not held:
        raise ValueError("no steps to hold out")
    return rows.withColumn("split", F.when(F.col(step).isin(*held), "test").when(share_of(key, seed) < val, "val").otherwise("train"))


def windows(files: DataFrame, key: str, frames: str, length: int, hop: int, most: int | None = None, seed: int = 0) -> DataFrame:
    """Starts of the windows of each file, at least one; with ``most`` a reproducible choice of so many, as training takes them."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col(frames) - length).cast("long"), F.lit(hop).cast("long")))
    each = files.withColumn("start", start)
    if most is None:
        return each
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col(key) * 1000003 + F.col("start")).cast("string")).cast("binary"))
    return each.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(order, "start"))).where(F.col("_rn") <= most).drop("_rn")


def holdout(rows: DataFrame, group: str, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the held groups, and the others."""
    return rows.join(held, group, "left_semi"), rows.join(held, group, "left_anti")


def folds(sizes: list[tuple[object, int]], k: int) -> dict[object, int]:
    """Groups to folds: the largest first, each to the smallest fold so far. Group sizes come from one aggregate."""
    load = [0] * k
    out: dict[object, int] = {}
    for group, n in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        f = min(range(k), key=lambda i: (load[i], i))
        out[group] = f
        load[f] += n
    return out


def greedy_stratified(counts: dict[object, dict[object, int]], shares: dict[str, float]) -> dict[object, str]:
    """Groups to splits, largest first, each where squared distance of class counts from their shares, and a quarter of that
    of the sizes, grows least. ``counts``: group to class counts."""
    classes = sorted({c for g in counts.values() for c in g}, key=str)
    total = {c: sum(g.get(c, 0) for g in counts.values()) for c in classes}
    whole = sum(total.values())
    held = {s: dict.fromkeys(classes, 0) for s in shares}
    out: dict[object, str] = {}

    def cost(split: str, extra: dict[object, int]) -> float:
        off = sum((held[split][c] + extra.get(c, 0) - shares[split] * total[c]) ** 2 for c in classes)
        size = sum(held[split].values()) + sum(extra.values()) - shares[split] * whole
        return off + 0.25 * size**2

    for group in sorted(counts, key=lambda g: (-sum(counts[g].values()), str(g))):
        best = min(shares, key=lambda s: (cost(s, counts[group]) - cost(s, {}), list(shares).index(s)))
        out[group] = best
        for c, n in counts[group].items():
            held[best][c] += n
    return out


def labels(rows: DataFrame, level: str) -> DataFrame:
    """``class_idx``: dense index of the sorted distinct levels, joined from one row a level."""
    index = rows.select(level).where(F.col(level).isNotNull()).distinct().withColumn("class_idx", F.dense_rank().over(W.orderBy(level)) - 1)
    return rows.join(index, level, "left")


def overlap(rows: DataFrame, value: str, split: str = "split", names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """How many values two splits, or all, share; one pass over values, no sets gathered."""
    flags = rows.groupBy(value).agg(*(F.max((F.col(split) == n).cast("int")).alias(n) for n in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    every = F.col(names[0])
    for n in names[1:]:
        every = every * F.col(n)
    return flags.agg(*(F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}") for a, b in pairs), F.coalesce(F.sum(every), F.lit(0)).alias("all_splits"))
