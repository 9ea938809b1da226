"""Error, reliability and classification measures as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(truth: str, pred: str) -> list[Column]:
    """MAE, RMSE, R2 and mean signed error in one pass, over rows where both are present."""
    t, p = F.col(truth), F.col(pred)
    both = t.isNotNull() & p.isNotNull()
    e = F.when(both, p - t)
    held = F.when(both, t)
    return [
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.count(e).alias("n"),
        (1 - F.try_divide(F.sum(e * e), F.count(e) * F.var_pop(held))).alias("r2"),
    ]


def variance(x: str) -> Column:
    """Sample variance, exactly 0 where all values are equal: adding up parts leaves a rest of rounding there, which a ratio would take for a spread."""
    same = (F.count(x) > 1) & (F.max(x) - F.min(x) == 0)
    return F.when(same, 0.0).otherwise(F.var_samp(x))


def error_quantiles(truth: str, pred: str, at: dict[str, float]) -> list[Column]:
    """Exact quantiles of the absolute error, interpolated linearly."""
    e = F.abs(F.col(pred) - F.col(truth))
    return [F.percentile(e, q).alias(name) for name, q in at.items()]


def within(truth: str, pred: str, tolerances: dict[str, float]) -> list[Column]:
    e = F.abs(F.col(pred) - F.col(truth))
    return [F.avg(F.when(e <= x, 1.0).otherwise(0.0)).alias(name) for name, x in tolerances.items()]


def reliability(truth: str, pred: str) -> list[Column]:
    return [
        *errors(truth, pred)[:4],
        *error_quantiles(truth, pred, {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "worst": 1.0}),
        *within(truth, pred, {"within_05": 0.05, "within_10": 0.10, "within_15": 0.15}),
    ]


def coverage(residual: str, sigma: str) -> list[Column]:
    """Shares within one and two sigma, over rows with a positive finite sigma."""
    s = F.col(sigma)
    ok = (s > 0) & (s < float("inf"))
    hit = lambda k: F.avg(F.when(ok, (F.abs(F.col(residual)) <= k * s).cast("double")))
    return [hit(1).alias("coverage_1sigma"), hit(2).alias("coverage_2sigma"), F.avg(F.when(ok, s)).alias("mean_sigma"), F.count(F.when(ok, 1)).alias("n_sigma")]


def per_class(rows: DataFrame, truth: str, pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where nothing is to divide by. Three counts a class, no pairs."""
    ends = rows.select(*by, F.explode(F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("is_true"), F.lit(0).alias("is_pred"), (F.col(truth) == F.col(pred)).cast("int").alias("hit")), F.struct(F.col(pred).alias("class"), F.lit(0).alias("is_true"), F.lit(1).alias("is_pred"), F.lit(0).alias("hit")))).alias("s")).select(*by, "s.*")
    counts = ends.groupBy(*by, "class").agg(F.sum("is_true").alias("support"), F.sum("is_pred").alias("predicted"), F.sum("hit").alias("hits"))
    precision, recall = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    scored = counts.withColumn("precision", precision).withColumn("recall", recall)
    return scored.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).select(*by, "class", "precision", "recall", "f1", "support")


def classification(rows: DataFrame, truth: str, pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, balanced accuracy (over classes that occur) and macro F1."""
    c = per_class(rows, truth, pred, by)
    return c.groupBy(*by).agg(
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), F.sum("support").alias("n"),
    )


def confusion(rows: DataFrame, truth: str, pred: str, labels: list) -> DataFrame:
    """Rows are truths, columns predictions in the order of ``labels``."""
    return rows.groupBy(truth).pivot(pred, labels).count().fillna(0)


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Inverse frequencies over their mean."""
    c = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    mean = c.agg(F.avg(1 / F.col("n")).alias("m"))
    return c.crossJoin(F.broadcast(mean)).select(label, "n", (1 / F.col("n") / F.col("m")).alias("weight"))  # a one-row side


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width bins; the upper end belongs to the last."""
    at = F.least(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return values.where(F.col(column).between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def holdout(rows: DataFrame, truth: str, raw: str, snapped: str, goal: float, step: float, *by: str) -> DataFrame:
    """Errors of the snapped predictions and of the raw ones, the goal, and the error as a fraction of the plan's step."""
    out = rows.groupBy(*by).agg(*errors(truth, snapped), F.avg(F.abs(F.col(raw) - F.col(truth))).alias("mae_raw"), F.count(F.lit(1)).alias("rows"))
    return out.withColumn("goal_met", F.col("mae") < goal).withColumn("fraction_of_step", F.col("mae") / step)


def nearest(value: Column, levels: tuple[float, ...]) -> Column:
    """The level next to a value, the smaller of equals."""
    return F.array_min(F.transform(F.array(*map(F.lit, levels)), lambda x: F.struct(F.round(F.abs(x - value), 9).alias("d"), x.alias("x"))))["x"]


def step_decisions(rows: DataFrame, truth: str, pred: str, levels: tuple[float, ...], step: float, band: float) -> DataFrame:
    """Rounding to levels with abstention: a prediction within ``band`` of the border between two levels is not decided."""
    border = F.array_min(F.transform(F.array(*(F.lit(x + step / 2) for x in levels[:-1])), lambda b: F.abs(b - F.col(pred))))
    n = rows.select(nearest(F.col(truth), levels).alias("t"), nearest(F.col(pred), levels).alias("d"), (border > band).alias("sure"))
    hit, off, sure = (F.col("t") == F.col("d")).cast("double"), F.rint(F.abs(F.col("t") - F.col("d")) / step), F.col("sure")
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return n.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(sure, 1)).alias("n_confident"), mean(sure.cast("double"), "coverage"), mean((~sure).cast("double"), "abstention"), mean(hit, "forced_accuracy"), mean(F.when(sure, hit), "confident_accuracy"),
        mean(F.when(sure, hit).otherwise(0.0), "decided_accuracy"), mean(F.when(sure, (off >= 1).cast("double")), "off_by_1"), mean(F.when(sure, (off >= 2).cast("double")), "off_by_2"),
    )
