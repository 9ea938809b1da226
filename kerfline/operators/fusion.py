"""Aligning predictions of several sources and fusing them.

Input is one long frame ``modality, validation_mae, record_name, row_idx, y_pred, sigma, y_true``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kerfline.functions.names import confidence

FLOOR = 0.05
TINY = 1e-9


def last_rows(rows: DataFrame) -> DataFrame:
    """One row a modality and record: the last by ``row_idx``."""
    rest = [c for c in rows.columns if c not in ("modality", "record_name")]
    return rows.groupBy("modality", "record_name").agg(F.max_by(F.struct(*rest), "row_idx").alias("r")).select("modality", "record_name", *(F.col(f"r.{c}").alias(c) for c in rest))


def aligned(rows: DataFrame, members: int) -> DataFrame:
    """Records that all ``members`` modalities have, one row each."""
    n = F.count("modality").over(W.partitionBy("record_name"))
    return last_rows(rows).withColumn("_n", n).where(F.col("_n") == members).drop("_n")


def raw_weight(mae: Column, floor: float = FLOOR) -> Column:
    return F.greatest(1 / (mae + TINY), F.lit(floor))


def normalised(weight: Column, by: W) -> Column:
    """Shares of the sum; equal shares where any weight is missing, infinite or not positive."""
    bad = weight.isNull() | F.isnan(weight) | (weight == float("inf")) | (weight <= 0)
    return F.when(F.max(bad.cast("int")).over(by) == 1, 1 / F.count(F.lit(1)).over(by)).otherwise(weight / F.sum(weight).over(by))


def fuse(rows: DataFrame, members: int, floor: float = FLOOR) -> DataFrame:
    """Per record: fused prediction, sigma from disagreement and members' own, and the fused reference error.

    Weights go over the members that have a prediction; a record where none has one stays, with nulls."""
    by = W.partitionBy("record_name")
    # Members without a prediction stay as rows without a weight, so truth and fusion come from one grouping.
    ok = F.col("y_pred").isNotNull() & ~F.isnan("y_pred")
    raw = F.when(ok, raw_weight(F.col("validation_mae"), floor))
    bad = ok & (raw.isNull() | F.isnan(raw) | (raw == float("inf")) | (raw <= 0))
    weight = F.when(F.max(bad.cast("int")).over(by) == 1, 1 / F.count(F.when(ok, 1)).over(by)).otherwise(raw / F.sum(raw).over(by))
    w = aligned(rows, members).withColumn("w", F.when(ok, weight))
    mu = w.withColumn("mu", F.sum(F.col("w") * F.col("y_pred")).over(by))
    spread = F.col("w") * (F.pow(F.col("y_pred") - F.col("mu"), 2) + F.pow(F.coalesce("sigma", F.lit(0.0)), 2))
    out = mu.groupBy("record_name").agg(
        F.max("y_true").alias("y_true"), F.max("mu").alias("y_pred"), F.sqrt(F.when(F.count("w") > 0, F.greatest(F.sum(spread), F.lit(0.0)))).alias("sigma"),
        F.sum(F.col("w") * F.col("validation_mae")).alias("reference_mae"), F.nullif(F.count("w"), F.lit(0)).alias("members"),
    )
    return out


def disagreement(rows: DataFrame, members: int, floor: float = FLOOR) -> DataFrame:
    """Weighted mean and the weighted spread around it, members' own sigmas aside."""
    by = W.partitionBy("record_name")
    w = aligned(rows, members).where(F.col("y_pred").isNotNull()).withColumn("w", normalised(raw_weight(F.col("validation_mae"), floor), by))
    mu = w.withColumn("mu", F.sum(F.col("w") * F.col("y_pred")).over(by))
    return mu.groupBy("record_name").agg(F.max("mu").alias("y_pred"), F.sqrt(F.sum(F.col("w") * F.pow(F.col("y_pred") - F.col("mu"), 2))).alias("sigma"))


def with_residuals(fused: DataFrame) -> DataFrame:
    """Confidence label, residual (prediction minus truth), its size, its z-score and whether it lies within 1 and 2 sigma."""
    r = F.col("y_pred") - F.col("y_true")
    return fused.withColumns({
        "confidence_label": confidence(F.col("sigma")), "residual_mm": r, "abs_residual_mm": F.abs(r), "z_score": F.try_divide(F.abs(r), F.col("sigma")),
        "within_1sigma": F.abs(r) <= F.col("sigma"), "within_2sigma": F.abs(r) <= 2 * F.col("sigma"),
    })


def reference_mae(measured: Column, configured: Column) -> Column:
    """From the artefact, else from the settings."""
    return F.coalesce(F.nanvl(measured, F.lit(None).cast("double")), configured)
