"""Tables with known columns, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the tables that go in and out.
DOE = "Step int, HoleID string, Depth_mm double"
PREDICTIONS = "row_idx long, record_name string, modality string, validation_mae double, y_pred double, sigma double, y_true double"
HOLES = "HoleID string, X_mm double, Y_mm double"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header and a stated schema: nothing is inferred. NaN becomes null."""
    t = spark.read.csv(path, header=True, schema=schema, nanValue="nan", enforceSchema=False)
    floats = [f.name for f in t.schema.fields if f.dataType.typeName() in ("double", "float")]
    return t.withColumns({c: F.nanvl(c, F.lit(None)) for c in floats}) if floats else t


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows that do not parse are nulls, not failures."""
    return spark.read.schema(schema).json(path, mode="PERMISSIVE")


def hole_positions(doe: DataFrame) -> DataFrame:
    return doe.where(F.col("HoleID").rlike(r"^[A-Z]\d+$")).select("HoleID", "X_mm", "Y_mm").dropDuplicates(["HoleID"])


def with_geometry(rows: DataFrame, holes: DataFrame, x: float, y: float) -> DataFrame:
    """Offset, distance, log distance and angle of each row's hole from a microphone at (x, y); null where the hole is unknown."""
    dx, dy = F.col("X_mm") - x, F.col("Y_mm") - y
    at = rows.join(holes, rows["hole_id"] == holes["HoleID"], "left").withColumns({"mic_dx": dx, "mic_dy": dy})
    r = F.hypot("mic_dx", "mic_dy")
    return at.withColumns({"mic_r": r, "mic_log_r": F.log(F.when(r.isNotNull(), F.greatest(r, F.lit(1e-6)))), "mic_angle": F.atan2("mic_dy", "mic_dx")}).drop("HoleID", "X_mm", "Y_mm")


def write_features(features: DataFrame, path: str) -> dict:
    """Parquet by recording, and what a later run needs to know about it."""
    features.write.mode("overwrite").partitionBy("recording_root").parquet(path)
    return features.agg(F.count(F.lit(1)).alias("rows"), F.min("duration_s").alias("least_s"), F.max("duration_s").alias("most_s"), F.avg("duration_s").alias("mean_s")).first().asDict()


def report(fused: DataFrame) -> DataFrame:
    """One row: counts, errors and the spread of sigma, as JSON beside the columns."""
    e = F.col("y_pred") - F.col("y_true")
    row = fused.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("sigma").alias("sigma_mean"), F.min("sigma").alias("sigma_min"), F.max("sigma").alias("sigma_max"))
    return row.withColumn("json", F.to_json(F.struct(*row.columns)))
