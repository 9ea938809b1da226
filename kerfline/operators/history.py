"""Runs from what they have left in their folders: files by run, reports as semi-structured values, and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kerfline.operators import records
from kerfline.operators.ledger import latest

# The folder of results, and what a run of each mode must leave there.
FINAL = "final"
REQUIRED = {"single": ("final_predictions.csv", "single_prediction_report.json"), "batch": ("final_predictions.csv", "batch_quality_report.json")}


def files(spark: SparkSession, root: str) -> DataFrame:
    """``path, folder, below, mtime``: every file under the folder of a run, and its place in it. Nothing is read; run folders are those right below the root."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("modificationTime").alias("mtime"))
    inside = F.regexp_extract("path", rf"/{root.rstrip('/').rpartition('/')[2]}/(.*)", 1)
    return listed.select("path", F.regexp_extract(inside, r"^([^/]+)/", 1).alias("folder"), F.regexp_extract(inside, r"^[^/]+/(.*)", 1).alias("below"), "mtime").where("folder <> ''")


def resolved(runs: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``base`` to ``runs(run_id, folder, ...)``: where a run's results lie, its folder itself ('') or else the child with a folder of results that changed last (ties: the
    last by name); null where there is none."""
    final = found.select("folder", F.regexp_extract("below", rf"^((?:[^/]+/)?){FINAL}/", 1).alias("base"), F.col("below").rlike(rf"^(?:[^/]+/)?{FINAL}/").alias("is_final"), "mtime").where("is_final")
    bases = final.groupBy("folder", "base").agg(F.max("mtime").alias("at"))
    best = bases.groupBy("folder").agg(F.max_by("base", F.struct((F.col("base") == "").alias("itself"), "at", "base")).alias("base"))
    return runs.join(best, "folder", "left")


def complete(runs: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``missing``, the required files that a run of its ``mode`` has not left, and ``modalities``, for which it has folders, to what ``resolved`` gives."""
    of = runs.select("run_id", "folder", "base", "mode").join(found.select("folder", "below"), "folder")
    inside = F.expr("substr(below, length(base) + 1)")
    there = of.where("base IS NOT NULL AND startswith(below, base)").groupBy("run_id").agg(F.collect_set(F.when(inside.startswith(f"{FINAL}/"), F.substr(inside, F.lit(len(FINAL) + 2)))).alias("_final"), F.array_sort(F.collect_set(F.regexp_extract(inside, r"^(airborne|structure)/", 1))).alias("_m"))
    need = F.lit(None).cast("array<string>")
    for mode, names in REQUIRED.items():
        need = F.when(F.col("mode") == mode, F.array(*map(F.lit, names))).otherwise(need)
    need = F.coalesce(need, F.array(*map(F.lit, REQUIRED["batch"])))
    none = F.array().cast("array<string>")
    out = runs.join(there, "run_id", "left")
    return out.withColumns({"missing": F.array_except(need, F.coalesce("_final", none)), "modalities": F.array_remove(F.coalesce("_m", none), "")}).drop("_final", "_m")


def reports(spark: SparkSession, runs: DataFrame, found: DataFrame) -> DataFrame:
    """``run_id, report, body``: the JSON files of each run's results as semi-structured values; a file that is no JSON has a null body."""
    wanted = runs.select("run_id", "folder", "base").join(found, "folder").where(F.expr(f"below RLIKE '{FINAL}/[^/]+[.]json$' AND startswith(below, concat(base, '{FINAL}/'))"))
    paths = [r.path for r in wanted.select("path").distinct().collect()]  # a few for each run asked for
    if not paths:
        return wanted.select("run_id", F.lit("").alias("report"), F.expr("parse_json('null')").alias("body")).limit(0)
    text = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("_p"), F.expr("try_parse_json(value)").alias("body"))
    name = lambda c: F.regexp_replace(F.col(c), r"^file:/+", "/")
    return wanted.join(text, name("path") == name("_p")).select("run_id", F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("report"), "body")


def fields(bodies: DataFrame, wanted: dict[str, tuple[str, str]], *keep: str, body: str = "body") -> DataFrame:
    """Columns out of semi-structured values: ``{name: (path, type)}``. What a value lacks, or has in another type, is null."""
    return bodies.select(*keep, *(F.try_variant_get(body, path, kind).alias(name) for name, (path, kind) in wanted.items()))


def states(log: DataFrame, *values: str) -> DataFrame:
    """The last state of each run from its events ``run_id, seq, ...``, and how many it has had."""
    return latest(log, "run_id", "seq", *values).join(log.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_events")), "run_id")


def listed(runs: DataFrame, most: int, order: str = "created_at") -> DataFrame:
    """The newest runs, as a report."""
    return runs.orderBy(F.desc(order), F.desc("run_id")).limit(most)


def last_succeeded(runs: DataFrame, by: str | None = None, order: str = "created_at") -> DataFrame:
    """The newest run that succeeded, of each ``by`` or of all."""
    done = runs.where("status = 'succeeded'")
    key = [by] if by else []
    top = done.groupBy(*key).agg(F.max(F.struct(order, "run_id")).alias("_t"))
    at = F.struct(order, "run_id") == F.col("_t")
    return done.join(F.broadcast(top), on=key, how="inner").where(at).drop("_t") if by else done.join(F.broadcast(top), at).drop("_t")  # one row a value of ``by``


def segment_files(manifest: DataFrame, modality: str) -> DataFrame:
    """``run_id, key, path``: the last file of each segment of ``manifest(run_id, pos, step, hole_id, output_path)``, by step and hole."""
    keyed = manifest.withColumn("key", records.step_key(F.col("step"), F.col("hole_id"))).where("key IS NOT NULL AND trim(output_path) <> ''")
    w = W.partitionBy("run_id", "key").orderBy(F.desc("pos"))
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("run_id", "key", F.lit(modality).alias("modality"), F.col("output_path").alias("path"))
