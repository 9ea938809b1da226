"""Fitted models as versioned folders: named by the hash of what is in them, checked when loaded, with a pointer to the current one.

``<root>/<name>/<version>/`` holds the stages of a pipeline, ``model.json`` (features' medians, settings, measures and other facts) and ``files.json`` (each file's SHA-256). A version is written aside
and moved to its place whole; ``<root>/<name>/CURRENT`` is replaced in one step. Hashes are made by Spark over the files, not by the driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfline.operators import ledger
from kerfline.operators.forests import ExtraTreesModel, Trees

POINTER = "CURRENT"
OWN = ("files.json",)


@dataclass(frozen=True)
class Saved:
    """What is kept beside the stages: medians that fill gaps, by feature in the model's order; settings, measures, and whatever else is to be found again."""

    held: dict[str, float]
    settings: dict = field(default_factory=dict)
    measures: dict = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


class Files:
    """Small files and moves on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(name, wholetext=True).collect())  # one small file

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), True)
        out.write(text.encode())
        out.close()

    def replace(self, source: str, target: str) -> None:
        """Move a file over another in one step."""
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(source), self.path(target), how)

    def move(self, source: str, target: str) -> bool:
        self.fs.mkdirs(self.path(target).getParent())
        return self.fs.rename(self.path(source), self.path(target))

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """``key, sha`` of every file below a folder, by its path in it, parts of tables by their numbers only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    key = F.regexp_extract("path", rf".*/{folder.rstrip('/').rpartition('/')[2]}/(.*)", 1)
    key = F.regexp_replace(key, r"part-(\d+)-[0-9a-f-]{36}(-c\d+)?", "part-$1")
    return files.select(key.alias("key"), F.sha2("content", 256).alias("sha")).where(~F.col("key").isin(*OWN))


def _save_stage(spark: SparkSession, stage, path: str) -> str:
    if isinstance(stage, ExtraTreesModel):
        t = stage.trees
        rows = [(i, int(f), float(c), int(n), float(v)) for i, (f, c, n, v) in enumerate(zip(t.feature, t.cut, t.child, t.value, strict=True))]
        spark.createDataFrame(rows, "node long, feature int, cut double, child long, value double").coalesce(1).write.parquet(f"{path}/nodes")
        facts = [(t.roots, t.depth, *stage.columns, [float(v) for v in stage.featureImportances])]
        spark.createDataFrame(facts, "roots int, depth int, features string, prediction string, importance array<double>").coalesce(1).write.json(f"{path}/facts")
        return "ExtraTreesModel"
    stage.write().save(path)
    return "pyspark"


def _load_stage(spark: SparkSession, kind: str, path: str):
    if kind == "ExtraTreesModel":
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("node").toPandas()
        facts = spark.read.schema("roots int, depth int, features string, prediction string, importance array<double>").json(f"{path}/facts").first()
        trees = Trees(*(nodes[c].to_numpy() for c in ("feature", "cut", "child", "value")), facts["roots"], facts["depth"])
        return ExtraTreesModel(trees, np.array(facts["importance"]), facts["features"], facts["prediction"])
    return DefaultParamsReader.loadParamsInstance(path, spark.sparkContext)


def publish(spark: SparkSession, root: str, name: str, model: PipelineModel, saved: Saved, current: bool = True) -> str:
    """Write a version and, unless told otherwise, make it the current one. The same content again is the same version."""
    files, aside = Files(spark, root), f"{root}/_writing-{uuid.uuid4().hex}"
    try:
        kinds = [_save_stage(spark, stage, f"{aside}/stages/{i:02d}") for i, stage in enumerate(model.stages)]
        files.write(f"{aside}/model.json", json.dumps({"kinds": kinds, "held": saved.held, "settings": saved.settings, "measures": saved.measures, "facts": saved.facts}, sort_keys=True))
        shas = {r.key: r.sha for r in fingerprint(spark, aside).collect()}  # the files of one model
        version = hashlib.sha256("".join(f"{k}:{shas[k]}\n" for k in sorted(shas)).encode()).hexdigest()[:24]
        files.write(f"{aside}/files.json", json.dumps(shas, sort_keys=True))
        if not files.exists(f"{root}/{name}/{version}"):
            files.move(aside, f"{root}/{name}/{version}")
    finally:
        files.remove(aside)
    if current:
        point(spark, root, name, version)
    return version


def point(spark: SparkSession, root: str, name: str, version: str) -> None:
    """Make a version the current one."""
    files = Files(spark, root)
    if not files.exists(f"{root}/{name}/{version}/files.json"):
        raise ValueError(f"{name} has no version {version}")
    aside = f"{root}/{name}/.{uuid.uuid4().hex}"
    files.write(aside, version)
    files.replace(aside, f"{root}/{name}/{POINTER}")


def current(spark: SparkSession, root: str, name: str) -> str:
    files = Files(spark, root)
    if not files.exists(f"{root}/{name}/{POINTER}"):
        raise ValueError(f"{name} has no current version")
    return files.read(f"{root}/{name}/{POINTER}").strip()


def load(spark: SparkSession, root: str, name: str, version: str | None = None) -> tuple[PipelineModel, Saved, str]:
    """A version, the current one unless told otherwise; files that are missing, new or changed fail by name."""
    version = version or current(spark, root, name)
    at, files = f"{root}/{name}/{version}", Files(spark, root)
    if not files.exists(f"{at}/files.json"):
        raise ValueError(f"{name} has no version {version}")
    known = json.loads(files.read(f"{at}/files.json"))
    now = {r.key: r.sha for r in fingerprint(spark, at).collect()}
    off = sorted(k for k in known.keys() | now.keys() if known.get(k) != now.get(k))
    if off:
        raise ValueError(f"{name} {version} is not as it was saved: {', '.join(off[:5])}")
    facts = json.loads(files.read(f"{at}/model.json"))
    stages = [_load_stage(spark, kind, f"{at}/stages/{i:02d}") for i, kind in enumerate(facts.pop("kinds"))]
    return PipelineModel(stages), Saved(**facts), version


def versions(spark: SparkSession, root: str) -> DataFrame:
    """``name, version, is_current, settings, measures, facts``: all that is there, facts as JSON."""
    files, rows = Files(spark, root), []
    for name in (n for n in files.names(root) if not n.startswith(("_", "."))):
        now = current(spark, root, name) if files.exists(f"{root}/{name}/{POINTER}") else None
        rows += [(name, v, v == now, f"{root}/{name}/{v}/model.json") for v in files.names(f"{root}/{name}") if files.exists(f"{root}/{name}/{v}/files.json")]
    listed = spark.createDataFrame(rows, "name string, version string, is_current boolean, path string")
    if not rows:
        return listed.select("name", "version", "is_current", *(F.lit("").alias(c) for c in ("settings", "measures", "facts")))
    said = spark.read.text([r[3] for r in rows], wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)/([^/]+)/model\.json$", 1).alias("name"), F.regexp_extract(F.input_file_name(), r"([^/]+)/([^/]+)/model\.json$", 2).alias("version"), "value")
    part = lambda c: F.get_json_object("value", f"$.{c}").alias(c)
    return listed.drop("path").join(said, ["name", "version"]).select("name", "version", "is_current", part("settings"), part("measures"), part("facts"))


def drift(spark: SparkSession, root: str, name: str, before: str, after: str | None = None) -> DataFrame:
    """File by file, what has changed from a version to another."""
    new = after or current(spark, root, name)
    return ledger.drift(*(fingerprint(spark, f"{root}/{name}/{v}") for v in (new, before)))
