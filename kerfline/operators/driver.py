"""Training from feature rows to registered models, as stages that are not done twice.

A stage's result is a table under ``<root>/stages``, named by a hash of what it is made from: the rows (counted and summed as hashes by Spark, in any order), its settings and the hash of the stage
before. A stage whose table is complete is read, so a run that broke off goes on where it stopped, and a change of settings repeats only what depends on them. Fitted models go to the
registry, and their stage's table holds the version.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfline.operators import metrics, models, registry, selection, splits, training


def rows_hash(rows: DataFrame, columns: list[str]) -> str:
    """Of the rows' values, whatever their order and partitions."""
    h = F.xxhash64(*(F.col(c) for c in columns))
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"), F.sum(h.bitwiseAND(F.lit((1 << 32) - 1))).alias("low")).first()
    return stage_hash(columns, *got)


def stage_hash(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


class Memo:
    """Tables of finished stages; ``ran`` names those that were made now."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.ran = spark, root, []

    def table(self, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/stages/{name}-{key}"
        if not registry.Files(self.spark, self.root).exists(f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
            self.ran.append(name)
        return self.spark.read.parquet(path)


@dataclass(frozen=True)
class Plan:
    """What to train on and how."""

    features: tuple[str, ...]
    target: str
    group: str
    specs: tuple[models.Spec, ...] = models.SPECS["fast"]
    least: float = 0.1  # rank correlation of a feature
    top: int = 60
    pruned_at: float = 0.75
    outer: int = 5
    inner: int = 3
    most: int | None = None  # candidates of a grid
    members: int = 3
    goal: float = 0.05
    step: float = 0.1


@dataclass
class Trained:
    selected: list[str]
    search: DataFrame
    summary: DataFrame
    versions: dict[str, str]  # best first
    holdout: DataFrame | None
    ran: list[str] = field(default_factory=list)


def best_settings(train: DataFrame, spec: models.Spec, features: list[str], plan: Plan) -> tuple[dict, float]:
    """The candidate with the least mean error over grouped folds of all training rows, the first of equals, and that error."""
    dealt = models.with_folds(train, plan.group, plan.inner, "_inner").cache()
    try:
        tried = [(sum(r["mae"] for r in models.scored(dealt, spec, c, features, plan.target, "_inner")) / plan.inner, i, c) for i, c in enumerate(spec.candidates(plan.most))]
    finally:
        dealt.unpersist()
    error, _, best = min(tried, key=lambda t: t[:2])
    return best, error


def train(spark: SparkSession, root: str, rows: DataFrame, plan: Plan, held: DataFrame | None = None) -> Trained:
    """Selection, nested search, refit of the best models on all training rows, and their errors and their ensemble's on the held-out groups of ``held(<group>)``."""
    memo = Memo(spark, root)
    wanted = [*plan.features, plan.target, plan.group]
    rows = rows.select(*wanted).dropna(subset=[plan.target])
    outside, inside = splits.holdout(rows, plan.group, held) if held is not None else (None, rows)
    key = stage_hash(rows_hash(inside, wanted), plan.features, plan.target, plan.least, plan.top, plan.pruned_at)

    def select() -> DataFrame:
        found = selection.select(inside, list(plan.features), plan.target, plan.least, plan.top, plan.pruned_at)
        if not found:
            raise ValueError("no feature is left")
        return spark.createDataFrame(list(enumerate(found)), "place int, feature string")

    chosen = [r.feature for r in memo.table("selected", key, select).orderBy("place").collect()]
    described = [(s.name, s.kind.__name__, s.fixed, s.grid) for s in plan.specs]
    key = stage_hash(key, chosen, plan.group, described, plan.outer, plan.inner, plan.most)
    search = memo.table("search", key, lambda: models.nested(inside, plan.specs, chosen, plan.target, plan.group, plan.outer, plan.inner, plan.most))
    summary = models.summary(search, plan.goal, plan.step)
    names = [r.model for r in summary.limit(plan.members).collect()]
    versions, by_name = {}, {s.name: s for s in plan.specs}
    for name in names:

        def refit(spec: models.Spec = by_name[name]) -> DataFrame:
            settings, error = best_settings(inside, spec, chosen, plan)
            model, medians = models.fit(inside, spec, settings, chosen, plan.target)
            saved = registry.Saved(medians, settings, {"inner_mae": error}, {"stage": key, "target": plan.target})
            return spark.createDataFrame([(spec.name, registry.publish(spark, f"{root}/models", spec.name, model, saved))], "model string, version string")

        versions[name] = memo.table(f"refit-{name}", key, refit).first()["version"]
    measured = None
    if outside is not None:

        def evaluate() -> DataFrame:
            at, columns = outside, [f"_{n}" for n in names]
            for n, c in zip(names, columns, strict=True):
                model, saved, _ = registry.load(spark, f"{root}/models", n, versions[n])
                at = models.predict(at, model, saved.held, c)
            at = training.ensemble(at, columns)
            each = [at.agg(*metrics.errors(plan.target, c)).withColumn("model", F.lit(n)) for n, c in (*zip(names, columns, strict=True), ("ensemble", "y_pred"))]
            out = each[0]
            for e in each[1:]:
                out = out.unionByName(e)
            return out.withColumn("goal_met", F.col("mae") < plan.goal)

        measured = memo.table("holdout", stage_hash(key, versions, rows_hash(outside, wanted), plan.goal), evaluate)
    return Trained(chosen, search, summary, versions, measured, memo.ran)
