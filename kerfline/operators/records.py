"""Record tables: columns brought into line, keys, labels, truth, choice of rows, and what is known of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window as W

from kerfline.functions import names

#: Columns in which a true value may stand, in the order they are asked for.
TRUTHS = ("y_true", "depth_mm", "y_true_depth")
#: Columns that follow from a truth or a sigma.
DERIVED = ("residual", "residual_mm", "abs_residual_mm", "z_abs", "within_1sigma", "within_2sigma", "confidence_label")


def numeric_columns(rows: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in rows.schema.fields if isinstance(f.dataType, NumericType) and f.name not in without]


def aligned(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns asked for, in that order; those that are missing as null doubles."""
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in columns))


def require(rows: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return rows


def rounded(rows: DataFrame, digits: int = 4) -> DataFrame:
    """All fractions to so many digits, halves to even."""
    return rows.select(*(F.bround(f.name, digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in rows.schema.fields))


def localised(code: Column, labels: dict[str, str]) -> Column:
    """A code's label, the code itself where it has none."""
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(table, code), code)


def mirrored_hole(hole: Column, mode: str) -> Column:
    """A hole of the 7 x 7 plate after ``rot180`` about its centre or ``mirror_col4`` across its middle column; else only in normal form."""
    h = F.upper(F.trim(hole))
    letter, number = F.substring(h, 1, 1), F.substring(h, 2, 1).try_cast("int")
    if mode == "rot180":
        return F.concat(F.translate(letter, "ABCDEFG", "GFEDCBA"), (8 - number).cast("string"))
    return F.concat(letter, (8 - number).cast("string")) if mode == "mirror_col4" else h


def step_key(step: Column, hole: Column) -> Column:
    """``step=007__hole=B2``; null where either is missing, blank or no number."""
    n, place = step.cast("string").try_cast("double").cast("int"), F.nullif(F.trim(hole.cast("string")), F.lit(""))
    return F.concat(F.lit("step="), names.padded(n), F.lit("__hole="), place)


def modality_of(path: Column, known: tuple[str, ...] = ("airborne", "structure")) -> Column:
    """By the folder that a file lies in; null for another."""
    folder = F.lower(F.try_element_at(F.split(path, "/"), F.lit(-2)))
    return F.when(folder.isin(*known), folder)


def extensions(values: list[str]) -> list[str]:
    """Lower case, with their dot, each once and in the order given."""
    plain = [v.strip().lower().lstrip(".") for v in values]
    return list(dict.fromkeys(f".{v}" for v in plain if v))


def resolved(rows: DataFrame, path: str, roots: list[str], files: DataFrame) -> DataFrame:
    """Adds ``resolved``: absolute paths as they are, others under the first root where ``files(path)`` has them, else under the last; null for blank ones."""
    text = F.nullif(F.trim(path), F.lit(""))
    asked = rows.withColumn("_p", text)
    for i, root in enumerate(roots):
        at = files.select(F.col("path").alias(f"_f{i}")).distinct()
        asked = asked.join(at, F.concat(F.lit(f"{root.rstrip('/')}/"), F.col("_p")) == F.col(f"_f{i}"), "left")
    found = F.coalesce(*(F.col(f"_f{i}") for i in range(len(roots))), F.concat(F.lit(f"{roots[-1].rstrip('/')}/"), F.col("_p")))
    out = asked.withColumn("resolved", F.when(F.col("_p").startswith("/"), F.col("_p")).otherwise(found))
    return out.drop("_p", *(f"_f{i}" for i in range(len(roots))))


def with_steps(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``step_idx`` by name, if any row has one."""
    out = rows.withColumn("step_idx", names.step(F.col(name)))
    return rows if out.where("step_idx IS NOT NULL").isEmpty() else out


def enriched(rows: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Left joins on one key, one after the other; which side is sent round is Spark's choice by size."""
    for other in others:
        rows = rows.join(other, key, "left")
    return rows


def timeline(rows: DataFrame, step: str, name: str, *by: str) -> DataFrame:
    """Adds ``position``: the step, or the row's place where it has none; in order of step, those without last, then of name."""
    w = W.partitionBy(*by).orderBy(F.asc_nulls_last(step), name)
    return rows.withColumn("position", F.coalesce(F.col(step).cast("double"), F.row_number().over(w).cast("double")))


def best(rows: DataFrame, order: list[Column], n: int = 1, *by: str) -> DataFrame:
    """The first ``n`` rows of each group in the order given."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def chosen_source(rows: DataFrame, wanted: str, *by: str) -> DataFrame:
    """Of each source the row of the record wanted, else its first by ``row_idx``."""
    return best(rows, [F.when(F.col("record_name") == wanted, 0).otherwise(1), F.col("row_idx")], 1, *by)


def truth(rows: DataFrame) -> str | None:
    """The first column of ``TRUTHS`` with a finite value. One pass over those that there are."""
    there = [c for c in TRUTHS if c in rows.columns]
    if not there:
        return None
    finite = lambda c: F.max((F.abs(F.col(c).cast("double")) < float("inf")).cast("int")).alias(c)
    got = rows.agg(*map(finite, there)).first()
    return next((c for c in there if got[c]), None)


def with_truth(rows: DataFrame, sigma: bool = False) -> DataFrame:
    """Prediction rows in their final form: one column ``y_true`` with what follows from it, or none; with ``sigma`` also label, z-score and hits."""
    at = truth(rows)
    out = rows.withColumn("_t", F.col(at).cast("double")) if at else rows
    out = out.drop(*TRUTHS, *DERIVED)
    if at:
        r = F.col("y_pred") - F.col("_t")
        out = out.withColumns({"y_true": F.col("_t"), "residual_mm": r, "abs_residual_mm": F.abs(r)}).drop("_t")
    if not sigma:
        return out.drop("sigma")
    out = out.withColumn("confidence_label", names.confidence(F.col("sigma")))
    if at:
        size, ok = F.col("abs_residual_mm"), (F.col("sigma") > 0) & (F.col("sigma") < float("inf"))
        out = out.withColumns({"z_abs": F.when(ok, size / F.col("sigma")), "within_1sigma": F.when(ok, size <= F.col("sigma")), "within_2sigma": F.when(ok, size <= 2 * F.col("sigma"))})
    return out


def without_truth(rows: DataFrame) -> DataFrame:
    return rows.drop(*TRUTHS, *(c for c in DERIVED if c != "confidence_label"))


def bundle(rows: DataFrame, modality: str, mae: float, key: str = "fusion") -> DataFrame:
    """Predictions as rows of a fusion bundle; the record's key is step and hole (``fusion``) or its whole name (``record``)."""
    if key not in ("fusion", "record"):
        raise ValueError(f"unknown key mode {key!r}")
    require(rows, ["record_name", "y_pred"])
    name = names.fusion_key(F.col("record_name")) if key == "fusion" else F.col("record_name")
    sigma = F.col("sigma").cast("double") if "sigma" in rows.columns else F.lit(0.0)
    at = truth(rows)
    return rows.select(
        F.lit(modality).alias("modality"), F.lit(mae).alias("validation_mae"), name.alias("record_name"), F.col("row_idx") if "row_idx" in rows.columns else F.monotonically_increasing_id().alias("row_idx"),
        F.col("y_pred").cast("double").alias("y_pred"), sigma.alias("sigma"), (F.col(at).cast("double") if at else F.lit(None).cast("double")).alias("y_true"),
    )


def expected_counts(files: DataFrame, counts: DataFrame, planned: int | None = None, default: int = 25) -> DataFrame:
    """Adds ``expected``: a file's own count ``counts(stem, expected)``, else the length of the plan, else the default."""
    return files.join(counts, "stem", "left").withColumn("expected", F.coalesce("expected", F.lit(planned or default)).cast("int"))


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of a feature list, as a model's snapshot holds it."""
    return F.sha2(F.array_join(F.array(*map(F.lit, columns)), "\n"), 256)


def normalised_shares(*shares: float) -> tuple[float, ...]:
    return tuple(s / sum(shares) for s in shares)


def epochs(repeats: DataFrame, column: str = "best_epoch") -> DataFrame:
    """Median of the repeats, cut to a whole number."""
    return repeats.agg(F.percentile(column, 0.5).cast("int").alias("epochs"))


#: Fixed value: what a control recording's name says.
CONTROL = r"(?i)^.*?_seg(\d+).*?step(\d+).*?__([A-G][1-7])__depth(\d+\.\d+)\.flac$"


def control_files(files: DataFrame, name: str) -> DataFrame:
    """Files whose names say segment, step, hole and depth, with these; the others are left out."""
    part = lambda i, kind: F.regexp_extract(name, CONTROL, i).cast(kind)
    there = files.where(F.col(name).rlike(CONTROL))
    return there.withColumns({"seg": part(1, "int"), "step": part(2, "int"), "hole": F.upper(part(3, "string")), "depth": part(4, "double")})
