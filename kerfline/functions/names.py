"""Composite record names: building, parsing and the keys made from them. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# The parts of a record name.
DEPTH = r"(?i)depth([0-9]+(?:[.,][0-9]+)?)"
DEPTH_SPACED = r"(?i)depth\s*([0-9]+(?:[.,][0-9]+)?)"
STEP = r"(?i)__step([0-9]+)__"
HOLES = (r"(?i)hole_([A-Z]\d+)", r"(?i)__([A-Z]\d+)__", r"(?i)\b([A-Z]\d+)\b")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def slug(text: Column) -> Column:
    # Empty ones are replaced by a pattern too, so that the text is written into the expression once.
    squeezed = F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9._-]+", "_"), "_+", "_")
    return F.coalesce(F.regexp_replace(F.btrim(squeezed, F.lit("_")), "^$", "NA"), F.lit("NA"))


def number_in_name(x: Column, digits: int = 3) -> Column:
    text = F.replace(F.format_string(f"%.{digits}f", x), F.lit("-"), F.lit("m"))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "NA").otherwise(text)


def padded(n: Column) -> Column:
    """At least three digits, longer numbers whole; null stays null."""
    return F.when(n.isNotNull(), F.format_string("%03d", n))


def depth(name: Column, pattern: str = DEPTH) -> Column:
    return F.replace(found(name, pattern), F.lit(","), F.lit(".")).try_cast("double")


def step(name: Column) -> Column:
    return found(name, STEP).try_cast("int")


def root(name: Column) -> Column:
    return F.substring_index(name, "__seg", 1)


def hole(name: Column) -> Column:
    # The name is bound to a variable: written into every pattern twice, an expression that makes names is evaluated as often in each filter on the hole.
    tried = lambda n: F.filter(F.array(*(F.regexp_extract(n, p, 1) for p in HOLES)), lambda h: h != "")
    return F.upper(F.get(F.get(F.transform(F.array(name), tried), 0), 0))


def file_name(stem: Column, segment: Column, step: Column, hole: Column, depth: Column, suffix: str) -> Column:
    place = F.when(hole.isNull(), "NA").otherwise(slug(hole))
    return F.concat(stem, F.lit("__seg"), padded(segment), F.lit("__step"), F.coalesce(padded(step), F.lit("NA")), F.lit("__"), place, F.lit("__depth"), number_in_name(depth), F.lit(suffix))


def fusion_key(name: Column) -> Column:
    """``step=007__hole=B2`` from the first token with ``step`` and the one after it; degraded forms where a part is missing."""
    # Where no three underscores meet and all is ASCII, the first token that begins so is where ``__step`` is first found; other names are split into their tokens.
    plain = ~F.contains(name, F.lit("___")) & (F.length(name) == F.octet_length(name))
    begin = F.instr(F.concat(F.lit("__"), F.lower(name)), "__step")
    rest = F.substr(name, begin + 4)
    more = F.substr(rest, F.instr(rest, "__") + 2)
    tokens = F.split(name, "__", -1)
    at = F.array_position(F.transform(tokens, lambda t: F.lower(F.substring(t, 1, 4)) == "step"), F.lit(True)).cast("int")
    number = F.when(plain, F.when(begin > 0, F.substring_index(rest, "__", 1))).otherwise(F.substring(F.get(tokens, at - 1), 5, 1 << 20))
    place = F.when(plain, F.when((begin > 0) & (F.instr(rest, "__") > 0), F.substring_index(more, "__", 1))).otherwise(F.when(at > 0, F.get(tokens, at)))
    n = number.try_cast("int")
    shown, spot = F.concat(F.lit("step="), padded(n)), F.concat(F.lit("hole="), place)
    return F.when(n.isNull() & place.isNull(), name).otherwise(F.concat_ws("__", shown, spot))


def long_keys(rows: DataFrame, name: str, order: str) -> DataFrame:
    """``key_long``: the rank of the run before the fusion key, repeats numbered in row order, also where one key has a large share of all rows."""
    from kerfline.operators.windows import numbered

    # Runs are ranked over their distinct names, not over all rows; the ranks' side is as large as there are runs, so Spark chooses the join.
    keyed = rows.withColumns({"_run": root(F.col(name)), "_key": fusion_key(F.col(name))})
    runs = rows.select(root(F.col(name)).alias("_run")).distinct().withColumn("_rank", F.dense_rank().over(W.orderBy("_run")))
    placed = numbered(keyed.withColumn("_both", F.concat_ws("\n", "_run", "_key")), "_both", order, "_n").join(runs, "_run")
    key = F.concat(F.lit("run="), padded(F.col("_rank")), F.lit("__"), F.col("_key"))
    return placed.withColumn("key_long", F.when(F.col("_n") == 1, key).otherwise(F.concat(key, F.lit("__occ"), padded(F.col("_n"))))).drop("_run", "_rank", "_key", "_both", "_n")


def snapped(x: Column, step: float) -> Column:
    """To the grid, halves to even."""
    return F.rint(x / step) * step


def confidence(sigma: Column, high: float = 0.05, medium: float = 0.15) -> Column:
    return F.when(sigma.isNull() | F.isnan(sigma) | (F.abs(sigma) == float("inf")), None).when(sigma < high, "high").when(sigma < medium, "medium").otherwise("low")
