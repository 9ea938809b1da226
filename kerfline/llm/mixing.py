r"""Mixing sources to target weights by systematic sampling.

A document's size is its number of ``[^\x20\x09-\x0D]+`` runs. Sources, by code point with null last, weigh
3, 1, 2, repeating, and share 150 % of all sizes; a target stops at twice its source's size and the excess is
reshared by weight (water-filling, solved in closed form over one row per source). All documents of a source
have the same expected number of copies, target / source_size; their prefix sum is that rate times the rank,
plus one random offset a source, and a copy is emitted for each integer boundary crossed.

Ranks run through (size class, slice, size, doc_id), so the sample is stratified by size. The rank is the sum
of three counts: of earlier size classes, of earlier slices of the class and within the slice. Slices are by
MD5 of the id; no task holds a whole source.

Defined results: null text has size 0; a null source is a source; a source without words has target 0 and no
copies; rows that repeat id and text are ranked one after the other, rows without an id too; texts may be of any length; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kerfline.llm.common import BLANK, Scratch, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SLICES = 128


def words(column: str = "text") -> Column:
    text = text_or_empty(column)
    parts = F.size(F.split(text, f"[{BLANK}]+", -1))
    lead = text.rlike(f"^[{BLANK}]").cast("int")
    tail = text.rlike(rf"[{BLANK}]\z").cast("int")
    # blank texts have one separator that is both first and last, and an empty text is one empty part
    return F.when(text.rlike(f"[^{BLANK}]"), parts - lead - tail).otherwise(0).cast("long")


def size_class(size: Column) -> Column:
    """Length of the binary form and its next two digits: classes about a quarter of an octave wide."""
    digits = F.bin(size)
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.rpad(F.substring(digits, 2, 2), 2, "0"))


def unit(column: Column, seed: str) -> Column:
    """A number in [0, 1) from the MD5 of a value."""
    hexed = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(column.cast("string"), F.lit("\0"))).cast("binary")), 1, 12)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(1 << 48))


def targets(per_source: DataFrame) -> DataFrame:
    """``per_source(source, source_size)`` with ``target``; one row a source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    by_weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = per_source.withColumn("weight", by_weight.cast("double")).withColumn("cap", CAP * F.col("source_size"))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = fill.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumns({
        "level": (SHARE * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)),
    })
    # Filling one more source raises the level while that source's cap is below it, and lowers it from there on.
    s = s.withColumn("level", F.max("level").over(whole))
    return s.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", slices: int = SLICES) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies."""
    spare = docs.select("doc_id", "source", words().alias("size")).withColumns({
        "class": size_class(F.col("size")),
        "slice": F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).cast("binary")), 1, 4), 16, 10).cast("int") % slices,
    })
    scratch = Scratch(docs.sparkSession, "mixing")
    base = scratch.written(spare, "sizes")
    slots = scratch.written(base.groupBy("source", "class", "slice").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "slots")
    by_class = slots.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    before = W.unboundedPreceding, -1
    class_before = by_class.select("source", "class", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("class").rowsBetween(*before)), F.lit(0)).alias("class_before"))
    slot_before = slots.select("source", "class", "slice", F.coalesce(F.sum("n").over(W.partitionBy("source", "class").orderBy("slice").rowsBetween(*before)), F.lit(0)).alias("slot_before"))
    goal = targets(by_class.groupBy("source").agg(F.sum("words").alias("source_size")))
    # One row a slot, with all that its documents need to know.
    known = scratch.written(
        _same(_same(slot_before, class_before, "source", "class"), goal, "source").select(
            "source", "class", "slice", (F.col("slot_before") + F.col("class_before")).alias("before"), "source_size", "target"),
        "slot-ranks")
    scratch.keep(base, known)
    ranked = base.withColumn("rank", F.row_number().over(W.partitionBy("source", "class", "slice").orderBy("size", "doc_id")))
    both = _same(ranked, known.hint("merge"), "source", "class", "slice")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col("before") + F.col("rank")
    start = unit(F.col("source"), seed)
    copies = (F.floor(start + rate * at) - F.floor(start + rate * (at - 1))).cast("long")
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def _same(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join on keys where null equals null."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(right, cond).drop(*(f"_{k}" for k in keys))
