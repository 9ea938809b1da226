"""Long signals as chunks ``rec, start, y``: consecutive stretches of bounded length, ``start`` the number of the first sample.

What needs more than its own chunk gets blocks with samples from the neighbours (``blocks``), or hands a small state from chunk to chunk
(``decimation``). A recording is never one value, and no task holds more of it than one block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(signal: DataFrame, length: int) -> DataFrame:
    """Samples ``rec, i, x`` as chunks that begin at multiples of ``length``."""
    each = signal.groupBy("rec", F.floor(F.col("i") / length).alias("k")).agg(F.array_sort(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x")))).alias("s"))  # at most ``length``
    return each.select("rec", F.element_at("s", 1)["i"].cast("long").alias("start"), F.transform("s", lambda v: v["x"]).alias("y"))


def lengths(chunks: DataFrame) -> DataFrame:
    """``rec, n``: samples of each recording."""
    return chunks.groupBy("rec").agg(F.sum(F.size("y")).cast("long").alias("n"))


def pieces(chunks: DataFrame, size: int, left: int, right: int) -> DataFrame:
    """``rec, block, at, y``: each chunk's samples for the blocks ``block * size - left .. (block + 1) * size + right`` that they fall into; ``at`` is the first one's number."""
    end = F.col("start") + F.size("y")
    first, last = F.greatest(F.floor((F.col("start") - right) / size), F.lit(0)), F.floor((end - 1 + left) / size)
    each = chunks.where(F.size("y") > 0).withColumn("block", F.explode(F.sequence(first, last)))
    a = F.greatest(F.col("start"), F.col("block") * size - left)
    b = F.least(end, (F.col("block") + 1) * size + right)
    return each.select("rec", "block", a.alias("at"), F.slice("y", (a - F.col("start") + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")).alias("y")).where(F.size("y") > 0)


def blocks(chunks: DataFrame, size: int, left: int, right: int) -> DataFrame:
    """``rec, start, n, y``: blocks of ``size`` samples (``n`` of them there, fewer at the end), with ``left`` samples before and ``right`` behind them; where the recording has none they are zero."""
    total = lengths(chunks)
    each = pieces(chunks, size, left, right).groupBy("rec", "block").agg(F.array_sort(F.collect_list(F.struct("at", "y"))).alias("p"))
    flat = each.join(total, "rec").withColumn("n", F.least(F.lit(size), F.col("n") - F.col("block") * size)).where("n > 0")
    begin = F.col("block") * size - left
    before = F.element_at("p", 1)["at"] - begin
    joined = F.flatten(F.transform("p", lambda v: v["y"]))
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    y = F.concat(zeros(before), joined)
    full = F.concat(y, zeros(F.greatest(F.col("n") + left + right - F.size(y), F.lit(0))))
    return flat.select("rec", (F.col("block") * size).alias("start"), F.col("n").cast("int").alias("n"), F.slice(full, F.lit(1), (F.col("n") + left + right).cast("int")).alias("y"))
