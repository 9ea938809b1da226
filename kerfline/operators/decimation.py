"""Decimation of long recordings by zero-phase recursive filters.

A recursive filter's state after a stretch is a matrix power times the state before, plus what the stretch adds from rest. So each chunk says what it adds, in
parallel; the states at the borders follow from these few numbers, a row a chunk, in order; and each chunk is filtered from its own state, in parallel again. The same
once more in the other order gives the backward pass. Results are those of filtering the whole recording as one array, mirrored at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kerfline.functions import dsp, filters
from kerfline.operators import chunks as parts
from kerfline.sources import shared

SIZE = 1 << 16  # samples a chunk


def _written(df: DataFrame, label: str) -> DataFrame:
    """Lineage ends in the shared folder: without that each pass would run all those before it twice."""
    path = shared.folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def framed(chunks: DataFrame, size: int = SIZE, edge: int = filters.EDGE) -> DataFrame:
    """``rec, k, last, start, y``: chunks of ``size`` samples, what remains added to the last one, mirrored at the recording's ends. Recordings of at most ``edge`` samples are left out."""
    n = parts.lengths(chunks)
    whole = parts.blocks(chunks, size, 0, 0)
    each = whole.join(n.withColumnRenamed("n", "total"), "rec").where(F.col("total") > edge)
    count = F.greatest(F.floor(F.col("total") / size), F.lit(1))
    k = F.least(F.floor(F.col("start") / size), count - 1)
    merged = each.groupBy("rec", k.alias("k"), (count - 1).alias("last")).agg(F.array_sort(F.collect_list(F.struct("start", "y"))).alias("p"))
    merged = merged.select("rec", "k", "last", F.element_at("p", 1)["start"].alias("start"), F.flatten(F.transform("p", lambda v: v["y"])).alias("y"))
    head = F.transform(F.reverse(F.slice("y", 2, edge)), lambda v: 2 * F.element_at("y", 1) - v)
    tail = F.transform(F.slice(F.reverse("y"), 2, edge), lambda v: 2 * F.element_at("y", -1) - v)
    none = F.array().cast("array<double>")
    return merged.withColumn("y", F.concat(F.when(F.col("k") == 0, head).otherwise(none), "y", F.when(F.col("k") == F.col("last"), tail).otherwise(none)))


def _passed(rows: DataFrame, system: filters.System, backward: bool) -> DataFrame:
    """One pass over ``rec, k, last, start, y``: backward, each chunk reversed and the last one first."""
    step = -1 if backward else 1
    rec = rows.schema["rec"].dataType.simpleString()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = [v.values.to_numpy()[::step] for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(v) for v in y], pa.int64()), pa.array([v[0] for v in y]), pa.array([system.end(v) for v in y], pa.list_(pa.float64()))], names=["rec", "k", "n", "first", "added"])

    def borders(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("k").to_numpy())[::step]
        n, added = table.column("n").to_numpy()[order], [table.column("added")[int(i)].values.to_numpy() for i in order]
        z, out, powers = system.steady * table.column("first")[int(order[0])].as_py(), [], {}
        for m, f in zip(n, added, strict=True):
            out.append(z)
            if m not in powers:
                powers[m] = system.power(int(m))
            z = powers[m] @ z + f
        return pa.table({"rec": table.column("rec").take(pa.array(order)), "k": table.column("k").take(pa.array(order)), "state": pa.array(out, pa.list_(pa.float64()))})

    states = rows.select("rec", "k", "y").mapInArrow(ends, f"rec {rec}, k long, n long, first double, added array<double>").groupBy("rec").applyInArrow(borders, f"rec {rec}, k long, state array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = [system.run(u.values.to_numpy()[::step], z.values.to_numpy())[0][::step] for u, z in zip(batch.column(4), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(y, pa.list_(pa.float64()))], names=["rec", "k", "last", "start", "y"])

    both = rows.join(states, ["rec", "k"]).select("rec", "k", "last", "start", "y", "state")
    return both.mapInArrow(run, f"rec {rec}, k long, last long, start long, y array<double>")


def decimated(chunks: DataFrame, q: int, size: int = SIZE) -> DataFrame:
    """Chunks ``rec, start, y`` at a ``q``-th of their rate: low-pass forwards and backwards, then every ``q``-th sample."""
    system, edge = filters.antialias(q), filters.EDGE
    rows = _written(framed(chunks, size), "framed")
    for backward in (False, True):
        rows = _written(_passed(rows, system, backward), "backward" if backward else "forward")
    skip = F.when(F.col("k") == 0, edge).otherwise(0)
    plain = F.slice("y", skip + 1, F.size("y") - skip - F.when(F.col("k") == F.col("last"), edge).otherwise(0))
    first = F.pmod(-F.col("start"), F.lit(q))
    kept = rows.withColumn("y", plain).where(F.size("y") > first)
    return kept.select("rec", ((F.col("start") + first) / q).cast("long").alias("start"), F.transform(F.sequence(first.cast("int"), F.size("y") - 1, F.lit(q)), lambda i: F.get("y", i)).alias("y"))


def resampled(chunks: DataFrame, up: int, down: int, size: int = SIZE, taps: int = 10) -> DataFrame:
    """Chunks at ``up / down`` of their rate, as ``dsp.resampled`` gives of the whole recording: blocks of a multiple of ``down``, with as many samples around them as its filter reaches."""
    g = int(np.gcd(up, down))
    up, down = up // g, down // g
    if up == down:
        return chunks.select("rec", "start", "y")
    halo = -(-(taps * max(up, down)) // up) + 1
    halo = -(-halo // down) * down  # so that the samples that stay are the same ones
    size = -(-size // down) * down
    made = parts.blocks(chunks, size, halo, halo)
    rec = chunks.schema["rec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, starts = [], []
            for start, n, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                wide = dsp.resampled(y.values.to_numpy()[None], up, down, taps)[0]
                skip = halo * up // down
                out.append(wide[skip : skip + -(-n * up // down)])
                starts.append(start * up // down)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=["rec", "start", "y"])

    return made.mapInArrow(run, f"rec {rec}, start long, y array<double>")


def at_rate(chunks: DataFrame, sr: int, target: int, size: int = SIZE) -> DataFrame:
    """Chunks at a rate: by ten while that leaves twice the target, then by the ratio of what is left."""
    rows = chunks.select("rec", "start", F.col("y").cast("array<double>").alias("y"))
    while sr // 10 >= 2 * target:
        rows, sr = decimated(rows, 10, size), sr // 10
    return resampled(rows, target, sr, size)


def cascade(chunks: DataFrame, factor: int, size: int = SIZE) -> DataFrame:
    """Chunks at a ``factor``-th of their rate, in steps of ten at most."""
    rows = chunks.select("rec", "start", F.col("y").cast("array<double>").alias("y"))
    for q in dsp.stages(factor):
        rows = decimated(rows, q, size)
    return rows


def samples(chunks: DataFrame) -> DataFrame:
    """``rec, i, x``."""
    return chunks.select("rec", "start", F.posexplode("y").alias("j", "x")).select("rec", (F.col("start") + F.col("j")).alias("i"), "x")


def renumbered(chunks: DataFrame) -> DataFrame:
    """Chunks of any lengths whose starts are counted anew from their order."""
    w = W.partitionBy("rec").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    return chunks.withColumn("start", F.coalesce(F.sum(F.size("y")).over(w), F.lit(0)))
