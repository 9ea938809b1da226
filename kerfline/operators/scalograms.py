"""Scalograms of long recordings, block by block, and mel pictures of short ones."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerfline.functions import scalograms as kernels
from kerfline.operators import chunks as parts


def scalogram(chunks: DataFrame, bank: kernels.Bank, size: int = 1 << 15) -> DataFrame:
    """Chunks ``rec, start, y`` to ``rec, band, start, db``: the transform in dB at each scale (numbered from 0), in blocks.

    Scales whose filters are about as long share blocks, with as many samples of the neighbours as their filters reach and at least as many of its own,
    so a sample is copied three times a group at most, and filters may be longer than a chunk. Values are those of the whole recording, which is zero outside."""
    rec = chunks.schema["rec"].dataType.simpleString()
    rows = chunks.select("rec", "start", F.col("y").cast("array<double>").alias("y"))

    def of(group: list[int]) -> DataFrame:
        scales = [bank.scales[k] for k in group]
        left, right = max(s.behind for s in scales), max(s.ahead for s in scales)
        own = max(size, left + right)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    n = batch.column(2)[i].as_py()
                    db = kernels.decibels(kernels.convolved(batch.column(3)[i].values.to_numpy(), scales, left, n))
                    again = pa.array(np.full(len(group), i))
                    offsets = pa.array(np.arange(len(group) + 1, dtype="i4") * n)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(again), pa.array(group, pa.int32()), batch.column(1).take(again), pa.ListArray.from_arrays(offsets, pa.array(db.ravel()))], names=["rec", "band", "start", "db"])

        return parts.blocks(rows, own, left, right).mapInArrow(run, f"rec {rec}, band int, start long, db array<double>")

    return reduce(DataFrame.unionByName, [of(g) for g in bank.groups()])


def standardised(blocks: DataFrame, value: str = "db") -> DataFrame:
    """Each recording's values to mean 0 and sample deviation 1 over all bands and times, by their counts, means and squares about them."""
    v = F.col(value)
    size = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / size
    each = blocks.where(size > 0).withColumn("_m", mean).withColumn("_s", F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))))
    # of blocks: squares about their own means, and squares of these about the common mean
    one = each.groupBy("rec").agg(F.sum(size).alias("n"), (F.sum(F.col("_m") * size) / F.sum(size)).alias("mean"))
    both = each.join(one, "rec").groupBy("rec").agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.sum(F.col("_s") + size * (F.col("_m") - F.col("mean")) * (F.col("_m") - F.col("mean"))).alias("s"))
    scale = both.select("rec", F.col("mean").alias("_mean"), F.greatest(F.sqrt(F.col("s") / F.greatest(F.col("n") - 1, F.lit(1))), F.lit(1e-6)).alias("_sd"))
    return blocks.join(scale, "rec").withColumn(value, F.transform(v, lambda x: (x - F.col("_mean")) / F.col("_sd"))).drop("_mean", "_sd")


def pictures(signals: DataFrame, key: str, y: str, sr: float, picture: kernels.Picture) -> DataFrame:
    """``key, bands, frames, centres, times, image, error`` of whole signals, by rows."""
    schema = f"{key} {signals.schema[key].dataType.simpleString()}, bands int, frames int, centres array<double>, times array<double>, image array<float>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in batch.column(1):
                try:
                    x = np.asarray(v.values.to_numpy() if v.is_valid else [], float)
                    if not len(x):
                        raise ValueError("no samples")
                    centres, times, image = kernels.mel_picture(x, sr, picture)
                    rows.append((*image.shape, centres, times, image.ravel().astype("f4"), None))
                except ValueError as e:
                    rows.append((None, None, None, None, None, str(e)))
            types = (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float32()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=[key, "bands", "frames", "centres", "times", "image", "error"])

    return signals.select(key, F.col(y).cast("array<double>")).mapInArrow(run, schema)
