"""A network's predictions over windows of long signals, and what they say of each recording.

Windows are put together from chunks, across their borders, with zeros behind the end; a sample is copied once a window that holds it. The network is any function
of a matrix of windows, sent to the tasks once; it gives ``regression`` (one value a window) or ``class_probs`` (a row of probabilities), and may give an ``embedding``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerfline.operators import chunks as parts

PREDICTED = "start long, y_pred double, pred_class int, probs array<double>, embedding array<double>"


def windows(chunks: DataFrame, length: int, hop: int) -> DataFrame:
    """``rec, start, x``: windows at 0, ``hop``, ... as long as they are whole, and one at least, of ``length`` samples; what is not finite is zero."""
    if not 0 < hop <= length:
        raise ValueError("the hop lies between 1 and the length of a window")
    total = parts.lengths(chunks)
    each = parts.pieces(chunks, hop, 0, length - hop).groupBy("rec", "block").agg(F.array_sort(F.collect_list(F.struct("at", "y"))).alias("p"))
    whole = each.join(total, "rec").withColumn("start", F.col("block") * hop).where(F.col("start") <= F.greatest(F.col("n") - length, F.lit(0)))
    y = F.flatten(F.transform("p", lambda v: v["y"]))
    finite = F.transform(y, lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull(), 0.0).otherwise(v))
    return whole.select("rec", "start", F.concat(finite, F.array_repeat(F.lit(0.0), F.lit(length) - F.size(y))).alias("x"))


@dataclass(frozen=True)
class Convolutional:
    """One layer of filters over time with rectifier and mean pooling, then a dense layer: weights ``filters x taps``, ``filters x outputs``."""

    taps: np.ndarray
    dense: np.ndarray
    bias: np.ndarray
    classes: bool = False

    def __call__(self, x: np.ndarray) -> dict[str, np.ndarray]:
        seen = np.lib.stride_tricks.sliding_window_view(x, self.taps.shape[1], axis=1)
        pooled = np.maximum(np.einsum("ntk,fk->nft", seen, self.taps), 0).mean(2)
        out = pooled @ self.dense + self.bias
        if not self.classes:
            return {"regression": out[:, 0], "embedding": pooled}
        e = np.exp(out - out.max(1, keepdims=True))
        return {"class_probs": e / e.sum(1, keepdims=True), "embedding": pooled}


def predict(cut: DataFrame, network: Callable[[np.ndarray], dict[str, np.ndarray]], at_once: int = 256) -> DataFrame:
    """``rec`` and PREDICTED of ``windows``. A prediction that is not finite fails and names its windows."""
    rec = cut.schema["rec"].dataType.simpleString()
    sent = cut.sparkSession.sparkContext.broadcast(cloudpickle.dumps(network))  # as large as the network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = pickle.loads(sent.value)
        for whole in batches:
            for s in range(0, whole.num_rows, at_once):
                batch = whole.slice(s, at_once)
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                out = network(x)
                value, probs, emb = out.get("regression"), out.get("class_probs"), out.get("embedding")
                checked = value[:, None] if probs is None else probs
                bad = ~np.isfinite(checked).all(1)
                if bad.any():
                    named = [f"{r} at {t}" for r, t, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bad, strict=True) if b]
                    raise ValueError(f"predictions that are not finite: {', '.join(named[:10])}")
                none = pa.nulls(batch.num_rows)
                lists = lambda v: none.cast(pa.list_(pa.float64())) if v is None else pa.array(list(np.asarray(v, float)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), none.cast(pa.float64()) if value is None else pa.array(np.asarray(value, float)),
                     none.cast(pa.int32()) if probs is None else pa.array(probs.argmax(1).astype("i4")), lists(probs), lists(emb)],
                    names=["rec", *(f.split()[0] for f in PREDICTED.split(", "))],
                )

    return cut.select("rec", F.col("start").cast("long").alias("start"), "x").mapInArrow(run, f"rec {rec}, {PREDICTED}")


def _means(rows: DataFrame, column: str) -> DataFrame:
    each = rows.select("rec", F.posexplode(column).alias("k", "v")).groupBy("rec", "k").agg(F.avg("v").alias("v"))
    return each.groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias(column))  # as many as the network gives


def by_recording(predicted: DataFrame) -> DataFrame:
    """``rec, n_windows, y_pred, probs, pred_class, embedding``: median of the values, means of probabilities and embeddings, and the class of the greatest mean (the first of equals)."""
    one = predicted.groupBy("rec").agg(F.count(F.lit(1)).alias("n_windows"), F.median("y_pred").alias("y_pred"))
    out = one.join(_means(predicted, "probs"), "rec", "left").join(_means(predicted, "embedding"), "rec", "left")
    return out.select("rec", "n_windows", "y_pred", "probs", (F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("pred_class"), "embedding")
