"""Ordered-sequence operators over long signals ``rec, i, x``; every window stays within one record.

A record is the unit of parallelism: windows are partitioned by it. Where a record can hold a large share of all samples,
``chunked`` cuts it into overlapping stretches first, so that bounded frames need no whole record in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def along(*by: str, order: str = "i"):
    return W.partitionBy(*by).orderBy(order)


def chunked(signal: DataFrame, length: int, halo: int) -> DataFrame:
    """Stretches of ``length`` samples with ``halo`` more on both sides: adds ``chunk`` and ``own`` (false in the halo)."""
    at = F.floor(F.col("i") / length)
    first, last = F.greatest(F.floor((F.col("i") - halo) / length), F.lit(0)), F.floor((F.col("i") + halo) / length)
    return signal.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("own", F.col("chunk") == at)


def difference(x: str = "x", lag: int = 1, by: tuple[str, ...] = ("rec",), order: str = "i") -> Column:
    return F.col(x) - F.lag(x, lag).over(along(*by, order=order))


def rolling_quantile(q: float, width: int, x: str = "x", by: tuple[str, ...] = ("rec",)) -> Column:
    """Centred, exact, linear between ranks; null with fewer than ``max(3, width // 5)`` samples in the frame."""
    half = width // 2
    frame = along(*by).rowsBetween(-half, half)
    return F.when(F.count(x).over(frame) >= max(3, width // 5), F.percentile(x, q).over(frame))


def filled(column: str, by: tuple[str, ...] = ("rec",), order: str = "i") -> Column:
    """Gaps filled by linear interpolation over the order, ends by the nearest value."""
    back, ahead = along(*by, order=order).rowsBetween(W.unboundedPreceding, 0), along(*by, order=order).rowsBetween(0, W.unboundedFollowing)
    held = F.when(F.col(column).isNotNull(), F.struct(F.col(order).alias("at"), F.col(column).alias("v")))
    a, b = F.last(held, True).over(back), F.first(held, True).over(ahead)
    line = a["v"] + (b["v"] - a["v"]) * (F.col(order) - a["at"]) / F.nullif(b["at"] - a["at"], F.lit(0))
    return F.coalesce(F.col(column), line, a["v"], b["v"])


def median_filter(width: int, x: str = "x", by: tuple[str, ...] = ("rec",)) -> Column:
    """Odd width, edges padded by repeating the end values: the median of the frame with the missing samples put back."""
    half = width // 2
    w = along(*by)
    frame, whole = w.rowsBetween(-half, half), w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n, i = F.count(x).over(whole), F.row_number().over(w)
    pad = lambda missing, end: F.array_repeat(end, F.greatest(missing, F.lit(0)).cast("int"))
    values = F.array_sort(F.concat(pad(half + 1 - i, F.first(x).over(whole)), F.collect_list(x).over(frame), pad(i + half - n, F.last(x).over(whole))))
    return F.element_at(values, half + 1)


def moving_rms(width: int, x: str = "x", by: tuple[str, ...] = ("rec",)) -> Column:
    half = width // 2
    return F.sqrt(F.avg(F.col(x) * F.col(x)).over(along(*by).rowsBetween(-half, width - half - 1)))


def smoothed(signal: DataFrame, rise: float, fall: float) -> DataFrame:
    """Asymmetric exponential smoothing, a recursion: ``rec, i, x, y``.

    Records are sorted and pass through in batches; only the last value goes from one to the next, so a record may be longer than a task's memory."""
    rec = signal.schema["rec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, y = None, 0.0
        for batch in batches:
            out = []
            for r, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if r != at:
                    at, y = r, v
                y += (rise if v > y else fall) * (v - y)
                out.append(y)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=["rec", "i", "x", "y"])

    rows = signal.select("rec", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")).repartition("rec").sortWithinPartitions("rec", "i")
    return rows.mapInArrow(run, f"rec {rec}, i long, x double, y double")


def frames(signal: DataFrame, length: int, hop: int) -> DataFrame:
    """Samples with the frames they belong to, ``frame`` and ``j`` in it; incomplete frames at the end are left out.

    A sample is copied once a frame that holds it, ``length / hop`` times; no record is gathered."""
    total = F.count(F.lit(1)).over(W.partitionBy("rec"))
    first = F.greatest(F.ceil((F.col("i") - length + 1) / hop), F.lit(0))
    s = signal.withColumn("_n", total).withColumn("frame", F.explode(F.when(F.floor(F.col("i") / hop) >= first, F.sequence(first, F.floor(F.col("i") / hop)))))
    return s.where(F.col("frame") * hop + length <= F.col("_n")).withColumn("j", F.col("i") - F.col("frame") * hop).drop("_n")


def average_rank(x: str, by: tuple[str, ...] = ()) -> Column:
    """Ranks with ties averaged."""
    w = W.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(W.partitionBy(*by, x)) - 1) / 2


def _dealt(counts: DataFrame, value: str, by: str, buckets: int) -> DataFrame:
    """``by, value, _n`` with the bucket ``_b`` of each value and the count ``_below`` of all lesser ones.

    Buckets are cut at approximate quantiles, which decide only how the work is shared; a count is that of the buckets before and of the values before in the bucket."""
    edges = counts.groupBy(by).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 1000).alias("_edges"))
    dealt = counts.join(edges, by).withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    before = dealt.groupBy(by, "_b").agg(F.sum("_n").alias("_t"))
    before = before.select(by, "_b", F.coalesce(F.sum("_t").over(W.partitionBy(by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_n").over(W.partitionBy(by, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_in", inside).join(before, [by, "_b"]).withColumn("_below", F.col("_before") + F.col("_in")).drop("_before", "_in")


def counted_ranks(counts: DataFrame, value: str, by: str, buckets: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """``by, value, n, rank, <keep>`` from ``by, value, _n, <keep>``: ranks with ties averaged of values that are counted."""
    return _dealt(counts, value, by, buckets).select(by, value, F.col("_n").alias("n"), (F.col("_below") + (F.col("_n") + 1) / 2).alias("rank"), *keep)


def average_ranks(rows: DataFrame, value: str, by: str, buckets: int = 64) -> DataFrame:
    """``by, value, rank`` for each distinct value: ranks with ties averaged, found without a group's rows in one task. Values are counted first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted_ranks(counts, value, by, buckets).drop("n")


def numbered(rows: DataFrame, by: str, order: str, name: str, buckets: int = 64) -> DataFrame:
    """Adds the number of each row within its group by a numeric ``order`` without repeats, from 1, however large the group: row numbers within stretches of the order, and the counts before."""
    cuts = rows.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 1000).alias("_e"))
    below = sum(((F.col("_e")[i] < F.col(order)).cast("int") for i in range(1, buckets - 1)), (F.col("_e")[0] < F.col(order)).cast("int"))
    dealt = rows.crossJoin(F.broadcast(cuts)).withColumn("_b", below).drop("_e")  # one row of cuts
    counts = dealt.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy(by, "_b").orderBy(order)))
    return own.join(before, [by, "_b"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).select(*rows.columns, name)


def benjamini_hochberg(tests: DataFrame, p: str, by: tuple[str, ...] = (), buckets: int = 64) -> DataFrame:
    """Adds ``q``: the least ``p * n / rank`` from here upward, at most 1. Equal p share the value of their last rank; tests without p count in n and come last.

    Found over the distinct p of a group in buckets: the least within the bucket upward, and the least of the buckets above. No group is in one task."""
    keyed = tests.withColumns({"_g": F.struct(*by) if by else F.lit(0), "_p": F.col(p).cast("double")})
    counts = keyed.groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy("_g").agg(F.sum("_n").alias("_total"))
    raw = _dealt(counts.where("_p IS NOT NULL"), "_p", "_g", buckets).join(total, "_g").withColumn("_raw", F.col("_p") * F.col("_total") / (F.col("_below") + F.col("_n")))
    least = raw.groupBy("_g", "_b").agg(F.min("_raw").alias("_least"))
    above = least.select("_g", "_b", F.min("_least").over(W.partitionBy("_g").orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)).alias("_above"))
    upward = F.min("_raw").over(W.partitionBy("_g", "_b").orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, 0))
    q = raw.withColumn("_up", upward).join(above, ["_g", "_b"]).select("_g", "_p", F.least("_up", "_above").alias("_q"))
    return keyed.join(q, ["_g", "_p"], "left").select(*tests.columns, F.least(F.lit(1.0), "_q").alias("q"))


def autocorrelation(lag: int, x: str = "x") -> list[Column]:
    """To be used in an aggregate over rows that carry ``lagged`` = x so many samples before."""
    return [(F.sum(F.col(x) * F.col("lagged")) / F.nullif(F.sum(F.col(x) * F.col(x)), F.lit(0.0))).alias(f"autocorr_{lag}")]


def sample_rate(times: DataFrame) -> DataFrame:
    """``rec, t`` to ``rec, sr, dt, jitter`` from the positive differences of the times."""
    d = times.withColumn("d", F.col("t") - F.lag("t").over(W.partitionBy("rec").orderBy("t"))).where("d > 0")
    middle = d.groupBy("rec").agg(F.percentile("d", 0.5).alias("dt"), F.max("d").alias("most"), F.min("d").alias("least"))
    jitter = F.greatest(F.abs(F.col("most") - F.col("dt")), F.abs(F.col("least") - F.col("dt"))) / F.col("dt")
    return middle.select("rec", F.rint(1 / F.col("dt")).cast("long").alias("sr"), "dt", jitter.alias("jitter"))
