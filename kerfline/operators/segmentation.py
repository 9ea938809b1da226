"""Event detection on envelopes and operations on intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kerfline.functions import bursts, names


def hysteresis(signal: DataFrame, on: float, off: float, on_frames: int, off_frames: int) -> DataFrame:
    """``rec, i, x`` to segments ``rec, seg, start, stop`` (indices, both inside) by a two-threshold state machine.

    Active after ``on_frames`` samples above ``on`` in a row, idle again after ``off_frames`` below ``off`` in a row. A segment
    starts with the first of the run that made it active and stops before the run that ended it; one still open at the end stops at the last sample.

    Runs are found by windows and the switches by alternation, so no record is folded sequentially: a switch on is the first
    sample that completes a run above, after a switch off, and the other way round."""
    w = W.partitionBy("rec").orderBy("i")
    run = lambda ok, n: F.when(F.min(ok.cast("int")).over(w.rowsBetween(1 - n, 0)) == 1, F.count(F.lit(1)).over(w.rowsBetween(1 - n, 0)) == n).otherwise(False)
    s = signal.withColumn("_up", run(F.col("x") > on, on_frames)).withColumn("_down", run(F.col("x") < off, off_frames)).withColumn("_last", F.max("i").over(W.partitionBy("rec")))
    events = s.where("_up OR _down").withColumn("_kind", F.when(F.col("_up"), 1).otherwise(0))
    # of events in a row of one kind only the first switches; a switch off needs one on before it
    changed = events.withColumn("_before", F.lag("_kind").over(w)).where((F.col("_kind") == 1) & F.coalesce(F.col("_before") != 1, F.lit(True)) | (F.col("_kind") == 0) & (F.col("_before") == 1))
    ended = changed.withColumn("_end", F.lead("i").over(w)).where("_kind = 1")
    start, stop = F.col("i") - on_frames + 1, F.coalesce(F.col("_end") - off_frames, F.col("_last"))
    return ended.select("rec", (F.row_number().over(w) - 1).alias("seg"), start.alias("start"), stop.alias("stop"))


def merged(intervals: DataFrame, gap: float, by: str = "rec") -> DataFrame:
    """Intervals ``start, stop`` joined where the gap to all before is at most ``gap``: gaps and islands."""
    w = W.partitionBy(by).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    islands = intervals.withColumn("_new", F.when(F.col("start") - reach <= gap, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(by, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


def padded(intervals: DataFrame, before: float, after: float, length: str) -> DataFrame:
    """Widened and clipped to [0, length]; empty ones go."""
    out = intervals.withColumn("start", F.greatest(F.col("start") - before, F.lit(0.0))).withColumn("stop", F.least(F.col("stop") + after, F.col(length)))
    return out.where(F.col("stop") > F.col("start"))


def long_enough(intervals: DataFrame, least: float) -> DataFrame:
    return intervals.where(F.col("stop") - F.col("start") >= least)


def numbered(segments: DataFrame, doe: DataFrame, by: str = "rec") -> DataFrame:
    """Segments in order next to the rows of a plan ``pos, step, hole_id, depth_mm``; those beyond it are ``extra_segment``."""
    n = segments.withColumn("pos", F.row_number().over(W.partitionBy(by).orderBy("start")))
    return n.join(doe, "pos", "left").withColumn("status", F.when(F.col("step").isNull(), "extra_segment").otherwise("matched"))


def best_band(attempts: DataFrame, expected: str, by: str = "rec") -> DataFrame:
    """Of several attempts ``attempt, found`` the one nearest to the expected count, the first of equals."""
    w = W.partitionBy(by).orderBy(F.abs(F.col("found") - F.col(expected)), "attempt")
    return attempts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def sample_span(start, stop, sr, n):
    """Seconds to sample indices: rounded half to even, kept within the recording."""
    bound = lambda x: F.greatest(F.least(F.rint(x * sr).cast("long"), n), F.lit(0))
    return bound(start), bound(stop)


def packed_envelopes(chunks: DataFrame, bands: list[tuple[float, float]]) -> DataFrame:
    """``rec, start, y, sr`` to ``rec, band, t, db``, arrays, a row a chunk and band (numbered from 1).

    ``start`` is the chunk's first sample in the recording, a multiple of the hop, and chunks overlap by a frame less a hop, so that every frame is
    whole in exactly one chunk (see ``stretches``). No recording is ever one value."""
    schema = f"rec {chunks.schema['rec'].dataType.simpleString()}, band int, t array<double>, db array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                y, sr = np.asarray(batch.column(2)[i].values, float), batch.column(3)[i].as_py()
                found += [(i, k, *bursts.band_envelope(y, sr, low, high, first=batch.column(1)[i].as_py())) for k, (low, high) in enumerate(bands, 1)]
            rec = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([rec, pa.array([f[1] for f in found], pa.int32()), *(pa.array([f[j] for f in found], pa.list_(pa.float64())) for j in (2, 3))], names=["rec", "band", "t", "db"])

    return chunks.select("rec", F.col("start").cast("long"), "y", F.col("sr").cast("double")).mapInArrow(run, schema)


def envelopes(chunks: DataFrame, bands: list[tuple[float, float]]) -> DataFrame:
    """``rec, start, y, sr`` to ``rec, band, t, db``: the envelope of each band, chunk by chunk (see ``packed_envelopes``), a row a value."""
    return packed_envelopes(chunks, bands).select("rec", "band", F.inline(F.arrays_zip("t", "db")))


def stretches(y: np.ndarray, sr: float, seconds: float = 10.0, win_ms: float = 21.0, hop_ms: float = 5.0) -> list[tuple[int, np.ndarray]]:
    """A recording in chunks of about so many seconds as ``envelopes`` takes them: ``(start, samples)``."""
    length, hop = max(256, int(sr * win_ms / 1000)), max(1, int(sr * hop_ms / 1000))
    frames = max(1, int(sr * seconds) // hop)
    total = max(0, (len(y) - length) // hop + 1)
    return [(f * hop, y[f * hop : (min(f + frames, total) - 1) * hop + length]) for f in range(0, max(total, 1), frames)]


FOUND = "seg int, core_start double, core_stop double, padded_start double, padded_stop double, start double, stop double"


def detected(envelope: DataFrame, expected: DataFrame, before: float = 0.20, after: float = 0.25) -> DataFrame:
    """Bursts of each recording and band: ``rec, band`` and FOUND, in seconds, from ``envelope(rec, band, t, db)``, values or arrays of them, and ``expected(rec, expected, duration)``.

    An envelope has some hundred values a second, whatever the recording's sample rate; one recording's is searched in one task. A recording without an
    expected count fails. Cores are as detected, then padded within the recording, then moved to where the envelope is quiet."""
    joined = envelope.join(expected, "rec", "left").withColumn("expected", F.when(F.col("expected").isNull(), F.raise_error(F.concat(F.lit("no expected count for "), F.col("rec").cast("string")))).otherwise(F.col("expected")).cast("int"))
    rec = envelope.schema["rec"].dataType.simpleString()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t, db = ((pc.list_flatten(v) if pa.types.is_list(v.type) else v).to_numpy() for v in (table.column("t"), table.column("db")))
        order = np.argsort(t, kind="stable")
        t, db = t[order], db[order]
        found = bursts.detect(t, db, table.column("expected")[0].as_py())
        core = found.seconds()
        wide = np.clip(core + [-before, after], 0, table.column("duration")[0].as_py())
        wide, core = wide[wide[:, 1] > wide[:, 0]], core[wide[:, 1] > wide[:, 0]]
        final = bursts.edges(found, wide)
        columns = [pa.array([k.as_py()] * len(core), f.type) for k, f in zip(key, (table.schema.field("rec"), table.schema.field("band")), strict=True)]
        spans = [pa.array(a[:, i] if len(a) else [], pa.float64()) for a in (core, wide, final) for i in (0, 1)]
        return pa.Table.from_arrays([*columns, pa.array(np.arange(1, len(core) + 1), pa.int32()), *spans], names=["rec", "band", *(f.split()[0] for f in FOUND.split(", "))])

    return joined.groupBy("rec", "band").applyInArrow(run, f"rec {rec}, band int, {FOUND}")


def segmented(chunks: DataFrame, expected: DataFrame, bands: list[tuple[float, float]]) -> DataFrame:
    """Bursts of each recording in the first of the bands whose count is nearest to the one expected; with how many were found and whether that matches."""
    each = detected(packed_envelopes(chunks, bands).where(F.size("t") > 0), expected).join(expected.select("rec", "expected"), "rec")
    # Counted and chosen beside the bursts, which are found once.
    tried = each.withColumn("found", F.count(F.lit(1)).over(W.partitionBy("rec", "band"))).withColumn("_off", F.struct(F.abs(F.col("found") - F.col("expected")), "band"))
    best = tried.withColumn("_best", F.min("_off").over(W.partitionBy("rec"))).where(F.col("_off") == F.col("_best"))
    return best.withColumn("matched", F.col("found") == F.col("expected")).drop("expected", "_off", "_best")


def manifest(segments: DataFrame, doe: DataFrame, recordings: DataFrame, suffix: str = ".wav") -> DataFrame:
    """A row a segment: its place in the plan, its file name and its samples, from ``segments(rec, start, stop, ...)``, ``doe(pos, step, hole_id, depth_mm)`` and ``recordings(rec, sr, n)``."""
    placed = numbered(segments, doe).join(recordings, "rec")
    first, last = sample_span(F.col("start"), F.col("stop"), F.col("sr"), F.col("n"))
    name = names.file_name(F.col("rec"), F.col("pos"), F.col("step"), F.col("hole_id"), F.col("depth_mm"), suffix)
    return placed.withColumns({"first_sample": first, "last_sample": last, "duration_seg_s": F.col("stop") - F.col("start"), "file_name": name})
