"""Recordings as DataFrames.

Files are listed by Spark's ``binaryFile`` source, so listing is distributed and filters on path and time apply before any
byte is read. WAV is decoded with the standard library; FLAC and HDF5 need their libraries and say so when those are missing.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfline.functions import dsp, names

# Suffixes by kind of recording.
AUDIO = ("flac", "wav", "ogg", "aiff", "aif")
STRUCTURE = ("h5", "hdf5")

SIGNAL = "path string, y array<float>, sr int, duration_s double, error string"


def kind(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin(*AUDIO), "audio").when(suffix.isin(*STRUCTURE), "hdf5")


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, stem, mtime, size`` without reading contents; folders are walked."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return f.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("stem"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def labelled(files: DataFrame) -> DataFrame:
    """Adds what the names say: root, step, hole, depth and kind."""
    stem = F.col("stem")
    return files.withColumns({"recording_root": names.root(stem), "step_idx": names.step(stem), "hole_id": names.hole(stem), "depth_mm": names.depth(stem), "kind": kind(F.col("path"))})


def chosen(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files whose root or stem is among ``roots(root)``."""
    by_root = files.join(roots.select(F.col("root").alias("recording_root")), "recording_root", "left_semi")
    by_stem = files.join(roots.select(F.col("root").alias("stem")), "stem", "left_semi").select(*by_root.columns)
    return by_root.unionByName(by_stem).dropDuplicates(["path"])


def read_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mean over channels as 32-bit floats, and the sample rate."""
    with wave.open(io.BytesIO(content)) as w:
        raw, width, channels, sr = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, "u1").astype("f4") - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, "u1").reshape(-1, 3).astype("i4")
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) / float(1 << 31)).astype("f4")
    else:
        x = np.frombuffer(raw, f"<i{width}").astype("f4") / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(1).astype("f4"), sr


def write_wav(x: np.ndarray, sr: int) -> bytes:
    """Floats with 16 bits, clipped to [-1, 1]; whole numbers of 2 or 4 bytes as they are."""
    x = x.astype(f"<i{x.dtype.itemsize}") if x.dtype.kind == "i" else (np.clip(x, -1, 1) * 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(x.dtype.itemsize)
        w.setframerate(sr)
        w.writeframes(x.tobytes())
    return out.getvalue()


def decode(path: str, content: bytes) -> tuple[np.ndarray, int]:
    suffix = path.rpartition(".")[2].lower()
    if suffix == "wav":
        return read_wav(content)
    if suffix in AUDIO:
        try:
            import soundfile
        except ImportError as e:
            raise ValueError(f".{suffix} needs the soundfile library") from e
        x, sr = soundfile.read(io.BytesIO(content), dtype="float32", always_2d=True)
        return x.mean(1), sr
    if suffix in STRUCTURE:
        try:
            import h5py
        except ImportError as e:
            raise ValueError(f".{suffix} needs the h5py library") from e
        with h5py.File(io.BytesIO(content)) as f:
            x, t = f["measurement/data"][:].astype("f4"), f["measurement/time_vector"][:]
        if x.ndim != 1:
            raise ValueError("a measurement must have one dimension")
        d = np.diff(t)
        return x - x.mean(), round(1 / np.median(d[np.isfinite(d) & (d > 0)]))
    raise ValueError(f"no reader for .{suffix}")


def probe(path: str, content: bytes) -> tuple[int, int, int]:
    """Number of samples, rate and channels; of WAV from its header alone."""
    if path.lower().endswith(".wav"):
        with wave.open(io.BytesIO(content)) as w:
            return w.getnframes(), w.getframerate(), w.getnchannels()
    x, sr = decode(path, content)
    return len(x), sr, 1


def probed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, n, sr, channels, duration_s, error`` of each recording, without its samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    n, sr, channels = probe(path, content.as_py())
                    rows.append((path, n, sr, channels, n / sr, None))
                except (ValueError, EOFError, wave.Error) as e:
                    rows.append((path, None, None, None, None, str(e) or type(e).__name__))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "n", "sr", "channels", "duration_s", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, "path string, n long, sr int, channels int, duration_s double, error string")


def signals(spark: SparkSession, folder: str, pattern: str = "*", target_sr: int | None = None) -> DataFrame:
    """One row a recording, at ``target_sr`` if that is given; one that cannot be read has an ``error`` instead of samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    x, sr = decode(path, content.as_py())
                    if target_sr and sr != target_sr:
                        x, sr = dsp.at_rate(x[None].astype(float), sr, target_sr)[0][0].astype("f4"), target_sr
                    rows.append((path, x, sr, len(x) / sr, None))
                except (ValueError, EOFError, wave.Error) as e:
                    rows.append((path, None, None, None, str(e) or type(e).__name__))
            types = (pa.string(), pa.list_(pa.float32()), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "y", "sr", "duration_s", "error"]) if rows else None

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(lambda b: (x for x in run(b) if x is not None), SIGNAL)


def segments(signals: DataFrame, spans: DataFrame) -> DataFrame:
    """Samples between ``start`` and ``stop`` seconds of each span ``path, seg, start, stop``."""
    at = lambda t: F.greatest(F.least(F.rint(F.col(t) * F.col("sr")), F.size("y")), F.lit(0)).cast("int")
    return signals.join(spans, "path").select("path", "seg", "sr", F.slice("y", at("start") + 1, F.greatest(at("stop") - at("start"), F.lit(0))).alias("y"))


def exported(cut: DataFrame, path: str) -> None:
    """Segments ``path, seg, sr, y`` as a Parquet table with a WAV file a row in ``content``, by recording."""
    schema = "path string, seg int, sr int, n int, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = [np.asarray(v.values, "f4") if v.is_valid else np.zeros(0, "f4") for v in batch.column(3)]
            files = [write_wav(x, sr) for x, sr in zip(y, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in y], pa.int32()), pa.array(files, pa.binary())], names=["path", "seg", "sr", "n", "content"])

    out = cut.select("path", F.col("seg").cast("int"), F.col("sr").cast("int"), "y").mapInArrow(run, schema)
    out.withColumn("stem", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)).write.mode("overwrite").partitionBy("stem").parquet(path)
