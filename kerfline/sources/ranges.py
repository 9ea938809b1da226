"""Recordings read in ranges: a Spark data source whose partitions are parts of files.

``spark.read.format("recordings").load(folder)`` gives ``path, kind, start, y, sr, n, error``: chunks of bounded length, mean over channels, with the number of the
chunk's first sample and of all samples. Planning lists files and sizes only. A file of more than ``range_mb`` is cut into as many parts as its size asks for, small files
share a partition; each part reads the header, then seeks to its own chunks, so that no task holds more than one chunk, or short ones of ``TOGETHER`` samples, however long a recording is.

Options: ``pattern`` (of file names), ``range_mb`` (64), ``seconds`` a chunk (10), and ``win_ms`` and ``hop_ms`` for chunks that overlap as
``operators.segmentation.envelopes`` takes them: each begins at a multiple of the hop and holds its last frame whole. Without them chunks follow one another.
For HDF5 ``data_key``, ``time_key``, and ``probe`` (4096), the number of times that the rate is told from. A file that cannot be read is one row with an ``error``.

Filters on ``path`` leave out files, filters on ``start`` leave out chunks before they are read, where Spark pushes them down
(``spark.sql.python.filterPushdown.enabled``).

Files are opened through pyarrow's file systems, by the path's scheme, on the executors. WAV is read by the standard library, other audio and HDF5
need soundfile and h5py.
"""

from __future__ import annotations

import fnmatch
import wave
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from kerfline.sources.recordings import AUDIO, STRUCTURE

SCHEMA = "path string, kind string, start bigint, y array<float>, sr int, n bigint, error string"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


def suffix(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[2].lower()


def kind(path: str) -> str | None:
    return "audio" if suffix(path) in AUDIO else "hdf5" if suffix(path) in STRUCTURE else None


class Wav:
    """Samples of a WAV file by their numbers."""

    def __init__(self, f, options: dict):
        self.w = wave.open(f)
        self.n, self.sr, self.channels, self.width = self.w.getnframes(), self.w.getframerate(), self.w.getnchannels(), self.w.getsampwidth()

    def read(self, start: int, count: int) -> np.ndarray:
        self.w.setpos(start)
        raw = self.w.readframes(count)
        if len(raw) < count * self.channels * self.width:
            raise EOFError(f"the file ends before sample {start + count}")
        if self.width == 1:
            x = (np.frombuffer(raw, "u1").astype("f4") - 128) / 128
        elif self.width == 3:
            b = np.frombuffer(raw, "u1").reshape(-1, 3)
            x = np.zeros((len(b), 4), "u1")
            x[:, 1:] = b
            x = x.view("<i4")[:, 0].astype("f4") / np.float32(1 << 31)
        else:
            x = np.frombuffer(raw, f"<i{self.width}").astype("f4") / np.float32(1 << (8 * self.width - 1))
        return x.reshape(-1, self.channels).mean(1).astype("f4")


class Sound:
    """Samples of other audio, by the soundfile library."""

    def __init__(self, f, options: dict):
        try:
            import soundfile
        except ImportError as e:
            raise ValueError("this kind of audio needs the soundfile library") from e
        self.f = soundfile.SoundFile(f)
        self.n, self.sr = self.f.frames, self.f.samplerate

    def read(self, start: int, count: int) -> np.ndarray:
        self.f.seek(start)
        return self.f.read(count, dtype="float32", always_2d=True).mean(1)


class Measurement:
    """Samples of an HDF5 measurement, by the h5py library; the rate is told from the first times."""

    def __init__(self, f, options: dict):
        try:
            import h5py
        except ImportError as e:
            raise ValueError("HDF5 needs the h5py library") from e
        self.f = h5py.File(f)
        self.y = self.f[options.get("data_key", "measurement/data")]
        if self.y.ndim != 1:
            raise ValueError("a measurement must have one dimension")
        self.n, self.sr = len(self.y), rate(self.f[options.get("time_key", "measurement/time_vector")][: max(2, int(options.get("probe", 4096)))])[0]

    def read(self, start: int, count: int) -> np.ndarray:
        return self.y[start : start + count].astype("f4")


def rate(times: np.ndarray) -> tuple[int, float, float]:
    """Rate, step and relative jitter of a time vector: the median of its positive differences."""
    if np.ndim(times) != 1 or len(times) < 2:
        raise ValueError("a time vector has one dimension and at least two values")
    d = np.diff(np.asarray(times, float))
    d = d[np.isfinite(d) & (d > 0)]
    if not len(d):
        raise ValueError("the times never increase")
    step = float(np.median(d))
    return round(1 / step), step, float(np.abs(d - step).max() / step)


@contextmanager
def recording(path: str, options: dict):
    fs, at = opened(path)
    form = Wav if suffix(path) == "wav" else Sound if suffix(path) in AUDIO else Measurement if suffix(path) in STRUCTURE else None
    if form is None:
        raise ValueError(f"no reader for .{suffix(path)}")
    with fs.open_input_file(at) as f:
        yield form(f, options)


@dataclass(frozen=True)
class Part:
    """Part ``index`` of ``of`` parts of a file."""

    path: str
    index: int
    of: int


@dataclass
class Parts(InputPartition):
    parts: list[Part]


OPEN_COST = 1e6  # bytes that opening a file counts as
TOGETHER = 1 << 12  # samples of short chunks that go to Spark together; longer ones go alone


@dataclass(frozen=True)
class Chunks:
    """How a recording of ``n`` samples is cut: chunk ``k`` begins at ``k * frames * hop`` and ends with its last frame."""

    n: int
    frames: int
    length: int
    hop: int

    @property
    def total(self) -> int:
        return max(0, (self.n - self.length) // self.hop + 1)

    @property
    def count(self) -> int:
        return max(1, -(-self.total // self.frames))

    def span(self, k: int) -> tuple[int, int]:
        first = k * self.frames
        last = min(first + self.frames, self.total)
        return first * self.hop, self.n if self.total == 0 else (last - 1) * self.hop + self.length


def chunks(n: int, sr: float, options: dict) -> Chunks:
    if "win_ms" in options or "hop_ms" in options:
        length, hop = max(256, int(sr * float(options.get("win_ms", 21.0)) / 1000)), max(1, int(sr * float(options.get("hop_ms", 5.0)) / 1000))
    else:
        length = hop = 1
    return Chunks(n, max(1, int(sr * float(options.get("seconds", 10.0))) // hop), length, hop)


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.paths: list[set[str]] = []
        self.starts: list[tuple[str, int]] = []

    def partitions(self) -> list[Parts]:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        fs, at = opened(path)
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        head = path[: path.rindex(at)] if at in path else path.partition("://")[0] + "://"
        size = float(self.options.get("range_mb", 64)) * 1e6
        out: list[Parts] = []
        room = 0.0
        for f in sorted(files, key=lambda f: f.path):
            if not f.is_file or f.base_name.startswith(("_", ".")) or kind(f.base_name) is None or not fnmatch.fnmatchcase(f.base_name, self.options.get("pattern", "*")):
                continue
            if all(head + f.path in some for some in self.paths):
                of = max(1, int(-(-f.size // size)))
                for i in range(of):
                    cost = f.size / of + min(OPEN_COST, size / 64)
                    if cost > room:
                        out.append(Parts([]))
                        room = size
                    out[-1].parts.append(Part(head + f.path, i, of))
                    room -= cost
        return out

    def _wanted(self, start: int) -> bool:
        return all({"gt": start > v, "ge": start >= v, "lt": start < v, "le": start <= v, "eq": start == v}[test] for test, v in self.starts)

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        held, samples = [], 0
        for part in partition.parts:
            for batch in self._read(part):
                held.append(batch)
                samples += len(batch.column(3).values)
                if samples >= TOGETHER:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, samples = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def _read(self, part: Part) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.float32()), pa.int32(), pa.int64(), pa.string())
        row = lambda *v: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(v, types, strict=True)], names=NAMES)
        try:
            with recording(part.path, self.options) as r:
                cut = chunks(r.n, r.sr, self.options)
                for k in range(cut.count * part.index // part.of, cut.count * (part.index + 1) // part.of):
                    start, stop = cut.span(k)
                    if self._wanted(start):
                        yield row(part.path, kind(part.path), start, r.read(start, stop - start), int(r.sr), r.n, None)
        except (ValueError, EOFError, wave.Error, OSError, KeyError) as e:
            yield row(part.path, kind(part.path), None, None, None, None, f"part {part.index}: {e or type(e).__name__}")


class FilteringReader(RecordingReader):
    def pushFilters(self, filters: list[Filter]):
        """Files and chunks that filters leave out; Spark applies filters on chunks once more."""
        tests = {GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", EqualTo: "eq"}
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.paths.append({f.value})
            elif isinstance(f, In) and f.attribute == ("path",):
                self.paths.append(set(f.value))
            elif type(f) in tests and f.attribute == ("start",):
                self.starts.append((tests[type(f)], f.value))
            yield f


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else RecordingReader)(self.options)


def chunked(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Chunks of the recordings of a folder; see the module for options."""
    spark.dataSource.register(RecordingSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")  # Spark refuses a reader that takes filters where this is off
    return spark.read.format("recordings").options(pushdown=pushdown, **options).load(folder)


def centred(parts: DataFrame) -> DataFrame:
    """Chunks that follow one another less their recording's mean, counted over all of it."""
    sums = parts.select("path", F.aggregate("y", F.lit(0.0), lambda a, v: a + v).alias("s"), F.size("y").alias("k"))
    mean = sums.groupBy("path").agg((F.sum("s") / F.sum("k")).alias("_mean"))
    return parts.join(mean, "path").withColumn("y", F.transform("y", lambda v: (v - F.col("_mean")).cast("float"))).drop("_mean")


def saved(files: DataFrame, folder: str, made: Callable | None = None) -> DataFrame:
    """Write ``files(name, content)`` each as a file of a folder, when the result ``name, path, size`` is read. A file appears whole, under its name, or
    not at all; a task that runs again writes the same again. With ``made`` the content is what that makes of the value, as bytes, so that a task holds one file at a time."""
    import uuid

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        for batch in batches:
            sizes, paths = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw, path = content.as_py() if made is None else made(content), f"{at.rstrip('/')}/{name}"
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                part = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(raw)
                fs.move(part, path)
                sizes.append(len(raw))
                paths.append(f"{folder.rstrip('/')}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["name", "path", "size"])

    return files.select("name", "content").mapInArrow(write, "name string, path string, size bigint")
