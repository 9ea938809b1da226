"""Watching a folder: a stream of sightings, files that have settled, and what to do with them.

``sightings`` is a stream source that lists a folder at each trigger, each of its subfolders in a task of its own. ``settled`` keeps a small state for each path, with a timer: a file
counts when its size and time of change have stayed the same for ``quiet`` seconds of event time, and is given out once; if it changes later it is given out again. A
file that is no longer seen is forgotten after ``forget`` seconds. Timers are of event time, so that a restart from the checkpoint goes on where it stopped, and a replay of
the same sightings gives the same files.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kerfline.operators import records
from kerfline.sources.ranges import opened

SIGHTING = "path string, size bigint, mtime_ns bigint, seen_at timestamp"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Folder(InputPartition):
    """A folder to list: all below it, or only the files in it."""

    path: str
    deep: bool
    at_ms: int


class SightingReader(DataSourceStreamReader):
    """Offsets are times of listing, so that each trigger has something new. A batch that is run again lists again: what is seen then is as true."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.endings = tuple(e if e.startswith(".") else f".{e}" for e in self.options.get("extensions", "").lower().split(",") if e)

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        return {"ms": int(dt.datetime.now(dt.UTC).timestamp() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        fs, at = opened(self.options["path"])
        inside = [f for f in fs.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.Directory]
        return [Folder(at, False, end["ms"]), *(Folder(f.path, True, end["ms"]) for f in inside)]

    def read(self, part: Folder) -> Iterator[tuple]:
        fs, at = opened(self.options["path"])
        head = self.options["path"][: self.options["path"].rindex(at)]
        seen = dt.datetime.fromtimestamp(part.at_ms / 1000, dt.UTC)
        for f in fs.get_file_info(pafs.FileSelector(part.path, recursive=part.deep, allow_not_found=True)):
            if f.is_file and not f.base_name.startswith((".", "_")) and (not self.endings or f.base_name.lower().endswith(self.endings)):
                yield head + f.path, f.size, f.mtime_ns, seen


class Sightings(DataSource):
    """Options: ``path``, and ``extensions``, with commas between."""

    @classmethod
    def name(cls) -> str:
        return "sightings"

    def schema(self) -> str:
        return SIGHTING

    def streamReader(self, schema) -> SightingReader:
        return SightingReader(self.options)


def sightings(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """A stream of what is in a folder, with extensions in their normal form."""
    spark.dataSource.register(Sightings)
    return spark.readStream.format("sightings").option("extensions", ",".join(records.extensions(list(extensions)))).load(folder)


class Settler(StatefulProcessor):
    """``size, mtime_ns``, since when (ms), last seen (ms), and whether it has been given out."""

    def __init__(self, quiet: float, forget: float):
        self.quiet, self.forget = int(quiet * 1000), int(forget * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "size bigint, mtime_ns bigint, since bigint, seen bigint, given boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = self.file.get() if self.file.exists() else None
        for r in sorted(rows, key=lambda r: r["seen_at"]):
            seen = int(r["seen_at"].timestamp() * 1000)
            if now is None or (r["size"], r["mtime_ns"]) != tuple(now[:2]):
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(seen + self.quiet)
                now = (r["size"], r["mtime_ns"], seen, seen, False)
            elif seen > now[3]:
                now = (*now[:3], seen, now[4])
        self.file.update(tuple(now))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.file.exists():
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        size, mtime, since, seen, given = self.file.get()
        if not given and seen >= since + self.quiet:
            yield Row(path=key[0], size=size, mtime_ns=mtime, seen_at=dt.datetime.fromtimestamp(seen / 1000))
            given = True
            self.file.update((size, mtime, since, seen, True))
        if at >= seen + self.forget:
            self.file.clear()
        else:  # not seen for long enough yet, or to be forgotten one day
            self.handle.registerTimer(max(at + 1, seen + self.forget) if given else at + self.quiet)

    def close(self) -> None:
        pass


def settled(seen: DataFrame, quiet: float, forget: float = 3600.0, late: str = "0 seconds") -> DataFrame:
    """Of a stream ``path, size, mtime_ns, seen_at`` each version of a file once, when it has not changed for ``quiet`` seconds."""
    spark = seen.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        raise ValueError(f"timers need spark.sql.streaming.stateStore.providerClass={STORE}")
    if forget <= quiet:
        raise ValueError("a file must not be forgotten before it has settled")
    return seen.withWatermark("seen_at", late).groupBy("path").transformWithState(Settler(quiet, forget), SIGHTING, "append", "eventTime")


def detected(files: DataFrame, known: tuple[str, ...] = ("airborne", "structure")) -> DataFrame:
    """What the ledger takes: settled files whose path tells their modality."""
    return files.withColumn("modality", records.modality_of(F.col("path"), known)).where("modality IS NOT NULL").select("path", "modality", "size", "mtime_ns", "seen_at")
