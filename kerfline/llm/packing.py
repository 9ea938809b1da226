"""Token-id output: documents packed into rows of a fixed length by best-fit decreasing.

Overlong documents are split losslessly into pieces of at most a row. Pieces of a whole row stand alone; the
others, longest first, each go to the fullest row that still has room, found in a segment tree over the free
capacities. A row is written with its ids, the cumulative lengths of its segments (``cu_seqlens``), and the
places where positions start again at 0 (``resets``); ``doc_ids`` and ``doc_starts`` say which part of which
document each segment is.

Documents are dealt to buckets of about ``stretch`` by a hash of id and text, and packed bucket by bucket in order of id, so rows and their ids depend on the
documents only, not on how the input is divided. A bucket with more than ``tokens`` ids is packed in several goes, so memory is bounded; a lost
task gives the same rows when it runs again.

Defined results: documents without ids (null or empty texts) have no segment and appear in no row; rows that
repeat an id, and rows without one, are packed each for itself; texts may be of any length; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "row_id string, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, doc_starts array<int>"


class Capacities:
    """Rows by free capacity: a segment tree of counts over 0..most, with a stack of rows at each leaf."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, row: int, capacity: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return a row of the smallest capacity that is at least ``least``, with that capacity."""
        i, count = least + self.leaves, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, to the first subtree on the right with a row
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        row = self.rows[capacity].pop()
        self._add(capacity, -1)
        return row, capacity


def best_fit_decreasing(lengths: list[int], room: int) -> list[list[int]]:
    """Items by row; every length is from 1 to ``room``. Ties keep the order given."""
    rows: list[list[int]] = []
    free = Capacities(room)
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[item]
        if n == room:
            rows.append([item])
            continue
        found = free.take(n)
        if found is None:
            row, capacity = len(rows), room
            rows.append([])
        else:
            row, capacity = found
        rows[row].append(item)
        if capacity > n:
            free.put(row, capacity - n)
    return rows


def pack_rows(docs: list[tuple[int | None, np.ndarray]], room: int) -> Iterator[tuple]:
    """``(doc_id, ids)`` of a stretch to the fields of SCHEMA after ``row_id``."""
    parts = [(d, s, ids[s : s + room]) for d, ids in docs for s in range(0, len(ids), room)]
    for row in best_fit_decreasing([len(p[2]) for p in parts], room):
        own = [parts[i] for i in row]
        ends = np.cumsum([len(p[2]) for p in own])
        yield int(ends[-1]), np.concatenate([p[2] for p in own]).tobytes(), [0, *ends.tolist()], [0, *ends[:-1].tolist()], [p[0] for p in own], [p[1] for p in own]


#: A byte-level vocabulary in rank form: base64 of each token's bytes, and its id, one a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_LOADED: dict[int, tiktoken.Encoding] = {}


def encoding(raw: bytes) -> tiktoken.Encoding:
    """One encoder a worker process and vocabulary."""
    key = hash(raw)
    if key not in _LOADED:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
        _LOADED.clear()
        _LOADED[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


def pack(docs: DataFrame, room: int = 2048, vocabulary: str = VOCABULARY, eos: int | None = 50256, stretch: int = 4096, tokens: int = 4 << 20) -> DataFrame:
    """``docs(doc_id, text)`` to packed rows; ids are little-endian, 2 bytes each if they fit, else 4.

    ``eos`` ends each document."""
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks.value)
        kind = "<u2" if max(coder.n_vocab, eos or 0) <= 1 << 16 else "<u4"
        end = [] if eos is None else [eos]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        held, size, part, n = [], 0, None, 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(f"{part}-{n}-{i}", *r) for i, r in enumerate(pack_rows(held, room))]
            for s in range(0, len(rows), 512):
                cols = zip(*rows[s : s + 512], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            ids, texts, buckets = batch.columns
            for i, bucket in enumerate(buckets.to_pylist()):
                if held and (bucket != part or size >= tokens):
                    yield from out()
                    held, size, n = [], 0, n + 1 if bucket == part else 0
                part = bucket
                held.append((ids[i].as_py(), np.array(coder.encode_ordinary(texts[i].as_py()) + end, kind)))
                size += len(held[-1][1])
        if held:
            yield from out()

    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text <> ''")
    buckets = max(1, -(-docs.count() // stretch))
    mark = F.xxhash64("doc_id", "text")
    dealt = full.withColumn("bucket", F.pmod(mark, F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "doc_id", mark)
    return dealt.mapInArrow(run, SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet: the id matrix is the binary column, one row of the matrix a value."""
    packed.write.mode("overwrite").parquet(path)


def matrix(rows, room: int, pad: int = 0, kind: str = "<u2") -> tuple[np.ndarray, np.ndarray]:
    """Ids and positions of packed rows (as collected or read by a loader) as two matrices of ``room`` columns."""
    ids, positions = np.full((len(rows), room), pad, "<i8"), np.zeros((len(rows), room), "<i8")
    for i, r in enumerate(rows):
        ids[i, : r["n_tokens"]] = np.frombuffer(r["ids"], kind)
        for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            positions[i, a:b] = np.arange(b - a)
    return ids, positions
