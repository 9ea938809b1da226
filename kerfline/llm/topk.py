"""Exact top-k search by inner product with one KD-tree a shard.

A shard is a bounded number of vectors. Its tree splits at the median of the coordinate with the widest spread, down to
small leaves, and every node has the tight bounding box of its vectors. A query goes through a tree best first:
the largest inner product a box can hold, ``sum(max(q * low, q * high))``, orders the nodes, and the search
ends when no box left can reach the k-th score found. That k-th score is passed on: all shards of a block of
queries are searched one after the other in one task, each starting from what those before have found, and shards
are spread over ``lanes`` tasks whose results are merged at the end.

Every block of queries meets every shard; neither side is broadcast or collected.

Defined results: vectors that are null or hold null or non-finite components take no part, neither as query nor as
candidate; only vectors of equal length are compared; every query row is answered, also where rows repeat its id, and not compared with itself only;
rows with a null id are candidates; ties go to the smaller id, null last; products whose size is beyond 2**53 are
computed with Python integers, and a score beyond 64 bits fails loudly; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kerfline.llm.common import written


@dataclass(frozen=True)
class Config:
    k: int = 5
    shard: int = 4096  # vectors, expected
    block: int = 4096  # queries, expected
    lanes: int = 8  # tasks over which the shards of one block of queries are spread
    leaf: int = 64


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of each component in double precision; null where the vector takes no part."""
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  larger ones are whole
    parts = F.transform(embedding, lambda x: whole(x.cast("double") * 256))
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)), parts)


#: In place of a null id's negative: below that of every other.
NO_ID = -(1 << 64)


class Tree:
    """Arrays of one KD-tree: nodes in pre-order, boxes, and vectors reordered so that a node is a slice."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, leaf: int):
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.child: list[tuple[int, int] | None] = []
        order = np.arange(len(rows))
        todo = [(0, len(rows), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            me = len(self.span)
            if parent >= 0:
                pair = self.child[parent] or (-1, -1)
                self.child[parent] = (me, pair[1]) if side == 0 else (pair[0], me)
            part = vectors[order[start:end]]
            low, high = part.min(0), part.max(0)
            self.low.append(low)
            self.high.append(high)
            self.span.append((start, end))
            self.child.append(None)
            if end - start > leaf and (high > low).any():
                axis = int((high - low).argmax())
                middle = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(part[:, axis], middle)]
                todo += [(start + middle, end, me, 1), (start, start + middle, me, 0)]
        self.vectors, self.rows, self.at = vectors[order], rows[order], order
        self.low, self.high = np.array(self.low), np.array(self.high)

    def search(self, q: np.ndarray, own: int, ids: list[int | None], k: int, best: list[tuple[int, int]]) -> None:
        """Improve ``best``, a heap of at most k entries (score, -id), by this tree's vectors, but for that of the row ``own``; ``ids`` in the order the tree was given them."""
        bounds = np.maximum(q * self.low, q * self.high).sum(1)
        todo = [(-bounds[0], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            if len(best) == k and -bound < best[0][0]:
                return
            if self.child[node] is not None:
                for c in self.child[node]:
                    if len(best) < k or bounds[c] >= best[0][0]:
                        heapq.heappush(todo, (-bounds[c], c))
                continue
            start, end = self.span[node]
            scores = self.vectors[start:end] @ q
            least = best[0][0] if len(best) == k else -np.inf
            for i in np.flatnonzero(scores >= least):
                if self.rows[start + i] == own:
                    continue
                vec = ids[self.at[start + i]]
                entry = (int(scores[i]), NO_ID if vec is None else -vec)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def _exact(vectors: np.ndarray) -> np.ndarray:
    """Doubles where all products are exact in them, else Python integers."""
    most = float(np.abs(vectors).max(initial=0.0))
    return vectors if most * most * max(1, vectors.shape[1]) < 2.0**53 else np.array([[int(x) for x in v] for v in vectors], object)


def search(vectors: DataFrame, is_query: Column, cfg: Config = Config()) -> DataFrame:
    """``vectors(vec_id, embedding)`` to ``query_id, rank, vec_id, score``: each query's k best."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).where("v IS NOT NULL")
    usable = written(usable.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")  # numbers are fixed by being written
    shards = max(1, -(-usable.count() // cfg.shard))
    blocks = max(1, -(-usable.where(is_query).count() // cfg.block))
    lanes = min(cfg.lanes, shards)
    some = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = usable.where(is_query).withColumn("shard", F.lit(-1)).withColumn("block", some(blocks)).withColumn("lane", every(lanes))
    there = usable.withColumn("shard", some(shards)).withColumn("block", every(blocks)).withColumn("lane", F.col("shard") % lanes)
    keys = ["dim", "block", "lane"]
    columns = [*keys, "shard", "row", "vec_id", "v"]
    # Sorted so that a group begins with its queries and goes on shard by shard.
    rows = asked.select(*columns).unionByName(there.select(*columns)).repartition(*keys).sortWithinPartitions(*keys, "shard")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, names, queries, best = None, [], None, []
        for shard, own, ids, v in _shards(batches):
            if shard < 0:
                asking, names, queries, best = own, ids, v, [[] for _ in own]
            elif asking is not None:
                both = _exact(np.concatenate([v, queries]))
                tree = Tree(both[: len(own)], own, cfg.leaf)
                for i, q in enumerate(asking):
                    tree.search(both[len(own) + i], q, ids, cfg.k, best[i])
        found = [(int(r), q, None if vec == NO_ID else -vec, s) for r, q, heap in zip(asking if asking is not None else (), names, best, strict=True) for s, vec in heap]
        cols = list(zip(*found, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "query_id", "vec_id", "score"])

    found = rows.groupBy(*keys).applyInArrow(run, "row long, query_id long, vec_id long, score long")
    order = W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list, np.ndarray]]:
    """``(shard, rows, ids, vectors)`` one shard at a time, from batches sorted by shard."""
    at, rows, ids, parts = None, [], [], []

    def whole() -> tuple[int, np.ndarray, list, np.ndarray]:
        return at, np.concatenate(rows), ids, np.concatenate(parts)

    for batch in batches:
        shard, own, named = batch.column("shard").to_numpy(), batch.column("row").to_numpy(), batch.column("vec_id").to_pylist()
        v = batch.column("v").flatten().to_numpy().reshape(len(own), -1) if len(own) else np.zeros((0, 0))
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            if rows and shard[s] != at:
                yield whole()
                rows, ids, parts = [], [], []
            at = int(shard[s])
            rows.append(own[s:e])
            ids = ids + named[s:e]
            parts.append(v[s:e])
    if rows:
        yield whole()
