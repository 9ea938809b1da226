"""Periodic runs of words, by a harmonic grid of longest common extensions.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) and length at least ``max(least, 3 * q)``
that no neighbouring word extends keeping that period. For every period ``p`` the words at ``j * p`` and ``(j + 1) * p`` are asked how far they
agree forwards and backwards; both answers together give the stretch of period ``p`` around them. A run of period ``p`` holds three neighbouring points
of that grid, so it is met. A query is put only where the words at both points, and the ``AHEAD - 1`` after them, are the same: a run's first grid point agrees
for at least ``max(p, least - 2 * p) + 1`` words. Stretches found by multiples of a period are the run of the least of them (two periods of a stretch of three times the larger make
their divisor one).

Extensions come from suffix arrays of the words and of the words reversed: ranks by doubling, common prefixes of neighbours in the array from the
ranks at each length, and a range-minimum table over them. Documents are put one behind the other between separators that
occur once, so an extension ends with its document.

Defined results: null and empty texts have no words and no runs; texts may be of any length (what a task holds is
proportional to its longest text with candidates, about 250 bytes a word); repeated rows are handled each for itself; null ids are kept; an empty table gives
an empty result; other columns pass through if asked for in ``keep``, whatever their names, and are not read otherwise.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 24
AHEAD = 9  # 1 + the least of max(p, 24 - 2 * p)
TEMPLATE = 1 << 15  # words of documents whose grid comes from a table
TOGETHER = 1 << 18  # words in one suffix array, if no document is longer
SLICE = 4 << 20  # bytes of text split into words at a time
QUERIES = 1 << 20  # extension queries at a time


class Grid:
    """Grid points ``(start, period)`` with two more points behind them, of all documents up to a length: sorted by the last point, so
    that a document's are the first ones."""

    def __init__(self, n: int):
        periods = [(p, np.arange(0, max(0, n - 2 * p), p, dtype="i4")) for p in range(1, n // 3 + 1)]
        start = np.concatenate([np.zeros(0, "i4"), *(s for _, s in periods)])
        period = np.repeat(np.array([p for p, _ in periods], "i4"), [len(s) for _, s in periods])
        last = start + 2 * period
        order = np.argsort(last, kind="stable")
        self.n, self.start, self.period, self.last = n, start[order], period[order], last[order]
        self.second = self.start + self.period

    def candidates(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points and periods of one document where three neighbouring grid points have one word."""
        if len(w) <= self.n:
            k = int(np.searchsorted(self.last, len(w)))
            at = np.flatnonzero(w.take(self.start[:k]) == w.take(self.second[:k]))
            at = at[w[self.second[at]] == w[self.last[at]]]
            return self.start[at], self.period[at]
        found = []
        for p in range(1, len(w) // 3 + 1):
            a = w[::p]
            same = a[1:] == a[:-1]
            at = np.flatnonzero(same[1:] & same[:-1])
            if len(at):
                found.append((at * p, np.full(len(at), p)))
        return tuple(np.concatenate([np.zeros(0, "i8"), *(f[k] for f in found)]).astype("i8") for k in (0, 1))


def promising(w: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """Grid points of one document's words from which a run can go."""
    at, p = grid.candidates(w)
    ok = at + p + AHEAD <= len(w)
    at, p = at[ok], p[ok]
    for i in range(1, AHEAD):
        if not len(at):
            break
        ok = w[at + i] == w[at + p + i]
        at, p = at[ok], p[ok]
    return at, p


class Extensions:
    """Longest common extensions of any two places of a sequence whose last element occurs once."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        _, first, group, size = np.unique(s, return_index=True, return_inverse=True, return_counts=True)
        rank = (np.cumsum(size) - size)[group].astype("i4")  # where the element's group begins
        levels, k = [rank], 1
        open_ = np.flatnonzero(size[group] > 1)
        while len(open_):
            nxt = np.zeros(len(open_), "i8")
            inside = open_ + k < n
            nxt[inside] = rank[open_[inside] + k] + 1
            key = (rank[open_].astype("i8") << 32) | nxt
            order = np.argsort(key)
            key, where = key[order], open_[order]
            place = np.arange(len(key))
            new = np.concatenate([[True], key[1:] != key[:-1]])
            new_group = np.concatenate([[True], key[1:] >> 32 != key[:-1] >> 32])
            begin, group_begin = (np.maximum.accumulate(np.where(x, place, 0)) for x in (new, new_group))
            rank = rank.copy()
            rank[where] += (begin - group_begin).astype("i4")
            levels.append(rank)
            alone = new & np.concatenate([new[1:], [True]])
            open_, k = where[~alone], 2 * k
        self.rank = rank
        array = np.empty(n, "i4")
        array[rank] = np.arange(n, dtype="i4")
        # What neighbours in the array have in common, from the longest pieces to single elements.
        a, b = array[:-1].astype("i8"), array[1:].astype("i8")
        common = np.zeros(max(0, n - 1), "i4")
        for level in reversed(range(len(levels))):
            same = levels[level][a + common] == levels[level][b + common]
            common[same] += 1 << level
        del levels
        self.least = [common]  # least[m][i]: of common[i : i + 2**m]
        while 2 << (len(self.least) - 1) <= len(common):
            half, m = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(half[:-m], half[m:]))

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        i, j = self.rank[x], self.rank[y]
        lo, hi = np.minimum(i, j).astype("i8"), np.maximum(i, j).astype("i8")
        m = np.frexp((hi - lo).astype("f8"))[1] - 1
        out = np.empty(len(x), "i8")
        for k in np.unique(m):
            at = np.flatnonzero(m == k)
            out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << int(k))])
        return out


def runs_of(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: int = LEAST) -> list[np.ndarray]:
    """For documents ``(word ids, grid points, periods)`` the rows ``start, length, period`` of their runs, by start and period."""
    top = 1 + max((int(w.max()) for w, _, _ in docs if len(w)), default=0)
    parts, offset, n = [np.array([top])], [], 1
    for d, (w, _, _) in enumerate(docs):
        parts += [w, np.array([top + 1 + d])]
        offset.append(n)
        n += len(w) + 1
    s = np.concatenate(parts)
    x, p = (np.concatenate([d[k] + (offset[i] if k == 1 else 0) for i, d in enumerate(docs)]).astype("i8") for k in (1, 2))
    of = np.repeat(np.arange(len(docs)), [len(d[1]) for d in docs])
    forward = Extensions(s)
    ahead = np.concatenate([np.zeros(0, "i8"), *(forward.of(x[i : i + QUERIES], x[i : i + QUERIES] + p[i : i + QUERIES]) for i in range(0, len(x), QUERIES))])
    del forward
    keep = ahead > np.maximum(p, least - 2 * p)  # a run's first grid point agrees as long
    x, p, of, ahead = x[keep], p[keep], of[keep], ahead[keep]
    backward = Extensions(s[::-1])
    behind = np.concatenate([np.zeros(0, "i8"), *(backward.of(n - x[i : i + QUERIES], n - x[i : i + QUERIES] - p[i : i + QUERIES]) for i in range(0, len(x), QUERIES))])
    start, length = x - behind, behind + p + ahead
    keep = length >= np.maximum(least, 3 * p)
    start, length, p, of = start[keep], length[keep], p[keep], of[keep]
    order = np.lexsort((p, length, start))
    start, length, p, of = start[order], length[order], p[order], of[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    rows = np.stack([start - np.array(offset, "i8")[of], length, p], 1)[new]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0], of[new]))]
    return np.split(rows, np.searchsorted(np.sort(of[new]), np.arange(1, len(docs))))


NONE = np.zeros((0, 3), "i8")


def runs_in(texts: list[list[bytes]], grid: Grid, least: int = LEAST) -> list[np.ndarray]:
    """Runs of each text, given as its words."""
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    out, held, size = [NONE] * len(texts), [], 0

    def flush() -> None:
        for (i, *_), rows in zip(held, runs_of([h[1:] for h in held], least), strict=True):
            out[i] = rows

    for i, words in enumerate(texts):
        if len(words) < least:
            continue
        w = np.fromiter(map(ids.__getitem__, words), "i4", len(words))
        at, p = promising(w, grid)
        if not len(at):
            continue
        if held and size + len(w) > TOGETHER:
            flush()
            held, size = [], 0
        held.append((i, w, at, p))
        size += len(w)
    if held:
        flush()
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, with one space between them."""
    if len(runs):
        edge = np.zeros(len(words) + 1, "i8")
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs(keep..., text)`` to ``keep..., runs, collapsed``: the runs by start and period, and the text without repetitions."""
    rest = list(dict.fromkeys(keep))
    schema = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(rest)), F.expr(f"CAST(NULL AS {RUNS}) AS runs"), F.lit("").alias("collapsed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Grid(TEMPLATE)
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.concatenate([np.searchsorted(size, np.arange(SLICE, size[-1] if len(size) else 0, SLICE)), [0, batch.num_rows]]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                words = [t.split() for t in part.column(part.num_columns - 1).to_pylist()]  # bytes split at ASCII white space
                runs = runs_in(words, grid)
                texts = pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
                rows = np.concatenate([NONE, *runs])
                each = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["start", "length", "period"])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype("i4"))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(offsets, each), texts], names=schema.names)

    found = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(rest)), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text")).mapInArrow(run, schema)
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(rest)), "runs", "collapsed")


def greatest(runs):
    """The run of greatest length by period, compared exactly; ties go to the smaller start, then the smaller period."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]  # noqa: E731  runs come by start and period, so the first of equals stays
    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))
