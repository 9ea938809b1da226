"""N-gram Jaccard join: a blocked product of the sparse incidence matrix of documents by shingles with its transpose.

A document's set is its distinct shingles of five words. Documents with equal sets are one row of the matrix. Two rows of ``a`` and ``b`` shingles link where their
overlap ``i`` has ``9 i >= 4 (a + b)``, that is a Jaccard similarity of 0.8; so ``i`` is at least ``least_overlap(a)`` for either of them. All columns are in one order, that of their
hashes. A row sends its first ``a - least_overlap(a) + slack(a)`` columns only: two linked rows have at least the smaller ``slack`` of these in common, and a row with fewer
of them shared with any other row is done. What is left is multiplied, a block of columns a task:

1. each column is multiplied with its first row only, the counts are summed over the blocks, and pairs that reach the bound are verified by
   their whole overlap. Links make components, and of a group of copies one is left.
2. Columns that still hold more than one component, in rows that have enough such columns, are multiplied anew, rows of the same component not among
   each other. For these rows all columns are counted and put in order of the number of rows that hold them, rare ones first, and again
   only the first ones are kept: a pair is met at the first column that both have, and only where what is left behind it in both rows is enough.

No pair that can link is left out but those within one component, so the components are those of all links. No column, however many rows it
has, meets in one task as a list: the first round takes a minimum and a join, the second a join with the rows outside the column's main component.

Defined results: null and empty texts and texts without words have no shingles and are their own component; with fewer than five words the whole
sequence is the only shingle; repeated rows are in the component of their text; a null id names a component only where there is no other id; a text may be of any length, its
shingles are held in one task; an empty table gives an empty result; other columns are not read. Shingles are compared by hashes of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kerfline.llm.common import Scratch, text_or_empty
from kerfline.llm.linkage import components, joined
from kerfline.llm.near_dup import mixed, word_hashes

WORDS = 5


def least_overlap(n: int) -> int:
    """What a row of ``n`` shingles has in common with any that it links with, at least."""
    return -(-4 * n // 5)


def slack(n: int) -> int:
    return 1 + n // 16


#: The same for columns ``n`` in SQL: overlap, and the shared leading columns that a row needs; a partner has at least ``least_overlap(n)`` shingles.
LEAST = "(4 * n + 4) DIV 5"
NEEDED = f"1 + ({LEAST}) DIV 16"


def shingles(raw: bytes) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    w = word_hashes(b" ".join(raw.lower().split()).decode())  # of bytes: A-Z and ASCII white space only
    if not len(w):
        return w
    n = min(WORDS, len(w))
    h = np.zeros(len(w) - n + 1, "u8")
    for j in range(n):
        h = mixed(h + w[j : len(w) - n + 1 + j])
    return np.unique(h)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _at() -> Column:
    """A row of the input, by id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_or_empty())


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, at, node, n, lead``: each document's set as a digest, its size, and its first columns."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                node, n, lead = [], [], []
                for t in part.column(2):
                    h = shingles(t.as_py())
                    n.append(len(h))
                    node.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                    lead.append(h[: len(h) - least_overlap(len(h)) + slack(len(h))].view("i8") if len(h) else np.zeros(0, "i8"))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lead])]).astype("i4")
                leads = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lead)))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(node, pa.binary()), pa.array(n, pa.int64()), leads], names=["doc_id", "at", "node", "n", "lead"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _at().alias("at"), text_or_empty().cast("binary").alias("raw")).mapInArrow(sign, f"doc_id {id_type}, at long, node binary, n long, lead array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of ``texts(id, raw)`` that link."""
    left, right = (texts.select(F.col("id").alias(c), F.col("raw").alias(f"{c}_raw")) for c in ("a", "b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()
        size = 0

        def of(node: int, raw: pa.BinaryScalar) -> np.ndarray:
            nonlocal size
            if node in known:
                known.move_to_end(node)
                return known[node]
            known[node] = out = shingles(raw.as_py())
            size += len(out)
            while size > 1_000_000 and len(known) > 1:
                size -= len(known.popitem(last=False)[1])
            return out

        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
                one, two = of(a, x), of(b, y)
                keep.append(9 * overlap(one, two) >= 4 * (len(one) + len(two)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Joined by ``a`` last: pairs of one ``a`` follow each other, so its shingles are made once.
    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "a_raw", "b_raw").mapInArrow(check, "a long, b long")


def columns_of(texts: DataFrame) -> DataFrame:
    """``id, col`` of all shingles of ``texts(id, raw)``."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                each = [shingles(t.as_py()) for t in part.column(1)]
                id_ = part.column(0).take(pa.array(np.repeat(np.arange(len(each)), [len(h) for h in each])))
                yield pa.RecordBatch.from_arrays([id_, pa.array(np.concatenate(each).view("i8"))], names=["id", "col"])

    return texts.select("id", "raw").mapInArrow(spell, "id long, col long")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def first_round(held: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b``: of ``held(col, id, n)`` the rows with the first row of enough of their columns, where sizes allow a link."""
    heads = scratch.written(held.groupBy("col").agg(F.min(F.struct("id", "n")).alias("h"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("col", F.col("h.id").alias("a"), F.col("h.n").alias("m")), "heads")
    each = scratch.written(held.join(heads.hint("merge"), "col").where("id != a AND 5 * least(n, m) >= 4 * greatest(n, m)").select("a", "id", "n"), "products")
    counts = each.groupBy("a", "id", "n").agg(F.count(F.lit(1)).alias("common")).where(f"common >= {NEEDED}")
    return counts.select("a", F.col("id").alias("b"))


def second_round(rest: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b``: of ``rest(id, n, root)`` the pairs of different roots that can link."""
    each = scratch.written(columns_of(texts.join(rest.select("id").hint("merge"), "id", "left_semi")), "columns")
    shared = scratch.written(each.groupBy("col").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    held = scratch.written(each.join(shared.hint("merge"), "col"), "held")
    scratch.drop(each, shared)
    own = held.groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    sized = scratch.written(rest.join(own.hint("merge"), "id").where(f"n - shared <= n - {LEAST}"), "sized")
    place = F.row_number().over(W.partitionBy("id").orderBy("df", "col"))  # within one document
    placed = held.join(sized.hint("merge"), "id").withColumn("place", F.col("n") - F.col("shared") + place)
    early = scratch.written(placed.where(f"place <= n - {LEAST} + 1").select("col", "id", "n", "root", "place"), "early")
    scratch.drop(held)
    by_root = early.groupBy("col", "root").agg(F.count(F.lit(1)).alias("k"))
    main = scratch.written(by_root.groupBy("col").agg(F.max_by("root", "k").alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("col", "main"), "main")
    both = scratch.written(early.join(main.hint("merge"), "col").select("col", "id", "n", "root", "place", (F.col("root") == F.col("main")).alias("inside")), "both")
    other = both.select("col", *(F.col(c).alias(f"b_{c}") for c in ("id", "n", "root", "place", "inside")))
    # At the first column that both have, no more is in common than what is left in either.
    most = F.least(F.col("n") - F.col("place"), F.col("b_n") - F.col("b_place")) + 1
    can = (F.col("root") != F.col("b_root")) & (F.col("b_inside") | (F.col("id") < F.col("b_id"))) & (9 * most >= 4 * (F.col("n") + F.col("b_n")))
    met = both.where("NOT inside").join(other.hint("merge"), "col").where(can)
    return met.select(F.least("id", "b_id").alias("a"), F.greatest("id", "b_id").alias("b")).distinct()


def linked(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, n_shingles, component_id``, one row a document."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows = scratch.written(signed(docs.select("doc_id", "text")).withColumn("rid", F.monotonically_increasing_id()), "signed")  # numbers are fixed by being written
    some = rows.where("node IS NOT NULL")
    nodes = scratch.written(some.groupBy("node").agg(F.min("rid").alias("id"), F.min("doc_id").alias("doc_id")), "nodes")
    lead = some.withColumnRenamed("rid", "id").join(nodes.select("id").hint("merge"), "id", "left_semi")
    first = scratch.written(lead.select("id", "n", "at", "lead"), "first")
    each = first.select("id", "n", F.explode_outer("lead").alias("col"))
    shared = scratch.written(each.groupBy("col").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("col"), "shared")
    held = scratch.written(each.join(shared.hint("merge"), "col", "left_semi"), "held")
    scratch.drop(shared)
    live = scratch.written(held.groupBy("id", "n").agg(F.count(F.lit(1)).alias("k")).where(f"k >= {NEEDED}").select("id"), "live")
    alive = scratch.written(held.join(live.hint("merge"), "id", "left_semi"), "alive")
    scratch.drop(held)
    at = first.select("id", "at").join(live.hint("merge"), "id", "left_semi")
    texts = docs.select(_at().alias("at"), text_or_empty().cast("binary").alias("raw")).join(at.hint("merge"), "at").select("id", "raw")
    texts = scratch.written(texts.dropDuplicates(["id"]), "texts")

    pairs = scratch.written(first_round(alive, scratch), "pairs")
    roots = scratch.written(components(scratch.written(verified(pairs, texts), "links"), scratch), "roots")
    scratch.keep(rows, nodes, alive, texts, roots)

    placed = scratch.written(_rooted(alive, roots), "placed")
    split = scratch.written(placed.groupBy("col").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("col"), "split")
    there = scratch.written(placed.join(split.hint("merge"), "col", "left_semi"), "there")
    rest = scratch.written(there.groupBy("id", "n", "root").agg(F.count(F.lit(1)).alias("k")).where(f"k >= {NEEDED}").select("id", "n", "root"), "rest")
    scratch.drop(alive, placed, split, there)
    more = scratch.written(second_round(rest, texts, scratch), "more")
    roots = joined(roots, scratch.written(verified(more, texts), "links"), scratch)

    of = scratch.written(_rooted(nodes, roots), "rooted")
    named = scratch.written(of.groupBy("root").agg(F.min("doc_id").alias("component_id")), "named")
    by_node = scratch.written(of.select("node", "root").join(named.hint("merge"), "root").select("node", "component_id"), "by-node")
    scratch.keep(rows, by_node)
    out = rows.where("node IS NOT NULL").join(by_node.hint("merge"), "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("node IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
