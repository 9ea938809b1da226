"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is lower-cased, and characters that are neither letters nor digits separate words. Shingles are five words (all of them, if
there are fewer); a shingle weighs its count in the text times its IDF, the mean over its words of
``1 + ln(min(N / df, rarest)) / ln(rarest)``. Document frequencies are counted over all documents. A word that fewer than one in ``rarest`` documents
hold weighs 2, whatever the corpus' size, so only the words above that share need a table; there are fewer of them than ``rarest`` times the
mean number of distinct words in a document, and that table, checked against ``most_words``, is sent to all tasks. IDF is by word since a shingle's own
frequency would take weight from exactly what a large group of copies shares.

Consistent weighted samples (one element and level for each of ``bands * rows`` draws) agree between two texts
with the probability of their weighted Jaccard similarity. The samples of a band make a key; texts that share a
key are linked by ``linkage.link``, each pair verified by its exact weighted Jaccard similarity.

An element's random numbers of a draw come from its hash: 13 bits of it pick (r, beta), 13 others c, each out of 8,192 drawn from their distributions.

Texts with the same words are one node from the start. Defined results: null and empty texts and texts without a word
are one class; repeated rows are in the class of their text; one row a class is kept, also where rows repeat id and text or have no id; a null id takes part, and names a class only where
there is no other id; a text may be of any length, its shingles are held in one task; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kerfline.llm.common import Scratch, text_or_empty
from kerfline.llm.linkage import link


@dataclass(frozen=True)
class Config:
    words: int = 5
    threshold: float = 0.8
    bands: int = 14
    rows: int = 4
    rarest: int = 1024
    most_words: int = 1 << 22
    seed: int = 5


TRIPLES = 1 << 13  # entries of the tables of random numbers
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)


class Powers:
    """Powers of an odd base modulo 2**64, and their inverses, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, "u8")

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 14)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, "u8"), np.full(n - 1, k, "u8")])) for k in (ODD, INVERSE))
        return self.up, self.down


_POWERS = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text with single spaces between them."""
    if not text:
        return np.zeros(0, "u8")
    b = np.frombuffer(text.encode(), "u1")
    up, down = _POWERS(len(b) + 1)
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum((b.astype("u8") + np.uint64(1)) * up[: len(b)], dtype="u8")])
    gaps = np.flatnonzero(b == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(b)]])
    return mixed((sums[end] - sums[start]) * down[start])


class Weights:
    """IDF by word from a table of the words that more than one in ``rarest`` documents hold; all others weigh 2."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, docs: int, rarest: int):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.idf = 1 + np.log(np.clip(docs / np.maximum(df[order], 1), 1, rarest)) / np.log(rarest)

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(words), 2.0)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.idf[at], 2.0)


def shingles(text: str, weights: Weights, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their TF-IDF weights."""
    w = word_hashes(text)
    if not len(w):
        return w, np.zeros(0)
    n = min(n, len(w))
    idf = weights.of(w)
    h, mean = np.zeros(len(w) - n + 1, "u8"), np.zeros(len(w) - n + 1)
    for j in range(n):
        h = mixed(h + w[j : len(w) - n + 1 + j])
        mean = mean + idf[j : len(w) - n + 1 + j]
    one, at, count = np.unique(h, return_index=True, return_counts=True)
    return one, mean[at] / n * count


class Sampler:
    """Improved consistent weighted sampling."""

    def __init__(self, cfg: Config):
        rng = np.random.default_rng(cfg.seed)
        k = cfg.bands * cfg.rows
        self.cfg = cfg
        self.by = (rng.integers(0, 1 << 63, k, dtype="u8") << np.uint64(1) | np.uint64(1))[:, None]
        self.r = rng.gamma(2, 1, TRIPLES).astype("f4")
        self.beta = rng.random(TRIPLES).astype("f4")
        self.ln_c = np.log(rng.gamma(2, 1, TRIPLES)).astype("f4")

    def keys(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One key a band."""
        k = len(self.by)
        best, kept, level = np.full(k, np.inf, "f4"), np.zeros(k, "u8"), np.zeros(k, "i8")
        ln = np.log(weight).astype("f4")
        for s in range(0, len(h), 2048):
            part = h[s : s + 2048]
            x = part[None] * self.by
            at = (x >> np.uint64(51)).view("i8")
            r, beta = self.r.take(at, mode="clip"), self.beta.take(at, mode="clip")
            t = np.floor(ln[s : s + 2048] / r + beta)
            ln_a = self.ln_c.take(((x >> np.uint64(38)) & np.uint64(TRIPLES - 1)).view("i8"), mode="clip") - r * (t - beta + 1)
            i = ln_a.argmin(1)
            low = ln_a[np.arange(k), i]
            new = low < best
            best[new], kept[new], level[new] = low[new], part[i[new]], t[np.arange(k), i][new].astype("i8")
        sample = mixed(kept + mixed(level.view("u8") + np.uint64(1))).reshape(self.cfg.bands, self.cfg.rows)
        key = np.arange(1, self.cfg.bands + 1, dtype="u8")
        for j in range(self.cfg.rows):
            key = mixed(key * np.uint64(ODD) + sample[:, j])
        return key.view("i8")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), max(0, len(b[0]) - 1))
    both = b[0][at] == a[0] if len(b[0]) else np.zeros(0, bool)
    low = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low)) if len(a[0]) or len(b[0]) else 1.0


def normal_form():
    return F.trim(F.regexp_replace(F.lower(text_or_empty()), r"[^\p{L}\p{N}]+", " "))


def node_of(norm):
    return F.unhex(F.md5(norm.cast("binary")))


def counted(texts: DataFrame) -> DataFrame:
    """``word, n``: hashes and document frequencies of all words of ``texts(norm)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view("i8")), pa.array(n.astype("i8"))], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.append(np.unique(word_hashes(t.as_py())))
                size += len(held[-1])
                if size > 1_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(by_word: DataFrame, docs: int, cfg: Config) -> Weights:
    """Weights from ``by_word(word, n)``; only words above the share that ``cfg.rarest`` names are gathered."""
    rows = by_word.where(F.col("n") * cfg.rarest > docs).limit(cfg.most_words + 1).toArrow()
    if rows.num_rows > cfg.most_words:
        raise ValueError(f"more than {cfg.most_words} words are in over one of {cfg.rarest} documents; take a smaller rarest")
    word, n = (rows.column(k).to_numpy() for k in ("word", "n"))
    return Weights(word.view("u8"), n, docs, cfg.rarest)


def classes(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, class_id, class_size, kept, node``: one row a document, the class named by its least id;
    node is the MD5 of the normal form."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    texts = docs.select("doc_id", normal_form().alias("norm"))
    by_word = scratch.written(counted(texts.select("norm")), "words")
    weights = spark.sparkContext.broadcast(frequent(by_word, docs.count(), cfg))  # at most ``most_words`` entries
    sampler = Sampler(cfg)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, keys = [], []
            for t in batch.column(2):
                h, w = shingles(t.as_py(), weights.value, cfg.words)
                total.append(float(w.sum()))
                keys.append(sampler.keys(h, w) if len(h) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(total), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "weight", "keys"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = texts.select("doc_id", node_of(F.col("norm")).alias("node"), "norm").mapInArrow(sign, f"doc_id {id_type}, node binary, weight double, keys array<long>")
    signed = scratch.written(signed.withColumn("row", F.monotonically_increasing_id()), "signed")  # fixed by being written
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = scratch.written(signed.groupBy("node").agg(least.getField("doc_id").alias("doc_id"), least.getField("row").alias("row"), F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"), F.first("keys").alias("keys")).withColumn("id", F.monotonically_increasing_id()), "nodes")  # numbers are fixed by being written
    members = nodes.select(F.explode("keys").alias("key"), "id", F.col("weight").alias("size"))

    def fetch(ids: DataFrame) -> DataFrame:
        """Texts of nodes, by the id of their first document; only what is asked for is normalised."""
        at = nodes.join(ids, "id").select("id", "node", F.col("doc_id").alias("_id"))
        found = docs.select("doc_id", "text").join(at.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("id", "node", normal_form().alias("norm"))
        return scratch.written(found.where(node_of(F.col("norm")) == F.col("node")).groupBy("id").agg(F.first("norm").alias("norm")), "texts")

    roots = link(
        members, fetch, lambda pairs, known: similar(pairs, known, weights, cfg), lambda ids, known: alone(ids, known, weights, cfg), cfg.threshold, scratch,
        lambda rows, known: rare_pairs(rows, known, weights, cfg, scratch),
    )
    of = scratch.written(nodes.join(roots, "id", "left").select("node", "doc_id", "n", "row", F.coalesce("root", "id").alias("root")), "rooted")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))  # the row that stays: of the least id, of none only where there is no other
    named = scratch.written(of.groupBy("root").agg(first.alias("first"), F.sum("n").alias("class_size")), "named")
    by_node = scratch.written(of.select("node", "root").join(named, "root").select("node", F.col("first.doc_id").alias("class_id"), "class_size", F.col("first.row").alias("stays")), "classes")
    scratch.keep(signed, by_node)
    return signed.select("doc_id", "node", "row").join(by_node, "node").select("doc_id", "class_id", "class_size", (F.col("row") == F.col("stays")).alias("kept"), "node")


def similar(pairs: DataFrame, texts: DataFrame, weights, cfg: Config) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose ``texts(id, norm)`` are similar enough."""
    left, right = (texts.select(F.col("id").alias(c), F.col("norm").alias(f"{c}_text")) for c in ("a", "b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, tuple] = OrderedDict()
        size = 0

        def of(node: int, text: pa.StringScalar) -> tuple:
            nonlocal size
            if node in known:
                known.move_to_end(node)
                return known[node]
            out = known[node] = shingles(text.as_py(), weights.value, cfg.words)
            size += len(out[0])
            while size > 1_000_000 and len(known) > 1:
                size -= len(known.popitem(last=False)[1][0])
            return out

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = [similarity(of(x, t), of(y, u)) >= cfg.threshold for x, y, t, u in zip(a, b, *batch.columns[2:], strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "a_text", "b_text").mapInArrow(check, "a long, b long")


def spelled(ids: DataFrame, texts: DataFrame, weights, cfg: Config) -> DataFrame:
    """``id, shingle, w`` of the ids' texts."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                each = [shingles(t.as_py(), weights.value, cfg.words) for t in part.column(1)]
                n = np.array([len(h) for h, _ in each], "i8")
                h, w = (np.concatenate([e[k] for e in each]) for k in (0, 1))
                id_ = part.column(0).take(pa.array(np.repeat(np.arange(len(each)), n)))
                yield pa.RecordBatch.from_arrays([id_, pa.array(h.view("i8")), pa.array(w.astype("f4"))], names=["id", "shingle", "w"])

    return texts.join(ids, "id", "left_semi").select("id", "norm").mapInArrow(spell, "id long, shingle long, w float")


def alone(ids: DataFrame, texts: DataFrame, weights, cfg: Config) -> DataFrame:
    """``id, own``: for each of the ids the weight of its shingles that no other of them has."""
    one = spelled(ids, texts, weights, cfg).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("w").alias("w")).where("n = 1")
    # rounded down a little: single precision must not make an own part larger than it is
    total = one.groupBy("id").agg((F.sum(F.col("w").cast("double")) * (1 - 1e-6)).alias("own"))
    return ids.join(total, "id", "left").select("id", F.coalesce("own", F.lit(0.0)).alias("own"))


def rare_pairs(rows: DataFrame, texts: DataFrame, weights, cfg: Config, scratch: Scratch) -> DataFrame:
    """Of ``rows(id, size, own, root)`` the pairs ``a, b`` of different roots that can be similar, by prefixes of rare shingles.

    Let all shingles be ordered by the number of these rows that have them, rare ones first. Of two texts of sizes ``a <= b`` that are similar, what they have in
    common weighs at least ``2 t / (1 + t)`` times ``a`` and ``t`` times ``b``; so the first shingle that both have comes, in each of them,
    before more than the rest of its weight is over. Only shingles that early are joined; what many texts share is not among them
    unless they share nearly all. In the group of a shingle nothing is compared within the root that most of its rows have."""
    t = cfg.threshold
    each = scratch.written(spelled(rows.select("id"), texts, weights, cfg), "spelled")
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    order = W.partitionBy("id").orderBy("n", "shingle").rowsBetween(W.unboundedPreceding, -1)  # within one text
    before = each.join(common.hint("merge"), "shingle").withColumn("before", F.coalesce(F.sum(F.col("w").cast("double")).over(order), F.lit(0.0)))
    early = before.join(rows.hint("merge"), "id").withColumn("before", (F.col("own") + F.col("before")) * (1 - 1e-6)).where(F.col("before") <= (1 - t) * F.col("size"))
    early = early.select("shingle", "id", "size", "root", (F.col("size") - F.col("before")).alias("left"), (F.col("before") <= (1 - 2 * t / (1 + t)) * F.col("size")).alias("first"))
    early = scratch.written(early, "early")
    by_root = early.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    main = by_root.groupBy("shingle").agg(F.max_by("root", "n").alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("shingle", "main")
    early = early.join(main.hint("merge"), "shingle").withColumn("inside", F.col("root") == F.col("main")).drop("main")
    out = early.where("NOT inside").drop("inside")
    other = early.select("shingle", *(F.col(c).alias(f"b_{c}") for c in ("id", "size", "root", "left", "first", "inside")))
    smaller = F.struct("size", "id") < F.struct("b_size", "b_id")
    can = (F.col("root") != F.col("b_root")) & (F.col("b_inside") | (F.col("id") < F.col("b_id"))) & F.when(smaller, F.col("first")).otherwise(F.col("b_first"))
    # At the first shingle that both have, all they can have in common is still to come.
    enough = F.least("left", "b_left") * (1 + 1e-6) >= t / (1 + t) * (F.col("size") + F.col("b_size"))
    return out.join(other.hint("merge"), "shingle").where(can & enough).select(F.least("id", "b_id").alias("a"), F.greatest("id", "b_id").alias("b")).distinct()
