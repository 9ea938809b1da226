"""Spelling variants by a symmetric-delete join.

Words are runs of Latin letters, counted over the whole corpus. Every word emits itself and its distinct single deletions; words that
share a key are paired, and a pair stays if its edit distance is exactly one. A word's form is the most frequent of its near words if that is
``times`` as frequent as the word; following forms to the last gives its root, by joining the table of roots with itself until no root has one, so
that the way is halved in each round.

A key holds no more words than there are ways to put one letter into it: with ``n`` letters at most ``90 * (n + 1) + 1``, however large the
corpus is. So no key, and no form, is hot beyond a bound that only the alphabet sets.

Defined results: null and empty texts have no words; texts and words may be of any length; repeated rows count each for
itself; ids and other columns are not read; ties between forms go to the first in code-point order; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerfline.llm.common import Scratch, text_or_empty

LETTERS = 6  # of a word at least
OFTEN, TIMES = 5, 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(run: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, UPPER.lower()))


def runs_of(docs: DataFrame, keep: tuple[str, ...] = (), letters: int = LETTERS) -> DataFrame:
    """``keep..., run``: the maximal runs of at least ``letters`` letters, in lower case. A run that is long enough is matched whole, from its first letter."""
    found = F.regexp_extract_all(text_or_empty(), F.lit(rf"[A-Za-zÀ-ÿ]{{{letters},}}"), F.lit(0))
    # An outer explosion: for another Spark puts the whole array into a filter, and so makes it twice.
    each = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.explode_outer(found).alias("run")).where("run IS NOT NULL")
    return each.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), lowered(F.col("run")).alias("run"))


def counted(runs: DataFrame, letters: int = LETTERS, often: int = OFTEN) -> DataFrame:
    """``word, n`` from ``runs(run)``."""
    return runs.where(F.length("run") >= letters).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


def near(words: DataFrame) -> DataFrame:
    """``a, b, na, nb``: the pairs ``a < b`` of ``words(word, n)`` at edit distance one, each once."""
    deletions = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1)))
    keys = words.select("word", "n", F.explode(F.array_distinct(F.array_append(deletions, F.col("word")))).alias("key")).withColumn("key", F.xxhash64("key"))
    left, right = (keys.select("key", F.col("word").alias(c), F.col("n").alias(f"n{c}")) for c in ("a", "b"))
    return left.join(right.hint("merge"), "key").where("a < b AND levenshtein(a, b, 1) = 1").select("a", "b", "na", "nb").dropDuplicates(["a", "b"])


def rooted(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` from ``links(word, form)`` that lead upwards, never round."""
    now = scratch.written(links.select("word", F.col("form").alias("root")), "links")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("top"))
        if now.join(up.hint("merge"), "root", "left_semi").isEmpty():
            return now
        before, now = now, scratch.written(now.join(up.hint("merge"), "root", "left").select("word", F.coalesce("top", "root").alias("root")), "links")
        scratch.drop(before)


def grouped(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of ``words(word, n)``."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.written(words, "words")
    pairs = scratch.written(near(words), "near")
    ends = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    formed = words.join(best.hint("merge"), "word", "left").withColumn("often", -F.col("best.less") >= times * F.col("n"))
    formed = scratch.written(
        formed.select("word", F.expr("CASE WHEN often THEN best.other END").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.expr("CASE WHEN often THEN -best.less END").alias("form_n")), "formed"
    )
    roots = rooted(formed.where("form IS NOT NULL"), scratch)
    scratch.keep(formed, roots)
    return formed.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """Words of ``docs(text)`` with their forms and roots."""
    return grouped(counted(runs_of(docs)))
