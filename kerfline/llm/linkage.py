"""From shared keys to connected groups, without all pairs of a key's members.

``link`` goes in rounds over the members of each key. First each is compared with the key's first member. Of keys
that still hold more than one component, each member is then compared with the most central one, if members have own sizes; without them that is the first one again. What is left are members of
keys with components apart. Where ``rare`` can say so, those of them are compared that can be similar at all (a filter on rare parts, see
``near_dup.rare_pairs``); else what lies outside the first one's component with all members of the key outside its own, as far as marks of the two leave it possible. What is never compared is a pair
that lies in one component already, or one that a bound rules out, so groups are those of all pairs that share a key.

The bound: a member's ``own`` size is what no other compared member has. Two members have in common at most the smaller
rest, so their similarity, common over all, can be told to stay below the threshold. A member whose own part
alone is too large is alone.

Components come from alternating large-star and small-star steps over edge tables; no node's neighbours and no
component ever meet in one task as a list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerfline.llm.common import Scratch

PARTS, EACH = 64, 1024  # most parts of a key in the last round, members outside its main component to a part


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads straight to a root: no node has two edges down, or one both ways."""
    ends = edges.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("lo").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by_node = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by_node.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch | None = None, rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``id, root``: root is the least id of the component. Ids without an edge do not appear."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    now = scratch.written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    for _ in range(rounds):
        if _settled(now):
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        before, least = now, scratch.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        now = scratch.written(large.where(F.col("hi") != F.col("lo")).distinct(), "large")
        scratch.drop(before, least)
        down = now.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        least = scratch.written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = down.join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        now = scratch.written(small.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).where(F.col("hi") != F.col("lo")).distinct(), "small")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("root"))).distinct()


def joined(roots: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Components ``id, root`` with further edges put in: only roots and new ids go through the rounds again."""
    end = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    tops = edges.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    tops = scratch.written(tops.where(F.col("a") != F.col("b")).distinct(), "tops")
    if tops.isEmpty():
        return roots
    over = scratch.written(components(tops, scratch), "over")
    moved = roots.join(over.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return scratch.written(moved.unionByName(over.join(roots.select("id"), "id", "left_anti").select("id", "root")), "roots")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``root`` of each row's id, itself where it has no edge."""
    return rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def link(members: DataFrame | list[DataFrame], fetch: Callable, verify: Callable, own: Callable | None, threshold: float, scratch: Scratch, rare: Callable | None = None, marks: Callable | None = None, possible: Callable | None = None) -> DataFrame:
    """``members(key, id, size)`` with numbers for ids, at most one row a key and id, to the components ``id, root`` of similar ids.
    A list of tables that have no key in common is taken table by table, so that no more than one of them is shuffled at a time.

    ``fetch(ids)`` gets what is to be compared, once for all ids that share a key with another. ``verify(pairs, what)``
    returns those of the pairs ``(a, b)`` that are similar, ``own(ids, what)`` each id's ``own`` size among these ids,
    ``rare(rows, what)`` the pairs of ``rows(id, size, own, root)`` with different roots that can be similar. Similarity is at most what two have in common over all they have.
    Without ``own`` and ``rare`` it is at most the smaller size over the larger, and ``possible(x, y)`` says of two members, whose columns of ``marks(what)``, rows of ``id`` and columns without nulls,
    ``x`` and ``y`` give by name, whether they can be similar."""
    held = None
    for some in members if isinstance(members, list) else [members]:
        heads = scratch.written(some.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head"), F.min_by("size", "id").alias("head_size")).where("n > 1").drop("n"), "heads")
        part = scratch.written(some.join(heads.hint("merge"), "key"), "held")
        scratch.drop(heads)
        held, parts = (part, [part]) if held is None else (held.unionByName(part), [*parts, part])
    what = fetch(held.select("id").distinct())
    near = F.least("size", "head_size") >= threshold * F.greatest("size", "head_size")
    first = scratch.written(held.where((F.col("id") != F.col("head")) & near).select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    roots = scratch.written(components(scratch.written(verify(first, what).select("a", "b"), "links"), scratch), "roots")
    if own is None:
        return _apart(held, parts, first, roots, what, verify, threshold, scratch, marks, possible)
    scratch.drop(first)

    # Keys with more than one component.
    placed = scratch.written(_rooted(held.select("key", "id", "size"), roots), "placed")
    split = scratch.written(placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key"), "split-keys")
    rest = scratch.written(placed.join(split, "key", "left_semi"), "rest")
    rest = rest.join(scratch.written(own(rest.select("id").distinct(), what), "own"), "id").where(F.col("own") <= (1 - threshold) * F.col("size"))
    rest = scratch.written(rest, "rest")
    scratch.drop(placed, split, *parts)
    central = scratch.written(rest.groupBy("key").agg(F.min(F.struct((F.col("own") / F.greatest("size", F.lit(1e-12))).alias("share"), "id", "size", "own", "root")).alias("h")), "central")
    beside = rest.join(central, "key").where((F.col("root") != F.col("h.root")) & _possible("size", "own", "h.size", "h.own", threshold))
    second = scratch.written(beside.select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b")).distinct(), "pairs")
    roots = joined(roots, scratch.written(verify(second, what).select("a", "b"), "links"), scratch)
    scratch.drop(second)
    apart = _rooted(rest.select("id", "size", "own").distinct(), roots)
    return joined(roots, scratch.written(verify(scratch.written(rare(scratch.written(apart, "apart"), what), "pairs"), what).select("a", "b"), "links"), scratch)


def _apart(held: DataFrame, parts: list[DataFrame], first: DataFrame, roots: DataFrame, what, verify: Callable, threshold: float, scratch: Scratch, marks: Callable, possible: Callable) -> DataFrame:
    """The last round without own sizes: members outside the component of their key's first one with all others of the key but the first, with which they have been compared. The members outside
    are dealt to ``PARTS`` at most for a key of many, so that a large key is not one task's; what a task holds at a time are the marks of one key's members, which Spark spills."""
    of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    placed = held.join(of("id"), "id", "left").join(of("head"), "head", "left").withColumn("root", F.coalesce("id_root", "id"))
    placed = placed.select("key", "id", "size", "root", (F.col("root") == F.coalesce("head_root", "head")).alias("main"), (F.col("id") == F.col("head")).alias("tested"))
    placed = scratch.written(placed, "placed")
    scratch.drop(*parts)
    dealt = placed.where("NOT main").groupBy("key").agg(F.least(F.lit(PARTS), F.ceil(F.count(F.lit(1)) / EACH)).cast("int").alias("parts"))
    there = placed.join(scratch.written(dealt, "dealt").hint("merge"), "key").where("NOT tested").drop("tested")
    there = scratch.written(there.join(marks(what).hint("merge"), "id"), "there")
    scratch.drop(placed)
    # Read back, all columns may be null; checks for that would make the join's code too long to be compiled.
    there = there.select("key", "parts", *(F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in there.dtypes if c not in ("key", "parts")))
    each = there.columns[2:]
    out = there.where("NOT main").select("key", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), *each)
    other = there.select("key", F.explode_outer(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"b_{c}") for c in each))
    near = F.least("size", "b_size") >= threshold * F.greatest("size", "b_size")
    met = out.join(other, ["key", "part"]).where((F.col("root") != F.col("b_root")) & (F.col("b_main") | (F.col("id") < F.col("b_id"))) & near & possible(F.col, lambda c: F.col(f"b_{c}")))
    met = met.select(F.least("id", "b_id").alias("a"), F.greatest("id", "b_id").alias("b")).distinct()
    # Each pair once.
    more = scratch.written(met.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).hint("merge"), ["a", "b"], "left_anti"), "pairs")
    scratch.drop(there, first)
    return joined(roots, scratch.written(verify(more, what).select("a", "b"), "links"), scratch)


def _possible(size: str, own: str, other: str, other_own: str, threshold: float):
    """Whether two members can be similar at all. Sums are compared with a little room, as they are rounded."""
    a, b = F.col(size), F.col(other)
    common = F.least(a - F.col(own), b - F.col(other_own))
    return common * (1 + 1e-9) >= threshold / (1 + threshold) * (a + b)
