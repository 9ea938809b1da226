r"""Secret scan through a trigram inverted index.

From each rule's regular expression a Boolean query over lower-case trigrams is derived, kept as a union of
clauses: a text can only match if it holds every trigram of one clause. Posting lists ``(trigram, doc_id)``
are made for the trigrams that the rules ask for (or any list of trigrams), intersected clause by clause, and
the documents left are verified with the expressions themselves. Rules without a mandatory trigram scan all.

Spans are counted in code points, end exclusive. Positions come from the lengths of the pieces between matches
and of the matches, so all of it stays in SQL functions.

Defined results: a null text counts as empty and has no spans; rows that repeat an id are scanned each for
itself; a null id is an id; texts may be of any length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerfline.llm.common import text_or_empty


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; those with fewer than ``least`` characters in ``group`` are dropped."""

    kind: str
    pattern: str
    group: int
    least: int


# Fixed values of the contract: the three base rules.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the same spans as [0-9a-f]+ of 24 characters or more: runs are maximal
)
#: Further published token formats; their spans are added to the base ones.
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)

#: Most alternatives that a derivation follows at once; beyond, the query gets weaker, never wrong.
WIDE = 64
ANY = frozenset([frozenset()])


def _grams(s: str) -> frozenset:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _any_of(strings: set) -> frozenset:
    return _absorb({_grams(s) for s in strings})


def _absorb(clauses: set) -> frozenset:
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _both(a: frozenset, b: frozenset) -> frozenset:
    if len(a) * len(b) > WIDE:
        return a if a != ANY else b
    return _absorb({x | y for x in a for y in b})


def _exact(op, arg) -> set | None:
    """The strings an element stands for, if they are few."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        out: set = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                out.add(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is C.SUBPATTERN:
        return _exact_all(arg[-1])
    if op is C.BRANCH:
        parts = [_exact_all(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is C.MAX_REPEAT and arg[1] is not C.MAXREPEAT and arg[1] <= 8:
        one = _exact_all(arg[2])
        if one is None:
            return None
        runs, out = {""}, {""} if arg[0] == 0 else set()
        for n in range(1, arg[1] + 1):
            runs = {a + b for a in runs for b in one}
            if len(runs) > WIDE:
                return None
            out |= runs if n >= arg[0] else set()
        return out
    return None


def _exact_all(items) -> set | None:
    out = {""}
    for op, arg in items:
        one = _exact(op, arg)
        if one is None or len(out) * len(one) > WIDE:
            return None
        out = {a + b for a in out for b in one}
    return out


def _derive(items) -> frozenset:
    query, run = ANY, {""}
    for op, arg in items:
        one = _exact(op, arg)
        if one is not None and len(run) * len(one) <= WIDE:
            run = {a + b for a in run for b in one}
            continue
        query, run = _both(query, _any_of(run)), {""}
        if one is not None:
            run = one
        elif op is C.SUBPATTERN:
            query = _both(query, _derive(arg[-1]))
        elif op is C.BRANCH:
            query = _both(query, _absorb(set().union(*(_derive(p) for p in arg[1]))))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            query = _both(query, _derive(arg[2]))
    return _both(query, _any_of(run))


def trigram_query(pattern: str) -> list[list[str]]:
    """Clauses of trigrams; a text that matches holds all of one clause. One empty clause: no trigram is mandatory."""
    return sorted(sorted(c) for c in _derive(_parser.parse(pattern)))


def mark() -> Column:
    """What postings name a document by: a hash of id and text, so that rows without an id do not meet. Rows that share one are verified, whichever was meant."""
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """``mark, trigram``: the posting lists of the given trigrams, over lower-case texts."""
    low = docs.select(mark().alias("mark"), F.lower(text_or_empty()).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("mark", F.explode(held).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``mark, kinds``: for each document that can match, the kinds of the rules to verify."""
    clauses = [(r.kind, n, c) for r in rules for n, c in enumerate(trigram_query(r.pattern)) if c]
    wanted = sorted({t for _, _, c in clauses for t in c})
    asked = docs.sparkSession.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(t).alias("trigram"), F.lit(kind).alias("kind"), F.lit(n).alias("clause"), F.lit(1 << i).alias("bit"), F.lit((1 << len(c)) - 1).alias("all"))
        for kind, n, c in clauses for i, t in enumerate(c)
    ))))
    # The rule table is as large as the rules, whatever the corpus.
    met = postings(docs, wanted).join(F.broadcast(asked), "trigram").groupBy("mark", "kind", "clause", "all").agg(F.bit_or("bit").alias("got"))
    return met.where(F.col("got") == F.col("all")).groupBy("mark").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, rank: int, text: Column, apply: Column) -> tuple[Column, Column, Column]:
    """Matches, the part that is measured, and the pieces between; null where the rule does not apply."""
    find = F.lit(rule.pattern)
    return (
        F.when(apply, F.regexp_extract_all(text, find, F.lit(0))),
        F.when(apply, F.regexp_extract_all(text, find, F.lit(rule.group))),
        F.when(apply, F.split(text, rule.pattern, -1)),
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``docs(doc_id, text)`` to one row a document: doc_id and ``found``, an array of (start, rank, kind, end)."""
    pairs = docs.select("doc_id", text_or_empty().alias("text"), mark().alias("mark"))
    free = {r.kind for r in rules if trigram_query(r.pattern) == [[]]}
    both = pairs.join(candidates(docs, rules), "mark", "left")
    parts = ["doc_id"]
    for rank, r in enumerate(rules):
        apply = F.col("text").rlike(r.pattern) if r.kind in free else F.coalesce(F.array_contains("kinds", r.kind), F.lit(False))
        parts += [c.alias(f"{name}{rank}") for name, c in zip(("whole", "part", "gap"), _spans(r, rank, F.col("text"), apply), strict=True)]
    cut = both.select(*parts)
    found = F.concat(*(F.coalesce(_placed(rank, r), F.array().cast(SPANS)) for rank, r in enumerate(rules)))
    return cut.select("doc_id", F.array_sort(found).alias("found"))


SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


#: Matches placed in one go; their spans are then put to those before.
BLOCK = 256


def _placed(rank: int, r: Rule) -> Column:
    """Spans of one rule's matches, by adding up the lengths of matches and of the pieces between. Blocks keep the time for many matches in one text in proportion."""
    whole, part, gap = f"whole{rank}", f"part{rank}", f"gap{rank}"
    span = f"named_struct('start', s.at + length({gap}[i]), 'rank', {rank}, 'kind', '{r.kind}', 'end', s.at + length({gap}[i]) + length({whole}[i]))"
    block = (
        f"aggregate(sequence(b * {BLOCK}, least(size({whole}), (b + 1) * {BLOCK}) - 1), named_struct('at', o.at, 'out', cast(array() AS {SPANS})), (s, i) -> named_struct("
        f"'at', s.at + length({gap}[i]) + length({whole}[i]), 'out', CASE WHEN length({part}[i]) >= {r.least} THEN array_append(s.out, {span}) ELSE s.out END))"
    )
    return F.when(F.size(whole) > 0, F.expr(
        f"filter(flatten(aggregate(sequence(0, CAST((size({whole}) - 1) DIV {BLOCK} AS INT)), named_struct('at', 0L, 'out', cast(array() AS array<{SPANS}>)), "
        f"(o, b) -> transform(array({block}), d -> named_struct('at', d.at, 'out', array_append(o.out, d.out)))[0], o -> o.out)), x -> x.end > x.start)"
    ))


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def base_only(found: Column, rules: tuple[Rule, ...] = BASE_RULES) -> Column:
    return F.filter(found, lambda x: x["rank"] < len(rules))
