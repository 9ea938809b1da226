"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from kerfline.llm import periodic, queries

RNG = random.Random(8)
DATA = "/root/testdata/sf0.001"


def brute(words, least=24):
    """Every maximal stretch of its smallest period, from the places where words ``p`` apart agree."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 3 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def folded(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(kind):
    if kind == 0:
        return RNG.choices("ab", k=RNG.randint(0, 90))
    if kind == 1:
        p = RNG.randint(1, 40)
        part = RNG.choices("abcdefgh", k=p)
        body = [part[i % p] for i in range(RNG.randint(p, 6 * p))]
        return RNG.choices("abcxyz", k=RNG.randint(0, 30)) + body + RNG.choices("abcxyz", k=RNG.randint(0, 30))
    if kind == 2:
        return ["a"] * RNG.randint(20, 60)
    one = ["p", "q"] * RNG.randint(10, 20) + ["r"]
    return one * RNG.randint(1, 6) + made(1)


def test_runs_of_random_words():
    grid = periodic.Grid(100)
    texts = [made(i % 4) for i in range(600)]
    got = periodic.runs_in([[w.encode() for w in t] for t in texts], grid)
    for t, rows in zip(texts, got, strict=True):
        assert [tuple(r) for r in rows.tolist()] == brute(t), t
        assert periodic.collapsed([w.encode() for w in t], rows).decode() == folded(t, brute(t))
    assert sum(len(r) > 1 for r in got) > 20
    assert sum(len(t) > 100 for t in texts) > 20  # beyond the table of grid points


def test_grid_table_and_strides_agree():
    w = np.array(RNG.choices(range(3), k=400), "i4")
    long, short = periodic.Grid(400), periodic.Grid(10)
    pairs = lambda g: sorted(zip(*(x.tolist() for x in g.candidates(w)), strict=True))
    assert pairs(long) == pairs(short)


def test_extensions_equal_counting():
    s = np.array(RNG.choices(range(2), k=300) + [7])
    e = periodic.Extensions(s)
    x = np.array([RNG.randrange(300) for _ in range(500)])
    y = np.array([(a + RNG.randrange(1, 300)) % 301 for a in x])
    want = []
    for a, b in zip(x, y, strict=True):
        k = 0
        while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        want.append(k)
    assert e.of(x, y).tolist() == want


def expected(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(folded(words, runs)))


def test_query_equals_brute_force(spark):
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, DATA).collect())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(expected(*r) for r in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    path = str(tmp_path)
    more = spark.createDataFrame([(9, "x y " * 30, "en", "a", 1, "runs", "z"), (10, "x y " * 30, "en", "a", 1, "runs", "z"), (10, "x y " * 30, "en", "a", 1, "runs", "z")], odd_docs.schema)
    odd_docs.unionByName(more).withColumn("runs", F.lit("other")).withColumn("collapsed", F.lit(1)).write.parquet(f"{path}/documents.parquet")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, path).collect()), key=key)
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted((expected(*r) for r in docs), key=key)
    assert periodic.find(no_docs).count() == 0
    kept = periodic.find(spark.read.parquet(f"{path}/documents.parquet"), keep=("score", "n_chars", "doc_id")).collect()
    assert len(kept) == len(docs) and kept[0].asDict().keys() == {"score", "n_chars", "doc_id", "runs", "collapsed"}
