"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from kerfline.llm import queries, spelling

RNG = random.Random(12)


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts, times=5):
    out = {}
    for w, n in counts.items():
        close = [v for v in counts if distance_one(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= times * n else None
        out[w] = [form, w, n, len(close), counts[form] if form else None]
    for w in out:
        at = w
        while out[at][0]:
            at = out[at][0]
        out[w][1] = at
    return {w: tuple(v) for w, v in out.items()}


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_random_words(spark):
    counts = Counter()
    for _ in range(250):
        counts["".join(RNG.choices("abcé", k=RNG.randint(6, 7)))] = RNG.choice([5, 6, 25, 26, 130, 700])
    counts |= {"aaaaaa": 9000, "aaaaaaaaaaaaaaaaaaaaaaaaa": 5, "aaaaaaaaaaaaaaaaaaaaaaaa": 25}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute(counts)
    assert result(spelling.grouped(words)) == want
    assert any(v[1] != v[0] and v[0] for v in want.values())  # roots beyond the form


def test_long_chain(spark):
    chain = {"b" * k + "a" * (20 - k): 5 ** (k + 1) for k in range(14)}
    got = result(spelling.grouped(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert got == brute(chain)
    assert {v[1] for v in got.values()} == {"b" * 13 + "a" * 7}


def test_runs_and_odd_rows(spark, odd_docs, no_docs):
    text = "Maximal RUNS of_Letters: ÀÉÎÕÜ× été-strasse Straßen ŒUVRES übermut\nübermut " * 5
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(20, text), (20, text), (21, "z" * 30_000)], "doc_id long, text string"))
    rows = docs.collect()
    lower = lambda r: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
    each = [(d, lower(r)) for d, t in rows for r in re.findall(r"[A-Za-zÀ-ÿ]+", t or "")]
    assert result(spelling.variants(docs)) == brute({w: n for w, n in Counter(r for _, r in each).items() if n >= 5 and len(w) >= 6})
    made = []
    for d, r in each:
        h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
        made.append(r if h % 199 else r[: h % len(r)] + r[h % len(r) + 1 :])
    got = Counter(r.run for r in queries.slipped(spelling.runs_of(docs, keep=("doc_id",))).collect() if len(r.run) >= 6)
    assert got == Counter(r for r in made if len(r) >= 6)
    assert spelling.variants(no_docs).count() == 0
