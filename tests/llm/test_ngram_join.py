"""N-gram Jaccard join against brute force over all pairs."""

import random
import re

import pytest

from kerfline.llm import ngram_join

RNG = random.Random(21)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 6))) for _ in range(300)]


def grams(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                root[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(d)
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(((d, len(sets[i]), min((x for x in ids[top(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=key)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def words(n):
    return RNG.choices(WORDS, k=n)


def edited(w, k):
    w = list(w)
    for _ in range(k):
        w[RNG.randrange(len(w))] = RNG.choice(WORDS)
    return w


@pytest.mark.parametrize("longest", [12, 120, 600])
def test_copies_at_all_distances(spark, longest):
    texts = []
    for _ in range(12):
        base = words(RNG.randint(1, longest))
        at = base
        for _ in range(8):
            texts.append(" ".join(edited(base, RNG.randint(0, 1 + len(base) // 25))))
            at = edited(at, 1 + len(at) // 60)  # a chain that drifts away
            texts.append(" ".join(at))
            cut = at[RNG.randint(0, len(at) // 6) :]
            texts.append("\t ".join(cut).upper())
    passage = words(60)  # shared by many that are not alike, in all proportions
    for _ in range(60):
        texts.append(" ".join(words(RNG.randint(0, 60)) + passage + words(RNG.randint(0, 30))))
    texts += [texts[3]] * 20
    rows = list(enumerate(texts))
    RNG.shuffle(rows)
    want = brute(rows)
    assert result(ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert len({r[2] for r in want}) < len(rows) - 60


def test_bounds_are_the_least_that_link():
    for a in range(1, 300):
        partners = [(b, i) for b in range(1, 400) for i in (-(-4 * (a + b) // 9),) if i <= min(a, b)]
        assert min(i for _, i in partners) == ngram_join.least_overlap(a)
        assert min(ngram_join.slack(b) for b, _ in partners) == ngram_join.slack(ngram_join.least_overlap(a))


def test_odd_rows(spark, odd_docs, no_docs):
    long = spark.createDataFrame([(30, "a b " * 50_000), (31, "b a " * 50_000), (None, "a b " * 9), (32, "one two"), (33, " ONE\ntwo"), (34, "one two three four five"), (None, "solo"), (None, "solo")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(long)
    rows = [tuple(r) for r in docs.collect()]
    got = result(ngram_join.linked(odd_docs.unionByName(long, allowMissingColumns=True)))
    assert got == brute(rows)
    assert ngram_join.linked(no_docs).count() == 0
