"""Exact, line and near deduplication."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerfline.llm import exact_dedup, linkage, line_dedup, near_dup
from kerfline.llm.common import Scratch, written

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def words(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def test_exact_groups(odd_docs):
    got = exact_dedup.exact_dedup(odd_docs).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(hashlib.sha256(re.sub("[ \t-\r]+", " ", t or "").encode()).hexdigest(), []).append(d)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
        assert r.doc_id == r.keep_id or not r.kept
    for digest in groups:
        assert sum(r.kept for r in got if r.text_sha256 == digest) == 1


def test_exact_index_persists_over_batches(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    one = spark.createDataFrame([(5, "same text"), (6, "other")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "same  text"), (2, "new")], "doc_id long, text string")
    exact_dedup.exact_dedup(one, path, 4).count()
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(two, path, 4).collect()}
    assert got == {1: (5, False), 2: (2, True)}
    assert spark.read.parquet(path).count() == 3


def test_exact_of_nothing(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_components_of_random_graphs(spark):
    n, edges = 60, [(RNG.randrange(60), RNG.randrange(60)) for _ in range(45)]
    root = list(range(n))
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in linkage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root[i] for e in edges for i in e if e[0] != e[1]} | {i: r for i, r in got.items() if root[i] == r}


def sketched(docs):
    nodes = written(line_dedup.nodes_of(line_dedup.lines_of(docs)), "nodes")
    return line_dedup.hashed(nodes, Scratch(docs.sparkSession, "test")).join(nodes.select("node", "norm"), "node").collect()


def test_lines_exact_and_near(spark):
    base = " ".join(words(60))
    typo = base[:100] + ("x" if base[100] != "x" else "y") + base[101:]
    other = " ".join(words(60))
    docs = spark.createDataFrame([(1, f"{base}\n{other}\n---"), (2, f"{typo}\nfresh line of its own here\n---"), (3, f"{other.upper()}!\n{base}"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.text is None): r.text for r in line_dedup.dedup(docs).collect()}
    assert got[(1, False)] == f"{base}\n{other}\n---"
    assert got[(3, False)] == ""
    assert got[(3, True)] is None
    assert got[(2, False)].endswith("fresh line of its own here\n---")


def test_all_line_pairs_within_two_bits_are_linked(spark):
    lines = []
    for _ in range(25):
        line = words(40)
        lines += [" ".join(line), " ".join([*line[:20], RNG.choice(WORDS), *line[21:]])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    place = {t: i for i, t in enumerate(lines)}
    sim = {place[r.norm]: r.sim for r in sketched(docs)}
    kept = {r.doc_id for r in line_dedup.dedup(docs).collect() if r.dropped == 0}
    root = {i: i for i in sim}
    for i in sim:
        for j in range(i):
            a, b = lines[i], lines[j]
            if ((sim[i] ^ sim[j]) & (1 << 64) - 1).bit_count() <= 2 and 1 - edit(a, b) / max(len(a), len(b)) >= line_dedup.SIMILAR:
                x, y = root[i], root[j]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert kept <= set(root.values())


def test_recall_of_similar_lines_against_all_pairs(spark):
    rng, lines, made = random.Random(11), [], {}
    for n, changed in ((8, 1), (10, 1), (14, 1), (20, 1), (20, 2), (40, 4)):
        for _ in range(30):
            line = [rng.choice(WORDS) for _ in range(n)]
            other = list(line)
            for i in rng.sample(range(n), changed):
                other[i] = rng.choice(WORDS)
            made.setdefault((n, changed), []).append(len(lines))
            lines += [" ".join(line), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    dropped = {r.doc_id for r in line_dedup.dedup(docs).collect() if r.dropped}
    alike = lambda i, j: 1 - edit(lines[i], lines[j]) / max(len(lines[i]), len(lines[j])) >= line_dedup.SIMILAR
    for case, firsts in made.items():
        pairs = [i for i in firsts if alike(i, i + 1)]
        assert sum(i + 1 in dropped for i in pairs) >= 0.9 * len(pairs), (case, len(pairs))
    near = lambda i, j: abs(len(lines[i]) - len(lines[j])) <= 0.2 * max(len(lines[i]), len(lines[j]))
    for i in sorted(dropped):
        assert any(near(i, j) and alike(i, j) for j in (i - 1, *range(len(lines))) if j != i)


def test_marks_outside_ascii_separate_words(spark):
    plain = 'it said "stop here" and then - nothing at all'
    curly = "it said \u201cstop here\u201d and then \u2014 nothing\u00a0at all"
    rows = [(1, f"{plain}\n\u2014\u2014\u2014"), (2, f"{curly}\n\u2014\u2014\u2014")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert docs.select(line_dedup.normal_form(docs["text"]).alias("n")).distinct().count() == 1
    assert docs.select(near_dup.normal_form().alias("n")).distinct().collect()[0].n == "it said stop here and then nothing at all"
    assert line_dedup.lines_of(docs).select("norm").distinct().count() == 1  # the rules are no content


def test_longest_lines_have_a_simhash(spark):
    line = "ab " * 530_000
    docs = spark.createDataFrame([(1, line + "one end"), (2, line + "two end")], "doc_id long, text string")
    word = spark.sql("SELECT xxhash64('ab') AS x").collect()[0].x
    assert [r.sim for r in sketched(docs)] == [word, word]


def test_lines_odd_rows(odd_docs, no_docs):
    got = line_dedup.dedup(odd_docs, keep=("doc_id", "kept", "score")).collect()
    assert len(got) == odd_docs.count()
    assert [r.text for r in got if r.doc_id == 6] == [" \n \n"]
    assert line_dedup.dedup(no_docs).count() == 0


def jaccard(a, b, weights):
    return near_dup.similarity(near_dup.shingles(a, weights, 5), near_dup.shingles(b, weights, 5))


def test_near_classes_equal_brute_force(spark):
    texts = []
    for _ in range(12):
        base = words(120)
        texts.append(base)
        for edits in (1, 2, 3, 5, 8):
            t = list(base)
            for _ in range(edits):
                t[RNG.randrange(len(t))] = RNG.choice(WORDS)
            texts.append(t)
    texts += [words(3), words(3), words(40), []]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    norm = docs.select(near_dup.normal_form().alias("norm"))
    weights = near_dup.frequent(near_dup.counted(norm), len(texts), near_dup.Config())
    root = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard(a, texts[j], weights) >= 0.8:
                x, y = root[i], root[j]
                root = [min(x, y) if v in (x, y) else v for v in root]
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    assert got == dict(enumerate(root))


def test_weights_of_words_depend_on_their_share_only():
    at = lambda df, n: near_dup.Weights(near_dup.word_hashes("a"), near_dup.np.array([df]), n, 1024).of(near_dup.word_hashes("a b"))
    assert near_dup.np.allclose(at(10, 10), [1, 2]) and near_dup.np.allclose(at(1, 32), [1.5, 2])
    assert near_dup.np.allclose(at(100, 3200), at(1, 32)) and near_dup.np.allclose(at(1, 5000), [2, 2])


def test_too_many_frequent_words_are_told(spark):
    by_word = spark.createDataFrame([(i, 3) for i in range(20)], "word long, n long")
    with pytest.raises(ValueError, match="rarest"):
        near_dup.frequent(by_word, 3, near_dup.Config(most_words=10))
    assert len(near_dup.frequent(by_word, 3, near_dup.Config()).hashes) == 20 and len(near_dup.frequent(by_word, 30_000, near_dup.Config()).hashes) == 0


def test_texts_that_share_a_passage_make_few_pairs(spark):
    """Copies of a passage with own words around it share keys, but only those that are similar may be joined."""
    passage, rng = [f"p{i}" for i in range(45)], random.Random(2)
    counted = []
    for n in (60, 240):
        texts = [" ".join([*passage, *(f"o{rng.randrange(1 << 30)}" for _ in range(20))]) for _ in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = docs.select(F.col("doc_id").alias("id"), F.lit(61.0 * 2).alias("size"), F.lit(0.0).alias("own"), F.col("doc_id").alias("root"))
        weights = spark.sparkContext.broadcast(near_dup.Weights(near_dup.np.zeros(0, "u8"), near_dup.np.zeros(0, "i8"), n, 1024))
        own = near_dup.alone(rows.select("id"), docs.select(F.col("doc_id").alias("id"), F.col("text").alias("norm")), weights, near_dup.Config())
        rows = rows.drop("own").join(own, "id")
        counted.append(near_dup.rare_pairs(rows, docs.select(F.col("doc_id").alias("id"), F.col("text").alias("norm")), weights, near_dup.Config(), Scratch(spark, "test")).count())
    assert counted == [0, 0]


def test_sample_agreement_estimates_weighted_jaccard():
    weights = near_dup.Weights(near_dup.word_hashes("a b"), near_dup.np.array([3, 2]), 10, 1024)
    sampler = near_dup.Sampler(near_dup.Config(bands=600, rows=1))
    base = words(300)
    other = [*base[:250], *words(50)]
    a, b = (near_dup.shingles(" ".join(t), weights, 5) for t in (base, other))
    agree = (sampler.keys(*a) == sampler.keys(*b)).mean()
    assert abs(agree - near_dup.similarity(a, b)) < 0.07


def test_near_odd_rows(odd_docs, no_docs):
    got = near_dup.classes(odd_docs.select("doc_id", "text")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == odd_docs.count()
    assert by[1].class_id == by[2].class_id == 1 and by[1].class_size == 3
    assert by[3].class_id == by[4].class_id == by[6].class_id == 3
    assert by[None].class_id is None and by[None].kept
    assert near_dup.classes(no_docs.select("doc_id", "text")).count() == 0


def distance(a, b):
    """Edit distance by bit-parallel columns."""
    at = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask, top, pv, mv, d = (1 << len(a)) - 1, 1 << (len(a) - 1), (1 << len(a)) - 1, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        d += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & mask, (mh << 1) & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
    return d


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_recall_on_the_given_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark, "test")
    nodes = scratch.written(line_dedup.nodes_of(line_dedup.lines_of(docs)), "nodes")
    roots = scratch.written(line_dedup.groups_of(nodes, line_dedup.SIMILAR, scratch), "roots")
    of = {r.norm: r.root for r in nodes.join(roots, "node").collect()}
    lines = sorted(of, key=len)
    size = np.array([len(x) for x in lines])
    pairs = {}
    rows = [[pairs.setdefault(x[i : i + 2], len(pairs)) for i in range(len(x) - 1)] for x in lines]
    bags = np.zeros((len(lines), len(pairs)), "u2")
    for i, r in enumerate(rows):
        np.add.at(bags[i], r, 1)
    near = []
    for i, x in enumerate(lines):
        others = np.arange(i + 1, np.searchsorted(size, size[i] / line_dedup.SIMILAR + 1e-9, "right"))
        longer = size[others]
        # an edit takes at most two pairs of characters away
        can = others[np.minimum(bags[i], bags[others]).sum(1, dtype="i8") >= longer - 1 - 2 * np.floor(0.2 * longer + 1e-9)]
        near += [(x, lines[j]) for j in can if distance(x, lines[j]) <= 0.2 * size[j] + 1e-9]
    assert len(near) > 20
    assert sum(of[a] == of[b] for a, b in near) >= 0.95 * len(near)
