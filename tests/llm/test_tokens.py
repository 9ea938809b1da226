"""Mixing, search, tokenising and packing."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerfline.llm import mixing, packing, sentencepiece_fst, topk

RNG = random.Random(6)


def water(sizes, weights, share, cap):
    """Targets by repeated sharing."""
    total, full = share * sum(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        t = [cap * s if i in full else rest * weights[i] / w for i, s in enumerate(sizes)]
        more = {i for i in range(len(sizes)) if t[i] > cap * sizes[i] + 1e-9}
        if not more:
            return t
        full |= more
        if len(full) == len(sizes):
            return [cap * s for s in sizes]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 50, 3000], [0, 7, 900, 900, 20], [5]])
def test_targets(spark, sizes):
    s = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(s).collect()}
    want = water(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5, 2.0)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mix_takes_near_its_targets(spark):
    rows = [(i, "w " * RNG.randint(0, 60), RNG.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert len(got) == 3000 and all(0 <= r.copies <= 2 for r in got)
    assert {r.doc_id: r.size for r in got} == {i: len(t.split()) for i, t, _ in rows}
    for source in ("a", "b", "c", None):
        mine = [r for r in got if r.source == source]
        assert sum(r.copies * r.size for r in mine) == pytest.approx(mine[0].target, rel=0.03)


def test_mix_odd_rows(odd_docs, no_docs):
    assert mixing.mix(odd_docs).count() == odd_docs.count()
    assert mixing.mix(no_docs).count() == 0
    sizes = odd_docs.select("text", mixing.words().alias("n")).collect()
    assert all(r.n == len((r.text or "").split()) for r in sizes)


@pytest.mark.parametrize("scale", [1.0, 2e6])
def test_topk_equals_brute_force(spark, scale):
    g = np.random.default_rng(1)
    v = np.round(g.normal(size=(300, 6)) * 4) / 8
    v[50:80] = v[0]  # ties
    v *= scale
    rows = [(i, [float(x) for x in r], "x") for i, r in enumerate(v)] + [(900, None, None), (950, [1.0, None], "x"), (1000, [float("nan")] * 6, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = topk.search(df, F.col("vec_id") % 50 == 0, topk.Config(shard=40, block=3, lanes=3, leaf=8)).collect()
    q = [[int(x) for x in np.floor(r * 256)] for r in v]
    want = {}
    for a in range(0, 300, 50):
        scores = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), b) for b in range(300) if b != a)[:5]
        want |= {(a, r + 1): (b, -s) for r, (s, b) in enumerate(scores)}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == want


def test_topk_rows_that_repeat_an_id_have_none_or_other_lengths(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (7, [3.0, 0.0]), (None, [3.0, 0.0]), (None, [1.0, 1.0]), (50, [1.0, 1.0, 1.0]), (3, [1.0, 0.0, 0.0]), (100, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.query_id, r.rank, -1 if r.vec_id is None else r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()))
    u = 256 * 256
    one = [(0, 1, 7, 3 * u), (0, 2, -1, 3 * u), (0, 3, 0, 2 * u), (0, 4, -1, u)]  # of the first row, ties to the row with an id
    two = [(0, 1, 7, 6 * u), (0, 2, -1, 6 * u), (0, 3, 0, 2 * u), (0, 4, -1, 2 * u)]
    assert got == sorted([*one, *two, (50, 1, 3, u)])


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, F.col("vec_id") % 50 == 0).count() == 0


FST = sentencepiece_fst.Transducer(sentencepiece_fst.read_model())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" aeinorst\n\t▁é漢🙂1,<s>", max_size=60))
def test_pieces_equal_the_library(text):
    import sentencepiece

    global LIB
    LIB = globals().get("LIB") or sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    ids = FST.encode(text)
    assert ids == LIB.encode(text)
    assert FST.decode(ids) == LIB.decode(ids)


def test_pieces_round_trip(odd_docs, no_docs):
    rows = sentencepiece_fst.encode(odd_docs, keep=("doc_id", "score")).collect()
    assert len(rows) == odd_docs.count() and all(r.round_trip for r in rows)
    encoded = sentencepiece_fst.encode(odd_docs.select(F.monotonically_increasing_id().alias("doc_id"), "text"))
    texts = sorted(r.text for r in sentencepiece_fst.decode(encoded).collect())
    assert texts == sorted(r.text or "" for r in odd_docs.collect())
    assert sentencepiece_fst.encode(no_docs).count() == 0


def first_fit(lengths, room):
    rows, free = [], []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(f, r) for r, f in enumerate(free) if f >= lengths[item]]
        r = min(fits)[1] if fits else len(rows)
        if not fits:
            rows.append([])
            free.append(room)
        rows[r].append(item)
        free[r] -= lengths[item]
    return sorted(free)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 70).flatmap(lambda room: st.tuples(st.just(room), st.lists(st.integers(1, room), max_size=60))))
def test_packing_is_best_fit(case):
    room, lengths = case
    rows = packing.best_fit_decreasing(lengths, room)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert sorted(room - sum(lengths[i] for i in r) for r in rows) == first_fit(lengths, room)


def test_packed_rows_give_the_documents_back(odd_docs, no_docs):
    whole = [r for r in packing.pack(odd_docs, room=64, stretch=3).collect()]
    assert sum(d is None and s == 0 for r in whole for d, s in zip(r.doc_ids, r.doc_starts, strict=True)) == 1
    assert sum(d == 2 and s == 0 for r in whole for d, s in zip(r.doc_ids, r.doc_starts, strict=True)) == 2
    docs = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = packing.pack(docs, room=64, stretch=3).collect()
    coder = packing.encoding(open(packing.VOCABULARY, "rb").read())
    parts = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == r.n_tokens == r.cu_seqlens[-1] <= 64 and r.resets == r.cu_seqlens[:-1]
        for d, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            parts.setdefault(d, []).append((start, ids[a:b]))
    for r in docs.collect():
        if r.text:
            whole = np.concatenate([p for _, p in sorted(parts[r.doc_id], key=lambda x: x[0])]).tolist()
            assert whole[-1] == 50256 and coder.decode(whole[:-1]) == r.text
        else:
            assert r.doc_id not in parts
    ids, positions = packing.matrix(rows, 64)
    assert ids.shape == positions.shape == (len(rows), 64) and (positions[:, 0] == 0).all()
    assert packing.pack(no_docs).count() == 0


def test_packed_rows_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, "word " * RNG.randint(0, 90)) for i in range(500)], "doc_id long, text string")
    key = lambda r: (r.row_id, r.n_tokens, tuple(r.doc_ids), tuple(r.doc_starts))
    found = [sorted(map(key, packing.pack(docs.repartition(n), room=128, stretch=100).collect())) for n in (1, 5, 16)]
    assert found[0] == found[1] == found[2]
    assert sum(r[1] for r in found[0]) / (128 * len(found[0])) > 0.97


def _message(fields):
    """A protocol-buffer message of varints, strings and floats."""
    import struct

    def varint(n):
        out = b""
        while True:
            out, n = out + bytes([n & 127 | (128 if n > 127 else 0)]), n >> 7
            if not n:
                return out

    out = b""
    for number, v in fields:
        if isinstance(v, float):
            out += varint(number << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(number << 3) + varint(v)
        else:
            out += varint(number << 3 | 2) + varint(len(v)) + v
    return out


def test_unigram_path_is_the_shortest_of_all():
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.1, 1), ("▁a", -2.2, 1), ("bab", -4.5, 1), ("ba", -3.9, 1), ("abb", -4.0, 1)]
    model = b"".join(_message([(1, _message([(1, p.encode()), (2, s), (3, k)]))]) for p, s, k in pieces)
    model += _message([(2, _message([(3, 1)])), (3, _message([(3, 1), (4, 0), (5, 1)]))])
    fst = sentencepiece_fst.Transducer(model)
    score = {p.replace("▁", " "): s for p, s, k in pieces if k == 1}
    ids = {p.replace("▁", " "): i for i, (p, _, _) in enumerate(pieces)}

    def ways(text):
        if not text:
            yield 0.0, []
        for n in range(1, len(text) + 1):
            if text[:n] in score:
                for s, rest in ways(text[n:]):
                    yield s + score[text[:n]], [ids[text[:n]], *rest]

    for _ in range(200):
        text = "".join(RNG.choices("ab", k=RNG.randint(1, 9)))
        best = max(s for s, _ in ways(" " + text))
        got = fst.encode(text)
        assert sum(pieces[i][1] for i in got) == pytest.approx(best) and fst.decode(got) == text
    assert fst.encode("axxb") == [ids[" a"], 0, ids["b"]]
