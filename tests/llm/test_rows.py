"""Rows without ids, repeated rows, and what a model learns from them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kerfline.llm import langid, near_dup

RNG = random.Random(17)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(200)]


def test_one_row_of_each_near_class_is_kept(spark):
    base = RNG.choices(WORDS, k=200)
    near, other = [*base[:-1], "changed"], RNG.choices(WORDS, k=200)
    rows = [(1, base), (1, base), (1, near), (2, near), (None, other), (None, [*other[:-1], "too"]), (None, other), (7, None), (7, None), (None, []), (9, ["solo"])]
    docs = spark.createDataFrame([(d, None if w is None else " ".join(w), "en", "a", 1) for d, w in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = near_dup.classes(docs.select("doc_id", "text")).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.class_id), r.class_size) for r in got if r.kept) == [("1", 4), ("7", 3), ("9", 1), ("None", 3)]
    assert all(r.doc_id == r.class_id for r in got if r.kept)
    left = corpus_pipeline.unique_documents(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "7", "9", "None"]


def test_language_is_learned_without_ids(spark):
    words = {"en": ["the", "house", "water", "under", "light"], "de": ["das", "haus", "wasser", "unter", "licht"]}
    rows = [(None, " ".join(RNG.choices(words[lang], k=30)), lang) for lang in words for _ in range(300)]
    docs = spark.createDataFrame(rows + rows[:200], "doc_id long, text string, lang string")
    cfg = langid.Config(rows_per_lang=100, epochs=3)
    drawn = langid.sample(docs, cfg)
    n = {r[0]: r[1] for r in drawn.groupBy("lang").count().collect()}
    assert all(50 < n[lang] < 160 for lang in words)
    assert drawn.distinct().count() == drawn.count()  # of repeated rows one counts
    out = langid.identify(docs.withColumn("truth", F.col("lang")), keep=("truth",), cfg=cfg)
    assert out.where("lang_pred = truth").count() >= 0.98 * docs.count()


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (None, "more", None)], "doc_id long, text string, lang string")
    assert {tuple(r) for r in langid.identify(docs).collect()} == {(1, "und", 0.0), (None, "und", 0.0)}


def test_gradients_equal_differences():
    cfg = langid.Config(window=24, filters=3, embed=2)
    model = langid.ByteConv(["a", "b", "c"], cfg)
    model.p = {k: v.astype("f8") for k, v in model.p.items()}
    rng = np.random.default_rng(3)
    x, y, weight = rng.integers(1, 12, (5, 24)).astype("u2"), rng.integers(0, 3, 5), rng.random(5)

    def loss():
        prob = model._forward(x)[2]
        return -(weight * np.log(prob[np.arange(5), y])).sum() / 5

    grad = model._gradients(x, y, weight)
    for name, p in model.p.items():
        for at in zip(*(rng.integers(0, n, 12) for n in p.shape), strict=True):
            before = p[at]
            p[at] = before + 1e-6
            up = loss()
            p[at] = before - 1e-6
            down = loss()
            p[at] = before
            assert grad[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-6), (name, at)


def test_held_out_documents_are_told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = langid.identify(docs).join(docs, "doc_id").where(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") >= 100))
    n = held.count()
    assert n > 200 and held.where("lang = lang_pred").count() >= 0.95 * n
