"""Findings of FINDINGS_r03.md on the training-data operators: what failed before."""

import tracemalloc

import pyarrow as pa

from kerfline.llm import langid


def test_language_id_copies_a_batch_in_pieces(spark, monkeypatch):
    """pipeline: all texts of a batch were held as strings and as bytes beside it."""
    docs, found = spark.createDataFrame([(1, "text")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: found.append(run) or self)
    model = langid.ByteConv(["a", "b"], langid.Config())
    langid.predict(docs, model)
    texts = [f"{i:06d} " * 300 if i % 9 else None for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "_text"])
    tracemalloc.start()
    out, ids = 0, []
    for part in found[0](iter([batch])):
        out, ids = max(out, part.num_rows), ids + part.column(0).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == list(range(3000)) and peak < batch.nbytes
