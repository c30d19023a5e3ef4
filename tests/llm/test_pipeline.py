"""The pipeline's stages take effect, keep the columns of documents, and nothing personal is left."""

from __future__ import annotations

import corpus_pipeline
from pixelloom.llm import near_dup, packing, pii, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == names
        after = docs.collect()
        if i == 0:
            assert {r["doc_id"] for r in after} <= {d for d, t in before.items() if not _base_failed(t)}
        if i == 1:
            fps = [near_dup.fingerprint(r["text"]) for r in after]
            assert len(fps) == len(set(fps)) and set(before[r["doc_id"]] for r in after) <= set(before.values())
        if i == 2:
            assert not any(s for r in after for s in pii.spans(r["text"]) if s[2] in pii.KINDS[:4])
            assert len(after) == len(before)
        if i == 3:
            assert all(before[r["doc_id"]] == r["text"] for r in after)
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packing.GROUP


def _base_failed(text):
    s = quality_rules.base_statistics(text)
    return s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
