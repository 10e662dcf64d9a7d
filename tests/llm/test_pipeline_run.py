from __future__ import annotations

import corpus_pipeline


def test_stages_are_stored_and_reread(spark, small_dir, monkeypatch):
    stages = [
        ("first", lambda spark, docs, sf_dir: docs.where("doc_id % 2 = 0")),
        ("second", lambda spark, docs, sf_dir: docs.where("doc_id % 3 = 0")),
        ("last", lambda spark, docs, sf_dir: docs.select("doc_id")),
    ]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    left = corpus_pipeline.run(spark, small_dir)
    assert left.inputFiles() and all("/second-" in f for f in left.inputFiles())
    docs = corpus_pipeline.documents(spark, small_dir)
    assert left.count() == docs.where("doc_id % 6 = 0").count()
