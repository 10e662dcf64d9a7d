from __future__ import annotations

import pytest

import __spark_entry__
import corpus_pipeline
from ledgerweave.llm.queries import QUERIES

CONTRACT = {
    1: {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    3: {
        "page_id": "bigint",
        "payload_bytes": "bigint",
        "payload_digest": "string",
        "record_type": "string",
        "refers_to": "bigint",
    },
    4: {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    6: {
        "doc_id": "bigint",
        "held_out": "boolean",
        "n_tokens": "bigint",
        "n_known": "bigint",
        "train_tokens": "bigint",
        "base_score": "double",
        "score": "double",
    },
    7: {
        "doc_id": "bigint",
        "n_assign": "bigint",
        "n_access": "bigint",
        "n_hex": "bigint",
        "base_sha256": "string",
        "spans": "string",
    },
    8: {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    9: {
        "doc_id": "bigint",
        "n_chars": "bigint",
        "edited_sha256": "string",
        "fingerprint": "string",
        "edited_fingerprint": "string",
        "near_edited": "double",
        "near_next": "double",
    },
    10: {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    11: {
        "conv_id": "bigint",
        "depth": "bigint",
        "parent_conv_id": "bigint",
        "n_convs": "bigint",
        "n_children": "bigint",
        "n_leaves": "bigint",
        "saved_tokens": "bigint",
        "ends_sha256": "string",
    },
    13: {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    12: {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
}


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == sorted({*CONTRACT, 2, 5})
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("number", sorted(CONTRACT))
def test_columns(spark, small_dir, number):
    query = next(q for n, q in QUERIES.items() if n.startswith(f"op{number}_"))
    frame = query(spark, small_dir)
    assert CONTRACT[number].items() <= dict(frame.dtypes).items()
    if number in (11, 12):
        return
    table = "pages" if number == 3 else "documents"
    assert frame.count() == spark.read.parquet(f"{small_dir}/{table}.parquet").count()


def test_pipeline_stages(spark, small_dir, tmp_path):
    docs = corpus_pipeline.documents(spark, small_dir)
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name != "source_mix":
            assert docs.columns == columns
    assert counts[:5] == sorted(counts[:5], reverse=True) and counts[4] > counts[0] / 2
    assert docs.count() > 0


def test_pipeline_on_edge_rows(spark, small_dir, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small_dir)
        docs.collect()
