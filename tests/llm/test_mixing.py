from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerweave.llm import mixing

from .conftest import words_of


def brute_targets(rows, weights=(5, 2, 1), share=1.5, cap=2.0):
    sizes = Counter()
    for source, text in rows:
        sizes[source] += len(words_of(text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target = share * sum(sizes.values()), dict.fromkeys(names, 0.0)
    active = set(names)
    while active and left > 1e-9:
        unit = left / sum(weight[s] for s in active)
        left = 0.0
        for s in sorted(active, key=names.index):
            target[s] += unit * weight[s]
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                active = active - {s}
    return sizes, target


def check(frame, rows, **more):
    """rows: (doc_id, source, text)."""
    sizes, target = brute_targets([r[1:] for r in rows])
    got = mixing.taken_words(frame, **more).collect()
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in got), key=repr) == sorted(
        ((d, s, len(words_of(t))) for d, s, t in rows), key=repr
    )
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    length = more.get("block_words", 128)
    for s in sizes:
        assert abs(taken[s] - target[s]) < 1.5 * length
    return got


def test_small_table(small_docs):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in small_docs.collect()]
    first = check(small_docs, rows, block_words=16, shard_slots=50)
    again = mixing.taken_words(small_docs.repartition(3), block_words=16, shard_slots=50).collect()
    assert sorted(first) == sorted(again)


def test_edge_cases(edge_docs, edge_rows):
    rows = [(r[0], r[3], r[1]) for r in edge_rows]
    check(edge_docs, rows, block_words=2, shard_slots=7)
    check(edge_docs, rows)


def test_ids_that_say_nothing(spark, small_docs):
    docs = small_docs.withColumn("doc_id", F.when(F.crc32("text") % 2 == 0, F.lit(7)).cast("long"))
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    got = check(docs, rows, block_words=16, shard_slots=50)
    again = mixing.taken_words(docs.repartition(5), block_words=16, shard_slots=50).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)


def test_taken_words_are_those_of_the_blocks(small_docs):
    blocks = mixing.mixed_blocks(small_docs, block_words=16, shard_slots=50)
    taken = mixing.taken_words(small_docs, block_words=16, shard_slots=50)
    by_source = {r["source"]: r["n"] for r in blocks.groupBy("source").agg(F.sum("n_words").alias("n")).collect()}
    assert {r["source"]: r["n"] for r in taken.groupBy("source").agg(F.sum("taken").alias("n")).collect()} == by_source


def test_no_rows(spark, no_docs):
    assert mixing.taken_words(no_docs).collect() == []
    assert mixing.mixed_blocks(no_docs).collect() == []
    blank = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.taken_words(blank).collect()] == [(0, 0.0)] * 2
    assert mixing.mixed_blocks(blank).collect() == []


def test_blocks_hold_the_words(small_docs):
    blocks = mixing.mixed_blocks(small_docs, block_words=16, shard_slots=50).collect()
    taken = mixing.taken_words(small_docs, block_words=16, shard_slots=50).collect()
    by_source = Counter()
    for r in taken:
        by_source[r["source"]] += r["taken"]
    held, texts = Counter(), {}
    for b in blocks:
        assert len(words_of(b["text"])) == b["n_words"] <= 16
        assert texts.setdefault((b["source"], b["block"]), b["text"]) == b["text"]
        held[b["source"]] += b["n_words"]
    assert held == by_source
    assert len({(b["shard"], b["slot"]) for b in blocks}) == len(blocks)
    assert max(Counter((b["source"], b["block"]) for b in blocks).values()) <= 2


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 5))
def test_permutation(size, key):
    assert sorted(mixing.permuted(np.arange(size), size, (key,)).tolist()) == list(range(size))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=6), st.integers(1, 60))
def test_shards_share_out_every_slot_once(counts, slots):
    quota = np.array(counts)
    shards = max(1, -(-int(quota.sum()) // slots))
    at = np.zeros_like(quota)
    for k in range(shards):
        first, own = mixing.shard_counts(quota, k, shards, slots, 3)
        assert (first == at).all() and own.sum() == min(slots, quota.sum() - k * slots)
        at = at + own
    assert (at == quota).all()


def test_shards_are_mixed():
    quota = np.array([5000, 3000, 2000])
    own = np.array([mixing.shard_counts(quota, k, 10, 1000, 3)[1] for k in range(10)])
    assert (abs(own - quota / 10) < 120).all() and len({tuple(r) for r in own}) > 5
