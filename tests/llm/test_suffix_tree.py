from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import suffix_tree as tree

from .conftest import cluttered, words_of

GROWTH = tree.Growth(least_share=0.002, least_pair=0.0005, divergence=0.02, discount=0.75)


def brute(rows, held, growth):
    """The same model with dictionaries: base and score of every row."""
    texts = [(d, words_of(t, lower=True) + [None]) for d, t in rows]
    train = [w for d, w in texts if not held(d)]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    least = max(2, math.ceil(growth.least_pair * n))
    words = {x for x in c if c[x] >= least}
    heads = {x for x in words if c[x] >= growth.least_share * n}
    pairs, triples = Counter(), Counter()
    for w in train:
        before = [None, *w]
        for i, x in enumerate(w):
            if x in words and before[i] in heads:
                pairs[before[i], x] += 1
                if i and before[i - 1] in heads:
                    triples[before[i - 1], before[i], x] += 1

    def root(x):
        return (c[x] + 1) / (n + v + 1)

    states = {}

    def prob(context, x):
        if len(context) > 2:
            context = context[-2:]
        if not context:
            return root(x)
        if context not in states:
            return prob(context[1:], x)
        rest, own = states[context]
        return own.get(x, 0.0) + rest * prob(context[1:], x)

    for counts, held_n in (
        (pairs, lambda s: c[s[0]]),
        (triples, lambda s: pairs[s] if pairs[s] >= least else 0),
    ):
        kept = {}
        for key, k in counts.items():
            if k >= least:
                kept.setdefault(key[:-1], {})[key[-1]] = k
        fresh = {}
        for s, nexts in kept.items():
            held_ = held_n(s)
            own = {x: (k - growth.discount) / max(held_, 1) for x, k in nexts.items()}
            rest = 1 - sum(own.values())
            short = {x: prob(s[1:], x) for x in nexts}
            gain = sum(
                (own[x] + max(rest, 1e-12) * short[x]) * math.log((own[x] + max(rest, 1e-12) * short[x]) / short[x])
                for x in nexts
            )
            other = max(1 - sum(short.values()), 1e-12)
            gain += rest * other * math.log(max(rest, 1e-12)) 
            if held_ >= growth.least_share * n and rest > 0 and gain >= growth.divergence:
                fresh[s] = (rest, own)
        states.update(fresh)
    out = {}
    for d, w in texts:
        base = sum(math.log10(root(x)) for x in w)
        before = [None, *w]
        score = sum(math.log10(prob(tuple(before[max(0, i - 1) : i + 1]), x)) for i, x in enumerate(w))
        out.setdefault(d, []).append((bool(held(d)), len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out, states, prob, c


def spark_held():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def py_held(doc_id):
    import zlib

    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def same(frame, rows, growth=GROWTH):
    expect, states, *_ = brute(rows, py_held, growth)
    got = {}
    for r in tree.scored(frame, spark_held(), growth).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert got.keys() == expect.keys()
    for d in expect:
        for a, b in zip(sorted(got[d]), sorted(expect[d])):
            assert a[:4] == b[:4]
            assert a[4:] == pytest.approx(b[4:], rel=1e-9)
    return states


def test_small_table_equals_brute_force(small_docs):
    states = same(small_docs, [(r["doc_id"], r["text"]) for r in small_docs.collect()])
    assert {len(s) for s in states} == {1, 2}


def test_bundles_and_parts_change_nothing(small_docs, monkeypatch):
    from ledgerweave.llm import bundles

    monkeypatch.setattr(tree, "BUNDLE_BYTES", 30_000)
    monkeypatch.setattr(bundles, "PART_ENTRIES", 1_000)
    same(small_docs.repartition(3), [(r["doc_id"], r["text"]) for r in small_docs.collect()])


def test_edge_cases(edge_docs, edge_rows):
    same(edge_docs, [(r[0], r[1]) for r in edge_rows])


def test_states_are_distributions(small_docs):
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    _, states, prob, c = brute(rows, py_held, GROWTH)
    n, v = sum(c.values()), len(c)
    for s in list(states)[:10]:
        unknown = prob(s, "\x00never")
        assert sum(prob(s, x) for x in c) + unknown == pytest.approx(1)


def test_held_out_texts_score_better_than_by_words_alone(small_docs):
    rows = tree.scored(small_docs, spark_held(), tree.Growth(0.001, 0.0003)).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_no_training_rows(spark, no_docs):
    assert tree.scored(no_docs, spark_held()).collect() == []
    one = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = tree.scored(one, F.lit(True)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in rows] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]


def deep(rows, held, divergence=tree.DIVERGENCE, discount=tree.DISCOUNT):
    """What ``WHOLE`` asks for, with dictionaries: scores by row, and the states."""
    texts = [(d, words_of(t, lower=True) + [None]) for d, t in rows]
    train = [w for d, w in texts if not held(d)]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    states = {}

    def prob(context, x):
        if not context:
            return (c[x] + 1) / (n + v + 1)
        if context not in states:
            return prob(context[1:], x)
        rest, own = states[context]
        return own.get(x, 0.0) + rest * prob(context[1:], x)

    depth = 0
    while True:
        depth += 1
        nexts = {}
        for w in train:
            before = [None, *w]
            for i in range(depth - 1, len(w)):
                s = tuple(before[i - depth + 1 : i + 1])
                if depth < 3 or s[1:] in states:
                    nexts.setdefault(s, Counter())[w[i]] += 1
        fresh = {}
        for s, followers in nexts.items():
            held_n = sum(followers.values())
            own = {x: (k - discount) / held_n for x, k in followers.items() if k >= 2}
            rest = 1 - sum(own.values())
            short = {x: prob(s[1:], x) for x in own}
            gain = sum((own[x] + rest * short[x]) * math.log((own[x] + rest * short[x]) / short[x]) for x in own)
            gain += rest * max(1 - sum(short.values()), 1e-12) * math.log(rest) if own else 0
            if own and gain >= divergence:
                fresh[s] = (rest, own)
        if not fresh:
            break
        states.update(fresh)
    out = {}
    for d, w in texts:
        before = [None, *w]
        score = sum(math.log10(prob(tuple(before[max(0, i - depth + 1) : i + 1]), x)) for i, x in enumerate(w))
        out.setdefault(d, []).append(score)
    return out, states


def test_whole_tree_has_rare_and_deep_contexts(small_docs, monkeypatch):
    from ledgerweave.llm import bundles

    monkeypatch.setattr(tree, "BUNDLE_BYTES", 60_000)
    monkeypatch.setattr(bundles, "PART_ENTRIES", 5_000)
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    expect, states = deep(rows, py_held)
    assert max(len(s) for s in states) > 2
    got = {}
    for r in tree.scored(small_docs, spark_held()).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert got.keys() == expect.keys()
    for d in expect:
        assert sorted(got[d]) == pytest.approx(sorted(expect[d]), rel=1e-9)
    half, fewer = deep(rows[: len(rows) // 2], py_held)
    assert len(states) > 1.5 * len(fewer)


def test_whole_tree_of_edge_rows(spark, edge_docs, edge_rows):
    """Nulls, empty and very long texts, repeated rows and extra columns, by the tree that is registered."""
    rows = [(r[0], r[1]) for r in edge_rows]
    docs = cluttered(edge_docs.union(edge_docs))
    expect, states = deep(rows + rows, py_held)
    assert max(len(s) for s in states) > 2
    got = {}
    for r in tree.scored(docs, spark_held()).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert got.keys() == expect.keys()
    for d in expect:
        assert sorted(got[d]) == pytest.approx(sorted(expect[d]), rel=1e-9)
