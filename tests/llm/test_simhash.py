from __future__ import annotations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerweave.llm import simhash
from ledgerweave.llm.components import rooted

from .conftest import words_of


def brute_print(text, size=3):
    words = words_of(text, lower=True)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    prints = [(d, brute_print(t)) for d, t in rows]
    distinct = sorted({p for _, p in prints})
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 3]
    root = components(links, distinct)
    least = {}
    for d, p in prints:
        if d is not None:
            least[root[p]] = min(least.get(root[p], d), d)
    return sorted([(d, p, least.get(root[p])) for d, p in prints], key=repr)


def got(frame, **more):
    rows = simhash.near_duplicates(frame, **more).collect()
    return sorted([(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in rows], key=repr)


def test_small_table_equals_brute_force(small_docs):
    assert got(small_docs) == brute([(r["doc_id"], r["text"]) for r in small_docs.collect()])


def test_edge_cases(edge_docs, edge_rows):
    assert got(edge_docs) == brute([(r[0], r[1]) for r in edge_rows])
    left = simhash.one_of_each_group(edge_docs)
    assert left.columns == edge_docs.columns
    ids = sorted(r["doc_id"] or 0 for r in left.collect())
    assert ids == [0, 1, 4, 6, 7, 8, 9, 10, 11, 12, 13]


def test_rows_that_share_an_id_are_judged_apart(spark):
    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in "abcd"]
    rows = [
        (5, texts[0], "clean"),
        (5, texts[1], "copy of 3"),
        (5, texts[0], "clean"),
        (3, texts[1], "original"),
        (None, texts[1], "copy without id"),
        (None, texts[2], "clean without id"),
        (None, texts[2], "clean without id"),
        (None, texts[3], "clean too"),
        (0, None, "no text"),
        (None, "", "no text without id"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, what string")
    left = simhash.one_of_each_group(frame)
    assert left.columns == frame.columns
    assert sorted((r["what"], r["doc_id"] or 0) for r in left.collect()) == [
        ("clean", 5), ("clean too", 0), ("clean without id", 0), ("no text", 0), ("original", 3),
    ]


def test_no_rows(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.one_of_each_group(no_docs).collect() == []


def near_values(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    out = set()
    while len(out) < n:
        value = int(rng.choice(centres))
        for bit in rng.integers(0, 64, rng.integers(0, 6)):
            value ^= 1 << int(bit)
        out.add(value)
    return np.array(sorted(out), dtype=np.uint64)


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_tree_finds_every_neighbour(radius):
    values = near_values(radius, 400)
    tree = simhash.BKTree(values)
    found = {(int(q), int(n)) for qs, ns in tree.within(values, radius) for q, n in zip(qs, ns)}
    distance = np.bitwise_count(values[:, None] ^ values[None, :])
    assert found == set(zip(*map(list, (x.tolist() for x in np.nonzero(distance <= radius)))))


@pytest.mark.parametrize("tree_nodes", [7, 4096])
def test_links_connect_what_all_links_connect(spark, tree_nodes):
    values = near_values(11, 500)
    signed = values.view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.links(frame, 3, tree_nodes).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
    every = [
        (a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    ]
    assert components(links, signed) == components(every, signed)


@settings(max_examples=8, deadline=None)
@given(edges=st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=40))
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    expect = components(edges, nodes | {n for e in edges for n in e})
    assert {r["node"]: r["root"] for r in rooted(frame).collect()} == {n: expect[n] for n in nodes}


def test_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)]
    found = rooted(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["root"] for r in found} == {0} and len(found) == 201
