from __future__ import annotations

import random
from itertools import combinations
from math import comb

import numpy as np
import pytest

from ledgerweave.llm import minhash
from tests.llm.conftest import cluttered, words_of


def shingles(text):
    w = words_of(text, lower=True)
    if len(w) < 4:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3))


def brute(rows):
    """doc_id, set size, least doc_id of the component, kept; by all pairs of distinct sets."""
    sets = [shingles(r[1]) for r in rows]
    distinct = sorted({s for s in sets if s}, key=sorted)
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in combinations(distinct, 2):
        if 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
            root[find(a)] = find(b)
    least = {}
    for (doc_id, *_), s in zip(rows, sets):
        if s and doc_id is not None:
            least[find(s)] = min(doc_id, least.get(find(s), doc_id))
    out = []
    for (doc_id, *_), s in zip(rows, sets):
        component = least.get(find(s)) if s else doc_id
        out.append((doc_id, len(s), component, doc_id == component))
    return sorted(out, key=repr)


def components(docs):
    return sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=repr)


@pytest.fixture(scope="module")
def edited_rows():
    """Originals with many edited copies around the threshold, copies of copies, chains,
    passages that unlike documents share, and short texts."""
    rng = random.Random(5)
    fresh = iter(range(10**9))
    passage = [f"passage{k}" for k in range(60)]
    rows = []
    for size, copies in ((40, 70), (120, 60), (300, 20), (7, 12)):
        text = [f"t{next(fresh)}" for _ in range(size)]
        chain = list(text)
        for k in range(copies):
            edited = list(text)
            for _ in range(rng.randrange(0, max(2, size // 10))):
                edited[rng.randrange(size)] = f"e{next(fresh)}"
            rows.append(" ".join(edited))
            if k % 5 == 0:
                chain[rng.randrange(size)] = f"c{next(fresh)}"
                rows.append(" ".join(chain).upper())
        rows += [" ".join(text)] * 30
    for k in range(80):
        own = [f"o{next(fresh)}" for _ in range(rng.randrange(5, 90))]
        rows.append(" ".join(own + passage if k % 2 else passage + own))
    rows += ["one two", "ONE two", "one two three", "a b c d", "a b c d e", "a b c d e f", "", " \t", None]
    rng.shuffle(rows)
    return [(k if k % 50 else None, t) for k, t in enumerate(rows)]


def test_edited_copies(spark, edited_rows):
    docs = spark.createDataFrame(edited_rows, "doc_id long, text string").repartition(5)
    assert components(docs) == brute(edited_rows)


def test_small_units_and_tiles_change_nothing(spark, edited_rows, monkeypatch):
    """Cut lists, tiles of a few classes and several askers' slots give the same rows."""
    monkeypatch.setattr(minhash, "UNIT", 7)
    monkeypatch.setattr(minhash, "TILE", 5)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "_TOGETHER", 8)
    docs = spark.createDataFrame(edited_rows, "doc_id long, text string").repartition(5)
    assert components(docs) == brute(edited_rows)


def test_edge_rows(spark, edge_docs, edge_rows):
    assert components(edge_docs) == brute(edge_rows)


def test_small_table(spark, small_docs):
    rows = [tuple(r) for r in small_docs.select("doc_id", "text").collect()]
    assert components(cluttered(small_docs)) == brute(rows)


def test_empty_table(spark, no_docs):
    assert components(no_docs) == []


def test_no_document_has_a_partner(spark):
    rows = [(k, f"a{k} b{k} c{k} d{k} e{k}") for k in range(20)]
    assert components(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_match_threshold_misses_almost_no_link():
    k, t = minhash.COORDINATES, minhash.LEAST_MATCHES
    assert sum(comb(k, i) * 0.8**i * 0.2 ** (k - i) for i in range(t)) < 1e-8


def test_coordinates_agree_as_often_as_sets_do():
    """Over many pairs of sets the share of equal coordinates is their Jaccard similarity."""
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(60):
        common = rng.integers(0, 2**64, 80, dtype=np.uint64)
        one, two = (np.concatenate([common, rng.integers(0, 2**64, 10, dtype=np.uint64)]) for _ in range(2))
        least = [((s[:, None] ^ minhash._TURN) * minhash._ODD).min(axis=0) for s in (one, two)]
        agree.append((least[0] == least[1]).mean())
    assert abs(np.mean(agree) - 0.8) < 0.02
