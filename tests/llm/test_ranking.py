from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from ledgerweave.llm import ranking
from ledgerweave.llm.bundles import Bundle
from tests.llm.conftest import cluttered

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

ITEMS = [
    (0, "One two THREE four, one-two!"),
    (1, "again"),
    (1, "shared7 shared8 naïve 😀"),
    (2, None),
    (3, " ... "),
    (4, "no document holds zzz"),
    (None, "five six seven"),
    (5, "w1x1 " * 500 + "again " * 2000),
]


def split(text):
    return TERM.findall((text or "").translate(_LOWER))


def brute(docs, items, best=20):
    bags = [(i, split(t)) for i, t, *_ in docs]
    bags = [(i, w) for i, w in bags if w]
    n_docs, total = len(bags), sum(len(w) for _, w in bags)
    counts = [(i, len(w), Counter(w)) for i, w in bags]
    held = Counter(t for _, _, c in counts for t in c)
    rows = []
    for item_id, text in items:
        found = []
        for doc_id, n, tf in counts:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m))
                for t in split(text)
                if t in tf
            )
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(found, key=lambda f: f[:3])[:best], 1):
            rows.append((item_id, rank, doc_id, -score))
    return sorted(rows, key=repr)


def ranks(docs, items, **given):
    return sorted(map(tuple, ranking.ranked(docs, items, **given).collect()), key=repr)


@pytest.mark.parametrize("best", [1, 2, 20])
def test_edge_rows(spark, edge_docs, edge_rows, best):
    items = cluttered(spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert ranks(edge_docs, items, best=best) == brute(edge_rows, ITEMS, best)


def test_blocks_of_items_change_nothing(spark, edge_docs, edge_rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").repartition(3)
    assert ranks(edge_docs, items, item_bytes=16) == brute(edge_rows, ITEMS)


def test_many_ties_over_many_tasks(spark):
    rows = [(900 - k, "same words here" if k % 3 else "same words here too") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(90)
    items = spark.createDataFrame([(7, "words here")], "item_id long, text string")
    assert ranks(docs, items) == brute(rows, [(7, "words here")])


def test_small_table(spark, small_docs, small_dir):
    items = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    docs = [tuple(r) for r in small_docs.select("doc_id", "text").collect()]
    wanted = brute(docs, [tuple(r) for r in items.select("item_id", "text").collect()])
    assert ranks(small_docs, items) == wanted


def test_empty_tables(spark, no_docs, edge_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "again")], "item_id long, text string")
    assert ranks(no_docs, one) == ranks(edge_docs, none) == ranks(no_docs, none) == []


def test_vocabulary_tiles_stay_below_the_bound():
    """Weights beyond the bound are cut, and no item's weights in a tile exceed it."""
    texts = [b"a " * 50 + b"b " * 7 + b"c", b"a b c d e", b"b " * 23]
    data = b"\n".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    block = ranking.ItemBlock(Bundle([1, 2, 3], [False] * 3, ends, data))
    rarity = np.arange(3, 3 + len(block.vocabulary))
    (low, high, tiles), = block.tiles(rarity, most=20)
    total = np.zeros((len(block.vocabulary), high - low), dtype=np.int64)
    for names, item, column, weight in tiles:
        assert len(set(names.tolist())) == len(names)
        assert np.bincount(item, weights=weight).max() <= 20
        np.add.at(total, (names[column], item), weight)
    wanted = np.zeros_like(total)
    for k, text in enumerate(texts):
        for term, n in Counter(text.split()).items():
            wanted[block.vocabulary[term], k] = n * rarity[block.vocabulary[term]]
    assert (total == wanted).all()
    assert ranking.MOST_WEIGHT * ranking.MOST_IMPACT < 2**53


def test_products_are_exact_at_the_bound():
    """Sums just below 2^53 keep their last digit."""
    left = np.array([[ranking.MOST_IMPACT - 1.0, ranking.MOST_IMPACT - 1.0]])
    right = np.array([[ranking.MOST_WEIGHT - 8.0], [7.0]])
    exact = (ranking.MOST_IMPACT - 1) * (ranking.MOST_WEIGHT - 8) + (ranking.MOST_IMPACT - 1) * 7
    assert int((left @ right)[0, 0]) == exact
