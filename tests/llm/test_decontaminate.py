from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerweave.llm import decontaminate as dc

ITEM = "the quick brown fox jumps over the lazy dog while the old cat sleeps on a warm window sill all day"


def least_distance(item, text):
    """Edit distance of the item to the nearest stretch of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        fresh = [i]
        for j, d in enumerate(text, 1):
            fresh.append(min(row[j - 1] + (c != d), row[j] + 1, fresh[-1] + 1))
        row = fresh
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", min_size=1, max_size=70), st.text("ab ", max_size=90))
def test_myers_equals_the_table(item, text):
    best, end = dc.Pattern(item).best(text)
    assert best == least_distance(item, text)
    assert best == len(item) or least_distance(item, text[:end]) == best


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_every_match_within_the_budget_is_found(data):
    letters = st.sampled_from("abcd ")
    text = list(ITEM)
    for _ in range(data.draw(st.integers(0, 9))):
        at = data.draw(st.integers(0, len(text) - 1))
        kind = data.draw(st.integers(0, 2))
        text[at : at + (kind > 0)] = [data.draw(letters)] if kind < 2 else []
    text = dc.folded("start of it " + "".join(text) + " and so on")
    matcher = dc.Matcher([(1, ITEM)], 12)
    distance = least_distance(ITEM, text)
    found = matcher.matches(text)
    assert bool(found) == (distance <= dc.budget(len(ITEM), 12))
    if found:
        assert found[0][0] == distance


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, ITEM, "x"), (2, None, "x"), (3, " \t", "x"), (4, "Who wrote  it?", "x"), (None, ITEM[:60].upper(), "x")]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


def test_edge_cases(spark, items, edge_docs):
    rows = [
        (100, "before " + ITEM.upper().replace(" ", "\n") + " after", "en", "s"),
        (101, ITEM.replace("quick", "quiet"), "en", "s"),
        (102, ITEM.replace("lazy dog while the old cat", "rather different animal over there"), "en", "s"),
        (103, "quiz: (who wrote it?) nobody", "en", "s"),
        (104, "anywho wrote it? who wrote it?s who wrot it?", "en", "s"),
        (None, ITEM, "en", "s"),
    ]
    docs = edge_docs.select("doc_id", "text", "lang", "source").union(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    )
    found = {(r["doc_id"], r["item_id"], r["distance"]) for r in dc.contaminated(docs, items).collect()}
    assert {(d, i) for d, i, _ in found} == {
        (100, 1), (100, None), (101, 1), (101, None), (103, 4), (None, 1), (None, None),
    }
    assert (100, 1, 0) in found and (101, 1, 2) in found
    left = dc.without_contaminated(docs, items)
    assert left.columns == docs.columns
    assert left.count() == docs.count() - 4


def test_given_items_in_documents(spark, small_dir, small_docs):
    items = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    folded = {r["item_id"]: dc.folded(r["text"]) for r in items.collect()}
    texts = {r["doc_id"]: dc.folded(r["text"]) for r in small_docs.collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in folded.items() if x in t}
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in dc.contaminated(small_docs, items).collect()}
    assert whole <= set(found) and {k for k, v in found.items() if v == 0} == whole


def test_blocks_and_empty_tables(spark, items, no_docs, edge_docs, monkeypatch):
    assert dc.contaminated(no_docs, items).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(edge_docs, none).collect() == []
    assert dc.without_contaminated(edge_docs, none).count() == edge_docs.count()
    monkeypatch.setattr(dc, "_BLOCK", 10)
    assert len(list(dc.item_blocks(items))) == 3


def test_blocks_change_nothing(spark, items, monkeypatch):
    rows = [(1, "see " + ITEM), (2, "who wrote it?"), (3, "clean"), (4, ITEM[:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(str, dc.contaminated(docs, items).collect()))
    monkeypatch.setattr(dc, "_BLOCK", 10)
    assert sorted(map(str, dc.contaminated(docs, items).collect())) == whole
    assert [r["doc_id"] for r in dc.without_contaminated(docs, items).collect()] == [3]


@settings(max_examples=200, deadline=None)
@given(st.text("ab1 ?", min_size=1, max_size=6), st.text("ab1 ?", max_size=40))
def test_short_items_match_between_word_edges(item, text):
    item, text = dc.folded(item), dc.folded(text)
    if not item:
        return
    wanted = any(
        text[k : k + len(item)] == item
        and not text[max(0, k - 1) : k].isalnum()
        and not text[k + len(item) : k + len(item) + 1].isalnum()
        for k in range(len(text))
    )
    assert bool(dc.Matcher([(1, item)], 16).matches(text)) == wanted
