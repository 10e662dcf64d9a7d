from __future__ import annotations

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerweave.llm import phrases
from ledgerweave.llm.bundles import Bundle, part_slices
from ledgerweave.llm.text import window_hashes, word_bounds, word_hashes

from .conftest import words_of


def brute(rows, length):
    seen = Counter()
    for _, text in rows:
        w = words_of(text)
        for i in range(len(w) - length + 1):
            seen[tuple(w[i : i + length])] += 1
    out = []
    for doc_id, text in rows:
        w = words_of(text)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def result(frame, length):
    rows = phrases.without_repeats(frame, length).collect()
    for r in rows:
        assert sum(s["end"] - s["first"] for s in r["removed"]) == r["n_removed"]
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows], key=repr)


def test_small_table_equals_brute_force(small_docs):
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    assert result(small_docs, 35) == brute(rows, 35)


def test_edge_cases(edge_docs, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows]
    for length in (8, 35):
        assert result(edge_docs, length) == brute(rows, length)


def test_shards_give_the_same(small_docs, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 20_000)
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    assert result(small_docs.repartition(3), 35) == brute(rows, 35)


def test_no_rows(no_docs):
    assert phrases.without_repeats(no_docs).collect() == []


def shard_of(texts, length=35, phrase=6):
    data = "\n".join(texts).encode()
    ends = np.cumsum([len(t.encode()) + 1 for t in texts]) - 1
    return phrases.Shard(Bundle(list(range(len(texts))), [False] * len(texts), ends, data), length, phrase)


def test_passages_learned_elsewhere_are_located(small_docs):
    """Passages of one half of the documents, found in the other half, whose own windows
    were never marked: positions come from the automaton's hits."""
    texts = [r["text"] or "" for r in small_docs.orderBy("doc_id").collect()]
    one, two = shard_of(texts[::2]), shard_of(texts[1::2])
    taught, keys = one.passages(one.valid)
    gone = two.located(taught, keys)
    known = {tuple(w[i : i + 35]) for w in map(words_of, texts[::2]) for i in range(len(w) - 34)}
    wanted = []
    for w in map(words_of, texts[1::2]):
        flags = [False] * len(w)
        for i in range(len(w) - 34):
            if tuple(w[i : i + 35]) in known:
                flags[i : i + 35] = [True] * 35
        wanted += flags
    assert any(wanted) and gone.tolist() == wanted


def test_questions_fall_evenly_into_parts(small_docs):
    """The least of many hashes crowd at the low end; no part may hold most of them."""
    texts = [r["text"] or "" for r in small_docs.collect()]
    asked = shard_of(texts).phrase_questions()
    sizes = np.zeros(50)
    for part, a, b in part_slices(asked, 50):
        sizes[part] = b - a
    assert sizes.max() <= 2 * sizes.mean()


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abé \n\t\x0b ", max_size=60))
def test_words_and_hashes(text):
    data = text.encode()
    starts, ends = word_bounds(data)
    assert [data[a:b].decode() for a, b in zip(starts, ends)] == words_of(text)
    hashes = word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words_of(text)))
    windows = window_hashes(hashes, 2)
    pairs = list(zip(words_of(text), words_of(text)[1:]))
    assert len(set(windows.tolist())) == len(set(pairs))


def test_long_words_differ():
    a, b = b"x" * 5000, b"x" * 4999 + b"y"
    h = [word_hashes(d, *word_bounds(d))[0] for d in (a, b, a[:-1])]
    assert len(set(h)) == 3


def test_sliding():
    values = np.array([5, 3, 8, 1, 9, 2, 7], dtype=np.uint64)
    for width in range(1, 8):
        expect = [min(values[i : i + width]) for i in range(len(values) - width + 1)]
        assert phrases.sliding(values, width).tolist() == expect
