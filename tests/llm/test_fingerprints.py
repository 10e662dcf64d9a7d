from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerweave.llm import fingerprints as fp


def rolled(data):
    h, out = 0, []
    for b in data:
        h = (h << 1) + int(fp._GEAR[b]) & 0xFFFFFFFF
        out.append(h)
    return out


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        changed = text[: len(text) - k] + after[:k]
        a, b, c = (fp.fingerprint(x.encode()) for x in (text, changed, after))
        out.append(
            (
                doc_id,
                len(text),
                hashlib.sha256(changed.encode()).hexdigest(),
                fp.written(a),
                fp.written(b),
                fp.likeness(a, b),
                fp.likeness(a, c),
            )
        )
    return sorted(out, key=repr)


def got(frame, **more):
    return sorted([tuple(r) for r in fp.compared_with_next(frame, **more).collect()], key=repr)


@given(st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_gear_hash_and_chunks(data):
    assert fp.gear_hashes(data).tolist() == rolled(data)
    ends = fp.boundaries(data)
    assert (ends[-1] if ends else 0) == len(data)
    sizes = np.diff([0, *ends])
    assert all(fp.LEAST <= s <= fp.MOST for s in sizes[:-1])


def test_strips_change_nothing(monkeypatch):
    data = np.random.default_rng(1).integers(97, 123, 50_000, dtype=np.uint8).tobytes()
    whole = fp.boundaries(data)
    monkeypatch.setattr(fp, "_STRIP", 1000)
    assert fp.boundaries(data) == whole


def test_text_that_moves_keeps_its_chunks():
    text = np.random.default_rng(2).integers(97, 123, 20_000, dtype=np.uint8).tobytes()
    assert fp.likeness(fp.fingerprint(text), fp.fingerprint(b"something in front " + text)) > 0.97
    assert fp.likeness(fp.fingerprint(text), fp.fingerprint(text[::-1])) == 0
    assert fp.likeness({}, {}) == 1 and fp.likeness({}, fp.fingerprint(b"x")) == 0


@pytest.mark.parametrize("range_rows", [1, 4, 4000])
def test_edge_cases(edge_docs, edge_rows, range_rows):
    assert got(edge_docs, range_rows=range_rows) == brute([(r[0], r[1]) for r in edge_rows])


def test_small_table_equals_brute_force(small_docs):
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    assert got(small_docs.repartition(5), range_rows=17) == brute(rows)


def test_few_rows(spark, no_docs):
    assert got(no_docs) == []
    one = spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")
    assert [(r[0], r[1], r[6]) for r in got(one)] == [(3, 8, 1.0)]
    nulls = spark.createDataFrame([(None, "b"), (None, "a"), (None, None)], "doc_id long, text string")
    assert got(nulls) == brute([(None, "b"), (None, "a"), (None, None)])
