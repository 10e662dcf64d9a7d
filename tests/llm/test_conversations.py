from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ledgerweave.llm import conversations
from ledgerweave.llm.conversations import SpillingQueue
from tests.llm.conftest import cluttered, words_of

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    members = defaultdict(list)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(words_of(node[-1][1])) if node else 0
        below = [totals[k] for k in children[node]]
        totals[node] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(rebuilt[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), *totals[node], sha))
    return sorted(out, key=repr)


def trie(frame, **given):
    return sorted(map(tuple, conversations.prefix_trie(frame, **given).collect()), key=repr)


@pytest.fixture(scope="module")
def talks():
    """Common first turns, many copies, conversations of many turns that share long prefixes,
    short heads, absent heads, negative and missing ids, null turns, roles and texts."""
    rng = random.Random(11)
    rows = []
    for c in range(150):
        first = f"hello number {c % 7 if c % 3 else c}"
        rows.append((c, 0, "user", first))
        for t in range(1, rng.randrange(1, 9)):
            rows.append((c, t, ("user", "assistant")[t % 2], f"turn {t} of {rng.randrange(3)} more words"))
    for c in range(200, 260):  # copies, apart from what their heads give them
        rows += [(c, t, "user", f"copied {t}") for t in range(6)]
    for c, n in ((300, 41), (301, 40), (302, 33), (303, 41), (304, 2), (320, 1)):
        rows += [(c, t, None if t % 5 == 0 else "user", f"long {t} {'x ' * (t % 4)}") for t in range(n)]
    rows += [(305, t, "user", f"long {t} {'x ' * (t % 4)}" if t < 30 else f"apart {t}") for t in range(37)]
    for c in (-1, -20, -25, 999, 1001, 1003, 1007):
        rows += [(c, t, "user", f"outside {t}") for t in range(1, 1 + abs(c) % 5)]
    rows += [(400, None, "user", "null first"), (400, 1, None, None), (400, 0, "user", "")]
    rows += [(None, 0, "user", "belongs nowhere"), (None, None, None, None)]
    rows += [(401, 5, "user", "said twice")] * 2
    rng.shuffle(rows)
    return rows


def test_talks(spark, talks):
    assert trie(cluttered(spark.createDataFrame(talks, SCHEMA))) == brute(talks)


@pytest.mark.parametrize("turns", [1, 2, 7])
def test_short_fragments_and_spilling_queues(spark, talks, turns, monkeypatch):
    """Conversations of many fragments, several shards and queues that hold three messages."""
    monkeypatch.setattr(conversations, "TURNS", turns)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(talks, SCHEMA).repartition(6)
        assert trie(frame, held=3) == brute(talks)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_table(spark, small_dir):
    frame = spark.read.parquet(f"{small_dir}/conversations.parquet")
    assert trie(frame) == brute([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])


def test_empty_table(spark):
    assert trie(spark.createDataFrame([], SCHEMA)) == []


def test_only_turnless(spark):
    """Conversations whose turns are all replaced by an absent head's."""
    lone = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:5]
    rows = [(c, 0, "user", "gone") for c in lone]
    assert trie(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_spilling_queue_keeps_order():
    rng = random.Random(2)
    queue, sent = SpillingQueue(10), defaultdict(list)
    for k in range(500):
        key = (rng.randrange(40), rng.randrange(3))
        queue.push(key, (k, "message"))
        sent[key].append(k)
    assert queue.spills > 10
    for key in sorted(sent):
        assert sorted(m[0] for m in queue.taken(key)) == sent[key]
    assert not queue.heap and not queue.runs
