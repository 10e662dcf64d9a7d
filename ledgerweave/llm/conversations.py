"""Prefix trie of conversations by time-forward processing.

Every conversation is rebuilt: the first turns of its group's head conversation, then its own
turns after as many. The trie has a node for every distinct sequence of first turns; a node
reports its members, its children, and the leaves and saved tokens of its subtree.

Turns are reduced to a 128-bit digest and a number of words before anything is shuffled, and
numbered by ranges of (conversation, turn), so a conversation of any length is spread over
tasks. Rebuilt conversations are cut into fragments of ``TURNS`` turns. A fragment is sorted
by its block number, the hash of all turns before it and the digests of its turns; fragments
that pass through the same nodes are then neighbours, and ranges of that order are the shards.

Within a shard, nodes are found by comparing neighbours, sorted by reverse level order (Spark
sorts externally), and processed once: a node takes its children's totals from a priority
queue, adds its own, and sends the result to its parent by the queue, which spills sorted
runs when it holds too many. Only nodes on the first and last path of a shard can have
members elsewhere; these stay open. What shards know of open nodes is added up, and the same
procedure runs across shards, over the open nodes. Conversations longer than a fragment are
joined likewise: each block's tries are totalled first, then the tree of their roots, and the
totals below a fragment's last node enter with the fragment.

Defined cases: null role or text is empty; a null turn comes first, equal turns go by digest;
rows without conv_id belong to no conversation and make no node; repeated rows are turns of
their own; turnless rebuilt conversations are members of the root; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.sources.durable import durable

# Turns of a fragment, and messages that a priority queue holds before it spills.
TURNS = 64
HELD = 1 << 18
GROUP, HEADS = 20, 4

_WORD = 2**64
# Fixed odd multipliers of the two hashes of a prefix.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_NOBODY = 2**63 - 1


def _signed(value: int) -> int:
    value %= _WORD
    return value - _WORD if value >= _WORD >> 1 else value


class SpillingQueue:
    """A priority queue of (key, message) that spills sorted runs to the folders that Spark
    gives a task for its own spills; they vanish with the task."""

    def __init__(self, held: int):
        self.held, self.heap, self.runs, self.spills, self.count = held, [], [], 0, 0

    def push(self, key: tuple, message: tuple) -> None:
        # The running number keeps messages themselves out of comparisons.
        self.count += 1
        heapq.heappush(self.heap, (key, self.count, message))
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        for entry in sorted(self.heap):
            pickle.dump(entry, file, protocol=pickle.HIGHEST_PROTOCOL)
        file.seek(0)
        self.heap, self.spills = [], self.spills + 1
        self._next(file)

    def _next(self, file) -> None:
        try:
            heapq.heappush(self.runs, (*pickle.load(file), file))
        except EOFError:
            file.close()

    def taken(self, key: tuple) -> Iterator[tuple]:
        """Removes and gives the messages for ``key``, which must be the least that is left."""
        while True:
            if self.heap and self.heap[0][0] == key:
                yield heapq.heappop(self.heap)[2]
            elif self.runs and self.runs[0][0] == key:
                _, _, message, file = heapq.heappop(self.runs)
                self._next(file)
                yield message
            else:
                return


def forwarded(
    rows: Iterator[dict], group: tuple[str, ...], own: tuple[str, ...], parent: tuple[str, ...], held: int
) -> Iterator[dict]:
    """Nodes with their totals. ``rows`` come group by group in reverse level order, and by
    ``own`` within a level. Open nodes keep what closed children sent and send nothing."""
    at, queue = None, SpillingQueue(held)
    for row in rows:
        if at != (now := tuple(row[c] for c in group)):
            at, queue = now, SpillingQueue(held)
        n, least, children, leaves, saved = (row[c] for c in ("n", "least", "children", "leaves", "saved"))
        for more, smaller, below, tokens in queue.taken((-row["depth"], *(row[c] for c in own))):
            n, least, children, leaves, saved = n + more, min(least, smaller), children + 1, leaves + below, saved + tokens
        if not row["open"]:
            children, leaves, saved = children + row["x_children"], leaves + row["x_leaves"], saved + row["x_saved"]
            if not children and not row["goes_on"]:
                leaves = 1
            saved += (n - 1) * row["words"]
            if not row["root"]:
                queue.push((1 - row["depth"], *(row[c] for c in parent)), (n, least, leaves, saved))
        yield row | {"n": n, "least": least, "children": children, "leaves": leaves, "saved": saved}


_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def _batched(rows: Iterator[dict], schema: str) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in schema.split(", ")]

    def batch(some: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[n] for r in some], _ARROW[t]) for n, t in fields], names=[n for n, _ in fields]
        )

    some: list[dict] = []
    for row in rows:
        some.append(row)
        if len(some) == 4096:
            yield batch(some)
            some = []
    if some:
        yield batch(some)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _streamed(df: DataFrame, step: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    return df.mapInArrow(lambda batches: _batched(step(_listed(batches)), schema), schema)


def _digests(conversations: DataFrame) -> DataFrame:
    """conv, turn, the two halves of the digest of role and text, and the words of the text."""

    def each(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            role, text = (row["role"] or "").encode(), (row["text"] or "").encode()
            digest = xxhash.xxh3_128_digest(b"%d:" % len(role) + role + text)
            yield {
                "conv": row["conv_id"],
                "turn": row["turn"],
                "one": int.from_bytes(digest[:8], "big", signed=True),
                "two": int.from_bytes(digest[8:], "big", signed=True),
                "words": len(text.split()),
            }

    source = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.col("role").cast("string"),
        F.col("text").cast("string"),
    ).where("conv_id IS NOT NULL")
    return _streamed(source, each, "conv long, turn long, one long, two long, words long")


def _numbered(digests: DataFrame) -> DataFrame:
    """Turns with their number in their range's part (chunk) of the conversation, from 1."""
    order = ["conv", "turn", "one", "two"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, chunk = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = np.asarray(batch.column(0)).astype(np.int64)
            edges = np.concatenate(([0], np.flatnonzero(conv[1:] != conv[:-1]) + 1, [len(conv)]))
            nth = np.arange(1, len(conv) + 1) - np.repeat(edges[:-1], np.diff(edges))
            if conv[0] == last:
                nth[: edges[1]] += count
            last, count = int(conv[-1]), int(nth[-1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv", "one", "two", "words")), pa.array([chunk] * len(conv), pa.int32()), pa.array(nth)],
                names=["conv", "one", "two", "words", "chunk", "nth"],
            )

    return (
        digests.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(number, "conv long, one long, two long, words long, chunk int, nth long")
    )


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations (conv, pos from 1, one, two, words, length), and
    the conversations (conv, length)."""
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    chunks = durable(
        turns.groupBy("conv", "chunk")
        .agg(F.max("nth").alias("n"))
        .select(
            "conv",
            "chunk",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
            F.sum("n").over(whole).alias("own"),
        ),
        "conversation-chunks",
    )
    sizes = chunks.groupBy("conv").agg(F.max("own").alias("own"))
    base, heads = F.col("conv") - F.col("conv") % GROUP, F.crc32(F.col("conv").cast("string")) % HEADS
    plans = sizes.select("conv", "own", base.alias("base"), heads.alias("heads")).join(
        sizes.select(F.col("conv").alias("base"), F.col("own").alias("base_own")).hint("merge"), "base", "left"
    )
    head = F.least("heads", F.coalesce("base_own", F.lit(0)))
    plans = durable(
        plans.withColumn("head", head).withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("heads"), F.lit(0))),
        "conversation-plans",
    )
    # One row for each part of a conversation, so a very long one is joined part by part.
    parts = chunks.join(plans.drop("own").hint("merge"), "conv")
    placed = turns.join(parts.hint("merge"), ["conv", "chunk"]).withColumn("at", F.col("before") + F.col("nth"))
    later = placed.where(F.col("at") > F.col("heads")).select(
        "conv", (F.col("at") - F.col("heads") + F.col("head")).alias("pos"), "one", "two", "words", "length"
    )
    first = placed.where((F.col("at") < HEADS) & (F.col("conv") == F.col("base"))).select(
        F.col("conv").alias("base"), "at", "one", "two", "words"
    )
    shared = (
        plans.join(first.hint("merge"), "base")
        .where(F.col("at") <= F.col("head"))
        .select("conv", F.col("at").alias("pos"), "one", "two", "words", "length")
    )
    return later.union(shared), plans.select("conv", "length")


def _fragments(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per conversation and block of turns: the digests and words of its turns, two sums that
    add up to hashes of prefixes, and whether the conversation ends with it."""
    keys, turns = ["conv", "block"], TURNS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key, some) -> dict:
            sums = [
                _signed(sum(r[c] * pow(b, r["pos"], _WORD) for r in some)) for c, b in zip(("one", "two"), _BASES)
            ]
            return {
                "conv": key[0],
                "block": key[1],
                "path": b"".join(r[c].to_bytes(8, "big", signed=True) for r in some for c in ("one", "two")),
                "words": np.array([r["words"] for r in some], dtype=np.int64).tobytes(),
                "sum1": sums[0],
                "sum2": sums[1],
                "ends": some[-1]["pos"] == some[-1]["length"],
                "length": some[-1]["length"],
            }

        def gathered() -> Iterator[dict]:
            at, some = None, []
            for r in _listed(batches):
                if at != (now := (r["conv"], r["block"])):
                    if some:
                        yield row(at, some)
                    at, some = now, []
                some.append(r)
            if some:
                yield row(at, some)

        yield from _batched(gathered(), _FRAGMENT)

    packed = (
        rows.withColumn("block", F.floor((F.col("pos") - 1) / turns).cast("long"))
        .repartition(*keys)
        .sortWithinPartitions(*keys, "pos")
        .mapInArrow(pack, _FRAGMENT)
    )
    nothing = F.lit(b"")
    turnless = conversations.where("length = 0").select(
        "conv",
        F.lit(0).cast("long").alias("block"),
        nothing.alias("path"),
        nothing.alias("words"),
        F.lit(0).cast("long").alias("sum1"),
        F.lit(0).cast("long").alias("sum2"),
        F.lit(True).alias("ends"),
        "length",
    )
    return packed.union(turnless)


_FRAGMENT = (
    "conv long, block long, path binary, words binary, sum1 long, sum2 long, ends boolean, length long"
)
_PREFIXES = "conv long, block long, c1 long, c2 long, o1 long, o2 long, u1 long, u2 long, t1 long, t2 long"


def _prefixed(fragments: DataFrame) -> DataFrame:
    """Fragments with the hashes of what comes before (c), of that and the fragment (o), of
    what comes before the fragment before (u), and of the first block (t); zero is nothing."""

    def add(rows: Iterator[dict]) -> Iterator[dict]:
        conv, seen, top = None, (0, 0), (0, 0)
        up = seen
        for r in rows:
            if r["conv"] != conv:
                conv, seen, up, top = r["conv"], (0, 0), (0, 0), (0, 0)
            after = _signed(seen[0] + r["sum1"]), _signed(seen[1] + r["sum2"])
            top = top if r["block"] else after
            yield dict(zip([f.split()[0] for f in _PREFIXES.split(", ")], (conv, r["block"], *seen, *after, *up, *top)))
            up, seen = seen, after

    long = fragments.where(F.col("length") > TURNS).select("conv", "block", "sum1", "sum2")
    prefixes = _streamed(long.repartition("conv").sortWithinPartitions("conv", "block"), add, _PREFIXES)
    with_prefixes = fragments.drop("sum1", "sum2", "length").join(prefixes.hint("merge"), ["conv", "block"], "left")
    return with_prefixes.na.fill(0, ["c1", "c2", "o1", "o2", "u1", "u2", "t1", "t2"])


_KNOWN = "block long, c1 long, c2 long, depth long, k1 long, k2 long, p1 long, p2 long, words long, root boolean"
_SUMS = "n long, least long, children long, leaves long, saved long"
_BELOW = "goes_on boolean, x_children long, x_leaves long, x_saved long"
_NODE = f"shard int, node long, parent long, {_KNOWN}, {_SUMS}, {_BELOW}, open boolean, ends string, named binary"


class _Trie:
    """Turns the sorted fragments of a shard into nodes, each given when its subtree ends."""

    def __init__(self, shard: int, turns: int):
        self.shard, self.turns, self.stack, self.nodes = shard, turns, [], 0
        self.trie, self.path, self.first = None, None, True

    def _push(self, depth: int, k: tuple[int, int], words: int) -> None:
        above = self.stack[-1] if self.stack else None
        self.nodes += 1
        block, c1, c2 = self.trie
        node = {"shard": self.shard, "node": self.nodes, "parent": above["node"] if above else 0}
        node |= {"block": block, "c1": c1, "c2": c2, "depth": depth, "k1": k[0], "k2": k[1], "words": words}
        node |= {"p1": above["k1"] if above else 0, "p2": above["k2"] if above else 0, "root": above is None}
        node |= {"n": 0, "least": _NOBODY, "children": 0, "leaves": 0, "saved": 0}
        node |= {"goes_on": False, "x_children": 0, "x_leaves": 0, "x_saved": 0}
        # A root, and what the shard's first path passes, may be elsewhere too.
        self.stack.append(node | {"open": above is None or self.first, "named": bytearray()})

    def _pop(self, to: int, last: bool) -> Iterator[dict]:
        while len(self.stack) > to:
            node = self.stack.pop()
            node["open"] |= last
            named = bytes(node["named"])
            yield node | {
                "ends": None if node["open"] else hashlib.sha256(named).hexdigest(),
                "named": named if node["open"] else None,
            }

    def of(self, rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            trie, path = (r["block"], r["c1"], r["c2"]), r["path"]
            if trie != self.trie:
                self.first = self.trie is None
                yield from self._pop(0, False)
                self.trie, self.path = trie, b""
                self._push(r["block"] * self.turns, (r["c1"], r["c2"]), 0)
                self._grow(path, r["words"], 0)
            elif path != self.path:
                self.first = False
                same = len(os.path.commonprefix([path, self.path])) // 16
                yield from self._pop(same + 1, False)
                self._grow(path, r["words"], same)
            self.path = path
            node = self.stack[-1]
            node["n"] += 1
            node["least"] = min(node["least"], r["conv"])
            if r["ends"]:
                node["named"] += b",%d" % r["conv"] if node["named"] else b"%d" % r["conv"]
            else:
                node |= {"goes_on": True} | {c: r[c] for c in ("x_children", "x_leaves", "x_saved")}
        yield from self._pop(0, True)

    def _grow(self, path: bytes, words: bytes, same: int) -> None:
        counts = np.frombuffer(words, dtype=np.int64).tolist()
        for i in range(same, len(counts)):
            above = self.stack[-1]
            depth = above["depth"] + 1
            halves = (int.from_bytes(path[16 * i + a : 16 * i + a + 8], "big", signed=True) for a in (0, 8))
            k = [
                _signed(above[c] + half * pow(base, depth, _WORD)) for c, half, base in zip(("k1", "k2"), halves, _BASES)
            ]
            self._push(depth, (k[0], k[1]), counts[i])


def _solved(fragments: DataFrame, held: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of the shards, and the open nodes as they are over all shards."""
    order, turns = ["block", "c1", "c2", "path", "conv"], TURNS

    def grow(rows: Iterator[dict]) -> Iterator[dict]:
        yield from _Trie(TaskContext.get().partitionId(), turns).of(rows)

    def within(rows: Iterator[dict]) -> Iterator[dict]:
        yield from forwarded(rows, ("shard",), ("node",), ("parent",), held)

    columns = [*order, "words", "ends", "x_children", "x_leaves", "x_saved"]
    sorted_fragments = fragments.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    levels = _streamed(sorted_fragments, grow, _NODE).sortWithinPartitions("shard", F.col("depth").desc(), "node")
    nodes = durable(_streamed(levels, within, _NODE), "trie-nodes")
    keys = [f.split()[0] for f in _KNOWN.split(", ")]
    merged = (
        nodes.where("open")
        .groupBy(*keys)
        .agg(
            *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
            F.min("least").alias("least"),
            *[F.max(c).alias(c) for c in ("goes_on", "x_children", "x_leaves", "x_saved")],
        )
        .withColumn("open", F.lit(False))
    )

    def across(rows: Iterator[dict]) -> Iterator[dict]:
        yield from forwarded(rows, ("block", "c1", "c2"), ("k1", "k2"), ("p1", "p2"), held)

    tries = ["block", "c1", "c2"]
    levels = merged.repartition(*tries).sortWithinPartitions(*tries, F.col("depth").desc(), "k1", "k2")
    return nodes, durable(_streamed(levels, across, f"{_KNOWN}, {_SUMS}"), "trie-open-nodes")


def _below(fragments: DataFrame, held: int) -> DataFrame:
    """For the last node of each fragment that goes on: children, and leaves and saved
    tokens below it (x_ columns), by block and hash of the tries that begin there."""
    later = fragments.where("block > 0").withColumns({c: F.lit(0).cast("long") for c in ("x_children", "x_leaves", "x_saved")})
    _, solved = _solved(later, held)
    above = later.groupBy("block", "c1", "c2").agg(*[F.first(c).alias(c) for c in ("u1", "u2", "t1", "t2")])
    tree = (
        solved.where("root")
        .join(above.hint("merge"), ["block", "c1", "c2"])
        .select(
            *["t1", "t2", "block", "c1", "c2", "u1", "u2"],
            F.col("block").alias("depth"),
            (F.col("block") == 1).alias("root"),
            F.col("children").alias("own"),
            F.lit(1).cast("long").alias("n"),
            F.lit(0).cast("long").alias("least"),
            *["children", "leaves", "saved"],
            F.lit(0).cast("long").alias("words"),
            F.lit(False).alias("open"),
            F.lit(True).alias("goes_on"),
            *[F.lit(0).cast("long").alias(c) for c in ("x_children", "x_leaves", "x_saved")],
        )
    )

    def across(rows: Iterator[dict]) -> Iterator[dict]:
        yield from forwarded(rows, ("t1", "t2"), ("c1", "c2"), ("u1", "u2"), held)

    levels = tree.repartition("t1", "t2").sortWithinPartitions("t1", "t2", F.col("depth").desc(), "c1", "c2")
    totals = _streamed(levels, across, "block long, c1 long, c2 long, own long, leaves long, saved long")
    return durable(
        totals.select(
            (F.col("block") - 1).alias("block"),
            F.col("c1").alias("o1"),
            F.col("c2").alias("o2"),
            F.col("own").alias("x_children"),
            F.col("leaves").alias("x_leaves"),
            F.col("saved").alias("x_saved"),
        ),
        "trie-below",
    )


def _named(open_nodes: DataFrame) -> DataFrame:
    """The hash of all members that end at an open node, its shards' parts in their order."""
    keys = ["depth", "k1", "k2"]

    def digest(rows: Iterator[dict]) -> Iterator[dict]:
        at, running, some = None, None, False
        for r in rows:
            if at != (now := tuple(r[k] for k in keys)):
                if at is not None:
                    yield dict(zip(keys, at)) | {"ends": running.hexdigest()}
                at, running, some = now, hashlib.sha256(), False
            running.update(b"," + r["named"] if some else r["named"])
            some = True
        if at is not None:
            yield dict(zip(keys, at)) | {"ends": running.hexdigest()}

    parts = open_nodes.where(F.octet_length("named") > 0).select(*keys, "shard", "named")
    levels = parts.repartition(*keys).sortWithinPartitions(*keys, "shard")
    return _streamed(levels, digest, "depth long, k1 long, k2 long, ends string")


def prefix_trie(conversations: DataFrame, held: int = HELD) -> DataFrame:
    """Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves and saved_tokens (of its subtree), and ends_sha256 (of the members that end)."""
    turns = durable(_numbered(_digests(conversations)), "conversation-turns")
    rows, lengths = _rebuilt(turns)
    fragments = durable(_prefixed(durable(_fragments(rows, lengths), "conversation-fragments")), "trie-fragments")
    x = ["x_children", "x_leaves", "x_saved"]
    if fragments.where("block > 0").isEmpty():
        fragments = fragments.withColumns({c: F.lit(0).cast("long") for c in x})
    else:
        # The tries of a block begin at the last nodes of the block before.
        fragments = fragments.join(
            _below(fragments, held).hint("merge"), ["block", "o1", "o2"], "left"
        ).na.fill(0, x)
    nodes, solved = _solved(fragments, held)
    # The root of a later block's tries is the last node of a fragment before; it counts there.
    kept = solved.where("block = 0 OR NOT root")
    keys = ["depth", "k1", "k2"]
    named = _named(nodes.where("open"))
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    closed = nodes.where("NOT open")
    # The smallest member of whatever may be a parent outside its children's shard: an open
    # node, or a fragment's last node, below which a later block's trie hangs.
    member = ["depth", "k1", "k2", "least"]
    members = durable(kept.select(*member).union(closed.where("goes_on").select(*member)), "trie-members")
    of_parent = members.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("parent_conv_id")
    )
    of_open = kept.join(named.hint("merge"), keys, "left").join(of_parent.hint("merge"), ["depth", "p1", "p2"], "left")
    in_shard = ["shard", F.col("node").alias("parent"), F.col("least").alias("parent_conv_id")]
    open_here = nodes.where("open").drop("least").join(members.hint("merge"), keys).select(*in_shard)
    of_closed = closed.join(closed.select(*in_shard).union(open_here).hint("merge"), ["shard", "parent"])
    columns = [
        F.col("least").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", nobody).alias("ends_sha256"),
    ]
    return of_open.select(*columns).union(of_closed.select(*columns))
