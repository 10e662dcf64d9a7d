"""SimHash near-duplicates by sharded BK-trees.

A document's fingerprint takes each bit from the majority of its shingles' hashes. Two
fingerprints within ``radius`` bits agree on at least two of radius + 2 pieces of the 64
bits, so distinct fingerprints are dealt into shards by every pair of pieces, and a
shard's members form BK-trees: children are keyed by their Hamming distance to the
parent, and a search follows the edges within ``radius`` of the query's distance. A shard
with more than ``tree_nodes`` members is cut into trees of at most about that many; each
member is then sent to every tree of its shard as a query, so no link is lost and no tree
is unbounded. Trees are built where their queries are instead of being broadcast, because
together they are as large as the set of fingerprints.

A shard reports a spanning forest of its links, which connects what all its links would
connect; components are then joined across shards.

Defined cases: null and blank texts have fingerprint 0, which is linked like any other;
texts with fewer words than a shingle are one shingle; a null doc_id counts for no
component id; repeated rows are copies; an empty table gives no rows. Where one row of a
group is kept, rows that share a doc_id but not a text are judged apart, in the order of a
hash of their text, and rows without doc_id come after all others, in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.components import rooted
from ledgerweave.llm.text import lower_bytes
from ledgerweave.sources.durable import durable, settled

SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    words = lower_bytes((text or "").encode()).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(first), _CHUNK):
        part = b"".join(
            [digest(joined[a:b], SEED) for a, b in zip(first[at : at + _CHUNK], last[at : at + _CHUNK])]
        )
        bits = np.unpackbits(np.frombuffer(part, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, tie (a hash of the text) and fp, the fingerprint as a signed number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(prints, pa.int64())], names=["doc_id", "tie", "fp"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text").mapInArrow(
        each, "doc_id long, tie long, fp long"
    )


class BKTree:
    """A BK-tree of 64-bit values under Hamming distance, held in arrays."""

    def __init__(self, values: np.ndarray):
        self.values = values
        slots: dict[tuple[int, int], int] = {}
        plain = values.tolist()
        for node in range(1, len(plain)):
            value, at = plain[node], 0
            while True:
                key = (at, (value ^ plain[at]).bit_count())
                below = slots.get(key)
                if below is None:
                    slots[key] = node
                    break
                at = below
        # Children in the order of (parent, distance to the parent).
        keys = np.array([p * 65 + d for p, d in slots], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.children = np.fromiter(slots.values(), dtype=np.int64, count=len(slots))[order]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, node) at most ``radius`` apart, one level at a time."""
        query = np.arange(len(queries))
        node = np.zeros(len(queries), dtype=np.int64)
        while len(query):
            distance = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            yield query[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.keys, node * 65 + np.minimum(distance + radius, 64), "right")
            n = high - low
            query = np.repeat(query, n)
            ahead = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            node = self.children[ahead]


class _Forest:
    """Components of a shard's values, and the links that made them."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.root[a], self.root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        _, one = np.unique(ra * len(self.root) + rb, return_index=True)
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for x, y, i in zip(ra[one].tolist(), rb[one].tolist(), one.tolist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                self.links.append((int(a[i]), int(b[i])))
        if up:
            final = {x: find(x) for x in up}
            change = np.arange(len(self.root))
            change[list(final)] = list(final.values())
            self.root = change[self.root]


# Queries that descend a tree together.
_QUERIES = 512


def shard_links(values: np.ndarray, members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between a shard's values and its tree's members."""
    place = np.flatnonzero(members)
    if len(place) == 0 or len(values) < 2:
        return []
    unsigned = values.view(np.uint64)
    tree = BKTree(unsigned[place])
    forest = _Forest(len(values))
    for at in range(0, len(values), _QUERIES):
        for query, node in tree.within(unsigned[at : at + _QUERIES], radius):
            forest.add(query + at, place[node])
    return [(int(values[a]), int(values[b])) for a, b in forest.links]


def _shard_keys(radius: int):
    """A key for every pair of pieces: the pair's number and the bits of both pieces."""
    pieces = radius + 2
    edges = [64 * i // pieces for i in range(pieces + 1)]

    def piece(i: int):
        width = edges[i + 1] - edges[i]
        return F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << width) - 1))

    return F.array(
        *[
            F.struct(F.lit(k).alias("pair"), piece(i).alias("low"), piece(j).alias("high"))
            for k, (i, j) in enumerate(combinations(range(pieces), 2))
        ]
    )


def links(prints: DataFrame, radius: int = 3, tree_nodes: int = 4096) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``radius`` bits that connect the same
    fingerprints as all such pairs. ``prints`` holds each fingerprint once, as fp."""
    spread = prints.select("fp", F.explode(_shard_keys(radius)).alias("key")).select("fp", "key.*")
    on = ["pair", "low", "high"]
    sizes = spread.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")
    trees = F.ceil(F.col("n") / tree_nodes).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(10)), F.col("trees"))
    dealt = (
        spread.join(sizes.hint("merge"), on)
        .withColumn("trees", trees)
        .withColumn("own", own)
        .select(*on, "fp", "own", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
        .select(*on, "tree", "fp", (F.col("own") == F.col("tree")).alias("member"))
        .repartition(*on, "tree")
        .sortWithinPartitions(*on, "tree", "fp")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # The last shard of a batch may go on in the next.
            if batch.num_rows:
                cut = _last_change(batch)
                if held and cut == 0 and _same(held[-1], batch):
                    held.append(batch)
                    continue
                if held and not _same(held[-1], batch):
                    yield from _linked(pa.Table.from_batches(held), radius)
                    held = []
                if cut:
                    yield from _linked(pa.Table.from_batches([*held, batch.slice(0, cut)]), radius)
                    held = []
                held.append(batch.slice(cut))
        if held:
            yield from _linked(pa.Table.from_batches(held), radius)

    return dealt.mapInArrow(search, "a long, b long")


def _codes(columns: list) -> np.ndarray:
    return np.stack([np.asarray(c).astype(np.int64) for c in columns])


def _last_change(batch: pa.RecordBatch) -> int:
    """Row at which the last shard of the batch begins."""
    codes = _codes([batch.column(i) for i in range(4)])
    change = np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0))
    return int(change[-1]) + 1 if len(change) else 0


def _same(before: pa.RecordBatch, batch: pa.RecordBatch) -> bool:
    return all(before.column(i)[-1] == batch.column(i)[0] for i in range(4))


def _linked(table: pa.Table, radius: int) -> Iterator[pa.RecordBatch]:
    codes = _codes([table.column(i) for i in range(4)])
    values = np.asarray(table.column(4)).astype(np.int64)
    members = np.asarray(table.column(5)).astype(bool)
    edges = np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1
    found: list[tuple[int, int]] = []
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(values)]):
        if high - low == 2 and members[low] and members[low + 1]:
            a, b = int(values[low]), int(values[low + 1])
            if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius:
                found.append((a, b))
        else:
            found += shard_links(values[low:high], members[low:high], radius)
    if found:
        a, b = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _components(prints: DataFrame, first: Column, radius: int, tree_nodes: int) -> DataFrame:
    """class_fp and component_id of every fingerprint: the least ``first`` that links lead to."""
    nodes = durable(prints.groupBy("fp").agg(F.min(first).alias("first")), "simhash-nodes")
    roots = durable(
        rooted(links(nodes.select("fp"), radius, tree_nodes)).select(F.col("node").alias("fp"), "root"),
        "simhash-roots",
    )
    placed = nodes.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(least.hint("merge"), "root").select(F.col("fp").alias("class_fp"), "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, tree_nodes: int = 4096) -> DataFrame:
    """Per document: doc_id, fp and component_id, the least doc_id that links lead to."""
    prints = durable(fingerprints(docs, shingle).drop("tie"), "simhash-prints")
    classes = settled(
        docs.sparkSession,
        "simhash-classes",
        lambda: _components(prints, F.col("doc_id"), radius, tree_nodes),
    )
    return prints.join(classes.hint("merge"), F.col("fp") == F.col("class_fp")).select(
        "doc_id", "fp", "component_id"
    )


def one_of_each_group(
    docs: DataFrame, shingle: int = 3, radius: int = 3, tree_nodes: int = 4096
) -> DataFrame:
    """The rows, all columns unchanged, of each group's first document: the one with the
    least doc_id, then the least hash of the text; rows without doc_id come last. Of rows
    that agree in doc_id and text one stays."""
    place = {"__lw_none": F.col("doc_id").isNull(), "__lw_doc": F.coalesce("doc_id", F.lit(0)), "__lw_tie": F.col("tie")}

    def firsts() -> DataFrame:
        prints = durable(fingerprints(docs, shingle), "simhash-prints")
        rank = F.struct(*[c.alias(name) for name, c in place.items()])
        return _components(prints, rank, radius, tree_nodes).select("component_id.*").distinct()

    stay = settled(docs.sparkSession, "simhash-first", firsts)
    # Equal rows are cut down before the shuffle, which the join then needs no more of.
    own = {"__lw_none": F.col("doc_id").isNull(), "__lw_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}
    own["__lw_tie"] = F.xxhash64("text")
    row = F.row_number().over(Window.partitionBy(*place).orderBy(*place))
    single = docs.withColumns(own).withColumn("__lw_row", row).where("__lw_row = 1")
    return single.join(stay.hint("merge"), list(place), "left_semi").select(*docs.columns)
