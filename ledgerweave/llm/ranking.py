"""Ranked lexical search by dense blocked matrix multiplication.

A term is a run of ASCII letters, digits and anything outside ASCII, A-Z in lower case. A
document's impact for a term is an integer that grows with the term's share of the document;
an item's weight for a term is the term's rarity times its repeats in the item; the score is
the sum of their products over the item's terms.

Items are taken in blocks of bounded bytes, so neither the driver nor a task ever holds more
than one block. For each block all documents are read once: tiles of documents keep the
counts of the block's terms, which is all that scoring needs, in a table in the shared
folder. The statistics (documents with terms, terms in all, documents per term) come from
the tiles. Then each tile of documents becomes a dense matrix of impacts for every compact
vocabulary tile of every item tile, and is multiplied with the items' weights.

The product is exact: impacts are below 10^6, and a vocabulary tile is closed before any
item's weights in it reach 2^53 / 10^6, so every partial sum is an integer below 2^53; tiles
are added up as 64-bit integers. A weight that is too large for one tile goes on in the next.

A task keeps the best documents of every item. Whatever equals the last kept score stays
until documents are compared by doc_id, so ties are safe at the edge of a tile.

Defined cases: a null or termless document counts for nothing and is never ranked; a
null or termless item has no rows; items that share an id are ranked each on their own; equal
scores go by doc_id, null last; repeated rows are ranked each; no documents, or no items,
give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.bundles import Bundle, bundled
from ledgerweave.sources.durable import durable

BEST = 20
ITEM_BYTES = 1 << 20
# Rows of a tile of documents and of items, and columns of a vocabulary tile.
TILE_DOCS, TILE_ITEMS, TILE_TERMS = 512, 256, 2048
# Term counts of a tile of documents.
TILE_ENTRIES = 1 << 20
# Impacts are below this; so are a vocabulary tile's weights times it below 2^53.
MOST_IMPACT = 10**6
MOST_WEIGHT = 2**53 // MOST_IMPACT - 1

_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(data: bytes) -> list[bytes]:
    return data.translate(_TERM_BYTES).split()


class ItemBlock:
    """The items of a block and their terms, numbered."""

    def __init__(self, bundle: Bundle):
        texts = [bundle.data[a:b] for a, b in zip(bundle.starts.tolist(), bundle.ends.tolist())]
        counts = [Counter(terms(t)) for t in texts]
        self.ids = bundle.ids
        self.vocabulary = {t: k for k, t in enumerate(sorted(set().union(*counts)))}
        self.items = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        self.terms = np.array([self.vocabulary[t] for c in counts for t in c], dtype=np.int64)
        self.repeats = np.array([n for c in counts for n in c.values()], dtype=np.int64)

    def tiles(self, rarity: np.ndarray, most: int = MOST_WEIGHT) -> list[tuple[int, int, list]]:
        """First and end (exclusive) of every tile of items, with its vocabulary tiles: the
        terms of the columns, and item, column and weight of every entry."""
        out = []
        for low in range(0, len(self.ids), TILE_ITEMS):
            high = min(low + TILE_ITEMS, len(self.ids))
            inside = (self.items >= low) & (self.items < high)
            item, term = self.items[inside] - low, self.terms[inside]
            weight = self.repeats[inside] * rarity[term]
            out.append((low, high, _vocabulary_tiles(item, term, weight, high - low, most)))
        return out


def _vocabulary_tiles(item: np.ndarray, term: np.ndarray, weight: np.ndarray, n_items: int, most: int) -> list:
    order = np.argsort(term, kind="stable")
    order = order[weight[order] > 0]
    columns: list[tuple[int, np.ndarray, np.ndarray]] = []
    for part in np.split(order, np.flatnonzero(np.diff(term[order])) + 1) if len(order) else []:
        who, left = item[part], weight[part]
        while len(who):
            now = np.minimum(left, most)
            columns.append((int(term[part[0]]), who, now))
            who, left = who[left > now], (left - now)[left > now]
    tiles, held, sums = [], [], np.zeros(n_items, dtype=np.int64)

    def close() -> None:
        names = np.array([t for t, _, _ in held], dtype=np.int64)
        place = np.repeat(np.arange(len(held)), [len(w) for _, w, _ in held])
        tiles.append(
            (names, np.concatenate([w for _, w, _ in held]), place, np.concatenate([n for _, _, n in held]))
        )

    for name, who, now in columns:
        if held and (len(held) == TILE_TERMS or held[-1][0] == name or (sums[who] + now > most).any()):
            close()
            held, sums = [], np.zeros(n_items, dtype=np.int64)
        held.append((name, who, now))
        sums[who] += now
    if held:
        close()
    return tiles


_TILE = "ids array<long>, lengths array<long>, counts array<int>, packed binary"


def _document_tiles(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Documents that have terms, some hundreds a row: doc_id, number of terms, number of
    entries, and the entries (term and its count) of all, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, counts, names, times = [], [], [], [], []

        def row() -> pa.RecordBatch:
            entries = np.array([names, times], dtype=np.int32).tobytes()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int32())),
                    pa.array([zstandard.ZstdCompressor(level=1).compress(entries)], pa.binary()),
                ],
                names=["ids", "lengths", "counts", "packed"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = terms(text.as_py() or b"")
                if not words:
                    continue
                known = Counter(words)
                found = [(vocabulary[t], n) for t, n in known.items() if t in vocabulary]
                if ids and (len(ids) == TILE_DOCS or len(names) + len(found) > TILE_ENTRIES):
                    yield row()
                    ids, lengths, counts, names, times = [], [], [], [], []
                ids.append(doc_id.as_py())
                lengths.append(len(words))
                counts.append(len(found))
                names += [t for t, _ in found]
                times += [n for _, n in found]
        if ids:
            yield row()

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return source.mapInArrow(pack, _TILE)


def _entries(row: dict) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row["packed"]), dtype=np.int32).reshape(2, -1)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _statistics(tiles: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, terms of all documents, documents that hold each term. What
    comes to the driver is one number for each term of the block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders, n, total = np.zeros(n_terms, dtype=np.int64), 0, 0
        for batch in batches:
            for row in _rows(batch):
                holders += np.bincount(_entries(row)[0], minlength=n_terms)
                n += len(row["ids"])
                total += sum(row["lengths"])
        met = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*met.tolist(), -1, -2], pa.int64()), pa.array([*holders[met].tolist(), n, total], pa.int64())],
            names=["term", "n"],
        )

    sums = dict(tiles.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    holders = np.array([sums.get(t, 0) for t in range(n_terms)], dtype=np.int64)
    return sums.get(-1, 0), sums.get(-2, 0), holders


def rarity(n_docs: int, holders: np.ndarray) -> np.ndarray:
    return np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holders.tolist()], dtype=np.int64
    )


class _Best:
    """The best documents of every item, by score and then doc_id, null last."""

    def __init__(self, n_items: int, best: int):
        self.best, self.least = best, np.ones(n_items, dtype=np.int64)
        self.kept = [np.empty(0, dtype=np.int64) for _ in range(4)]
        self.new: list[tuple] = []

    def add(self, low: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """``scores``: one row a document, one column for each item from ``low`` on."""
        doc, item = np.nonzero(scores >= self.least[low : low + scores.shape[1]])
        if len(doc):
            self.new.append((item + low, scores[doc, item], missing[doc].astype(np.int64), ids[doc]))
            if sum(len(n[0]) for n in self.new) > (1 << 18):
                self.settle()

    def settle(self) -> list[np.ndarray]:
        item, score, missing, doc_id = (np.concatenate(parts) for parts in zip(self.kept, *self.new))
        order = np.lexsort((doc_id, missing, -score, item))
        rank = np.arange(len(item)) - np.searchsorted(item[order], item[order], "left")
        order, rank = order[rank < self.best], rank[rank < self.best]
        self.kept, self.new = [a[order] for a in (item, score, missing, doc_id)], []
        full = rank == self.best - 1
        self.least[self.kept[0][full]] = self.kept[1][full]
        return self.kept


_FOUND = "item int, item_id long, doc_id long, score long, task int"


def _searched(tiles: DataFrame, block: ItemBlock, n_docs: int, n_terms: int, weights: np.ndarray, best: int) -> DataFrame:
    """The best documents of every item in each task."""
    item_tiles, ids, size = block.tiles(weights), block.ids, len(weights)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Best(len(ids), best)
        for batch in batches:
            for row in _rows(batch):
                term, times = _entries(row).astype(np.int64)
                doc = np.repeat(np.arange(len(row["ids"])), row["counts"])
                damping = np.array([75 + 25 * n * n_docs // n_terms for n in row["lengths"]], dtype=np.int64)
                impact = 1_000_000_000 * times // (1000 * times + 12 * damping[doc])
                doc_ids = np.array([i or 0 for i in row["ids"]], dtype=np.int64)
                missing = np.array([i is None for i in row["ids"]], dtype=bool)
                for low, high, vocabulary in item_tiles:
                    scores = np.zeros((len(doc_ids), high - low), dtype=np.int64)
                    for names, item, column, weight in vocabulary:
                        place = np.full(size, -1, dtype=np.int64)
                        place[names] = np.arange(len(names))
                        inside = place[term] >= 0
                        left = np.zeros((len(doc_ids), len(names)))
                        left[doc[inside], place[term[inside]]] = impact[inside]
                        right = np.zeros((len(names), high - low))
                        right[column, item] = weight
                        scores += (left @ right).astype(np.int64)
                    top.add(low, scores, doc_ids, missing)
        item, score, missing, doc_id = top.settle()
        if len(item):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(item, pa.int32()),
                    pa.array([ids[i] for i in item.tolist()], pa.int64()),
                    pa.array(doc_id, pa.int64(), mask=missing.astype(bool)),
                    pa.array(score, pa.int64()),
                    pa.array([TaskContext.get().partitionId()] * len(item), pa.int32()),
                ],
                names=["item", "item_id", "doc_id", "score", "task"],
            )

    return tiles.mapInArrow(search, _FOUND)


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``best`` documents of each item."""
    spark = docs.sparkSession
    size = items.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    few = items.select(F.col("item_id").alias("doc_id"), "text").coalesce(max(1, -(-size // (64 * item_bytes))))
    blocks = bundled(few, item_bytes)
    found = []
    # One pass over the documents for each block; only numbers of blocks are listed here.
    for (number,) in blocks.select("bundle").orderBy("bundle").toLocalIterator():
        block = ItemBlock(Bundle.of(blocks.where(F.col("bundle") == number).first().asDict()))
        tiles = durable(_document_tiles(docs, block.vocabulary), "document-tiles")
        n_docs, n_terms, holders = _statistics(tiles, len(block.vocabulary))
        near = _searched(tiles, block, n_docs, n_terms, rarity(n_docs, holders), best)
        found.append(durable(near.withColumn("block", F.lit(number)), "ranking-candidates"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # A task has few rows for an item, but there may be very many tasks: groups of them first.
    groups = Window.partitionBy("block", "item", F.pmod("task", F.lit(64))).orderBy(*order)
    whole = Window.partitionBy("block", "item").orderBy(*order)
    return (
        reduce(DataFrame.union, found)
        .withColumn("rank", F.row_number().over(groups))
        .where(F.col("rank") <= best)
        .withColumn("rank", F.row_number().over(whole))
        .where(F.col("rank") <= best)
        .select("item_id", "rank", "doc_id", "score")
    )
