"""Mixing sources to target weights by fixed-length blocks.

The words of each source, document after document, are cut into blocks of equal length
(the last may be shorter). A source's target says how many block slots it fills. The
slots of the mix are cut into output shards; a shard's source counts are drawn by a tree
of multinomial draws, each conditioned on what its parent still owes every source, so
shards are random mixtures and yet the totals are exact. A source's slot number goes
through a pseudorandom permutation of its block numbers (another one for each pass over
the source), and the blocks are joined by number.

Defined cases: a null text has no words and is never taken; a null source is a source of
its own, listed last; repeated rows are documents of their own; documents are laid out
by a hash of doc_id and text and then by doc_id, size and text hash, so equal input gives
an equal mix; an empty table gives an empty mix. A source's taken words differ from its
target by less than a block and a half: half a block because slots are whole, and a block
where the source's short last block is drawn or not. No block is drawn more often than the whole passes in
``cap`` (2), so no document exceeds ``cap`` times its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.text import WORD
from ledgerweave.sources.durable import durable

# Documents whose order is settled together when a source is laid out.
BUCKET_ROWS = 2_000


def sized(docs: DataFrame, with_text: bool = False) -> DataFrame:
    columns = [
        F.col("doc_id"),
        F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("tie"),
    ]
    return docs.select(*columns, *([F.col("text")] if with_text else []))


def source_targets(
    rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """One row per source: number, size, target. Weights repeat over the sources in code
    point order. Targets above ``cap`` times the size stop there and the excess goes to
    the others by weight: with sources sorted by the level at which they stop, the water
    level is the highest of the levels that each prefix of stopped sources would leave.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # One row per source, not per document.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_stop = Window.orderBy("stop", "source_no")
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights) + 1)
    most = F.lit(float(cap)) * F.col("source_size")
    ranked = (
        sums.withColumn("source_no", F.row_number().over(order) - 1)
        .withColumn("weight", weight)
        .withColumn("most", most)
        .withColumn("stop", F.col("most") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("before", F.sum("most").over(by_stop) - F.col("most"))
        .withColumn(
            "open_weight",
            F.sum("weight").over(everything) - F.sum("weight").over(by_stop) + F.col("weight"),
        )
        .withColumn("level", F.max((F.col("total") - F.col("before")) / F.col("open_weight")).over(everything))
    )
    target = F.least(F.col("most"), F.col("level") * F.col("weight"))
    return ranked.select("source", "source_no", "source_size", "n_docs", target.alias("target"))


def laid_out(rows: DataFrame, targets: DataFrame, counted: DataFrame) -> DataFrame:
    """``rows`` with source number and the first word's place in the source.
    ``counted`` holds the same rows without text and is used for the bucket sums, so no
    source is ever ordered in one task."""

    def bucketed(frame: DataFrame) -> DataFrame:
        parts = F.ceil(F.col("n_docs") / BUCKET_ROWS)
        return frame.join(
            targets.select(F.col("source").alias("known"), "source_no", "n_docs"),
            F.col("source").eqNullSafe(F.col("known")),
        ).select(
            *frame.columns,
            "source_no",
            F.pmod(F.xxhash64("doc_id", "tie"), parts).cast("long").alias("bucket"),
        )

    sums = bucketed(counted).groupBy("source_no", "bucket").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("source_no").orderBy("bucket")
    starts = sums.select("source_no", "bucket", (F.sum("held").over(before) - F.col("held")).alias("first"))
    within = Window.partitionBy("source_no", "bucket").orderBy(
        "doc_id", "size", "tie"
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        bucketed(rows)
        .withColumn("upto", F.sum("size").over(within))
        .join(starts, ["source_no", "bucket"])
        .withColumn("place", F.col("first") + F.col("upto") - F.col("size"))
        .drop("bucket", "upto", "first")
    )


def _split(counts: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """A multinomial draw of ``size`` slots that takes no more than ``counts`` holds."""
    total = int(counts.sum())
    taken = np.minimum(rng.multinomial(size, counts / total), counts)
    while (short := size - int(taken.sum())) > 0:
        room = counts - taken
        more = rng.multinomial(short, room / room.sum())
        taken = np.minimum(taken + more, counts)
    return taken


def shard_counts(
    counts: np.ndarray, shard: int, shards: int, slots: int, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """First slot and number of slots of each source in one shard, by walking down the
    tree of draws; every shard sees the same draws at the nodes it shares with others."""
    counts = counts.copy()
    first = np.zeros_like(counts)
    low, high = 0, shards
    total = int(counts.sum())
    while high - low > 1:
        middle = (low + high) // 2
        left = min(middle * slots, total) - min(low * slots, total)
        drawn = _split(counts, left, np.random.default_rng((seed, low, high)))
        if shard < middle:
            counts, high = drawn, middle
        else:
            first, counts, low = first + drawn, counts - drawn, middle
    return first, counts


def permuted(index: np.ndarray, size: int, key: tuple[int, ...]) -> np.ndarray:
    """Pseudorandom permutation of range(size) at ``index``: a four-round Feistel
    network over the next even power of two, walked until it lands inside the range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 2**64, 4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(size)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


_SLOT_SCHEMA = pa.schema(
    [("shard", pa.int64()), ("slot", pa.int64()), ("source_no", pa.int32()), ("block", pa.int64())]
)


def drawn_slots(
    targets: DataFrame, block_words: int = 128, shard_slots: int = 4096, seed: int = 17
) -> DataFrame:
    """One row per slot of the mix: shard, slot in the shard, source number, block.

    The driver sees one row per source (size and target), as many as there are sources
    to weigh; slots are made by the tasks, a range of shards each.
    """
    spark = targets.sparkSession
    rows = sorted(tuple(r) for r in targets.select("source_no", "source_size", "target").collect())
    sizes = np.array([r[1] for r in rows], dtype=np.int64)
    wanted = np.array([r[2] for r in rows], dtype=np.float64)
    blocks = -(-sizes // block_words)
    passes = np.where(sizes > 0, wanted // np.maximum(sizes, 1), 0).astype(np.int64)
    rest = np.rint((wanted - passes * sizes) / block_words).astype(np.int64)
    quota = passes * blocks + np.clip(rest, 0, blocks)
    shards = max(1, -(-int(quota.sum()) // shard_slots))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, counts = shard_counts(quota, shard, shards, shard_slots, seed)
                source, block = [], []
                for s in np.flatnonzero(counts):
                    slot = np.arange(first[s], first[s] + counts[s])
                    for p in np.unique(slot // blocks[s]):
                        own = slot[slot // blocks[s] == p] % blocks[s]
                        block.append(permuted(own, int(blocks[s]), (seed, int(s), int(p))))
                        source.append(np.full(len(own), s, dtype=np.int32))
                if not block:
                    continue
                sources, numbers = np.concatenate(source), np.concatenate(block)
                order = np.random.default_rng((seed, shards, shard)).permutation(len(numbers))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(numbers), shard, dtype=np.int64)),
                        pa.array(np.arange(len(numbers), dtype=np.int64)),
                        pa.array(sources[order]),
                        pa.array(numbers[order]),
                    ],
                    schema=_SLOT_SCHEMA,
                )

    return spark.range(shards).mapInArrow(draw, "shard long, slot long, source_no int, block long")


_PIECE = (
    "source_no int, block long, at int, place long, doc_id long, n_words int, text string"
)


def _mixed(
    counted: DataFrame,
    docs: DataFrame,
    targets: DataFrame,
    block_words: int,
    shard_slots: int,
    seed: int,
) -> DataFrame:
    """One row per slot: shard, slot, source_no, block and the block's pieces in order."""
    placed = laid_out(sized(docs, with_text=True), targets, counted)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in ("source_no", "block", "at", "place", "doc_id", "n_words", "text")}
            for row in batch.to_pylist():
                words = row["text"].encode().split()
                at, done = row["place"], 0
                while done < len(words):
                    block, inside = divmod(at + done, block_words)
                    part = words[done : done + block_words - inside]
                    values = (row["source_no"], block, inside, at, row["doc_id"], len(part), b" ".join(part).decode())
                    for name, value in zip(out, values):
                        out[name].append(value)
                    done += len(part)
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, type) for values, type in zip(out.values(), types)], names=list(out)
            )

    pieces = placed.where("size > 0").select(
        "source_no", "place", F.col("doc_id").cast("long").alias("doc_id"), "text"
    ).mapInArrow(cut, _PIECE)
    # A block has at most block_words words, so its list of pieces is bounded.
    parts = F.array_sort(F.collect_list(F.struct("at", "place", "doc_id", "n_words", "text")))
    blocks = pieces.groupBy("source_no", "block").agg(parts.alias("parts"))
    # The planner takes the slots for as few as the shards they come from.
    return drawn_slots(targets, block_words, shard_slots, seed).hint("merge").join(blocks, ["source_no", "block"])


def mixed_blocks(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 128,
    shard_slots: int = 4096,
    seed: int = 17,
) -> DataFrame:
    """The mix itself, one row per slot: shard, slot, source, block, n_words, doc_ids
    (those it has words of, in order) and text (words joined by one space)."""
    counted = durable(sized(docs), "mix-sizes")
    targets = durable(source_targets(counted, weights, share, cap), "mix-targets")
    return (
        _mixed(counted, docs, targets, block_words, shard_slots, seed)
        .join(targets.select("source_no", "source"), "source_no")
        .select(
            "shard",
            "slot",
            "source",
            "block",
            F.aggregate("parts", F.lit(0), lambda s, p: s + p["n_words"]).alias("n_words"),
            F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
            F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"),
        )
    )


def taken_words(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 128,
    shard_slots: int = 4096,
    seed: int = 17,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and the words of it that
    the mix takes, repeats counted, as found in the texts of the mixed blocks."""
    counted = durable(sized(docs), "mix-sizes")
    targets = durable(source_targets(counted, weights, share, cap), "mix-targets")
    pieces = _mixed(counted, docs, targets, block_words, shard_slots, seed).select("source_no", F.explode("parts").alias("p"))
    taken = pieces.groupBy(F.col("source_no").alias("t_no"), F.col("p.place").alias("t_place")).agg(
        F.sum(F.size(F.split("p.text", " "))).alias("t_words")
    )
    placed = laid_out(counted, targets, counted)
    return (
        placed.join(
            taken.hint("merge"),
            (F.col("source_no") == F.col("t_no")) & (F.col("place") == F.col("t_place")) & (F.col("size") > 0),
            "left",
        )
        .join(targets.select("source_no", "source_size", "target"), "source_no")
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            F.coalesce("t_words", F.lit(0)).cast("long").alias("taken"),
        )
    )
