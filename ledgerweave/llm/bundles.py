"""Documents packed into bundles, and questions asked about all bundles at once.

A bundle holds the texts of some neighbouring documents, compressed, in one row of a table
in the shared folder. It is made without a shuffle, and it is the same in every later pass.
An operator that must know which of a bundle's hashes occur elsewhere asks by *cells*: the
bundle's distinct hashes, sorted and cut by value into parts, one row for each bundle and
part. A part gathers its cells from all bundles, finds the answer for every hash in them,
and sends each bundle an answer of the same order. A value that is in a third of all
documents is at most one entry per bundle, so no part is swamped by it; the number of parts
follows the number of words, so parts keep their size as the input grows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.text import word_bounds
from ledgerweave.sources.durable import durable

# Entries that a part holds, about.
PART_ENTRIES = 1 << 20

_BUNDLE = (
    "bundle long, n_words long, n_marked long, ids array<long>, flags array<boolean>, ends array<long>, "
    "packed binary"
)


@dataclass(frozen=True)
class Bundle:
    """Texts joined by a newline; ``ends`` are the ends of the texts, the newline left out."""

    ids: list
    flags: list
    ends: np.ndarray
    data: bytes

    @classmethod
    def of(cls, row: dict) -> Bundle:
        return cls(
            row["ids"],
            row["flags"],
            np.array(row["ends"], dtype=np.int64),
            zstandard.ZstdDecompressor().decompress(row["packed"]),
        )

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], self.ends[:-1] + 1))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and the number of words before each text (with the
        number of all words at the end)."""
        starts, ends = word_bounds(self.data)
        return starts, ends, np.append(np.searchsorted(starts, self.starts), len(starts))


def bundled(docs: DataFrame, size: int, fold: Callable[[bytes], bytes] = bytes, flag=None) -> DataFrame:
    """Bundles of about ``size`` bytes of text; a longer text is a bundle of its own. A
    null text is empty. ``flag`` is a boolean column that is kept with each document;
    n_words and n_marked count the words of all texts and of those with the flag."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, flags, texts, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            data = b"\n".join(texts)
            ends = np.cumsum([len(t) + 1 for t in texts]) - 1
            starts = word_bounds(data)[0]
            words = np.diff(np.searchsorted(starts, [0, *(ends + 1).tolist()]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([int(words.sum())], pa.int64()),
                    pa.array([int(words[np.array(flags, dtype=bool)].sum())], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([flags], pa.list_(pa.bool_())),
                    pa.array([ends], pa.list_(pa.int64())),
                    pa.array([zstandard.ZstdCompressor(level=3).compress(data)], pa.binary()),
                ],
                names=["bundle", "n_words", "n_marked", "ids", "flags", "ends", "packed"],
            )

        for batch in batches:
            for doc_id, mark, text in zip(*(batch.column(i) for i in range(3))):
                data = fold((text.as_py() or "").encode())
                if texts and held + len(data) > size:
                    yield row()
                    number += 1
                    ids, flags, texts, held = [], [], [], 0
                ids.append(doc_id.as_py())
                flags.append(mark.as_py())
                texts.append(data)
                held += len(data) + 1
        if texts:
            yield row()

    mark = F.lit(False) if flag is None else flag
    source = docs.select(F.col("doc_id").cast("long"), mark.alias("flag"), F.col("text").cast("string"))
    return durable(source.mapInArrow(pack, _BUNDLE), "bundles")


def parts_for(entries: float) -> int:
    return max(1, int(-(-entries // PART_ENTRIES)))


def part_slices(values: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """Part, first and end (exclusive) of the sorted values that belong to it."""
    bounds = np.array([(p << 64) // parts for p in range(1, parts)], dtype=np.uint64)
    cuts = [0, *np.searchsorted(values, bounds, "left").tolist(), len(values)]
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            yield part, a, b


def asked(
    bundles: DataFrame,
    questions: Callable[[dict], tuple[np.ndarray, np.ndarray | None]],
    parts: int,
) -> DataFrame:
    """One row for each bundle and part: the sorted distinct values of the bundle in that
    part and, where ``questions`` gives them, a number beside each."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                values, numbers = questions(row)
                cells = [
                    (
                        row["bundle"],
                        part,
                        values[a:b].tobytes(),
                        None if numbers is None else numbers[a:b].tobytes(),
                    )
                    for part, a, b in part_slices(values, parts)
                ]
                if cells:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(c, t)
                            for c, t in zip(zip(*cells), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))
                        ],
                        names=["bundle", "part", "cell", "numbers"],
                    )

    return bundles.mapInArrow(ask, "bundle long, part int, cell binary, numbers binary")


def answered(
    cells: DataFrame,
    answer: Callable[[list[np.ndarray], list], list[bytes]] | None,
    extra: Callable[[list[np.ndarray], list], bytes] | None = None,
) -> DataFrame:
    """bundle, part, answer: what ``answer`` gives for each cell of a part; ``extra`` may
    add one answer of the whole part, under bundle -1."""

    def reply(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        owners = table["bundle"].to_pylist()
        values = [np.frombuffer(c.as_buffer(), dtype=np.uint64) for c in table["cell"]]
        numbers = [None if not n.is_valid else np.frombuffer(n.as_buffer(), dtype=np.int64) for n in table["numbers"]]
        replies = [] if answer is None else answer(values, numbers)
        owners = owners if answer else []
        if extra is not None:
            owners.append(-1)
            replies.append(extra(values, numbers))
        return pa.table(
            {
                "bundle": pa.array(owners, pa.int64()),
                "part": pa.array([part] * len(owners), pa.int32()),
                "answer": pa.array(replies, pa.binary()),
            }
        )

    return cells.groupBy("part").applyInArrow(reply, "bundle long, part int, answer binary")


def in_several(values: list[np.ndarray], _numbers: list) -> list[bytes]:
    """For each value of each cell one bit: is it in another cell as well?"""
    together = np.concatenate(values)
    order = np.argsort(together, kind="stable")
    ranked = together[order]
    same = ranked[1:] == ranked[:-1]
    repeated = np.zeros(len(ranked), dtype=bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    flags = np.empty(len(ranked), dtype=bool)
    flags[order] = repeated
    cuts = np.cumsum([len(v) for v in values])[:-1]
    return [np.packbits(f).tobytes() for f in np.split(flags, cuts)]


def with_answers(bundles: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Bundles with an array of their answers, in the order of the parts."""
    lists = (
        answers.where("bundle >= 0")
        .groupBy("bundle")
        .agg(F.array_sort(F.collect_list(F.struct("part", "answer"))).alias(name))
        .withColumnRenamed("bundle", "__lw_bundle")
    )
    return bundles.join(lists.hint("merge"), F.col("bundle") == F.col("__lw_bundle"), "left").drop("__lw_bundle")


def bits_of(values: np.ndarray, parts: int, answers: list[dict] | None) -> np.ndarray:
    """The answers to the sorted ``values`` as booleans."""
    out = np.zeros(len(values), dtype=bool)
    by_part = {a["part"]: a["answer"] for a in answers or ()}
    for part, a, b in part_slices(values, parts):
        out[a:b] = np.unpackbits(np.frombuffer(by_part[part], dtype=np.uint8), count=b - a)
    return out
