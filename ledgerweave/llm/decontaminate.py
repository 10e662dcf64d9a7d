"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage by an error budget e that is a share of its length.
Cut into e + 1 pieces, at least one piece of a matching passage is unchanged, so an
Aho-Corasick automaton of all pieces finds every possible match in one pass over the text.
Around each piece hit, Myers' bit-parallel algorithm computes the least edit distance of
the whole item to any stretch of the text there.

Texts are compared in lower case with blanks folded to one space. An item of fewer than
``LEAST_CHARS`` characters after folding has no error budget and must stand between word
edges: no letter or digit right before or after it. Items are a stated query set: blocks of
items with a bounded number of characters are sent to all tasks, one block after the other,
and every block is matched against all documents; the driver holds one block at a time.

Defined cases: null and blank texts, and null and blank items, match nothing; repeated rows
of documents are judged each by itself; an item that occurs twice under one id is searched
under it twice; without documents or items there are no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.sources.durable import durable

# Shorter items are searched for as whole words without errors.
LEAST_CHARS = 20
# One error for so many characters.
CHARS_PER_ERROR = 16
# Characters of items in one block.
_BLOCK = 8 << 20


def folded(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, chars_per_error: int = CHARS_PER_ERROR) -> int:
    return length // chars_per_error if length >= LEAST_CHARS else 0


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their offsets."""
    n = len(item)
    cuts = [n * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """An item as bit masks for Myers' algorithm."""

    def __init__(self, item: str):
        self.length = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Least edit distance to any stretch of ``text``, and where the first such
        stretch ends. A column of the distance table is held as vertical steps of +1
        (``up``) and -1 (``down``)."""
        full = (1 << self.length) - 1
        top = 1 << (self.length - 1)
        up, down, score = full, 0, self.length
        best, at = score, 0
        masks = self.masks.get
        for i, c in enumerate(text, 1):
            equal = masks(c, 0)
            level = ((((equal & up) + up) ^ up) | equal | down) & full
            right_up = down | (full & ~(level | up))
            right_down = up & level
            if right_up & top:
                score += 1
            elif right_down & top:
                score -= 1
            right_up = (right_up << 1) & full
            right_down = (right_down << 1) & full
            up = right_down | (full & ~((equal | down) | right_up))
            down = right_up & (equal | down)
            if score < best:
                best, at = score, i
        return best, at


class Matcher:
    """A block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], chars_per_error: int):
        self.items = [(i, t, budget(len(t), chars_per_error)) for i, t in items]
        self.patterns: dict[int, Pattern] = {}
        spots: dict[str, list[tuple[int, int]]] = {}
        for number, (_, item, errors) in enumerate(self.items):
            for offset, piece in pieces(item, errors):
                spots.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in spots.items():
            self.automaton.add_word(piece, (len(piece), where))
        if spots:
            self.automaton.make_automaton()
        self.empty = not spots

    def matches(self, text: str | None) -> dict[int, tuple[int, int]]:
        """Item number to (distance, end) of its best match in the text."""
        out: dict[int, tuple[int, int]] = {}
        if self.empty or not text:
            return out
        plain = folded(text)
        done: dict[int, list[int]] = {}
        for last, (size, where) in self.automaton.iter(plain):
            for number, offset in where:
                if number in out and out[number][0] == 0:
                    continue
                start = last + 1 - size - offset
                _, item, errors = self.items[number]
                if len(item) < LEAST_CHARS:
                    beside = plain[max(0, start - 1) : start], plain[last + 1 : last + 2]
                    if not any(c.isalnum() for c in beside):
                        out[number] = (0, last + 1)
                    continue
                # A hit whose window lies inside one that was searched tells nothing new.
                if any(abs(start - s) <= errors for s in done.get(number, ())[-4:]):
                    continue
                done.setdefault(number, []).append(start)
                low = max(0, start - 2 * errors)
                pattern = self.patterns.get(number) or self.patterns.setdefault(number, Pattern(item))
                distance, end = pattern.best(plain[low : start + len(item) + 2 * errors])
                if distance <= errors and (number not in out or distance < out[number][0]):
                    out[number] = (distance, low + end)
        return out


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, folded, in blocks of at most about ``_BLOCK`` characters."""
    block: list[tuple[int, str]] = []
    held = 0
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        plain = folded(text)
        if not plain:
            continue
        if block and held + len(plain) > _BLOCK:
            yield block
            block, held = [], 0
        block.append((item_id, plain))
        held += len(plain)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """Pairs of a document and a test item found in it: doc_id, item_id, distance (edits),
    end (code points into the folded text)."""

    def search(block: list[tuple[int, str]]) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, chars_per_error)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                rows = [
                    (ids[i].as_py(), matcher.items[number][0], distance, end)
                    for i in range(batch.num_rows)
                    for number, (distance, end) in matcher.matches(texts[i].as_py()).items()
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                        names=["doc_id", "item_id", "distance", "end"],
                    )

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            each, "doc_id long, item_id long, distance int, end long"
        )

    blocks = item_blocks(items)
    found = [search(next(blocks, []))]
    for block in blocks:
        # What a block has found is stored before the next one is held.
        found[-1] = durable(found[-1], "contaminated")
        found.append(search(block))
    return reduce(DataFrame.union, found)


def without_contaminated(docs: DataFrame, items: DataFrame, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """The rows, all columns unchanged, in which no test item is found."""
    place = docs.columns.index("text")
    for number, block in enumerate(item_blocks(items)):
        if number:
            docs = durable(docs, "uncontaminated")

        def sift(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, chars_per_error)
            for batch in batches:
                clean = [not matcher.matches(t.as_py()) for t in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(sift, docs.schema)
    return docs
