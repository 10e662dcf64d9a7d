"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; a chunk ends where the hash has its upper bits
clear. Chunking is normalised: below the wanted size more bits must be clear, above it
fewer, so sizes gather around it. Boundaries depend on the bytes before them only, so
text that moves keeps its chunks. A fingerprint is the set of chunk digests with their
lengths, written digest+length in digest order; the likeness of two is the length-weighted
containment of the smaller in the larger.

Defined cases: a null text is empty and has the empty fingerprint; two empty fingerprints
are alike (1), an empty and another are not (0); the order of documents is doc_id (nulls
last), then text; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, WANTED, MOST = 32, 128, 512
_STRICT_BITS, _LOOSE_BITS = 8, 6

_GEAR = np.random.default_rng(2024).integers(0, 2**32, 256, dtype=np.uint32)
_STRICT = np.uint32(((1 << _STRICT_BITS) - 1) << (32 - _STRICT_BITS))
_LOOSE = np.uint32(((1 << _LOOSE_BITS) - 1) << (32 - _LOOSE_BITS))
# Bytes that are hashed at a time; the 31 bytes before them are taken along.
_STRIP = 1 << 20


def gear_hashes(data: bytes | memoryview) -> np.ndarray:
    """Gear hash at every byte: the sum of the last 32 bytes' gears, shifted by age.
    Adding a copy of the array shifted by 1, 2, 4, 8 and 16 builds it up."""
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; the last is its length."""
    size = len(data)
    strict, loose = [], []
    for at in range(0, size, _STRIP):
        lead = min(at, 31)
        h = gear_hashes(memoryview(data)[at - lead : at + _STRIP])[lead:]
        soft = np.flatnonzero((h & _LOOSE) == 0)
        loose.append(soft + at + 1)
        strict.append((h[soft] & _STRICT) == 0)
    if not loose:
        return []
    spots = np.concatenate(loose).tolist()
    hard = np.concatenate(strict).tolist()
    ends: list[int] = []
    start, k, n = 0, 0, len(spots)
    while size - start > LEAST:
        end = min(start + MOST, size)
        while k < n and spots[k] < start + LEAST:
            k += 1
        j = k
        while j < n and spots[j] < end:
            if hard[j] or spots[j] >= start + WANTED:
                end = spots[j]
                break
            j += 1
        ends.append(end)
        start, k = end, j
    if start < size:
        ends.append(size)
    return ends


def fingerprint(data: bytes) -> dict[bytes, int]:
    """Chunk digests and the bytes they stand for."""
    out: dict[bytes, int] = {}
    start = 0
    for end in boundaries(data):
        out[hashlib.blake2b(data[start:end], digest_size=6).digest()] = end - start
        start = end
    return out


def written(print_: dict[bytes, int]) -> str:
    return " ".join(f"{d.hex()}:{print_[d]:x}" for d in sorted(print_))


def likeness(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    if len(a) > len(b):
        a, b = b, a
    shared = sum(n for d, n in a.items() if d in b)
    return min(1.0, shared / min(sum(a.values()), sum(b.values())))


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as many code points of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


# Ranges at most; their bounds, 800 kB, are sent to every task. Ranges of a larger table
# hold more rows each, which are sorted on disk and read one at a time.
MOST_RANGES = 100_000


def _ranged(docs: DataFrame, range_rows: int) -> DataFrame:
    """Rows dealt into ranges of doc_id of about ``range_rows`` rows. The bounds are ids of
    the table, so the first document of a range is known by its id alone; it is dealt a
    second time, as the end of the range before it (``tail``), and the very first document
    as the end of the last range."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n, low = ids.agg(F.count("*"), F.min("doc_id")).first()
    parts = max(1, min(n // range_rows, MOST_RANGES))
    bounds = np.empty(0, dtype=np.int64)
    if low is not None and parts > 1:
        shares = [i / parts for i in range(1, parts)]
        found = ids.agg(F.percentile_approx("doc_id", shares, 10 * parts)).first()[0]
        bounds = np.array(sorted(set(found) - {low}), dtype=np.int64)
    last = len(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            absent = column.is_null().to_numpy(zero_copy_only=False)
            values = column.fill_null(0).to_numpy()
            place = np.where(absent, last, np.searchsorted(bounds, values, "right")).astype(np.int32)
            starts = np.isin(values, bounds) & ~absent
            first = absent if low is None else (values == low) & ~absent
            for rows, ranges, tail in (
                (None, place, False),
                (np.flatnonzero(starts), place[starts] - 1, True),
                (np.flatnonzero(first), np.full(int(first.sum()), last, dtype=np.int32), True),
            ):
                part = batch if rows is None else batch.take(pa.array(rows))
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ranges, pa.int32()),
                            pa.array(np.full(part.num_rows, tail)),
                            part.column(0),
                            part.column(1),
                        ],
                        names=["range", "tail", "doc_id", "text"],
                    )

    return (
        docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .mapInArrow(deal, "range int, tail boolean, doc_id long, text string")
        .repartition("range")
        .sortWithinPartitions("range", "tail", F.col("doc_id").asc_nulls_last(), "text")
    )


def compared_with_next(docs: DataFrame, range_rows: int = 4_000) -> DataFrame:
    """Per document: doc_id, n_chars, the digest of its edited text, the fingerprints of
    both, and the likeness of its fingerprint to the edited text's and to that of the next
    document (ascending doc_id; after the last comes the first).

    The text is shuffled once, into ranges of doc_id that are read in order, a row ahead.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        out: list[tuple] = []
        weight = 0
        for batch in batches:
            for i in range(batch.num_rows):
                range_, tail, doc_id, text = (batch.column(c)[i].as_py() for c in range(4))
                own = fingerprint(text.encode())
                if held is not None and held[0] == range_:
                    _, h_id, h_text, h_print = held
                    changed = edited(h_text, text)
                    data = changed.encode()
                    c_print = fingerprint(data)
                    out.append(
                        (
                            h_id,
                            len(h_text),
                            hashlib.sha256(data).hexdigest(),
                            written(h_print),
                            written(c_print),
                            likeness(h_print, c_print),
                            likeness(h_print, own),
                        )
                    )
                    weight += len(h_text)
                held = None if tail else (range_, doc_id, text, own)
                if weight > 4 << 20 or len(out) >= 5_000:
                    yield _batch(out)
                    out, weight = [], 0
        if out:
            yield _batch(out)

    return _ranged(docs, range_rows).mapInArrow(
        compare,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA
    )
