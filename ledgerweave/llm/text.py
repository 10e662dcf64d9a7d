"""Word splitting and hashing shared by the operators.

Words are runs of anything but the six ASCII blanks (space and 0x09 to 0x0D). None of
these bytes occurs inside a UTF-8 sequence, so words are found on the encoded text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Java and RE2 spelling of a word.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

# Longest word part that has a multiplier of its own; longer words reuse them in turn
# with a factor for each turn.
_SPAN = 256


def _odd(rng: np.random.Generator, n: int) -> np.ndarray:
    return rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


class _Family:
    """Fixed random multipliers of one 64-bit hash."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.letter = _odd(rng, 256)
        self.place = _odd(rng, _SPAN)
        self.turn = int(_odd(rng, 1)[0])
        self.base = int(_odd(rng, 1)[0])


_FAMILIES = {seed: _Family(seed) for seed in (1, 2)}


def lower_ascii(column: Column) -> Column:
    return F.translate(column, _UPPER, _UPPER.lower())


def lower_bytes(data: bytes) -> bytes:
    return data.translate(_LOWER_TABLE)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word."""
    solid = ~_BLANK[np.frombuffer(data, dtype=np.uint8)]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# Words that are hashed together; their bytes and the arrays beside them stay in cache.
_TOGETHER = 1 << 14


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word; equal words hash alike in every batch and process."""
    family = _FAMILIES[seed]
    raw = np.frombuffer(data, dtype=np.uint8)
    out = np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(starts), _TOGETHER):
        some = slice(at, at + _TOGETHER)
        lengths = ends[some] - starts[some]
        firsts = np.cumsum(lengths) - lengths
        ahead = np.arange(int(lengths.sum()))
        place = ahead - np.repeat(firsts, lengths)
        letters = family.letter[raw[ahead + np.repeat(starts[some] - firsts, lengths)]]
        if lengths.max(initial=0) <= _SPAN:
            value = letters * family.place[place]
        else:
            value = letters * family.place[place % _SPAN]
            far = place >= _SPAN
            turns = place[far] // _SPAN
            value[far] = mixed(value[far] + np.uint64(family.turn) * turns.astype(np.uint64))
        total = np.add.reduceat(value, firsts)
        out[some] = mixed(total + lengths.astype(np.uint64) * np.uint64(family.base))
    return out


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(hashes: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """Hash of every run of ``length`` consecutive word hashes, by prefix sums."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    base = _FAMILIES[seed].base
    up = powers(base, len(hashes))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * up, dtype=np.uint64)))
    down = powers(pow(base, -1, 2**64), n)
    return mixed((sums[length:] - sums[:n]) * down)


def slices(batch: pa.RecordBatch, column: str, budget: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about ``budget`` bytes of ``column`` each; a
    longer value gets a range of its own. No row is left out."""
    values = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0))
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > budget:
            yield first, i
            first, held = i, 0
        held += int(size)
    if first < len(sizes):
        yield first, len(sizes)
