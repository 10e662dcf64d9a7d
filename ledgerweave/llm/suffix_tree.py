"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are words (A-Z in lower case) and the end of a text. The tree's root holds the
smoothed unigram distribution, (c + 1) / (N + V + 1), where the last of the V + 1 is all
words never seen. A context becomes a state if some symbol follows it twice or more and its
next-symbol distribution diverges from that of the next shorter state (Kullback-Leibler, at
least ``divergence`` nats). A state keeps the next symbols seen twice or more, each
discounted; the rest of its mass goes to the next shorter state, so every state is a
distribution. All contexts of one and two words are looked at; a longer one where the context
without its oldest word is a state, so contexts grow while they diverge, without a limit of
their own. A token is scored in the state of the longest suffix of what precedes it; before
the first word of a text stands an end.

The tree is never in one place. Every bundle of documents asks for what it needs of it (see
``bundles``), one depth after the other: first for the counts of its own contexts with their
next symbols, then for the states among its contexts. Between two depths a bundle is stored
with what is still looked at of it, and the tables of the depth before are deleted. For the second question each next
symbol is sent by one of the bundles that hold it, so a context's part gets each only once.
Counts are exact and cover every training document. The driver receives N, V and the number
of states of each depth.

``Growth`` can ask for more than two occurrences, as shares of all tokens, and for a greatest
depth.

Defined cases: a null text is empty and has one token, its end; repeated rows are trained on
as often as they occur; without training documents N and V are 0 and only unknown words are
left (log10 of 1); an empty table gives no rows. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.bundles import (
    Bundle,
    answered,
    asked,
    bundled,
    part_slices,
    parts_for,
    with_answers,
)
from ledgerweave.llm.text import lower_bytes, mixed, word_hashes
from ledgerweave.sources.durable import delete, durable

BUNDLE_BYTES = 4 << 20
LEAST = 2
DIVERGENCE, DISCOUNT = 0.02, 0.75

END = np.uint64(0x5EED0F7E57E0F00D)
_TURN = np.uint64(0x9E3779B97F4A7C15)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and the place of each value among them."""
    codes, met = pd.factorize(values)
    order = np.argsort(met)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return met[order], rank[codes]


def joined(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Hash of a context followed by a symbol."""
    return mixed(context * _TURN + symbol)


class Tokens:
    """The tokens of a bundle, one text after the other, each with its end."""

    def __init__(self, bundle: Bundle):
        starts, ends, first = bundle.words()
        hashes = word_hashes(bundle.data, starts, ends)
        lengths = np.diff(first) + 1
        self.last = np.cumsum(lengths) - 1
        is_end = np.zeros(int(lengths.sum()), dtype=bool)
        is_end[self.last] = True
        self.symbol = np.empty(len(is_end), dtype=np.uint64)
        self.symbol[is_end] = END
        self.symbol[~is_end] = hashes
        self.first = self.last - lengths + 1
        self.length = lengths
        self.train = np.repeat(~np.array(bundle.flags, dtype=bool), lengths)


def _totals(values: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct, place = np.unique(np.concatenate(values), return_inverse=True)
    totals = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(totals, place, np.concatenate(numbers))
    return distinct, totals, place


def _counts(values: list[np.ndarray], numbers: list[np.ndarray]) -> list[bytes]:
    _, totals, place = _totals(values, numbers)
    found = totals[place]
    cuts = np.cumsum([len(v) for v in values])[:-1]
    return [c.tobytes() for c in np.split(found, cuts)]


def word_counts(bundles: DataFrame, parts: int) -> DataFrame:
    """bundle, part, answer: the training counts of a bundle's words. Under bundle -1, for
    each part, the number of distinct training words."""

    def ask(row: dict):
        tokens = Tokens(Bundle.of(row))
        values, place = distinct(tokens.symbol)
        return values, np.bincount(place, tokens.train, len(values)).astype(np.int64)

    def summary(values, numbers) -> bytes:
        return (_totals(values, numbers)[1] > 0).sum().astype(np.int64).tobytes()

    return durable(answered(asked(bundles, ask, parts), _counts, summary), "word-counts")


def _summed(answers: DataFrame) -> int:
    """Sum of the parts' own answers, one number each."""
    rows = answers.where("bundle < 0").select("answer").toArrow()["answer"]
    return sum(int(np.frombuffer(r.as_buffer(), dtype=np.int64)[0]) for r in rows)


@dataclass(frozen=True)
class Growth:
    """What a context needs to become a state: its share of all tokens, the share of all
    tokens that a next symbol needs (``LEAST`` occurrences at least), the divergence, the
    discount of a count, and the greatest depth (None: while contexts diverge)."""

    least_share: float = 0.0
    least_pair: float = 0.0
    divergence: float = DIVERGENCE
    discount: float = DISCOUNT
    depth: int | None = 2


WHOLE = Growth(depth=None)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Compressed, the first bytes of all numbers first and their last bytes last."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unsqueezed(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _gathered(values: np.ndarray, parts: int, answers: list[dict] | None, width: int = 1) -> np.ndarray:
    """The squeezed answers to the sorted ``values``, ``width`` numbers each."""
    out = np.zeros((len(values), width), dtype=np.int64)
    by_part = {a["part"]: a["answer"] for a in answers or ()}
    for part, a, b in part_slices(values, parts):
        out[a:b] = _unsqueezed(by_part[part], np.int64).reshape(-1, width)
    return out


def _followed(values: list[np.ndarray], numbers: list[np.ndarray]) -> list[bytes]:
    """For each context with its next symbol twice its count, and one more in one of the
    cells that hold it."""
    together = np.concatenate(values)
    distinct, first, place = np.unique(together, return_index=True, return_inverse=True)
    totals = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(totals, place, np.concatenate(numbers))
    found = 2 * totals[place]
    found[first] += 1
    cuts = np.cumsum([len(v) for v in values])[:-1]
    return [_squeezed(c) for c in np.split(found, cuts)]


# A count that was not asked for.
_UNASKED = np.int64(1) << np.int64(62)


@dataclass(frozen=True)
class Grower:
    """What every bundle knows of the tree's making."""

    total: int
    distinct: int
    parts: tuple[int, int]
    growth: Growth

    @property
    def least(self) -> int:
        return max(LEAST, int(np.ceil(self.growth.least_pair * self.total)))

    @property
    def least_context(self) -> float:
        return max(self.least, self.growth.least_share * self.total)

    def states(self, values: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, int]:
        """The contexts of each cell; for each of them, one cell after the other, its count,
        the sum of its next symbols' counts and their number, zeros where it is no state; and
        the number of states. ``numbers`` are pairs: a context's count in a bundle and 0, or
        a next symbol's count and the bits of its share in the shorter state."""
        together = np.concatenate(values)
        pairs = np.concatenate(numbers).reshape(-1, 2)
        distinct, place = np.unique(together, return_inverse=True)
        own = np.flatnonzero(pairs[:, 1] == 0)
        held = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(held, place[own], pairs[own, 0])
        at = np.flatnonzero(pairs[:, 1] != 0)
        at = at[np.lexsort((pairs[at, 1], pairs[at, 0], place[at]))]
        context, times = place[at], pairs[at, 0]
        shorter = np.ascontiguousarray(pairs[at, 1]).view(np.float64)
        sums = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(sums, context, times)
        kinds = np.bincount(context, minlength=len(distinct))
        rest = self.rest(held, sums, kinds)
        share = (times - self.growth.discount) / np.maximum(held, 1)[context]
        other = np.clip(1 - np.bincount(context, shorter, len(distinct)), 1e-12, None)
        full = share + np.clip(rest, 1e-12, None)[context] * shorter
        gain = np.bincount(context, full * np.log(full / shorter), len(distinct)).astype(np.float64)
        # Symbols that are not kept one by one have their shorter share times ``rest``.
        gain += rest * other * np.log(np.clip(rest, 1e-12, None))
        keep = (held >= self.least_context) & (kinds > 0) & (rest > 0) & (gain >= self.growth.divergence)
        table = np.stack((held, sums, kinds), axis=1) * keep[:, None]
        return [table[np.searchsorted(distinct, np.unique(v))] for v in values], int(keep.sum())

    def rest(self, held: np.ndarray, sums: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """What a state passes on to the shorter one."""
        return 1 - (sums - kinds * self.growth.discount) / np.maximum(held, 1)


_STATE = (
    "bundle long, depth int, ids array<long>, flags array<boolean>, lengths array<long>, n_known array<long>, "
    "base array<double>, score array<double>, vocabulary binary, codes binary, live binary, at binary, "
    "upto binary, chance binary"
)
_STATE_TYPES = {
    "bundle": pa.int64(),
    "depth": pa.int32(),
    "ids": pa.list_(pa.int64()),
    "flags": pa.list_(pa.bool_()),
    "lengths": pa.list_(pa.int64()),
    "n_known": pa.list_(pa.int64()),
    "base": pa.list_(pa.float64()),
    "score": pa.list_(pa.float64()),
    **dict.fromkeys(("vocabulary", "codes", "live", "at", "upto", "chance"), pa.binary()),
}


@dataclass
class State:
    """A bundle on its way down the tree, at one depth. ``at`` are the tokens whose context
    of the depth is looked at, ``upto`` the counts of the sequences of the next shorter
    context and the token, and ``chance`` the tokens' probabilities in the longest state so
    far; all other tokens are done, and in their texts' ``score``. ``live`` marks the tokens
    that with the next shorter context may be frequent. Words that no
    context can hold any more are let go. ``upto`` and ``chance`` are stored once for equal sequences."""

    bundle: int
    depth: int
    ids: list
    flags: list
    lengths: np.ndarray
    n_known: np.ndarray
    base: np.ndarray
    score: np.ndarray
    symbol: np.ndarray
    live: np.ndarray
    at: np.ndarray
    upto: np.ndarray
    chance: np.ndarray

    @classmethod
    def first(cls, grower: Grower, row: dict) -> State:
        bundle = Bundle.of(row)
        tokens = Tokens(bundle)
        values, place = distinct(tokens.symbol)
        counts = np.zeros(len(values), dtype=np.int64)
        by_part = {a["part"]: a["answer"] for a in row["counts"] or ()}
        for part, a, b in part_slices(values, grower.parts[0]):
            counts[a:b] = np.frombuffer(by_part[part], dtype=np.int64)
        known = counts[place]
        chance = (known + 1.0) / (grower.total + grower.distinct + 1)
        held = np.roll(known, 1)
        held[tokens.first] = known[tokens.last]
        at = np.flatnonzero(held >= grower.least_context)
        state = cls(
            row["bundle"],
            0,
            bundle.ids,
            bundle.flags,
            tokens.length,
            np.add.reduceat((known > 0).astype(np.int64), tokens.first),
            np.add.reduceat(np.log10(chance), tokens.first),
            np.zeros(len(tokens.length)),
            # No sequence with a rare word is frequent: only its count tells it from others.
            np.where(known < grower.least, known.astype(np.uint64), tokens.symbol),
            np.zeros(len(known), dtype=bool),
            np.arange(len(known)),
            known,
            chance,
        )
        state.go_on(at, known[at], chance[at])
        return state

    @classmethod
    def of(cls, row: dict) -> State:
        symbol = _unsqueezed(row["vocabulary"], np.uint64)[_unsqueezed(row["codes"], np.int32)]
        state = cls(
            row["bundle"],
            row["depth"],
            row["ids"],
            row["flags"],
            np.array(row["lengths"], dtype=np.int64),
            np.array(row["n_known"], dtype=np.int64),
            np.array(row["base"]),
            np.array(row["score"]),
            symbol,
            np.unpackbits(_unsqueezed(row["live"], np.uint8), count=len(symbol)).astype(bool),
            np.flatnonzero(np.unpackbits(_unsqueezed(row["at"], np.uint8), count=len(symbol))),
            np.empty(0, np.int64),
            np.empty(0),
        )
        own = pd.factorize(state.sequence())[0]
        state.upto = _unsqueezed(row["upto"], np.int64)[own]
        state.chance = _unsqueezed(row["chance"], np.float64)[own]
        return state

    def batch(self) -> pa.RecordBatch:
        looked = np.zeros(len(self.symbol), dtype=bool)
        looked[self.at] = True
        vocabulary, codes, times = np.unique(
            np.where(self._needed(looked), self.symbol, END), return_inverse=True, return_counts=True
        )
        # Frequent words get small numbers, which take less room.
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order))
        own = pd.factorize(self.sequence())[0]
        one = np.empty(own.max(initial=-1) + 1, dtype=np.int64)
        one[own] = np.arange(len(own))
        values = {
            "bundle": self.bundle,
            "depth": self.depth,
            "ids": self.ids,
            "flags": self.flags,
            "lengths": self.lengths,
            "n_known": self.n_known,
            "base": self.base,
            "score": self.score,
            "vocabulary": _squeezed(vocabulary[order]),
            "codes": _squeezed(rank[codes]),
            "live": _squeezed(np.packbits(self.live)),
            "at": _squeezed(np.packbits(looked)),
            "upto": _squeezed(self.upto[one]),
            "chance": _squeezed(self.chance[one]),
        }
        return pa.RecordBatch.from_arrays(
            [pa.array([values[n]], t) for n, t in _STATE_TYPES.items()], names=list(_STATE_TYPES)
        )

    def _needed(self, looked: np.ndarray) -> np.ndarray:
        """The tokens that a context can still hold: those that are looked at or may be
        frequent with the next shorter context, and that context."""
        if not self.depth:
            return np.ones(len(looked), dtype=bool)
        before = np.concatenate(([0], np.cumsum(looked | self.live)))
        upto = np.minimum(np.arange(len(looked)) + self.depth + 2, len(looked))
        return before[upto] > before[:-1]

    @cached_property
    def text(self) -> np.ndarray:
        """The text of each token."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    @cached_property
    def place(self) -> np.ndarray:
        """The place of each token in its text."""
        return np.arange(len(self.symbol)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def context(self, depth: int) -> np.ndarray:
        """Of the tokens looked at, the hash of the ``depth`` + 1 tokens before each; an end
        stands before a text."""
        oldest = self.at - depth
        value = np.where(self.place[oldest] > 0, self.symbol[oldest - 1], END)
        for back in range(depth, 0, -1):
            value = joined(value, self.symbol[self.at - back])
        return value

    def sequence(self) -> np.ndarray:
        """Of the tokens looked at, the hash of each with the next shorter context."""
        symbol = self.symbol[self.at]
        return joined(self.context(self.depth - 1), symbol) if self.depth else symbol

    def trained(self, tokens: np.ndarray) -> np.ndarray:
        return ~np.array(self.flags, dtype=bool)[self.text[tokens]]

    def done(self) -> np.ndarray:
        """log10 probability of each text, with the tokens still looked at."""
        return self.score + np.bincount(self.text[self.at], np.log10(self.chance), len(self.lengths))

    def go_on(self, at: np.ndarray, upto: np.ndarray, chance: np.ndarray) -> None:
        """Looks at the tokens ``at`` only, which are some of those looked at so far."""
        left = np.ones(len(self.at), dtype=bool)
        left[np.searchsorted(self.at, at)] = False
        self.score = self.score + np.bincount(self.text[self.at[left]], np.log10(self.chance[left]), len(self.lengths))
        self.at, self.upto, self.chance = at, upto, chance


class Step:
    """The questions and answers of a bundle's step down by one depth."""

    def __init__(self, grower: Grower, row: dict):
        self.grower = grower
        self.state = state = State.of(row)
        self.context = state.context(state.depth)
        self.whole = np.flatnonzero(state.upto >= grower.least)
        self.keys, self.key = distinct(joined(self.context[self.whole], state.symbol[state.at[self.whole]]))

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """The contexts with their next symbols, and their training counts in the bundle."""
        trained = self.state.trained(self.state.at[self.whole])
        return self.keys, np.bincount(self.key, trained, len(self.keys)).astype(np.int64)

    def _times(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        found = _gathered(self.keys, self.grower.parts[1], row["times"])[:, 0]
        return (found & 1) > 0, found >> 1

    def contexts(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """The contexts with their counts in the bundle, and the next symbols that this
        bundle is to send, with their counts and their shares in the shorter state."""
        state = self.state
        mine, times = self._times(row)
        states, place = distinct(self.context)
        sent = np.full(len(self.keys), -1)
        sent[self.key] = self.whole
        send = mine & (times >= self.grower.least)
        sent, number = sent[send], times[send]
        local = np.bincount(place, state.trained(state.at), len(states)).astype(np.int64)
        values = np.concatenate((states, self.context[sent]))
        order = np.argsort(values, kind="stable")
        bits = np.concatenate((np.zeros(len(states), np.int64), state.chance[sent].view(np.int64)))
        return values[order], np.stack((np.concatenate((local, number)), bits), axis=1)[order]

    def next(self, row: dict) -> State:
        """The bundle one depth further."""
        state, grower, depth = self.state, self.grower, self.state.depth
        times = self._times(row)[1][self.key]
        states, place = distinct(self.context)
        count, sums, kinds = _gathered(states, grower.parts[1], row["found"], 3).T
        share = np.zeros(len(state.at))
        enough = times >= grower.least
        share[self.whole[enough]] = times[enough] - grower.growth.discount
        kept = np.flatnonzero((kinds > 0)[place])
        own = place[kept]
        rest = grower.rest(count, sums, kinds)
        state.chance[kept] = share[kept] / count[own] + rest[own] * state.chance[kept]
        # What is no longer looked at although it may be frequent was not asked for.
        before = np.roll(state.live, 1)
        after = np.where(state.live & before & (state.place >= depth), _UNASKED, 0)
        after[state.at] = 0
        after[state.at[self.whole]] = times
        state.live = after >= grower.least
        chosen = kept if depth else np.arange(len(state.at))
        at = state.at[chosen]
        chosen = chosen[(state.place[at] > depth) & (after[at - 1] >= grower.least_context)]
        state.go_on(state.at[chosen], after[state.at[chosen]], state.chance[chosen])
        state.depth = depth + 1
        return state


def _each(work: Callable[[dict], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on one row after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield work({n: batch.column(n)[i].as_py() for n in batch.schema.names})

    return run


def _freed(spark) -> None:
    """Lets Spark delete the shuffle files of steps that are stored and done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scored(docs: DataFrame, held_out: Column, growth: Growth | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score. Documents for which ``held_out`` holds are not learned from."""
    growth = growth or WHOLE
    spark = docs.sparkSession
    bundles = bundled(docs, BUNDLE_BYTES, lower_bytes, held_out)
    trained = F.size(F.filter("flags", lambda x: ~x))
    size, total = bundles.agg(
        F.coalesce(F.sum("n_words"), F.lit(0)),
        F.coalesce(F.sum(F.col("n_words") - F.col("n_marked") + trained), F.lit(0)),
    ).first()
    parts = parts_for(size / 8), parts_for(size / 2)
    answers = word_counts(bundles, parts[0])
    grower = Grower(total, _summed(answers), parts, growth)

    def start(row: dict) -> pa.RecordBatch:
        return State.first(grower, row).batch()

    state = durable(with_answers(bundles, answers, "counts").mapInArrow(_each(start), _STATE), "suffix-bundles")
    delete(answers)
    delete(bundles)
    _freed(spark)
    depth = 0
    while growth.depth is None or depth < growth.depth:
        further = _further(state, grower, depth)
        if further is None:
            # No context of this depth diverges: neither will a longer one be looked at.
            break
        delete(state)
        state = further
        depth += 1

    def score(row: dict) -> pa.RecordBatch:
        state = State.of(row)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(state.ids, pa.int64()),
                pa.array(state.flags, pa.bool_()),
                pa.array(state.lengths),
                pa.array(state.n_known),
                pa.array(np.full(len(state.ids), total, dtype=np.int64)),
                pa.array(state.base),
                pa.array(state.done()),
            ],
            names=_COLUMNS,
        )

    return state.mapInArrow(
        _each(score),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )


def _further(state: DataFrame, grower: Grower, depth: int) -> DataFrame | None:
    """All bundles one depth further; None where no context of the depth is a state."""
    parts = grower.parts[1]
    made = [0]

    def states_of(values, numbers, made: list = made) -> list[bytes]:
        tables, made[0] = grower.states(values, numbers)
        return [_squeezed(t) for t in tables]

    def number_of(values, numbers, made: list = made) -> bytes:
        """Called after ``states_of`` for the same part."""
        return np.array(made, dtype=np.int64).tobytes()

    def ask(row: dict):
        return Step(grower, row).sequences()

    def ask_states(row: dict):
        return Step(grower, row).contexts(row)

    def advance(row: dict) -> pa.RecordBatch:
        return Step(grower, row).next(row).batch()

    times = durable(answered(asked(state, ask, parts), _followed), f"suffix-counts-{depth + 1}")
    _freed(state.sparkSession)
    known = with_answers(state, times, "times")
    found = durable(answered(asked(known, ask_states, parts), states_of, number_of), f"suffix-states-{depth + 1}")
    _freed(state.sparkSession)
    further = None
    if _summed(found):
        # Both answers at once: the bundles are shuffled once for them.
        tables = times.withColumn("part", -1 - F.col("part")).union(found)
        own = F.transform(
            F.filter("both", lambda a: a["part"] < 0),
            lambda a: F.struct((-1 - a["part"]).alias("part"), a["answer"].alias("answer")),
        )
        both = with_answers(state, tables, "both").select(
            *state.columns, own.alias("times"), F.filter("both", lambda a: a["part"] >= 0).alias("found")
        )
        further = durable(both.mapInArrow(_each(advance), _STATE), f"suffix-bundles-{depth + 1}")
    delete(times)
    delete(found)
    _freed(state.sparkSession)
    return further


_COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
