"""Substring de-duplication by repeated-phrase automata.

A window of ``length`` consecutive words whose word sequence starts anywhere else, in the
same document or another, is repeated, and every word that it covers goes.

Recurring passages are confirmed in two steps. Each window is stood for by its phrase, the
``phrase`` consecutive words with the least hash in it; equal windows have equal phrases, so
only windows whose phrase recurs can be repeated, and there are few phrases. The windows
left are confirmed by two independent hashes of all their words. Both questions are asked
of all documents at once, shard by shard (see ``bundles``). What is kept of a confirmed
passage is its hash and, once, the text of its phrase. The phrases are compiled into
Aho-Corasick automata, one for each shard of documents, and all documents are streamed
through their shard's automaton. Its hits alone say where to look: the windows around a hit
whose hash is a confirmed passage's are marked.

A shard is a bundle of neighbouring documents: an automaton holds the confirmed phrases
that its shard can contain and no others, so each text runs through one automaton, whatever
the size of the collection, and an automaton's memory is bounded by its shard's text.

Defined cases: null, blank and short texts have no window and lose nothing; a document that
repeats itself is treated like any other; repeated rows are documents of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.bundles import (
    Bundle,
    answered,
    asked,
    bits_of,
    bundled,
    in_several,
    parts_for,
    with_answers,
)
from ledgerweave.llm.text import mixed, window_hashes, word_hashes
from ledgerweave.sources.durable import durable

LENGTH, PHRASE = 35, 6
SHARD_BYTES = 4 << 20


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """Least (or greatest) of every ``width`` consecutive values, by doubling."""
    out, done = values, 1
    while done * 2 <= width:
        out, done = best(out[:-done], out[done:]), done * 2
    rest = width - done
    return best(out[: len(out) - rest], out[rest:]) if rest else out


class Shard:
    """Words, phrases and windows of a bundle's documents."""

    def __init__(self, bundle: Bundle, length: int, phrase: int):
        self.bundle, self.length, self.phrase = bundle, length, phrase
        self.starts, self.ends, self.first = bundle.words()
        n = len(self.starts)
        self.hashes = word_hashes(bundle.data, self.starts, self.ends)
        # A window ends before the next document begins.
        limit = np.repeat(self.first[1:], np.diff(self.first))
        self.valid = np.flatnonzero(np.arange(n) + length <= limit)
        if not len(self.valid):
            self.grams = self.least = np.empty(0, dtype=np.uint64)
            self.spots = np.empty(0, dtype=np.int64)
            return
        self.grams = window_hashes(self.hashes, phrase, 2)
        width = length - phrase + 1
        self.least = sliding(self.grams, width)
        # A phrase stands for some window if no smaller one is in every window over it.
        greatest = np.zeros(n + width, dtype=np.uint64)
        greatest[self.valid + width - 1] = self.least[self.valid]
        self.spots = np.flatnonzero(sliding(greatest, width, np.maximum)[: len(self.grams)] == self.grams)

    def phrase_questions(self) -> np.ndarray:
        """Mixed, because the least of many hashes crowd at the low end and parts are cut by
        value."""
        return np.unique(mixed(self.grams[self.spots]))

    def candidates(self, parts: int, answers: list[dict] | None) -> np.ndarray:
        """Valid windows whose phrase recurs."""
        grams, times = np.unique(mixed(self.grams[self.spots]), return_counts=True)
        recurring = bits_of(grams, parts, answers) | (times > 1)
        return self.valid[recurring[np.searchsorted(grams, mixed(self.least[self.valid]))]]

    def window_keys(self, windows: np.ndarray) -> np.ndarray:
        if not len(windows):
            return np.empty((0, 2), dtype=np.uint64)
        return np.stack([window_hashes(self.hashes, self.length, s)[windows] for s in (1, 2)], axis=1)

    def confirmed(self, windows: np.ndarray, parts: int, answers: list[dict] | None) -> np.ndarray:
        keys = folded_keys(self.window_keys(windows))
        values, place, times = np.unique(keys, return_inverse=True, return_counts=True)
        return windows[(bits_of(values, parts, answers) | (times > 1))[place]]

    def passages(self, confirmed: np.ndarray) -> tuple[list[str], np.ndarray]:
        """What tells confirmed windows: the texts of their phrases, each once, one character
        for each byte and a blank before, between and after the words; and their hashes."""
        wanted = np.unique(self.least[confirmed])
        spots = self.spots[np.isin(self.grams[self.spots], wanted)]
        _, one = np.unique(self.grams[spots], return_index=True)
        phrases = [self._text(spot, spot + self.phrase) for spot in spots[one].tolist()]
        return phrases, np.unique(folded_keys(self.window_keys(confirmed)))

    def _text(self, first: int, end: int) -> str:
        bounds = zip(self.starts[first:end].tolist(), self.ends[first:end].tolist())
        return b" ".join([b"", *(self.bundle.data[a:b] for a, b in bounds), b""]).decode("latin-1")

    def located(self, phrases: list[str], keys: np.ndarray) -> np.ndarray:
        """Which words are covered by passages, wherever these were learned: every text runs
        through the automaton of the phrases, and the windows around a hit are compared with
        the passages' sorted hashes."""
        covered = np.zeros(len(self.starts) + 1, dtype=np.int64)
        if not phrases or not len(self.valid):
            return covered[:-1] > 0
        automaton = ahocorasick.Automaton()
        for text in phrases:
            automaton.add_word(text, len(text))
        automaton.make_automaton()
        width = self.length - self.phrase + 1
        hits = []
        for a, b in zip(self.first.tolist(), self.first[1:].tolist()):
            if b - a < self.length:
                continue
            met = [last - size + 1 for last, size in automaton.iter(self._text(a, b))]
            if met:
                lengths = self.ends[a:b] - self.starts[a:b]
                begins = np.cumsum(lengths + 1) - lengths - 1
                found = a + np.searchsorted(begins, np.array(met))
                around = (found[:, None] - np.arange(width)[None, :]).ravel()
                hits.append(around[(around >= a) & (around + self.length <= b)])
        if not hits:
            return covered[:-1] > 0
        windows = np.unique(np.concatenate(hits))
        found = folded_keys(self.window_keys(windows))
        place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        marked = windows[keys[place] == found]
        np.add.at(covered, marked, 1)
        np.add.at(covered, marked + self.length, -1)
        return np.cumsum(covered)[:-1] > 0


def folded_keys(keys: np.ndarray) -> np.ndarray:
    """One number of both hashes of a window."""
    return mixed(keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15)))


_RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<first:long,end:long>>, kept string"


def without_repeats(docs: DataFrame, length: int = LENGTH, phrase: int = PHRASE) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, the removed runs of words (numbered from
    0, end exclusive) and the kept words, joined by one space."""
    bundles = bundled(docs, SHARD_BYTES)
    n_words = bundles.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    phrase_parts = parts_for(2 * n_words / (length - phrase + 2))
    window_parts = parts_for(n_words / 4)

    def ask_phrases(row: dict):
        return Shard(Bundle.of(row), length, phrase).phrase_questions(), None

    def ask_windows(row: dict):
        shard = Shard(Bundle.of(row), length, phrase)
        windows = shard.candidates(phrase_parts, row["phrases"])
        return np.unique(folded_keys(shard.window_keys(windows))), None

    recurring = durable(answered(asked(bundles, ask_phrases, phrase_parts), in_several), "phrase-answers")
    known = with_answers(bundles, recurring, "phrases")
    repeated = durable(answered(asked(known, ask_windows, window_parts), in_several), "window-answers")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                shard = Shard(Bundle.of(row), length, phrase)
                windows = shard.candidates(phrase_parts, row["phrases"])
                confirmed = shard.confirmed(windows, window_parts, row["windows"])
                gone = shard.located(*shard.passages(confirmed))
                yield _result(shard, gone)

    return with_answers(with_answers(bundles, recurring, "phrases"), repeated, "windows").mapInArrow(mark, _RESULT)


def _result(shard: Shard, gone: np.ndarray) -> pa.RecordBatch:
    data = shard.bundle.data
    starts, ends, stay = shard.starts.tolist(), shard.ends.tolist(), ~gone
    n_words, n_removed, removed, kept = [], [], [], []
    for a, b in zip(shard.first.tolist(), shard.first[1:].tolist()):
        edge = np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)
        runs = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())
        n_words.append(b - a)
        n_removed.append(int(gone[a:b].sum()))
        removed.append([{"first": x, "end": y} for x, y in runs])
        kept.append(b" ".join([data[starts[k] : ends[k]] for k in (a + np.flatnonzero(stay[a:b])).tolist()]))
    spans = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(shard.bundle.ids, pa.int64()),
            pa.array(n_words, pa.int64()),
            pa.array(n_removed, pa.int64()),
            pa.array(removed, spans),
            pa.array([k.decode() for k in kept], pa.string()),
        ],
        names=["doc_id", "n_words", "n_removed", "removed", "kept"],
    )
