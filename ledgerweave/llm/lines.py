"""Line de-duplication by an exact set-similarity join.

A line is the set of its words (A-Z in lower case). A line goes when an earlier line,
in doc_id and line order, has a Jaccard similarity of at least ``threshold`` to it.

Lines with equal sets are one class, named by two 64-bit hashes of the set; only a class's
first line can have to be compared. Words are ordered by rarity, as counted over all
documents in a table of fixed size, and then by hash; any fixed order keeps the join
exact. Two sets that are similar enough share a word among the rarest of each (prefix
filter), have similar sizes (length filter), and where the shared word stands bounds what
they can still share (positional filter); the words that only one of them has show in 128
bits of parity. A pair that passes is verified on the whole sets.

A class needs one earlier match, not all of them: each prefix word first offers a class its
three earliest partners, and only classes that are still without a match while they have
more partners are compared with all of them. So copies with small edits do not give all
pairs. A prefix word in very many classes is split: each class is a member of one part and
is compared with all parts.

Defined cases: a null text has no lines; a line without words is never removed and removes
none; rows without doc_id come last; rows with equal doc_id and text are one document, rows
with equal doc_id and other texts, or without doc_id, are documents of their own, ordered by
a hash of the text; an empty table gives no rows; other columns of the input are passed on unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.text import lower_bytes, mixed, word_bounds, word_hashes
from ledgerweave.sources.durable import durable, settled

THRESHOLD = Fraction(4, 5)
# Places of the table of word counts and of the table of prefix words: their size in
# memory, 2 and 8 MB, does not depend on the input.
_COUNT_BITS, _PART_BITS = 18, 20
# Bits of the filters for lines whose sets are wanted and for prefix words (8 MB).
_FILTER_BITS = 26
# Partners that a prefix word offers first.
OFFERS = 3
_STRIP = 1 << 18
_LAST = (1 << 63) - 1


def least_shared(total, threshold: Fraction):
    """Words that two sets with ``total`` words together must share at least."""
    a, b = threshold.numerator, threshold.denominator
    return -(-(a * total) // (a + b))


def _strips(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray]]:
    """Texts first to last (exclusive) as one lower-case byte string, with the number of
    newlines before each text and the row of each line."""
    first, held, size = 0, [], 0
    for i, text in enumerate([*texts, None]):
        data = lower_bytes((text or "").encode()) if i < len(texts) else b""
        if held and (i == len(texts) or size + len(data) > _STRIP):
            joined = b"\n".join(held)
            lines = np.array([d.count(b"\n") + 1 for d in held])
            yield first, first + len(held), joined, np.repeat(np.arange(len(held)), lines), lines
            first, held, size = i, [], 0
        held.append(data)
        size += len(data)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and line number of each word."""
    starts, ends = word_bounds(data)
    breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
    return word_hashes(data, starts, ends), np.searchsorted(breaks, starts)


def _rarity(counts: np.ndarray) -> np.ndarray:
    """Steps of a logarithmic scale, below 4096."""
    return (np.log2(counts + 1.0) * 64).astype(np.uint64)


def _ordered_sets(hashes: np.ndarray, line: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each line, by rarity and then by hash."""
    step = rarity[_slot(hashes, _COUNT_BITS)]
    if line[-1] < 1 << 20:
        upper = hashes >> np.uint64(32)
        key = (line.astype(np.uint64) << np.uint64(44)) | (step << np.uint64(32)) | upper
        order = np.argsort(key)
        key, hashes = key[order], hashes[order]
        same = key[1:] == key[:-1]
        if (hashes[1:][same] == hashes[:-1][same]).all():
            fresh = np.concatenate(([True], ~same))
            return hashes[fresh], line[order][fresh]
        line, step = line[order], step[order]
    # Two words of a line agree in half their hash, or there are very many lines.
    order = np.lexsort((hashes, hashes >> np.uint64(32), step, line))
    hashes, line = hashes[order], line[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
    return hashes[fresh], line[fresh]


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def word_counts(docs: DataFrame) -> np.ndarray:
    """Words counted by the upper bits of their hash, over all documents. At most 2^18
    rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << _COUNT_BITS, dtype=np.int64)
        for batch in batches:
            for _, _, data, _, _ in _strips(batch.column(0).to_pylist()):
                hashes, _ = _words(data)
                counts += np.bincount(_slot(hashes, _COUNT_BITS), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["slot", "n"])

    table = (
        docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    )
    out = np.zeros(1 << _COUNT_BITS, dtype=np.int64)
    out[table["slot"].to_numpy()] = table["n"].to_numpy()
    return out


_LINE = (
    "doc_id long, tie long, line int, text_hash long, sig long, sig2 long, bits long, half long, n int, "
    "prefix array<int>"
)


def described(docs: DataFrame, counts: np.ndarray, threshold: Fraction) -> DataFrame:
    """Each line with words: its place, its class, the size of its set and the rarest
    words of it, as many as two similar sets must share one of."""
    rank = docs.sparkSession.sparkContext.broadcast(_rarity(counts))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for first, last, data, row, lines in _strips(texts):
                hashes, line = _words(data)
                if not len(hashes):
                    continue
                hashes, line = _ordered_sets(hashes, line, rank.value)
                heads = np.flatnonzero(np.diff(line, prepend=-1))
                n = np.diff(heads, append=len(line))
                sig, sig2 = _signatures(hashes, heads)
                turned = np.uint64(1) << (hashes & np.uint64(63))
                bits = np.bitwise_xor.reduceat(turned, heads)
                # The parity of half the words tells that of the other half as well.
                half = np.bitwise_xor.reduceat(np.where(hashes & np.uint64(64), turned, np.uint64(0)), heads)
                keep = n - -(-(threshold.numerator * n) // threshold.denominator) + 1
                # Sets this small are similar only to equal ones.
                keep[n * threshold.denominator < threshold.numerator * (n + 1)] = 0
                place = np.arange(len(line)) - np.repeat(heads, n)
                chosen = place < np.repeat(keep, n)
                offsets = np.concatenate(([0], np.cumsum(keep))).astype(np.int32)
                line = line[heads]
                within = line - (np.cumsum(lines) - lines)[row[line]]
                owner = pa.array(first + row[line])
                spelled = data.split(b"\n")
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(owner),
                        ties.take(owner),
                        pa.array(within.astype(np.int32)),
                        pa.array([_text_hash(spelled[x]) for x in line.tolist()], pa.int64()),
                        pa.array(sig.view(np.int64)),
                        pa.array(sig2.view(np.int64)),
                        pa.array(bits.view(np.int64)),
                        pa.array(half.view(np.int64)),
                        pa.array(n.astype(np.int32)),
                        pa.ListArray.from_arrays(
                            pa.array(offsets), pa.array((hashes[chosen] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                        ),
                    ],
                    names=["doc_id", "tie", "line", "text_hash", "sig", "sig2", "bits", "half", "n", "prefix"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text").mapInArrow(describe, _LINE)


def _text_hash(line: bytes) -> int:
    h = xxhash.xxh64_intdigest(line)
    return h - (1 << 64) if h >> 63 else h


def _parts(classes: DataFrame, part_rows: int) -> np.ndarray:
    """Parts into which each prefix word is split, by the lower bits of its hash. Only
    slots far above the mean are split. At most 2^20 rows reach the driver."""
    slots = classes.select(F.explode("prefix").alias("word")).select(
        F.col("word").bitwiseAND(F.lit((1 << _PART_BITS) - 1)).alias("slot")
    )
    table = slots.groupBy("slot").agg(F.count("*").alias("n")).toArrow()
    sizes = np.zeros(1 << _PART_BITS, dtype=np.int64)
    sizes[table["slot"].to_numpy()] = table["n"].to_numpy()
    even = 4 * int(sizes.mean())
    return np.maximum(1, -(-(sizes - even) // part_rows)).astype(np.int32)


def _filter_of(bits: DataFrame) -> np.ndarray:
    """A table of bits in 64-bit words, with those numbered in the column ``bit`` set. At
    most 2^20 words reach the driver."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    words = (
        bits.select(F.shiftright("bit", 6).alias("word"), mask.alias("mask"))
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
        .toArrow()
    )
    out = np.zeros(1 << (_FILTER_BITS - 6), dtype=np.int64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy()
    return out


_OFFER = "later long, earlier long, more boolean"


def offers(classes: DataFrame, threshold: Fraction, most: int | None, part_rows: int) -> DataFrame:
    """Pairs (later, earlier) of classes that pass all filters; per prefix word at most
    ``most`` for each later class, the earliest, and ``more`` where there were others.
    Only classes with ``wanted`` are looked up as later ones; where these are few (``most``
    is None), a filter of fixed size passes their prefix words and few others."""
    context = classes.sparkSession.sparkContext
    parts = context.broadcast(_parts(classes, part_rows))
    asked = None
    if most is None:
        words = classes.where("wanted").select(F.explode("prefix").alias("word"))
        asked = context.broadcast(
            _filter_of(words.select(F.col("word").bitwiseAND(F.lit((1 << _FILTER_BITS) - 1)).cast("long").alias("bit")))
        )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            n_words = pc.list_value_length(lists).to_numpy()
            word = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), n_words)
            place = np.arange(len(word)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
            if asked is not None:
                bit = word.astype(np.int64) & ((1 << _FILTER_BITS) - 1)
                passed = (asked.value[bit >> 6] >> (bit & 63)) & 1 == 1
                owner, word, place = owner[passed], word[passed], place[passed]
            split = parts.value[word & ((1 << _PART_BITS) - 1)]
            owner, place, word = np.repeat(owner, split), np.repeat(place, split), np.repeat(word, split)
            part = np.arange(len(word)) - np.repeat(np.cumsum(split) - split, split)
            bits = batch.column(1).to_numpy()[owner]
            own = mixed(bits.view(np.uint64)) % np.repeat(split, split).astype(np.uint64) == part.astype(np.uint64)
            wanted = batch.column(5).to_numpy(zero_copy_only=False)[owner]
            n = batch.column(2).to_numpy()[owner].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((word.astype(np.int64) << 24) + part),
                    pa.array((n << 34) | (place << 2) | (own.astype(np.int64) << 1) | wanted),
                    pa.array(bits),
                    *[pa.array(batch.column(c).to_numpy()[owner]) for c in (3, 4, 6, 7)],
                ],
                names=["word", "spot", "bits", "doc", "line", "apart", "half"],
            )

    # A row of this table, of which there are many, is short. ``spot`` packs the size of
    # the set, the place of the word in it and two marks, and sorts by size. The parity
    # bits also name the class: where two classes share them, both are looked up.
    dealt = (
        classes.where(F.size("prefix") > 0)
        .select("prefix", "bits", "n", "doc", "line", "wanted", "apart", "half")
        .mapInArrow(deal, "word long, spot long, bits long, doc long, line int, apart long, half long")
        .repartition("word")
        .sortWithinPartitions("word", "spot")
    )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            change = np.flatnonzero(_changes(held))
            if len(change):
                cut = int(change[-1]) + 1
                yield from _offered(held.slice(0, cut), threshold, most)
                held = held.slice(cut)
        if held is not None:
            yield from _offered(held, threshold, most)

    return dealt.mapInArrow(pair, _OFFER)


def _changes(table: pa.Table) -> np.ndarray:
    word = table["word"].to_numpy()
    return word[1:] != word[:-1]


def _offered(table: pa.Table, threshold: Fraction, most: int | None) -> Iterator[pa.RecordBatch]:
    """Compares each row with the next, the one after it, and so on, as long as they are
    in the same group and of similar size; all groups of the table at once."""
    spot, name = table["spot"].to_numpy(), table["bits"].to_numpy()
    half = table["half"].to_numpy().view(np.uint64)
    rest = name.view(np.uint64) ^ half
    n, place = spot >> 34, (spot >> 2) & 0xFFFFFFFF
    own, wanted = (spot & 2).astype(bool), (spot & 1).astype(bool)
    size = len(n)
    group = np.concatenate(([0], np.cumsum(_changes(table))))
    longest = n * threshold.denominator // threshold.numerator
    # Place of each row among all, earliest first.
    age = np.empty(size, dtype=np.int64)
    age[np.lexsort([name, *(table[c].to_numpy() for c in ("line", "apart", "doc"))])] = np.arange(size)
    indexed = place < n - least_shared(2 * n, threshold) + 1
    best = np.full((size, most or 0), size, dtype=np.int64)
    more = np.zeros(size, dtype=bool)
    by_age = np.argsort(age)
    row = np.flatnonzero(indexed)
    step = 0
    while True:
        step += 1
        row = row[row + step < size]
        other = row + step
        near = (group[row] == group[other]) & (n[other] <= longest[row])
        row, other = row[near], other[near]
        if not len(row):
            break
        shared = np.minimum(n[row] - place[row], n[other] - place[other])
        both = n[row] + n[other]
        least = least_shared(both, threshold)
        # Every word that one set has and the other has not turns one bit of 128. With 64
        # any two sets of 150 words would be as good as alike.
        apart = np.bitwise_count(half[row] ^ half[other]).astype(np.int64) + np.bitwise_count(rest[row] ^ rest[other])
        good = (own[row] | own[other]) & (shared >= least) & (apart <= both - 2 * least)
        a, b = row[good], other[good]
        swap = age[a] > age[b]
        for later, earlier in ((a[swap], b[swap]), (b[~swap], a[~swap])):
            ask = wanted[later]
            later, earlier = later[ask], earlier[ask]
            if not len(later):
                continue
            if most is None:
                yield _pairs(name[later], name[earlier], np.zeros(len(later), dtype=bool))
                continue
            carried = age[earlier]
            for k in range(most):
                low = np.minimum(best[later, k], carried)
                carried = np.maximum(best[later, k], carried)
                best[later, k] = low
            more[later] |= carried < size
    if most:
        later, k = np.nonzero(best < size)
        if len(later):
            yield _pairs(name[later], name[by_age[best[later, k]]], more[later])


def _pairs(later: np.ndarray, earlier: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(later), pa.array(earlier), pa.array(more)], names=["later", "earlier", "more"]
    )


# Lines that a task remembers having sent; forgetting some only repeats rows.
_SEEN = 200_000


def _sets(spelled: list[bytes]) -> Iterator[pa.RecordBatch]:
    """sig, sig2 and the sorted set of each line that has words."""
    hashes, line = _words(b"\n".join(spelled))
    if not len(hashes):
        return
    order = np.lexsort((hashes, line))
    hashes, line = hashes[order], line[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
    hashes, line = hashes[fresh], line[fresh]
    heads = np.flatnonzero(np.diff(line, prepend=-1))
    sig, sig2 = _signatures(hashes, heads)
    offsets = pa.array(np.append(heads, len(hashes)).astype(np.int32))
    sets = pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(sig.view(np.int64)), pa.array(sig2.view(np.int64)), sets], names=["sig", "sig2", "words"]
    )


def _signatures(hashes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, whatever the order of its words."""
    return (
        mixed(np.add.reduceat(hashes, heads)),
        np.add.reduceat(mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15)), heads),
    )


def wanted_sets(docs: DataFrame, text_hashes: DataFrame) -> DataFrame:
    """sig, sig2 and the set (sorted word hashes) of every line whose hash is in
    ``text_hashes``. A filter of fixed size lets few other lines through."""
    filled = _filter_of(text_hashes.select(F.shiftrightunsigned("text_hash", 64 - _FILTER_BITS).alias("bit")))
    held = docs.sparkSession.sparkContext.broadcast(filled)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            picked, size = [], 0
            for text in batch.column(0):
                for line in lower_bytes((text.as_py() or "").encode()).split(b"\n"):
                    full = xxhash.xxh64_intdigest(line)
                    bit = full >> (64 - _FILTER_BITS)
                    if not held.value[bit >> 6] >> (bit & 63) & 1 or full in seen:
                        continue
                    seen.add(full)
                    picked.append(line)
                    size += len(line)
                    if size > _STRIP:
                        yield from _sets(picked)
                        picked, size = [], 0
            yield from _sets(picked)
            if len(seen) > _SEEN:
                seen.clear()

    return docs.select("text").mapInArrow(pick, "sig long, sig2 long, words array<long>")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """sig and sig2 of the later classes that an earlier class is similar to. ``pairs``
    names classes by their parity bits."""
    ends = pairs.select(F.col("later").alias("s")).union(pairs.select(F.col("earlier").alias("s")))
    involved = ends.distinct()
    known = classes.join(involved.hint("merge"), F.col("bits") == F.col("s"), "left_semi")
    sets = durable(
        wanted_sets(docs, known.select("text_hash"))
        .dropDuplicates(["sig", "sig2"])
        .join(known.select("sig", "sig2", "bits", "doc", "apart", "line").hint("merge"), ["sig", "sig2"])
        .select("bits", "words", F.struct("doc", "apart", "line", "sig", "sig2").alias("at")),
        "line-sets",
    )

    def similar(x: Column, y: Column) -> Column:
        # Words of x that look the same, which whole hashes never do, count as shared.
        shared = F.size(F.array_intersect(x, y)) + F.size(x) - F.size(F.array_distinct(x))
        return shared * threshold.denominator >= (F.size(x) + F.size(y) - shared) * threshold.numerator

    def joined(pairs: DataFrame, on: str, name: str, words: Column) -> DataFrame:
        side = sets.select(F.col("bits").alias(on), words.alias(name), F.col("at").alias(f"{name}_at"))
        return pairs.join(side.hint("merge"), on)

    # Half of each hash, cut to the same number of words, travels first: it can only make
    # sets look more alike, and few pairs are left for the whole hashes.
    half = F.transform("words", lambda w: F.shiftright(w, 32).cast("int"))
    near = joined(joined(pairs, "later", "x", half), "earlier", "y", half)
    near = durable(
        near.where((F.col("y_at") < F.col("x_at")) & similar(F.col("x"), F.col("y")))
        .select("later", "earlier")
        .distinct(),
        "line-near",
    )
    words = F.col("words")
    both = joined(joined(near, "later", "x", words), "earlier", "y", words).where(
        (F.col("y_at") < F.col("x_at")) & similar(F.col("x"), F.col("y"))
    )
    return both.select("x_at.sig", "x_at.sig2").distinct()


def _classes(lines: DataFrame) -> DataFrame:
    """One row per different set of words, with the place of its first line. ``apart`` is
    the document's tie where other texts have its doc_id, or where it has none, and else 0."""
    doc = F.coalesce("doc_id", F.lit(_LAST))
    at = F.struct(doc.alias("doc"), "tie", "line", "text_hash")
    shared = lines.groupBy(doc.alias("shared")).agg(F.min("tie").alias("a"), F.max("tie").alias("b")).where("a < b")
    return (
        lines.groupBy("sig", "sig2")
        .agg(F.min(at).alias("at"), *[F.any_value(c).alias(c) for c in ("bits", "half", "n", "prefix")])
        .select("sig", "sig2", "at.*", "bits", "half", "n", "prefix", F.lit(True).alias("wanted"))
        .join(shared.select("shared"), F.col("doc") == F.col("shared"), "left")
        .withColumn("apart", F.when(F.col("shared").isNull(), F.lit(0)).otherwise(F.col("tie")).cast("long"))
        .drop("tie", "shared")
    )


def removed_lines(docs: DataFrame, threshold: Fraction = THRESHOLD, part_rows: int = 20_000) -> DataFrame:
    """doc_id, tie (a hash of the text) and the numbers of the lines that go, ascending;
    documents that lose none are left out."""
    spark = docs.sparkSession
    lines = durable(described(docs, word_counts(docs), threshold), "lines")
    classes = durable(_classes(lines), "line-classes")

    def settle() -> DataFrame:
        first = durable(offers(classes, threshold, OFFERS, part_rows), "line-offers")
        pairs = first.select("later", "earlier").distinct()
        gone = settled(spark, "line-gone", lambda: _verified(docs, classes, pairs, threshold))
        more = first.where("more").select(F.col("later").alias("s")).distinct()
        open_ = durable(
            classes.join(more.hint("merge"), F.col("bits") == F.col("s"), "left_semi")
            .join(gone.hint("merge"), ["sig", "sig2"], "left_anti")
            .select("sig", "sig2", F.lit(True).alias("asked")),
            "line-open",
        )
        if open_.isEmpty():
            return gone
        again = classes.join(open_.hint("merge"), ["sig", "sig2"], "left").withColumn(
            "wanted", F.coalesce("asked", F.lit(False))
        )
        rest = durable(offers(again, threshold, None, part_rows).select("later", "earlier").distinct(), "line-rest")
        return gone.union(_verified(docs, classes, rest, threshold)).distinct()

    gone = settled(spark, "line-all-gone", settle)
    flags = gone.select("sig", "sig2", F.lit(True).alias("gone"))
    starts = classes.join(flags.hint("merge"), ["sig", "sig2"], "left").select(
        "sig", "sig2", "doc", "apart", F.col("line").alias("at_line"), "gone"
    )
    own = (
        (F.coalesce("doc_id", F.lit(_LAST)) == F.col("doc"))
        & ((F.col("apart") == 0) | (F.col("apart") == F.col("tie")))
        & (F.col("line") == F.col("at_line"))
    )
    return (
        lines.join(starts.hint("merge"), ["sig", "sig2"])
        .where(F.coalesce("gone", F.lit(False)) | ~own)
        .groupBy("doc_id", "tie")
        .agg(F.array_sort(F.collect_set("line")).alias("lines"))
    )


def _matched(docs: DataFrame, removed: DataFrame, tie: Column, *columns) -> DataFrame:
    gone = removed.select(F.col("doc_id").alias("__lw_doc"), F.col("tie").alias("__lw_tie"), F.col("lines").alias("__lw_gone"))
    same = docs["doc_id"].cast("long").eqNullSafe(gone["__lw_doc"]) & (tie == gone["__lw_tie"])
    return docs.join(gone.hint("merge"), same, "left").select(*columns)


def line_report(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and the removed line numbers (from 0)."""
    removed = removed_lines(docs, threshold)
    narrow = docs.select(
        "doc_id",
        F.xxhash64("text").alias("tie"),
        F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n"),
        F.col("text").isNull().alias("none"),
    )
    gone = F.coalesce("__lw_gone", F.expr("cast(array() as array<int>)"))
    return _matched(
        narrow,
        removed,
        narrow["tie"],
        "doc_id",
        F.when(F.col("none"), 0).otherwise(F.col("n")).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        gone.alias("removed_lines"),
    )


def without_repeated_lines(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The rows with the repeated lines taken out of text; all other columns unchanged,
    and so is the text of a row that loses none. Every row stays, if with an empty text."""
    removed = removed_lines(docs, threshold)
    left = F.array_join(
        F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__lw_gone", i)), "\n"
    )
    text = F.when(F.col("__lw_gone").isNull(), F.col("text")).otherwise(left)
    columns = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return _matched(docs, removed, F.xxhash64(docs["text"]), *columns)
