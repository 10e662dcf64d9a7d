"""MinHash near-duplicates by an inverted join on signature coordinates.

A document is the set of its distinct word shingles. Equal sets are one class, named by two
64-bit hashes; only one holder of each class takes part in what follows. A class's signature
has ``COORDINATES`` minima of its hashed shingles, and the class is posted under each
(coordinate, value) pair, its tokens.

Two sets with a Jaccard similarity of 0.8 agree in each coordinate with that probability, so
in fewer than ``LEAST_MATCHES`` of 64 with a probability below 10^-8; that is the match
threshold. Tokens are counted over all classes. A token of one class matches nothing, so a
class with fewer than LEAST_MATCHES other tokens has no partner. Those left are ordered by
rarity; two classes with enough matches share one of the first s - LEAST_MATCHES + 1 of
either's s tokens, so only these prefixes are posted. A shingle that no other remaining class
has is in no intersection, so a class with too few others goes as well (exactly).

The posted lists are merged in two rounds, and never all pairs of a list:

* The class with the largest share of common shingles leads a list. A class is compared with
  the leaders of its lists and verified against the one with most matches. What is verified
  makes components.
* Lists whose classes are all in one component are skipped. In the others the classes outside
  the list's main component are compared with the rest; pairs within a component, or with
  sizes too different, are skipped before their collisions are counted. A class that reaches
  the match threshold with some class of another component asks for that class's tile (a part
  of a component, or of the classes around a leader). Tiles verify on the full sets and report
  one link for each component met.

A long list is cut into units of bounded size, so none is held as a whole. What is quadratic
is the number of classes outside a list's main component times the list's length.

Defined cases: texts of fewer words than a shingle are one shingle; null and blank texts are
empty sets that are linked with nothing; a null doc_id counts for no component id, and is
null where a component has no other; repeated rows are copies; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.bundles import (
    Bundle,
    answered,
    asked,
    bits_of,
    bundled,
    in_several,
    part_slices,
    parts_for,
    with_answers,
)
from ledgerweave.llm.components import rooted
from ledgerweave.llm.text import lower_bytes, mixed, window_hashes, word_hashes
from ledgerweave.sources.durable import durable

WIDTH = 4
COORDINATES, LEAST_MATCHES = 64, 31
# Similarity of a link, in hundredths.
LEAST_HUNDREDTHS = 80
BUNDLE_BYTES = 4 << 20
# Classes of a stored block, of a list's unit on either side, and of a tile.
BLOCK, UNIT, TILE = 4096, 4096, 512
# Pairs that are compared together.
_TOGETHER = 1 << 15

_RNG = np.random.default_rng(13)
_TURN = _RNG.integers(0, 2**64, COORDINATES, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**64, COORDINATES, dtype=np.uint64) | np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, COORDINATES + 1, dtype=np.uint64) * _GOLD


class Sets:
    """The distinct shingles of a bundle's documents, sorted within each document."""

    def __init__(self, bundle: Bundle, width: int):
        starts, ends, first = bundle.words()
        hashes = word_hashes(bundle.data, starts, ends)
        words = np.diff(first)
        runs = np.where(words >= width, words - width + 1, np.minimum(words, 1))
        doc = np.repeat(np.arange(len(words)), runs)
        spot = np.arange(len(doc)) + np.repeat(first[:-1] - (np.cumsum(runs) - runs), runs)
        values = np.empty(len(doc), dtype=np.uint64)
        whole = words[doc] >= width
        values[whole] = window_hashes(hashes, width)[spot[whole]]
        for n in range(1, width):
            short = words[doc] == n
            if short.any():
                # Told apart from shingles of full width by the number of words.
                values[short] = mixed(window_hashes(hashes, n)[spot[short]] + _STEPS[n - 1])
        edges = np.concatenate(([0], np.cumsum(runs))).tolist()
        for a, b in zip(edges, edges[1:]):
            values[a:b].sort()
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
        self.values = values[new]
        self.sizes = np.bincount(doc[new], minlength=len(words))
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))

    def of(self, place: int) -> np.ndarray:
        return self.values[self.first[place] : self.first[place + 1]]

    def keys(self) -> list[np.ndarray]:
        """Two hashes of each set."""
        out = []
        for turn in (np.uint64(0), _GOLD):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed(self.values ^ turn), dtype=np.uint64)))
            out.append(mixed(sums[self.first[1:]] - sums[self.first[:-1]]).view(np.int64))
        return out

    def tokens(self) -> np.ndarray:
        """One row for each document that is not empty, one number for each coordinate."""
        starts = self.first[:-1][self.sizes > 0]
        out = np.empty((len(starts), COORDINATES), dtype=np.uint64)
        if len(starts):
            for k in range(COORDINATES):
                least = np.minimum.reduceat((self.values ^ _TURN[k]) * _ODD[k], starts)
                out[:, k] = mixed(least + _STEPS[k])
        return out


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _fixed(values: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    width = values.shape[1] * values.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(
        pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    )


def _matrix(column, kind) -> np.ndarray:
    """The matrix whose rows are the values of a binary column of equal lengths."""
    if not len(column):
        return np.empty((0, COORDINATES), dtype=kind)
    joined = np.frombuffer(b"".join(column.to_pylist()), dtype=kind)
    return joined.reshape(len(column), -1)


# A document's number: 20 bits of the task that bundled it, 20 of the bundle, 23 of its place.
_PLACES = 23


def _number(bundle: int, n: int) -> np.ndarray:
    task, turn = bundle >> 32, bundle & 0xFFFFFFFF
    if task >= 1 << 20 or turn >= 1 << 20 or n > 1 << _PLACES:
        raise ValueError("more tasks, bundles or documents than document numbers have room for")
    return (((task << 20) | turn) << _PLACES) + np.arange(n, dtype=np.int64)


def _bundle_of(number: Column) -> Column:
    joint = F.shiftright(number, _PLACES)
    return F.shiftleft(F.shiftright(joint, 20), 32) + joint.bitwiseAND(F.lit((1 << 20) - 1))


def _prints(bundles: DataFrame, width: int) -> DataFrame:
    """Per document: its number, doc_id, size, the hashes of its set and its tokens."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                bundle = Bundle.of(row)
                sets = Sets(bundle, width)
                tokens = np.zeros((len(bundle.ids), COORDINATES), dtype=np.uint64)
                tokens[sets.sizes > 0] = sets.tokens()
                one, two = sets.keys()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_number(row["bundle"], len(bundle.ids))),
                        pa.array(bundle.ids, pa.int64()),
                        pa.array(sets.sizes.astype(np.int64)),
                        pa.array(one),
                        pa.array(two),
                        _fixed(tokens),
                    ],
                    names=["number", "doc_id", "n", "key1", "key2", "tokens"],
                )

    return bundles.mapInArrow(each, "number long, doc_id long, n long, key1 long, key2 long, tokens binary")


def _blocks(classes: DataFrame) -> DataFrame:
    """Rows (number, n, tokens) packed, ``BLOCK`` classes a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                some = batch.slice(low, BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name], pa.int64()),
                        pa.array([np.asarray(some.column(0)).astype(np.int64).tobytes()], pa.binary()),
                        pa.array([np.asarray(some.column(1)).astype(np.int64).tobytes()], pa.binary()),
                        pa.array([b"".join(some.column(2).to_pylist())], pa.binary()),
                    ],
                    names=["bundle", "numbers", "sizes", "tokens"],
                )
                name += 1

    return classes.select("number", "n", "tokens").mapInArrow(
        pack, "bundle long, numbers binary, sizes binary, tokens binary"
    )


def _totals(values: list[np.ndarray], numbers: list[np.ndarray]) -> list[bytes]:
    """For each value of each cell the sum of the numbers beside it in all cells."""
    together, place = np.unique(np.concatenate(values), return_inverse=True)
    sums = np.bincount(place, weights=np.concatenate(numbers), minlength=len(together))
    sums = np.minimum(sums, 2**31 - 1).astype(np.int32)[place]
    cuts = np.cumsum([len(v) for v in values])[:-1]
    return [zstandard.ZstdCompressor(level=1).compress(s.tobytes()) for s in np.split(sums, cuts)]


def _counted(values: np.ndarray, parts: int, answers: list[dict]) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.int64)
    by_part = {a["part"]: a["answer"] for a in answers}
    for part, a, b in part_slices(values, parts):
        out[a:b] = np.frombuffer(zstandard.ZstdDecompressor().decompress(by_part[part]), dtype=np.int32)
    return out


def _posted(blocks: DataFrame, parts: int) -> DataFrame:
    """The classes that may have a partner: number, n, codes (half of each token) and the
    prefix of their tokens, each with the number of classes that hold it."""

    def ask(row: dict):
        return np.unique(np.frombuffer(row["tokens"], dtype=np.uint64), return_counts=True)

    answers = durable(answered(asked(blocks, ask, parts), _totals), "token-answers")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                tokens = np.frombuffer(row["tokens"], dtype=np.uint64).reshape(-1, COORDINATES)
                values, place = np.unique(tokens, return_inverse=True)
                holders = _counted(values, parts, row["answers"])[place.reshape(tokens.shape)]
                shared = (holders > 1).sum(axis=1)
                stay = np.flatnonzero(shared >= LEAST_MATCHES)
                if not len(stay):
                    continue
                tokens, holders, shared = tokens[stay], holders[stay], shared[stay]
                order = np.lexsort((tokens, holders, holders == 1), axis=1)
                prefix = np.arange(COORDINATES)[None, :] < (shared - LEAST_MATCHES + 1)[:, None]
                flat = pa.StructArray.from_arrays(
                    [
                        pa.array(np.take_along_axis(tokens, order, 1)[prefix].view(np.int64)),
                        pa.array(np.take_along_axis(holders, order, 1)[prefix]),
                    ],
                    names=["token", "holders"],
                )
                ends = np.concatenate(([0], np.cumsum(prefix.sum(axis=1)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(row["numbers"], dtype=np.int64)[stay]),
                        pa.array(np.frombuffer(row["sizes"], dtype=np.int64)[stay]),
                        _fixed((tokens >> np.uint64(32)).astype(np.uint32)),
                        pa.ListArray.from_arrays(pa.array(ends), flat),
                    ],
                    names=["number", "n", "codes", "prefix"],
                )

    return with_answers(blocks, answers, "answers").mapInArrow(
        post, "number long, n long, codes binary, prefix array<struct<token:long,holders:long>>"
    )


def _members(bundles: DataFrame, posted: DataFrame, width: int) -> DataFrame:
    """The classes of ``posted`` that share enough shingles with others: number, n, shared
    and the shingles that they share."""
    lists = posted.groupBy(_bundle_of(F.col("number")).alias("__lw_bundle")).agg(
        F.array_sort(F.collect_list(F.col("number").bitwiseAND(F.lit((1 << _PLACES) - 1)))).alias("places")
    )
    wanted = bundles.join(lists.hint("merge"), F.col("bundle") == F.col("__lw_bundle")).drop("__lw_bundle")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                bundle = Bundle.of(row)
                sets = Sets(bundle, width)
                numbers = _number(row["bundle"], len(bundle.ids))[row["places"]]
                values = np.concatenate([sets.of(p) for p in row["places"]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["bundle"]], pa.int64()),
                        pa.array([numbers.tobytes()], pa.binary()),
                        pa.array([sets.sizes[row["places"]].astype(np.int64).tobytes()], pa.binary()),
                        pa.array([values.tobytes()], pa.binary()),
                    ],
                    names=["bundle", "numbers", "sizes", "shingles"],
                )

    packed = durable(wanted.mapInArrow(pack, "bundle long, numbers binary, sizes binary, shingles binary"), "near-sets")
    entries = packed.agg(F.coalesce(F.sum(F.octet_length("shingles")), F.lit(0))).first()[0] / 8
    parts = parts_for(entries)

    def ask(row: dict):
        return np.unique(np.frombuffer(row["shingles"], dtype=np.uint64)), None

    answers = durable(answered(asked(packed, ask, parts), in_several), "shingle-answers")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                shingles = np.frombuffer(row["shingles"], dtype=np.uint64)
                values, place, times = np.unique(shingles, return_inverse=True, return_counts=True)
                common = (bits_of(values, parts, row["answers"]) | (times > 1))[place]
                numbers, sizes = (np.frombuffer(row[n], dtype=np.int64) for n in ("numbers", "sizes"))
                edges = np.concatenate(([0], np.cumsum(sizes)))
                sums = np.concatenate(([0], np.cumsum(common)))
                shared = sums[edges[1:]] - sums[edges[:-1]]
                stay = np.flatnonzero(100 * shared >= LEAST_HUNDREDTHS * sizes).tolist()
                if stay:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(numbers[stay]),
                            pa.array(sizes[stay]),
                            pa.array(shared[stay].astype(np.int64)),
                            pa.array(
                                [shingles[a:b][common[a:b]].tobytes() for a, b in ((edges[i], edges[i + 1]) for i in stay)],
                                pa.binary(),
                            ),
                        ],
                        names=["number", "n", "shared", "shingles"],
                    )

    return with_answers(packed, answers, "answers").mapInArrow(
        sift, "number long, n long, shared long, shingles binary"
    )


def _sizes_fit(one, two):
    return 100 * np.minimum(one, two) >= LEAST_HUNDREDTHS * np.maximum(one, two)


def _complete(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The sorted rows of each batch and the next ones so that no group of equal keys is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in keys])
        change = np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            yield pa.Table.from_batches([*held, batch.slice(0, int(change[-1]))])
            held = [batch.slice(int(change[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name)).astype(np.int64)


def _edges(table: pa.Table, keys: list[str]) -> np.ndarray:
    codes = np.stack([_column(table, k) for k in keys])
    return np.concatenate(([0], np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1, [table.num_rows]))


def _led(near: DataFrame) -> DataFrame:
    """For each class the leader of its lists with most matches: number and leader."""
    cuts = F.ceil(F.col("entry.holders") / UNIT)
    lists = (
        near.select("number", "n", "shared", "codes", F.explode("prefix").alias("entry"))
        .select(
            F.col("entry.token").alias("token"),
            F.pmod(F.xxhash64("number"), cuts).cast("int").alias("cut"),
            (F.col("shared") / F.col("n")).alias("share"),
            "number",
            "n",
            "codes",
        )
        .repartition("token", "cut")
        .sortWithinPartitions("token", "cut", F.col("share").desc(), "number")
    )

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _complete(batches, ["token", "cut"]):
            edges = _edges(table, ["token", "cut"])
            first = np.repeat(edges[:-1], np.diff(edges))
            numbers, sizes = _column(table, "number"), _column(table, "n")
            codes = _matrix(table.column("codes"), np.uint32)
            matches = np.concatenate(
                [
                    (codes[a : a + _TOGETHER] == codes[first[a : a + _TOGETHER]]).sum(axis=1)
                    for a in range(0, len(first), _TOGETHER)
                ]
            )
            good = (matches >= LEAST_MATCHES) & (first != np.arange(len(first))) & _sizes_fit(sizes, sizes[first])
            if good.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[good]), pa.array(numbers[first][good]), pa.array(matches[good])],
                    names=["number", "leader", "matches"],
                )

    found = lists.mapInArrow(star, "number long, leader long, matches long")
    best = F.max_by("leader", F.struct("matches", -F.col("leader")))
    return found.groupBy("number").agg(best.alias("leader"))


def _similar(common, one, two):
    return 100 * common >= LEAST_HUNDREDTHS * (one + two - common)


def _verified(led: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (number, leader) that are similar enough, on their full sets, as a and b."""
    slot = F.pmod(F.xxhash64("number"), F.lit(64)).cast("int")
    pairs = led.withColumn("slot", slot)
    leaders = pairs.select("leader", "slot").distinct().join(
        members.select(F.col("number").alias("leader"), F.col("n").alias("m"), F.col("shingles").alias("others")).hint("merge"),
        "leader",
    )
    both = pairs.join(members.select("number", "n", "shingles").hint("merge"), "number").join(
        leaders.hint("merge"), ["leader", "slot"]
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in _rows(batch):
                one, two = (np.frombuffer(row[n], dtype=np.uint64) for n in ("shingles", "others"))
                place = np.minimum(np.searchsorted(two, one), len(two) - 1)
                if _similar(int((two[place] == one).sum()), row["n"], row["m"]):
                    a.append(row["number"])
                    b.append(row["leader"])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return both.select("number", "n", "shingles", "leader", "m", "others").mapInArrow(verify, "a long, b long")


def _placed(members: DataFrame, led: DataFrame, roots: DataFrame) -> DataFrame:
    """Per class: number, root (of its component) and its tile, as label and piece. A tile
    holds part of a component, or of the classes that have the same leader."""
    root_of_leader = roots.select(F.col("node").alias("leader"), F.col("root").alias("leader_root"))
    places = (
        members.select("number")
        .join(roots.select(F.col("node").alias("number"), "root").hint("merge"), "number", "left")
        .join(led.hint("merge"), "number", "left")
        .join(root_of_leader.hint("merge"), "leader", "left")
        .select(
            "number",
            F.coalesce("root", "number").alias("root"),
            F.coalesce("root", "leader_root", "leader", "number").alias("label"),
        )
    )
    pieces = places.groupBy("label").agg(F.ceil(F.count("*") / TILE).alias("pieces"))
    return places.join(pieces.hint("merge"), "label").select(
        "number", "root", "label", F.pmod(F.xxhash64("number", F.lit(7)), "pieces").cast("int").alias("piece")
    )


def _wanted(near: DataFrame, places: DataFrame) -> DataFrame:
    """The tiles, of other components, in which a class may have a partner."""
    spread = near.select("number", "n", "codes", F.explode("prefix.token").alias("token")).join(
        places.hint("merge"), "number"
    )
    by_root = spread.groupBy("token", "root").agg(F.count("*").alias("k"))
    mixtures = durable(
        by_root.groupBy("token")
        .agg(
            F.count("*").alias("roots"),
            F.sum("k").alias("all"),
            F.max("k").alias("most"),
            F.max_by("root", F.struct("k", "root")).alias("main"),
        )
        .where("roots > 1")
        .select(
            F.col("token").alias("list"),
            "main",
            F.ceil(F.col("all") / UNIT).cast("int").alias("rows"),
            F.ceil((F.col("all") - F.col("most")) / UNIT).cast("int").alias("columns"),
        ),
        "near-mixtures",
    )
    outside = F.col("root") != F.col("main")
    own_row = F.pmod(F.xxhash64("number"), F.col("rows")).cast("int")
    own_column = F.pmod(F.xxhash64("number", F.lit(3)), F.col("columns")).cast("int")

    def unit(row, column, asks: bool):
        return F.struct(row.alias("row"), column.alias("column"), F.lit(asks).alias("asks"))

    def every(n: str):
        return F.sequence(F.lit(0), F.col(n) - 1)

    met = F.transform(every("columns"), lambda c: unit(own_row, c, False))
    asking = F.transform(every("rows"), lambda r: unit(r, own_column, True))
    keys = ["list", "row", "column"]
    units = (
        spread.join(mixtures.hint("merge"), F.col("token") == F.col("list"))
        .withColumn("unit", F.explode(F.when(outside, F.concat(met, asking)).otherwise(met)))
        .select("list", "unit.*", "number", "n", "root", "main", "label", "piece", "codes")
        .repartition(*keys)
        .sortWithinPartitions(*keys, "asks", "number")
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _complete(batches, keys):
            edges = _edges(table, keys)
            names = ("number", "n", "root", "main", "label", "piece")
            number, n, root, main, label, piece = (_column(table, c) for c in names)
            codes = _matrix(table.column("codes"), np.uint32)
            asks = np.asarray(table.column("asks")).astype(bool)
            # The rows that ask come after those that are met, in every unit.
            group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            n_met = np.bincount(group[~asks], minlength=len(edges) - 1)
            askers = np.flatnonzero(asks)
            lengths = n_met[group[askers]]
            found = []
            at = 0
            while at < len(askers):
                end = max(at + 1, at + int(np.searchsorted(np.cumsum(lengths[at:]), _TOGETHER, "right")))
                some, size = askers[at:end], lengths[at:end]
                one = np.repeat(some, size)
                two = np.arange(len(one)) + np.repeat(edges[group[some]] - (np.cumsum(size) - size), size)
                once = (root[two] == main[two]) | (number[one] < number[two])
                skip = (root[one] == root[two]) | ~once | ~_sizes_fit(n[one], n[two])
                one, two = one[~skip], two[~skip]
                near_enough = (codes[one] == codes[two]).sum(axis=1) >= LEAST_MATCHES
                one, two = one[near_enough], two[near_enough]
                if len(one):
                    found.append(np.unique(np.stack([number[one], label[two], piece[two]]), axis=1))
                at = end
            if found:
                rows = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32))],
                    names=["number", "label", "piece"],
                )

    return units.mapInArrow(meet, "number long, label long, piece int").distinct()


def _linked(wanted: DataFrame, places: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) between classes and the tiles that they ask for: one for each component
    of a tile with a similar enough set."""
    sets = members.select(F.col("number").alias("member"), "n", "shingles")
    tiles = wanted.groupBy("label", "piece").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("slots"))
    slots = F.explode(F.sequence(F.lit(0), F.col("slots") - 1))
    held = (
        places.join(tiles.hint("merge"), ["label", "piece"])
        .select("label", "piece", slots.alias("slot"), F.lit(False).alias("asks"), "number", "root")
    )
    asking = (
        wanted.join(tiles.hint("merge"), ["label", "piece"])
        .join(places.select("number", "root").hint("merge"), "number")
        .select(
            "label",
            "piece",
            F.pmod(F.xxhash64("number"), "slots").cast("int").alias("slot"),
            F.lit(True).alias("asks"),
            "number",
            "root",
        )
    )
    keys = ["label", "piece", "slot"]
    rows = (
        held.union(asking)
        .join(sets.hint("merge"), F.col("number") == F.col("member"))
        .select(*keys, "asks", "number", "root", "n", "shingles")
        .repartition(*keys)
        .sortWithinPartitions(*keys, "asks", "number")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile, held = None, None, []
        for batch in batches:
            a, b = [], []
            for row in _rows(batch):
                if at != (now := tuple(row[k] for k in keys)):
                    at, tile, held = now, None, []
                if not row["asks"]:
                    held.append(row)
                    continue
                tile = tile or _Tile(held)
                for number in tile.partners(row):
                    a.append(row["number"])
                    b.append(number)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(verify, "a long, b long")


class _Tile:
    """The sets of a tile, as lists of their holders by shingle."""

    def __init__(self, rows: list[dict]):
        self.numbers, self.roots, self.sizes = (
            np.array([r[k] for r in rows], dtype=np.int64) for k in ("number", "root", "n")
        )
        sets = [np.frombuffer(r["shingles"], dtype=np.uint64) for r in rows]
        owner = np.repeat(np.arange(len(rows)), [len(s) for s in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.owner = owner[order]
        self.values, self.first = np.unique(values[order], return_index=True)
        self.last = np.append(self.first[1:], len(values))

    def partners(self, row: dict) -> list[int]:
        own = np.frombuffer(row["shingles"], dtype=np.uint64)
        place = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        place = place[self.values[place] == own]
        lengths = self.last[place] - self.first[place]
        spots = np.arange(lengths.sum()) + np.repeat(self.first[place] - (np.cumsum(lengths) - lengths), lengths)
        common = np.bincount(self.owner[spots], minlength=len(self.numbers))
        good = np.flatnonzero(_similar(common, self.sizes, row["n"]) & (self.roots != row["root"]))
        _, one = np.unique(self.roots[good], return_index=True)
        return self.numbers[good[one]].tolist()


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id that links lead to)
    and kept (is it this document's?)."""
    bundles = bundled(docs, BUNDLE_BYTES, lower_bytes)
    prints = durable(_prints(bundles, width), "minhash-prints")
    classes = durable(
        prints.where("n > 0").groupBy("key1", "key2").agg(F.min("number").alias("number"), F.min("doc_id").alias("first")),
        "minhash-classes",
    )
    holders = prints.join(classes.select("number").hint("merge"), "number")
    blocks = durable(_blocks(holders), "minhash-blocks")
    n_classes = classes.count()
    posted = durable(_posted(blocks, parts_for(COORDINATES * n_classes)), "minhash-posted")
    members = durable(_members(bundles, posted, width), "minhash-members")
    near = durable(
        members.select("number", "n", "shared").join(posted.drop("n").hint("merge"), "number"), "minhash-near"
    )
    led = durable(_led(near), "minhash-leaders")
    led_links = durable(_verified(led, members), "minhash-links")
    places = durable(_placed(members, led, rooted(led_links)), "minhash-places")
    wanted = durable(_wanted(near, places), "minhash-wanted")
    links = durable(led_links.union(_linked(wanted, places, members)), "minhash-links")
    roots = rooted(links).select(F.col("node").alias("number"), "root")
    in_components = classes.join(roots.hint("merge"), "number", "left").withColumn("root", F.coalesce("root", "number"))
    least = in_components.groupBy("root").agg(F.min("first").alias("component"))
    named = durable(
        in_components.join(least.hint("merge"), "root").select(
            F.col("key1").alias("class1"), F.col("key2").alias("class2"), "component"
        ),
        "minhash-components",
    )
    same = (F.col("key1") == F.col("class1")) & (F.col("key2") == F.col("class2")) & (F.col("n") > 0)
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return (
        prints.select("doc_id", "n", "key1", "key2")
        .join(named.hint("merge"), same, "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            F.col("doc_id").eqNullSafe(component).alias("kept"),
        )
    )
