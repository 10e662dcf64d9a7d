"""Secret scan with a randomness test battery, in DataFrame functions only.

Base patterns name the usual shapes of credentials. Beside them, every maximal run of 20
or more base64-like characters is tested: its encoding is inferred from its characters;
chi-squared uniformity over that alphabet, a runs test on the upper against the lower
half of the alphabet, and lag-1 serial correlation must all agree with randomness. A run
counts as found when, besides, the hypothesis that it is ordinary text is rejected. That has two
kinds of evidence, of which the stronger counts (its p-value doubled): text leaves a
chi-squared statistic that grows with its length, which tells long runs; and text follows
the letter pairs of the other candidates of the table, changes of case and class included,
while a random run does not. The p-value of the pairs is the square root of the likelihood
ratio of text to random, which no text beats more often than that says (Markov); the root
allows for text whose unusual pairs come together. Pairs are counted once for each distinct
candidate, and a run's own are left out. The rejections are controlled for false discovery
(Benjamini-Hochberg) within each encoding and length class, over all documents.

Defined cases: a null text is empty; an empty table gives no rows; repeated rows are
judged alike, each row by itself; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.sources.durable import durable

KINDS = ("assign", "access", "hex", "random")

# Shapes of credentials, the group that is measured, its least length.
PATTERNS = (
    (
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    (r"AKIA[A-Z0-9]+", 0, 18),
    (r"[0-9a-f]{16,}", 0, 16),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()

# Alphabets in the order of their digits, and how far ordinary text is from
# uniform over each (alphabet size times the sum of squared letter shares, less one); for
# the alphabets with both cases as little as for words run together in capitals.
ALPHABETS = {
    "hex": (_DIGITS + "abcdef", 2.0),
    "HEX": (_DIGITS + "ABCDEF", 2.0),
    "base32": (_UPPER + "234567", 1.1),
    "base36": (_DIGITS + _LOWER, 1.3),
    "base64": (_UPPER + _LOWER + _DIGITS + "+/", 2.0),
    "base64url": (_UPPER + _LOWER + _DIGITS + "-_", 2.0),
}
_SHAPES = (
    ("hex", r"^[0-9a-f]+$"),
    ("HEX", r"^[0-9A-F]+$"),
    ("base32", r"^[A-Z2-7]+$"),
    ("base36", r"^[0-9a-z]+$"),
    ("base64url", r"[-_]"),
)

_SPAN = "struct<start:int,kind:int,end:int>"
# Steps of -log10(p) in which p-values are counted.
_BIN = 0.05
_BINS = 400
# The characters of candidates, and how many letters after a character weigh as much as
# what the random hypothesis expects there.
_ALL = _UPPER + _LOWER + _DIGITS + "+/_=-"
_PRIOR = 32.0


def _located(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` is long enough, by
    adding up the lengths of matches and of the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    steps = F.arrays_zip(
        F.slice(pieces, 1, F.size(found)).alias("gap"),
        F.transform(found, lambda x: F.length(x)).alias("long"),
        F.transform(judged, lambda x: F.length(x)).alias("judged"),
    )
    none = F.expr(f"cast(array() as array<{_SPAN}>)")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["long"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(
            end.alias("at"),
            F.when(x["judged"] >= least, F.array_append(state["spans"], span))
            .otherwise(state["spans"])
            .alias("spans"),
        )

    spans = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"]
    )
    return F.when(F.size(found) > 0, spans).otherwise(none)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by the usual five-term approximation."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    terms = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    poly = F.lit(0.0)
    for c in reversed(terms):
        poly = (poly + c) * t
    p = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, p).otherwise(1 - p)


def _chosen(encoding: Column, values: dict[str, object]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), encoding)


def _named(runs: DataFrame) -> DataFrame:
    """Adds the run without padding, and its encoding."""
    encoding = F.lit("base64")
    for name, shape in reversed(_SHAPES):
        encoding = F.when(F.col("bare").rlike(shape), name).otherwise(encoding)
    return runs.withColumn("bare", F.regexp_replace("value", "=+$", "")).withColumn("encoding", encoding)


def _pairs(text: Column) -> Column:
    """Number of each pair of neighbouring characters."""
    at = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(_ALL), c))
    return F.zip_with(
        F.slice(at, 1, F.size(at) - 1),
        F.slice(at, 2, F.size(at) - 1),
        lambda x, y: (x - 1) * len(_ALL) + y - 1,
    )


def pair_counts(runs: DataFrame) -> DataFrame:
    """One row: in how many runs each pair occurs (an array by number), the sums by first
    character, and the number of runs of each encoding."""
    named = _named(runs)
    square = len(_ALL) * len(_ALL)

    def as_map(key: str) -> Column:
        return F.map_from_entries(F.collect_list(F.struct(key, "held")))

    pairs = (
        named.select(F.explode(F.array_distinct(_pairs(F.col("bare")))).alias("pair"))
        .groupBy("pair")
        .agg(F.count("*").alias("held"))
        .agg(as_map("pair").alias("by_pair"))
        .select(
            F.transform(
                F.sequence(F.lit(0), F.lit(square - 1)),
                lambda i: F.coalesce(F.try_element_at("by_pair", i), F.lit(0)).cast("double"),
            ).alias("by_pair")
        )
    )
    encodings = named.groupBy("encoding").agg(F.count("*").alias("held")).agg(as_map("encoding").alias("by_encoding"))
    by_first = F.transform(
        F.sequence(F.lit(0), F.lit(len(_ALL) - 1)),
        lambda a: F.aggregate(F.slice("by_pair", a * len(_ALL) + 1, len(_ALL)), F.lit(0.0), lambda s, x: s + x),
    )
    return pairs.select("by_pair", by_first.alias("by_first")).crossJoin(encodings)


def with_pair_evidence(tested: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``p_pairs`` to rows of ``with_battery``, from the one row of ``pair_counts``."""

    def ratio(pair: Column) -> Column:
        """log of the pair's probability in text over that in a random run."""
        others = F.get("by_pair", pair) - 1
        first = F.get("by_first", F.floor(pair / len(_ALL)).cast("int")) - F.col("own")
        share = (others + _PRIOR / F.col("size")) / (F.greatest(first, others) + _PRIOR)
        return F.log(share) + F.log(F.col("size").cast("double"))

    total = F.aggregate(F.map_values("by_encoding"), F.lit(0.0), lambda s, x: s + x)
    # Text is as likely among the runs of its encoding as its pairs say, or more.
    narrowed = F.log(total / F.element_at("by_encoding", F.col("encoding")))
    foreign = F.length(F.call_function("translate", F.col("bare"), F.col("letters"), F.lit(""))) > 0
    return (
        tested.crossJoin(counts)
        .withColumn("pairs", _pairs(F.col("bare")))
        .withColumn("own", F.size(F.array_distinct("pairs")))
        .withColumn("ratio", narrowed + F.aggregate("pairs", F.lit(0.0), lambda s, x: s + ratio(x)))
        .withColumn(
            "p_pairs",
            F.when(foreign, 1.0).otherwise(F.exp(F.least(F.col("ratio"), F.lit(0.0)) / 2)),
        )
        .drop("by_pair", "by_first", "by_encoding", "pairs", "own", "ratio")
    )


def with_battery(runs: DataFrame) -> DataFrame:
    """Adds encoding, the three test p-values and the text hypothesis' p-value to rows
    that hold a run of characters in ``value``."""
    halves = {
        name: "L" * (len(letters) // 2) + "H" * (len(letters) - len(letters) // 2)
        for name, (letters, _) in ALPHABETS.items()
    }

    def folded(text: Column) -> Column:
        """Each character replaced by the half of the alphabet that it is in."""
        out = F.lit(None).cast("string")
        for name, (letters, _) in ALPHABETS.items():
            out = F.when(F.col("encoding") == name, F.translate(text, letters, halves[name])).otherwise(out)
        return out

    def count(text: str, part: str) -> Column:
        return (F.length(text) - F.length(F.replace(F.col(text), F.lit(part), F.lit("")))) / len(part)

    squares = F.aggregate(
        F.split("letters", ""),
        F.lit(0.0),
        lambda s, c: s + F.pow(F.length("bare") - F.length(F.replace(F.col("bare"), c, F.lit(""))), F.lit(2.0)),
    )
    values = F.transform(F.split("bare", ""), lambda c: F.instr(F.col("letters"), c).cast("double"))
    df, n = F.col("size") - 1, F.col("n")
    lean = (
        F.pow(F.col("chi2") / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))
    ) / F.sqrt(2 / (9 * df))
    mean_runs = 2 * F.col("high") * (n - F.col("high")) / n + 1
    spread = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    runs_z = F.when(spread > 0, (F.col("runs") - mean_runs) / F.sqrt(spread)).otherwise(99.0)
    excess = n * F.col("excess")
    text_z = (F.col("chi2") - df - excess) / F.sqrt(2 * (df + 2 * excess))

    def sum_of(column: Column) -> Column:
        return F.aggregate(column, F.lit(0.0), lambda s, x: s + x)

    return (
        _named(runs)
        .withColumn("letters", _chosen(F.col("encoding"), {k: v[0] for k, v in ALPHABETS.items()}))
        .withColumn("size", F.length("letters"))
        .withColumn("excess", _chosen(F.col("encoding"), {k: v[1] for k, v in ALPHABETS.items()}))
        .withColumn("n", F.length("bare").cast("double"))
        .where("n >= 16")
        .withColumn("chi2", F.col("size") / n * squares - n)
        .withColumn("folded", folded(F.col("bare")))
        .withColumn("high", count("folded", "H"))
        .withColumn("runs", 1 + count("folded", "LH") + count("folded", "HL"))
        .withColumn("values", values)
        .withColumn("mean", sum_of(F.col("values")) / n)
        .withColumn("values", F.transform("values", lambda x: x - F.col("mean")))
        .withColumn("var", sum_of(F.transform("values", lambda x: x * x)))
        .withColumn(
            "lagged",
            sum_of(
                F.zip_with(
                    F.slice("values", 1, F.size("values") - 1),
                    F.slice("values", 2, F.size("values") - 1),
                    lambda x, y: x * y,
                )
            ),
        )
        .withColumn("p_uniform", _upper_tail(lean))
        .withColumn("p_runs", 2 * _upper_tail(F.abs(runs_z)))
        .withColumn(
            "p_serial",
            F.when(F.col("var") > 0, 2 * _upper_tail(F.abs(F.col("lagged") / F.col("var") * F.sqrt(n)))).otherwise(0.0),
        )
        .withColumn("p_text", _upper_tail(-text_z))
    )


def length_class(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def discovery_bins(tested: DataFrame, rate: float) -> dict[str, int]:
    """Least bin of -log10(p) that is accepted, by encoding and length class
    (Benjamini-Hochberg). At most one row for each of six encodings and some thirty
    length classes comes to the driver, whatever the number of documents."""
    counts = tested.groupBy("family", "bin").agg(F.count("*").alias("held"))
    upto = Window.partitionBy("family").orderBy(F.col("bin").desc())
    family = Window.partitionBy("family")
    cut = (
        counts.withColumn("rank", F.sum("held").over(upto))
        .withColumn("all", F.sum("held").over(family))
        .where(F.pow(F.lit(10.0), -F.col("bin") * _BIN) * F.col("all") <= rate * F.col("rank"))
        .groupBy("family")
        .agg(F.min("bin").alias("bin"))
    )
    return {r["family"]: r["bin"] for r in cut.collect()}


def found_secrets(docs: DataFrame, rate: float = 0.01, level: float = 0.001) -> DataFrame:
    """One row per document: doc_id, base (spans of the base patterns) and all_spans
    (those and the random runs), each an array of (start, kind, end) in code points.
    ``rate`` is the share of text among accepted runs that is put up with, ``level``
    the level at which each test of the battery rejects randomness."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(
        F.concat(*[_located(text, p, g, n, k) for k, (p, g, n) in enumerate(PATTERNS)])
    )
    candidates = _located(text, CANDIDATE, 0, 20, 3)
    scanned = docs.select("doc_id", base.alias("base"), candidates.alias("spots"), text.alias("text")).select(
        "doc_id",
        "base",
        F.transform(
            F.filter(
                "spots",
                lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])),
            ),
            lambda s: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]).alias("value"),
            ),
        ).alias("spots"),
    )
    scanned = durable(scanned, "secret-spots")
    values = durable(
        scanned.select(F.explode(F.array_distinct(F.transform("spots", lambda s: s["value"]))).alias("value"))
        .groupBy("value")
        .agg(F.count("*").alias("docs")),
        "secret-values",
    )
    counts = durable(pair_counts(values), "secret-pairs")
    tested = with_pair_evidence(with_battery(values), counts).withColumn(
        "p_text", F.least(2 * F.least("p_text", "p_pairs"), F.lit(1.0))
    )
    tested = tested.select(
        "value",
        F.concat_ws(":", "encoding", length_class(F.col("n"))).alias("family"),
        F.least(F.floor(-F.log10(F.greatest("p_text", F.lit(1e-30))) / _BIN), F.lit(_BINS)).cast("int").alias("bin"),
        ((F.col("p_uniform") >= level) & (F.col("p_runs") >= level) & (F.col("p_serial") >= level)).alias("random"),
    )
    tested = durable(tested, "secret-tests")
    cuts = discovery_bins(tested, rate)
    limit = F.lit(None).cast("int")
    for family, bin in cuts.items():
        limit = F.when(F.col("family") == family, bin).otherwise(limit)
    accepted = tested.where(F.col("random") & (F.col("bin") >= limit)).select("value")
    # Only documents with candidates meet the accepted values; a value is one row there.
    keyed = scanned.select(
        "doc_id", "base", "spots", F.when(F.size("spots") > 0, F.uuid()).alias("row")
    )
    keyed = durable(keyed, "secret-rows")
    extra = (
        keyed.where("row is not null")
        .select("row", F.explode("spots").alias("spot"))
        .withColumn("value", F.col("spot.value"))
        .join(accepted, "value")
        .groupBy(F.col("row").alias("hit"))
        .agg(
            F.collect_list(
                F.struct(
                    F.col("spot.start").alias("start"), F.lit(3).alias("kind"), F.col("spot.end").alias("end")
                )
            ).alias("extra")
        )
    )
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    return keyed.join(extra, F.col("row") == F.col("hit"), "left").select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("extra", none))).alias("all_spans")
    )


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
        ),
        ",",
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
