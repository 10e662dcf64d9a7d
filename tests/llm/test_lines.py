from __future__ import annotations

from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerweave.llm import lines
from ledgerweave.sources.durable import durable

from .conftest import words_of


def tie(text):
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def brute(rows, threshold=Fraction(4, 5)):
    """Removed line numbers of each row, compared with every earlier line."""
    flat = []
    for doc in sorted({(r[0] is None, r[0] or 0, tie(r[1]), r[1]) for r in rows if r[1] is not None}):
        for i, line in enumerate(doc[3].split("\n")):
            if words := frozenset(words_of(line, lower=True)):
                flat.append((doc, i, words))
    gone = {}
    for at, (doc, i, words) in enumerate(flat):
        for _, _, before in flat[:at]:
            shared = len(words & before)
            if shared >= threshold * (len(words) + len(before) - shared):
                gone.setdefault(((doc[0], doc[1]), doc[3]), []).append(i)
                break
    return {k: sorted(v) for k, v in gone.items()}


def found(frame):
    rows = lines.removed_lines(frame).join(
        frame.select("doc_id", "text", F.xxhash64("text").alias("t")).distinct().withColumnRenamed("doc_id", "d"),
        F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tie")),
    )
    return {((r["doc_id"] is None, r["doc_id"] or 0), r["text"]): list(r["lines"]) for r in rows.collect()}


def test_small_table_equals_brute_force(small_docs):
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    assert found(small_docs) == brute(rows)


@pytest.fixture(scope="module")
def variants(spark):
    """One line in 60 versions that differ in a word or two, over as many documents, each
    between lines of its own; and lines of very frequent words."""
    words = [f"t{i}" for i in range(12)]
    rows = []
    for i in range(60):
        line = words[:]
        line[i % 12] = f"new{i}"
        if i % 3 == 0:
            line[(i + 5) % 12] = f"other{i}"
        rows.append((i, f"own {i} line{i} here\n" + " ".join(line) + f"\nthe of and {words[i % 12]}"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_variants_are_found_when_a_class_has_many_partners(variants):
    rows, frame = variants
    assert found(frame) == brute(rows)


def test_split_prefix_words_lose_nothing(variants, monkeypatch):
    rows, frame = variants
    monkeypatch.setattr(lines, "_parts", lambda classes, part_rows: __import__("numpy").full(1 << 20, 3, dtype="int32"))
    assert found(frame) == brute(rows)


def test_long_lines_that_differ_are_not_compared_word_by_word(spark):
    """Lines of 200 words with the same rarest word; two of them are alike."""
    rows = [(i, " ".join(["rarest", *(f"w{i}x{j}" for j in range(200))])) for i in range(60)]
    rows.append((60, rows[3][1].replace(" w", " y", 10)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = durable(lines._classes(lines.described(docs, lines.word_counts(docs), lines.THRESHOLD)), "line-classes")
    # The word stands first in every set.
    classes = made.withColumn("prefix", F.array(F.lit(7).cast("int")))
    pairs = lines.offers(classes, lines.THRESHOLD, None, 20_000).select("later", "earlier").distinct().collect()
    name = {r["doc"]: r["bits"] for r in made.collect()}
    assert (name[60], name[3]) in {tuple(r) for r in pairs} and len(pairs) < 60
    gone = lines.removed_lines(docs).select("doc_id", "lines").collect()
    assert [(r["doc_id"], list(r["lines"])) for r in gone] == [(60, [0])]


def test_edge_cases(edge_docs, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows]
    assert found(edge_docs) == brute(rows)


@pytest.mark.parametrize("doc_id", [None, 7, (1 << 63) - 1])
def test_documents_without_an_id_of_their_own(spark, doc_id):
    words = [f"t{i}" for i in range(12)]
    rows = [(3, "an early line of five words\nend")]
    for i in range(12):
        near = " ".join(words[:i] + [f"new{i}"] + words[i + 1 :])
        rows.append((doc_id, f"{near}\nthe very same line in all of them\nown {i} line{i} here\nan early line of five words"))
    rows += rows[4:6]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expect = brute(rows)
    assert found(frame) == expect and len(expect) == 12
    kept = [r["text"].split("\n") for r in lines.without_repeated_lines(frame).distinct().collect()]
    assert sum("the very same line in all of them" in k for k in kept) == 1


def test_report_and_text(edge_docs, edge_rows):
    gone = brute([(r[0], r[1]) for r in edge_rows])
    report = lines.line_report(edge_docs).collect()
    assert len(report) == len(edge_rows)
    assert sum(r["n_removed"] for r in report) == sum(
        len(gone.get(((r[0] is None, r[0] or 0), r[1]), ())) for r in edge_rows
    )
    assert [r["n_lines"] for r in report if r["doc_id"] == 1] == [0]
    left = lines.without_repeated_lines(edge_docs)
    assert left.columns == edge_docs.columns
    texts = {(r["doc_id"], r["source"]): r["text"] for r in left.collect()}
    assert texts[(1, "s1")] is None and texts[(2, "s1")] == ""
    assert texts[(4, "s1")] == edge_rows[3][1] and texts[(5, "s2")] == ""


def test_no_rows(no_docs):
    assert lines.line_report(no_docs).collect() == []
    assert lines.without_repeated_lines(no_docs).collect() == []
