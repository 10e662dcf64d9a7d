from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

# Names that operators use inside; as extra columns they must do no harm.
CLASHING = (
    "words part n key value place size tie line component_id fp score held_out root node a b "
    "range tail bundle block slot shard source_no first last target taken item_id distance "
    "record_id kind lines sig prefix doc spots rejected lang_pred"
).split()

LONG = " ".join(f"w{i % 977}x{i % 1013}" for i in range(60_000))
SHARED = " ".join(f"shared{i}" for i in range(60))

# doc_id, text, lang, source: nulls in every column, empty and blank texts, copies, ties,
# a repeated row, a very long text, a text that repeats itself, and astral characters.
ROWS = [
    (1, None, "en", "s1"),
    (2, "", None, "s1"),
    (3, " \t\n\r\x0b\x0c ", "en", None),
    (4, "One two THREE four\nfive six seven eight nine", "en", "s1"),
    (5, "One two THREE four\nfive six seven eight nine", "en", "s2"),
    (5, "One two THREE four\nfive six seven eight nine", "en", "s2"),
    (6, SHARED + "\nalpha beta", "en", "s1"),
    (7, "gamma " + SHARED + " delta", None, "s1"),
    (8, "again " * 80, "en", "s3"),
    (9, LONG, "en", "s1"),
    (10, "naïve 😀 ünïcode word   façade", "fr", "s1"),
    (None, "a text without a number that stands alone here", "en", "s1"),
    (11, "five six seven eight nine ten", "en", ""),
    (12, "1234 5678 !!! ---", "en", "s1"),
    (13, "One two three four", "en", "s1"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def words_of(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(_LOWER) if lower else text)


def cluttered(frame):
    """The same rows with extra columns of awkward names."""
    return frame.select("*", *[F.lit(7).alias(c) for c in CLASHING if c not in frame.columns])


@pytest.fixture(scope="session")
def edge_rows():
    return ROWS


@pytest.fixture(scope="session")
def edge_docs(spark):
    return cluttered(spark.createDataFrame(ROWS, SCHEMA))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()
