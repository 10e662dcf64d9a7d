"""The corpus pipeline: documents in, a training mix out.

Each stage works on all that its predecessor kept and returns the columns of documents,
apart from the last, which returns the blocks of the mix. Every stage's result but the last
is written as Parquet and read again as the next one's documents; the tables that a stage
stored on its way are deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import decontaminate, language, lines, mixing, simhash
from ledgerweave.llm.queries import benchmark, documents
from ledgerweave.sources.durable import settled


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near a centroid of some language."""
    return language.without_rejected(docs, language.learn(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines similar to an earlier one; n_chars follows the text."""
    left = lines.without_repeated_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: shingles of three words, three bits."""
    return simhash.one_of_each_group(docs, shingle=3, radius=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_contaminated(docs, benchmark(spark, sf_dir))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row per block slot, with its text and the documents it is from."""
    return mixing.mixed_blocks(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", keep_one_of_copies),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
]

# Centroids, components and mixing draws are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    *earlier, (_, last) = STAGES
    for name, stage in earlier:
        docs = settled(spark, name, lambda: stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
