"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.oracles import ORACLES  # noqa: F401
from ledgerweave.llm import archives, conversations, decontaminate, fingerprints, language, lines, minhash, mixing, phrases, ranking, secrets, simhash, suffix_tree


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return archives.round_trip(pages).drop("url", "date")


def held_out(divisor: int) -> Column:
    """Documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == 2, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out(4))
    model = language.learn(docs, ~F.col("held_out"))
    return language.predicted(docs, model, "doc_id", "held_out")


def op1_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = phrases.without_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(documents(spark, sf_dir))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir))
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scored(documents(spark, sf_dir), held_out(7))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.found_secrets(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[secrets.count_of(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.spelled(F.col("base")), 256).alias("base_sha256"),
        secrets.spelled(F.col("all_spans")).alias("spans"),
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(documents(spark, sf_dir)).drop("source")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared_with_next(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeated_phrases": op1_repeated_phrases,
    "op2_line_dedup": op2_line_dedup,
    "op3_arc_to_warc": op3_arc_to_warc,
    "op4_language": op4_language,
    "op5_decontaminate": op5_decontaminate,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_secret_scan": op7_secret_scan,
    "op8_source_mix": op8_source_mix,
    "op9_fingerprints": op9_fingerprints,
    "op10_simhash": op10_simhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ranked_search": op12_ranked_search,
    "op13_minhash": op13_minhash,
}

