"""Scans and sinks of every artifact, as partitioned tables.

    views, features       partitioned by bank_id
    encoded datasets      partitioned by plan_hash, bank_id, split
    model parameters      partitioned by model_id, round
    plan                  table form, and a one-document JSON form for exchange
    round log             JSON lines, truncated by "overwrite", extended by "append"
    documents             JSON by bank_id, one document a row (statistics, reports)
    summaries             one sorted CSV file, a row per bank
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.settings import FeatureSpec
from ledgerweave.sources.small import small_table

TEXT_PARTITIONS = ("bank_id", "plan_hash", "split", "model_id")
WRITE_MODES = ("overwrite", "append", "errorifexists")
PLAN_COLUMNS = "idx int, kind string, col string, value string, mean double, std double, name string"
PLAN_DOCUMENT = (
    "schema_version string, "
    "feature_schema struct<cat_cols: array<string>, num_cols: array<string>>, "
    "global_categories map<string, array<string>>, "
    "global_numeric map<string, struct<mean: double, std: double>>"
)
PARAMETER_SCHEMA = pa.schema(
    [
        ("model_id", pa.string()),
        ("alpha", pa.float64()),
        ("round", pa.int32()),
        ("key", pa.string()),
        ("shape", pa.list_(pa.int32())),
        ("values", pa.list_(pa.float64())),
        ("meta", pa.map_(pa.string(), pa.string())),
    ]
)


def _checked(mode: str) -> str:
    if mode not in WRITE_MODES:
        raise ValueError(f"mode must be one of {WRITE_MODES}")
    return mode


# --- raw ledger ---------------------------------------------------------------


def _as_text(df: DataFrame, names: Sequence[str]) -> T.StructType:
    """The table's schema with the named columns as text. Spark would otherwise guess
    partition values, turning bank '007' into 7."""
    return T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in names else f.dataType) for f in df.schema]
    )


def _read_parquet(spark: SparkSession, path: str) -> DataFrame:
    schema = _as_text(spark.read.parquet(path), TEXT_PARTITIONS)
    return spark.read.schema(schema).parquet(path)


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text, so that coercion decides what is valid
    and nothing is inferred from the data. Directories named bank_id=<bank> below
    ``path`` become a column."""
    reader = spark.read.option("header", True)
    found = reader.csv(path)
    return reader.schema(_as_text(found, found.columns)).csv(path)


def write_by_bank(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Partitioned by bank. REBALANCE sizes the output files: small banks share a task,
    and AQE splits a bank that is larger than the target over several."""
    writer = df.hint("rebalance", "bank_id").write.mode(_checked(mode)).partitionBy("bank_id")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.option("partitionOverwriteMode", "dynamic").format(fmt).save(path)


def read_by_bank(spark: SparkSession, path: str, bank: str | None = None) -> DataFrame:
    """Parquet by bank; naming a bank prunes the scan to its partition."""
    df = _read_parquet(spark, path)
    return df if bank is None else df.where(F.col("bank_id") == bank)


# --- plan ----------------------------------------------------------------------


def plan_document(plan: DataFrame, spec: FeatureSpec) -> DataFrame:
    """One row, one column ``plan_json``: the plan as an exchangeable document. Its size
    is the width of the model."""
    values = F.transform(
        F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda r: r["value"]
    )
    cats = (
        plan.where(F.col("kind") == "cat")
        .groupBy("col")
        .agg(values.alias("values"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "values")))))
    )
    nums = plan.where(F.col("kind") == "num").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("col", F.struct("mean", "std"))))
        )
    )
    document = F.struct(
        F.lit(spec.version).alias("schema_version"),
        F.struct(
            F.array(*(F.lit(c) for c in spec.cat_cols)).alias("cat_cols"),
            F.array(*(F.lit(c) for c in spec.num_cols)).alias("num_cols"),
        ).alias("feature_schema"),
        cats.scalar().alias("global_categories"),
        nums.scalar().alias("global_numeric"),
    )
    return plan.sparkSession.range(1).select(F.to_json(document).alias("plan_json"))


def plan_from_document(documents: DataFrame) -> DataFrame:
    """The plan table of a document written by :func:`plan_document`."""
    d = F.from_json("plan_json", PLAN_DOCUMENT)
    parsed = documents.select(d.alias("d")).select(
        F.col("d.feature_schema.num_cols").alias("num_cols"),
        F.col("d.feature_schema.cat_cols").alias("cat_cols"),
        F.col("d.global_categories").alias("categories"),
        F.col("d.global_numeric").alias("numeric"),
    )
    numeric = F.transform(
        "num_cols",
        lambda c, i: F.struct(
            i.cast("int").alias("idx"),
            F.lit("num").alias("kind"),
            c.alias("col"),
            F.lit(None).cast("string").alias("value"),
            F.element_at("numeric", c)["mean"].alias("mean"),
            F.element_at("numeric", c)["std"].alias("std"),
            F.concat(F.lit("num__"), c).alias("name"),
        ),
    )
    pairs = F.flatten(
        F.transform(
            "cat_cols",
            lambda c: F.transform(
                F.element_at("categories", c), lambda v: F.struct(c.alias("col"), v.alias("value"))
            ),
        )
    )
    categorical = F.transform(
        pairs,
        lambda p, i: F.struct(
            (i + F.size("num_cols")).cast("int").alias("idx"),
            F.lit("cat").alias("kind"),
            p["col"].alias("col"),
            p["value"].alias("value"),
            F.lit(None).cast("double").alias("mean"),
            F.lit(None).cast("double").alias("std"),
            F.concat(F.lit("cat__"), p["col"], F.lit("_"), p["value"]).alias("name"),
        ),
    )
    return parsed.select(F.inline(F.concat(numeric, categorical)))


def save_plan(plan: DataFrame, spec: FeatureSpec, path: str, mode: str = "errorifexists") -> None:
    plan_document(plan, spec).write.mode(_checked(mode)).text(path)


def load_plan(spark: SparkSession, path: str) -> DataFrame:
    return plan_from_document(spark.read.text(path).withColumnRenamed("value", "plan_json"))


# --- encoded datasets ------------------------------------------------------------


def save_dataset(
    encoded: DataFrame, plan_hash: str, path: str, mode: str = "errorifexists"
) -> None:
    """Encoded rows pinned to the plan they were made with. By default an existing
    dataset is refused; "overwrite" replaces the partitions written."""
    (
        encoded.withColumn("plan_hash", F.lit(plan_hash))
        .hint("rebalance", "bank_id", "split")
        .write.mode(_checked(mode))
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("plan_hash", "bank_id", "split")
        .parquet(path)
    )


def load_dataset(spark: SparkSession, path: str, plan_hash: str) -> DataFrame:
    """The dataset of exactly this plan. Rows of other plans are pruned by partition; a
    dataset that has only others is an error, not an empty table."""
    df = _read_parquet(spark, path)
    if "plan_hash" not in df.columns:
        raise ValueError(f"{path} does not say which plan it was encoded with")
    mine = df.where(F.col("plan_hash") == plan_hash)
    if mine.isEmpty():
        raise ValueError(f"{path} has no dataset for plan {plan_hash}")
    return mine


def dataset_meta(dataset: DataFrame, width: int, version: str) -> DataFrame:
    """(bank_id, plan_hash, schema_version, feature_dim, data_used_n, <split>_n,
    <split>_pos): what a bank states about its encoded dataset."""
    pick = {s: F.col("split") == s for s in ("train", "val", "test")}
    counts = [F.count("*").alias("data_used_n")]
    counts += [F.count_if(c).alias(f"{s}_n") for s, c in pick.items()]
    counts += [F.count_if(c & (F.col("y") == 1)).alias(f"{s}_pos") for s, c in pick.items()]
    return (
        dataset.groupBy("bank_id", "plan_hash")
        .agg(*counts)
        .withColumns(
            {"schema_version": F.lit(version), "feature_dim": F.lit(width)}
        )
    )


# --- model parameters --------------------------------------------------------------


def save_params(
    spark: SparkSession,
    path: str,
    model_id: str,
    params: Mapping[str, np.ndarray],
    alpha: float | None = None,
    round_id: int | None = None,
    meta: Mapping[str, str] | None = None,
    mode: str = "append",
) -> None:
    """Arrays of any names and shapes. Models are told apart by id, alpha and round, so
    one alpha never overwrites another's file; the meta map travels with them."""
    save_models(spark, path, [(model_id, alpha, round_id, params, meta or {})], mode)


def save_models(
    spark: SparkSession,
    path: str,
    models: Sequence[tuple[str, float | None, int | None, Mapping[str, np.ndarray], Mapping[str, str]]],
    mode: str = "append",
) -> None:
    """Several models (id, alpha, round, arrays, meta) in one write."""
    rows = [
        (
            model_id,
            alpha,
            -1 if round_id is None else round_id,
            key,
            list(np.shape(value)),
            np.ravel(value).astype(float).tolist(),
            list(meta.items()),
        )
        for model_id, alpha, round_id, params, meta in models
        for key, value in params.items()
    ]
    (
        small_table(spark, PARAMETER_SCHEMA, rows)
        .coalesce(1)
        .write.mode(_checked(mode))
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model_id", "round")
        .parquet(path)
    )


def load_params(
    spark: SparkSession,
    path: str,
    model_id: str,
    alpha: float | None = None,
    round_id: int | None = None,
) -> tuple[dict[str, np.ndarray], dict[str, str]]:
    """(arrays, meta) of one saved model."""
    rows = (
        _read_parquet(spark, path)
        .where(F.col("model_id") == model_id)
        .where(F.col("round") == (-1 if round_id is None else round_id))
        .where(F.col("alpha").eqNullSafe(F.lit(alpha).cast("double")))
        .collect()
    )
    if not rows:
        raise FileNotFoundError(f"no parameters of {model_id} under {path}")
    arrays = {r["key"]: np.array(r["values"]).reshape(r["shape"]) for r in rows}
    return arrays, dict(rows[0]["meta"] or {})


def load_models(
    spark: SparkSession, path: str
) -> dict[tuple[str, float | None, int], tuple[dict[str, np.ndarray], dict[str, str]]]:
    """(id, alpha, round) -> (arrays, meta) of all models under ``path``; a model saved
    without a round has -1."""
    out: dict[tuple[str, float | None, int], tuple[dict[str, np.ndarray], dict[str, str]]] = {}
    for r in _read_parquet(spark, path).collect():
        arrays, meta = out.setdefault((r["model_id"], r["alpha"], r["round"]), ({}, {}))
        arrays[r["key"]] = np.array(r["values"]).reshape(r["shape"])
        meta.update(r["meta"] or {})
    return out


# --- logs and summaries -------------------------------------------------------------


def write_round_log(
    spark: SparkSession, log: Sequence[Mapping], path: str, mode: str = "overwrite"
) -> None:
    """One JSON line per (alpha, round); "overwrite" starts a new log."""
    spark.createDataFrame([dict(r) for r in log]).coalesce(1).write.mode(_checked(mode)).json(path)


def write_summary(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV file with a header, sorted by bank; a row per bank, so one task is right."""
    df.orderBy("bank_id").coalesce(1).write.mode(_checked(mode)).option("header", True).csv(path)


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a summary with ``place``, their order in the file. A row per bank, so one
    task reads it."""
    lines = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("place", "line")
    )
    return lines.where("place > 0").select("place", F.from_csv("line", schema).alias("r")).select("place", "r.*")


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON, one document a row, by bank; "overwrite" replaces the banks written."""
    (
        df.hint("rebalance", "bank_id")
        .write.mode(_checked(mode))
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bank_id")
        .json(path)
    )


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents with the fields of ``schema``, a missing one as null; text that is no
    document at all is an error."""
    fields = f"{schema}, bank_id string"
    return spark.read.schema(fields).option("mode", "FAILFAST").json(path)
