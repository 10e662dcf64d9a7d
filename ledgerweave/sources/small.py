"""Tables with a row per bank, model or stratum, built from driver values."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def small_table(spark: SparkSession, schema: pa.Schema, rows: Iterable[tuple]) -> DataFrame:
    """A local relation: Catalyst knows its exact size, so it broadcasts the table
    below the configured threshold and shuffles it above."""
    columns = list(zip(*rows)) or [[] for _ in schema]
    return spark.createDataFrame(
        pa.Table.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
        )
    )
