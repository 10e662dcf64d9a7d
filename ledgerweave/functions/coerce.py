"""Lenient parsing: a malformed value becomes null instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as an id, a number, and a zoned timestamp.
ID_PATTERN = r"^\s*[+-]?\d+(\.0+)?\s*$"
NUMBER_PATTERN = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|inf|infinity)\s*$"
ZONE_PATTERN = r"(?i)\d\s*(z|utc|gmt|[+-]\d{1,2}(:?\d{2})?)\s*$"
CLOCK_PATTERN = r"\d:\d"


def _type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def as_id(df: DataFrame, name: str) -> Column:
    """BIGINT id. Text such as ' 8 ' or '8.0' is accepted, '8.5' and 'x' are not."""
    c = F.col(name)
    if isinstance(_type_of(df, name), T.IntegralType):
        return c.cast("bigint")
    text = c.cast("string")
    digits = F.regexp_replace(F.trim(text), r"\.0+$", "")
    return F.when(text.rlike(ID_PATTERN), digits.try_cast("bigint"))


def as_number(df: DataFrame, name: str, to: str = "double") -> Column:
    """Number of type ``to``; text that is no number, and NaN, become null."""
    c = F.col(name)
    source = _type_of(df, name)
    if isinstance(source, T.FractionalType) and not isinstance(source, T.DecimalType):
        return F.when(~F.isnan(c), c).cast(to)
    if isinstance(source, T.NumericType):
        return c.cast(to)
    text = c.cast("string")
    return F.when(F.lower(text).rlike(NUMBER_PATTERN), F.trim(text).try_cast(to))


def utc_wall_clock(instant: Column) -> Column:
    """TIMESTAMP -> TIMESTAMP_NTZ in UTC, whatever the session time zone is."""
    return F.timestamp_add(
        "MICROSECOND",
        F.unix_micros(instant),
        F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
    )


def as_utc(df: DataFrame, name: str) -> Column:
    """TIMESTAMP_NTZ in UTC; zone-less text is read as UTC, bad text is null."""
    c = F.col(name)
    source = _type_of(df, name)
    if isinstance(source, T.TimestampNTZType):
        return c
    if isinstance(source, T.TimestampType):
        return utc_wall_clock(c)
    text = F.trim(c.cast("string"))
    zoned = text.rlike(ZONE_PATTERN) & text.rlike(CLOCK_PATTERN)
    return F.when(zoned, utc_wall_clock(text.try_cast("timestamp"))).otherwise(
        text.try_cast("timestamp_ntz")
    )
