"""Table scans of the driver parquet tables, plus time helpers.

Scans stay lazy so Catalyst prunes columns and pushes filters into the
parquet reader; nothing here caches or collects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; column pruning and filters reach the parquet reader."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def micros(df: DataFrame, col: str) -> Column:
    """Microseconds since the epoch of a timestamp column, independent of
    the session time zone.

    The driver tables store wall-clock timestamps without a zone; Spark
    reads them as TIMESTAMP_NTZ. Measuring the distance from the NTZ epoch
    keeps the value equal to DuckDB's ``epoch_us`` whatever the session
    zone is. A zone-aware column is already an instant.
    """
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(F.col(col))
    raise TypeError(f"{col} is {dtype}, not a timestamp")


def iso_utc(us: Column) -> Column:
    """RFC 3339 text (``yyyy-MM-ddTHH:mm:ss.ffffffZ``) of epoch microseconds,
    built from the day number and the time of day, so no session time zone
    (and no daylight-saving gap) is involved."""
    day_us = 86_400_000_000
    day = F.floor(us / F.lit(day_us))
    rem = us - day * F.lit(day_us)

    def two(x):
        return F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"),
                    two(F.floor(rem / 3_600_000_000)), F.lit(":"),
                    two(F.floor(rem / 60_000_000) % 60), F.lit(":"),
                    two(F.floor(rem / 1_000_000) % 60), F.lit("."),
                    F.lpad((rem % 1_000_000).cast("string"), 6, "0"), F.lit("Z"))
