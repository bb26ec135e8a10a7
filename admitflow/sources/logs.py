"""S3: structured JSON log lines -> a fixed struct plus a map of the
remaining attributes (nothing is dropped)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields every log record has (correlation_id only when set).
KNOWN_FIELDS = ["time", "level", "msg", "service", "correlation_id"]
LOG_SCHEMA = "time STRING, level STRING, msg STRING, service STRING, correlation_id STRING"


def parse_log_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Parse each line once as a struct and once as a string map; the map
    minus the known keys is ``attrs``."""
    rec = F.from_json(F.col(line), LOG_SCHEMA)
    everything = F.from_json(F.col(line), "map<string,string>")
    attrs = F.map_filter(everything, lambda k, v: ~k.isin(*KNOWN_FIELDS))
    return lines.select("*", rec.alias("_r"), attrs.alias("attrs")).select(
        *[c for c in lines.columns], *[F.col(f"_r.{f}").alias(f) for f in KNOWN_FIELDS], "attrs")


def read_logs(spark, path: str) -> DataFrame:
    """S3 from files: one JSON record per line."""
    return parse_log_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def attr(name: str) -> Column:
    return F.col("attrs").getItem(name)
