"""Registered trace and log queries (TR1-TR5, P18, S3) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import log_level
from ..operators import trace as TR
from ..sources import views as VW
from ..sources.logs import attr, parse_log_lines
from ..sources.tables import read_table
from . import sqlviews as V


def _chosen_id(spark, sf):
    """The trace TR1 looks up: the newest order whose payment line is missing."""
    o = read_table(spark, sf, "orders")
    return o.where(F.col("o_orderkey") % 13 == 0).select(
        F.concat(F.lit("o-"), F.max("o_orderkey").cast("string"))).scalar()


def q_trace_one(spark, sf):
    lg = VW.logs(spark, sf)
    return TR.trace(lg, _chosen_id(spark, sf)).select("ts_us", "line_no", "service", "msg")


def q_traces(spark, sf):
    return TR.traces(VW.logs(spark, sf))


def q_trace_gaps(spark, sf):
    return TR.trace_gaps(VW.logs(spark, sf))


def q_step_latency(spark, sf):
    return TR.step_latency(VW.logs(spark, sf)).select("correlation_id", "line_no", "service",
                                                      "prev_service", "gap_us")


def q_uncorrelated(spark, sf):
    return TR.uncorrelated(VW.logs(spark, sf)).select("ts_us", "service", "level", "msg", "order_id")


def q_log_level(spark, sf):
    """P18 over the raw level spellings of the log lines."""
    lg = VW.logs(spark, sf)
    return lg.select("order_id", "line_no", F.col("level").alias("raw"), log_level("level").alias("level"))


def q_src_logs(spark, sf):
    """S3: parse JSON log lines; unknown attributes land in a map."""
    p = parse_log_lines(VW.log_lines(spark, sf))
    return p.select("ts_us", "line_no", "time", "level", "msg", "service", "correlation_id",
                    F.size("attrs").cast("bigint").alias("n_attrs"), attr("order_id").alias("order_id"),
                    attr("attempt").alias("attempt"))


QUERIES = {
    "trace_one": q_trace_one,
    "traces": q_traces,
    "trace_gaps": q_trace_gaps,
    "step_latency": q_step_latency,
    "uncorrelated": q_uncorrelated,
    "log_level": q_log_level,
    "src_logs": q_src_logs,
}

L = f"WITH {V.LOGS} "

ORACLES = {
    "trace_one": L + "SELECT ts_us, line_no, service, msg FROM logs WHERE correlation_id = "
                     "(SELECT 'o-' || CAST(max(o_orderkey) AS VARCHAR) FROM orders WHERE o_orderkey % 13 = 0)",
    "traces": L + "SELECT correlation_id, array_to_string(list_sort(list_distinct(list(service))), ',') AS services, "
                  "COUNT(*) AS steps, min(ts_us) AS start_us, max(ts_us) AS end_us, "
                  "arg_min(service, (ts_us, line_no)) AS first_service, arg_max(service, (ts_us, line_no)) AS last_service, "
                  "max(ts_us) - min(ts_us) AS duration_us FROM logs WHERE correlation_id IS NOT NULL GROUP BY correlation_id",
    "trace_gaps": L + ", s AS (SELECT correlation_id, list_distinct(list(service)) AS seen FROM logs "
                      "WHERE correlation_id IS NOT NULL GROUP BY correlation_id), "
                      "m AS (SELECT correlation_id, list_sort(list_filter(['gateway', 'orders', 'payment'], "
                      "lambda x: NOT list_contains(seen, x))) AS miss FROM s) "
                      "SELECT correlation_id, array_to_string(miss, ',') AS missing FROM m WHERE len(miss) > 0",
    "step_latency": L + "SELECT correlation_id, line_no, service, "
                        "lag(service) OVER (PARTITION BY correlation_id ORDER BY ts_us, service, line_no) AS prev_service, "
                        "ts_us - lag(ts_us) OVER (PARTITION BY correlation_id ORDER BY ts_us, service, line_no) AS gap_us "
                        "FROM logs WHERE correlation_id IS NOT NULL",
    "uncorrelated": L + "SELECT ts_us, service, level, msg, order_id FROM logs WHERE correlation_id IS NULL",
    "log_level": L + f"SELECT order_id, line_no, level AS raw, {V.log_level('level')} AS level FROM logs",
    "src_logs": f"WITH {V.LOG_LINES} SELECT ts_us, line_no, json_extract_string(line, '$.time') AS time, "
                "json_extract_string(line, '$.level') AS level, json_extract_string(line, '$.msg') AS msg, "
                "json_extract_string(line, '$.service') AS service, json_extract_string(line, '$.correlation_id') AS correlation_id, "
                "CAST(len(list_filter(json_keys(line), lambda k: k NOT IN ('time', 'level', 'msg', 'service', 'correlation_id'))) "
                "AS BIGINT) AS n_attrs, json_extract_string(line, '$.order_id') AS order_id, "
                "json_extract_string(line, '$.attempt') AS attempt FROM log_lines",
}
