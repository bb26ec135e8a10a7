"""Registered queries over the request log: scalar functions (P1-P6,
P10), gateway outcome (P19), request metrics (M1-M4, M10, M11, M16) and
the access-log source (S4). ``ORACLES`` holds the DuckDB twin of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics as M
from ..operators.gateway import gateway_outcome as _gateway
from ..operators.limits import rate_limit
from ..sources.views import requests
from . import sqlviews as V
from .params import LIMIT, WINDOW_US
from .limiter_sql import sliding_counter_sql, token_bucket_sql

R = "WITH " + V.REQUESTS + " "


def q_limit_key(spark: SparkSession, sf: str) -> DataFrame:
    """Limiter key per request."""
    r = requests(spark, sf)
    return r.select("request_id", "subject", "remote_addr",
                    S.limit_key("subject", "remote_addr").alias("limit_key"))


def _addr_variants(r: DataFrame) -> DataFrame:
    k = F.col("k")
    port = (F.col("request_id") % 60000 + 1024).cast("string")
    host = F.concat(F.lit("2001:db8::"), k.cast("string"))
    addr = (F.when(k % 5 == 0, F.concat(F.lit("["), host, F.lit("]:"), port))
             .when(k % 5 == 1, F.regexp_extract("remote_addr", r"^([^:]*):", 1))
             .when(k % 5 == 2, F.concat(F.lit("["), host, F.lit("]")))
             .when(k % 5 == 3, F.concat(host, F.lit(":"), port))
             .otherwise(F.col("remote_addr")))
    return r.select("request_id", addr.alias("addr"))


def q_client_ip(spark: SparkSession, sf: str) -> DataFrame:
    """Host of host:port in IPv4, bracketed IPv6, bare and malformed forms."""
    a = _addr_variants(requests(spark, sf))
    return a.select("request_id", "addr", S.client_ip("addr").alias("client_ip"))


def q_ensure_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Keep a valid inbound id, else mint md5(request_id)."""
    r = requests(spark, sf)
    return r.select("request_id", S.correlation_valid("correlation_id").alias("valid"),
                    S.ensure_correlation("correlation_id", "request_id").alias("correlation_id"))


def q_rate_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Response headers of the grid sliding-window-counter decisions."""
    r = requests(spark, sf).select("request_id", "seq", "t_us", "subject", "remote_addr")
    out = rate_limit(r, S.limit_key("subject", "remote_addr"), "sliding_window_counter", LIMIT, WINDOW_US)
    return out.select("request_id", *S.rate_headers("limit", "remaining", "reset_after_us",
                                                    "retry_after_us", "allowed"))


def q_route_label(spark: SparkSession, sf: str) -> DataFrame:
    """P5: route pattern per request."""
    r = requests(spark, sf)
    return r.select("request_id", "method", "path", S.route_label("method", "path").alias("route"))


def q_clamp_page(spark: SparkSession, sf: str) -> DataFrame:
    """P10: page parameters from raw query strings."""
    r = requests(spark, sf)
    k = F.col("k")
    raw_limit = (F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.concat(F.lit("x"), k.cast("string")))
                  .otherwise((k * 3 - 50).cast("string")))
    raw_offset = (F.when(k % 3 == 0, (-k).cast("string")).when(k % 3 == 1, F.concat(F.lit("+"), k.cast("string")))
                   .otherwise((F.col("request_id") * 100000).cast("string")))
    return r.select("request_id", raw_limit.alias("raw_limit"), raw_offset.alias("raw_offset"),
                    S.clamp_param(raw_limit, 20, 1, 100).alias("page_limit"),
                    S.clamp_param(raw_offset, 0, 0, 2147483647).alias("page_offset"))


def limiter_down(k="k"):
    """Requests that met a limiter outage (1 in 100) in the derived log."""
    return F.col(k) == 99


def q_gateway_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Class of every request through the gateway pipeline."""
    r = requests(spark, sf).select("request_id", "seq", "t_us", "k", "subject", "remote_addr", "path", "status")
    out = _gateway(r, "token_bucket", LIMIT, WINDOW_US, limiter_error=limiter_down(), keep=["request_id"])
    return out.select("request_id", "stage", "outcome_status", "outcome", "allowed")


def q_src_access(spark: SparkSession, sf: str) -> DataFrame:
    """Access-log lines; the /metrics scrape is not logged."""
    r = requests(spark, sf)
    return (r.where(F.col("path") != M.METRICS_PATH)
             .select("request_id", "method", "path", "status",
                     (F.col("duration_us") / 1000).alias("duration_ms"),
                     S.client_ip("remote_addr").alias("remote_ip")))


def q_red_requests(spark, sf):
    return M.red_requests(requests(spark, sf))


def q_red_errors(spark, sf):
    return M.red_errors(requests(spark, sf))


def q_red_duration(spark, sf):
    return M.red_duration(requests(spark, sf))


def q_throughput(spark, sf):
    return M.throughput(requests(spark, sf))


def q_label_cardinality(spark, sf):
    return M.label_cardinality(requests(spark, sf))


def q_load_report(spark, sf):
    return M.load_report(requests(spark, sf))


def q_in_flight(spark, sf):
    return M.in_flight(requests(spark, sf))


QUERIES = {
    "limit_key": q_limit_key,
    "client_ip": q_client_ip,
    "ensure_correlation": q_ensure_correlation,
    "rate_headers": q_rate_headers,
    "route_label": q_route_label,
    "clamp_page": q_clamp_page,
    "gateway_outcome": q_gateway_outcome,
    "src_access": q_src_access,
    "red_requests": q_red_requests,
    "red_errors": q_red_errors,
    "red_duration": q_red_duration,
    "throughput": q_throughput,
    "label_cardinality": q_label_cardinality,
    "load_report": q_load_report,
    "in_flight": q_in_flight,
}

# ---------------------------------------------------------------- oracles

_KEY = V.limit_key("subject", "remote_addr")
_ROUTE = V.route_label("method", "path")
_OBS = f"obs AS (SELECT *, {_ROUTE} AS route FROM requests WHERE path <> '/metrics')"
_SERVICE = ("CASE WHEN starts_with(path, '/auth/') THEN 'auth' WHEN starts_with(path, '/catalog/') THEN 'catalog' "
            "WHEN starts_with(path, '/orders/') THEN 'orders' WHEN starts_with(path, '/payment/') THEN 'payment' "
            "ELSE 'gateway' END")

_ADDR = ("CASE WHEN k % 5 = 0 THEN '[' || h || ']:' || p WHEN k % 5 = 1 THEN regexp_extract(remote_addr, '^([^:]*):', 1) "
         "WHEN k % 5 = 2 THEN '[' || h || ']' WHEN k % 5 = 3 THEN h || ':' || p ELSE remote_addr END")

_BUCKETS = M.DEFAULT_BUCKETS


def _red_duration_sql() -> str:
    arms = []
    for b in _BUCKETS:
        arms.append(f"SELECT method, route, count, sum_us, '{M._le_label(b)}' AS le, b{_BUCKETS.index(b)} AS cumulative FROM wide")
    arms.append("SELECT method, route, count, sum_us, '+Inf' AS le, count AS cumulative FROM wide")
    sums = ", ".join(f"CAST(SUM(CASE WHEN duration_us <= {int(round(b * 1_000_000))} THEN 1 ELSE 0 END) AS BIGINT) AS b{i}"
                     for i, b in enumerate(_BUCKETS))
    return (R + f", {_OBS}, wide AS (SELECT method, route, {sums}, COUNT(*) AS count, "
            f"CAST(SUM(duration_us) AS BIGINT) AS sum_us FROM obs GROUP BY method, route) " + " UNION ALL ".join(arms))


def gateway_fold_sql() -> tuple[str, str]:
    """(prelude, fold) of the gateway oracle: the classified requests and
    the token-bucket fold over the rows that reach the limiter."""
    stage = ("CASE WHEN path IN ('/healthz', '/metrics') THEN 'gateway' WHEN starts_with(path, '/auth/') THEN 'public' "
             "WHEN starts_with(path, '/catalog/') OR starts_with(path, '/orders/') OR starts_with(path, '/payment/') "
             "THEN 'protected' ELSE 'unrouted' END")
    key = f"CASE WHEN stage = 'protected' THEN 'user:' || subject ELSE 'ip:' || ({V.client_ip('remote_addr')}) END"
    prelude = (V.REQUESTS + f", gw AS (SELECT *, {stage} AS stage, k = 99 AS lerr FROM requests), "
               "gw2 AS (SELECT *, (stage <> 'protected' OR subject <> '') AS auth FROM gw), "
               "lim_src AS (SELECT * FROM gw2 WHERE stage IN ('public', 'protected') AND auth AND NOT lerr)")
    return prelude, token_bucket_sql(key, LIMIT, WINDOW_US, prelude=prelude, source="lim_src")


def _gateway_sql() -> str:
    prelude, fold = gateway_fold_sql()
    return (f"WITH {prelude} SELECT g.request_id, g.stage, "
            "CAST(CASE WHEN g.stage = 'gateway' THEN 200 WHEN g.stage = 'unrouted' THEN 404 WHEN NOT g.auth THEN 401 "
            "WHEN g.lerr THEN 503 WHEN NOT l.allowed THEN 429 WHEN g.status = 502 THEN 502 "
            "WHEN g.path = '/auth/me' THEN 401 ELSE g.status END AS INTEGER) AS outcome_status, "
            "CASE WHEN g.stage = 'gateway' THEN 'served' WHEN g.stage = 'unrouted' THEN 'unrouted' "
            "WHEN NOT g.auth THEN 'unauthorized' WHEN g.lerr THEN 'limiter_unavailable' "
            "WHEN NOT coalesce(l.allowed, true) THEN 'rate_limited' WHEN g.status = 502 THEN 'upstream_error' "
            "WHEN g.path = '/auth/me' THEN 'upstream_unauthorized' "
            "ELSE 'upstream' END AS outcome, l.allowed "
            f"FROM gw2 g LEFT JOIN ({fold}) l ON l.request_id = g.request_id")


def _load_report_sql() -> str:
    pcts = ", ".join(f"round(quantile_cont(duration_us, {p}) / 1000, 3) AS {n}"
                     for p, n in zip([0.5, 0.9, 0.95, 0.99], ["med_ms", "p90_ms", "p95_ms", "p99_ms"]))
    return (R + f", {_OBS} SELECT route, COUNT(*) AS requests, "
            "CAST(SUM(CASE WHEN status >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS failures, "
            "CAST(SUM(CASE WHEN status >= 400 THEN 1 ELSE 0 END) * 1000000 // COUNT(*) AS BIGINT) AS failure_rate_ppm, "
            "CASE WHEN max(t_us) > min(t_us) THEN CAST(COUNT(*) * 1000000000 // (max(t_us) - min(t_us)) AS BIGINT) END AS rate_per_1000s, "
            "round(avg(duration_us) / 1000, 3) AS avg_ms, round(min(duration_us) / 1000, 3) AS min_ms, "
            f"{pcts}, round(max(duration_us) / 1000, 3) AS max_ms FROM obs GROUP BY route")


def _in_flight_sql() -> str:
    P = 15_000_000
    return (R + ", r AS (SELECT instance, t_us AS s, t_us + duration_us AS e FROM requests), "
            "marks AS (SELECT instance, s AS t, 1 AS d FROM r UNION ALL SELECT instance, e AS t, -1 AS d FROM r), "
            "lv AS (SELECT instance, SUM(d) OVER (PARTITION BY instance ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS lvl FROM marks), "
            "peak AS (SELECT instance, CAST(max(lvl) AS BIGINT) AS peak_in_flight FROM lv GROUP BY instance), "
            f"sc AS (SELECT instance, unnest(range((s + {P - 1}) // {P}, (e - 1) // {P} + 1)) AS i FROM r "
            f"WHERE (e - 1) // {P} >= (s + {P - 1}) // {P}), "
            "sc2 AS (SELECT instance, i, COUNT(*) AS n FROM sc GROUP BY instance, i), "
            "sc3 AS (SELECT instance, max(n) AS m, COUNT(*) AS b FROM sc2 GROUP BY instance) "
            "SELECT p.instance, p.peak_in_flight, CAST(coalesce(m, 0) AS BIGINT) AS max_at_scrape, "
            "CAST(coalesce(b, 0) AS BIGINT) AS busy_scrapes FROM peak p LEFT JOIN sc3 USING (instance)")


ORACLES = {
    "limit_key": R + f"SELECT request_id, subject, remote_addr, {_KEY} AS limit_key FROM requests",
    "client_ip": R + ", a AS (SELECT request_id, " + _ADDR + " AS addr FROM (SELECT *, '2001:db8::' || CAST(k AS VARCHAR) AS h, "
                     "CAST(request_id % 60000 + 1024 AS VARCHAR) AS p FROM requests) z) "
                     f"SELECT request_id, addr, {V.client_ip('addr')} AS client_ip FROM a",
    "ensure_correlation": R + f"SELECT request_id, {V.correlation_valid('correlation_id')} AS valid, "
                              f"CASE WHEN {V.correlation_valid('correlation_id')} THEN correlation_id "
                              "ELSE md5(CAST(request_id AS VARCHAR)) END AS correlation_id FROM requests",
    "rate_headers": "SELECT request_id, CAST(\"limit\" AS BIGINT) AS x_ratelimit_limit, remaining AS x_ratelimit_remaining, "
                    f"{V.seconds_ceil('reset_after_us')} AS x_ratelimit_reset, CASE WHEN allowed THEN NULL ELSE "
                    f"greatest(1, {V.seconds_ceil('retry_after_us')}) END AS retry_after_s FROM ("
                    + sliding_counter_sql(_KEY, LIMIT, WINDOW_US, anchored=False) + ") t",
    "route_label": R + f"SELECT request_id, method, path, {_ROUTE} AS route FROM requests",
    "clamp_page": R + ", c AS (SELECT request_id, "
                      "CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN 'x' || CAST(k AS VARCHAR) ELSE CAST(k * 3 - 50 AS VARCHAR) END AS raw_limit, "
                      "CASE WHEN k % 3 = 0 THEN CAST(-k AS VARCHAR) WHEN k % 3 = 1 THEN '+' || CAST(k AS VARCHAR) "
                      "ELSE CAST(request_id * 100000 AS VARCHAR) END AS raw_offset FROM requests) "
                      f"SELECT request_id, raw_limit, raw_offset, {V.clamp_param('raw_limit', 20, 1, 100)} AS page_limit, "
                      f"{V.clamp_param('raw_offset', 0, 0, 2147483647)} AS page_offset FROM c",
    "gateway_outcome": _gateway_sql(),
    "src_access": R + f"SELECT request_id, method, path, status, duration_us / 1000 AS duration_ms, "
                      f"{V.client_ip('remote_addr')} AS remote_ip FROM requests WHERE path <> '/metrics'",
    "red_requests": R + f", {_OBS} SELECT {_SERVICE} AS service, method, route, status, COUNT(*) AS requests "
                        "FROM obs GROUP BY ALL",
    "red_errors": R + f", {_OBS} SELECT method, route, COUNT(*) AS requests, "
                      "CAST(SUM(CASE WHEN status >= 500 THEN 1 ELSE 0 END) AS BIGINT) AS errors, "
                      "CAST(SUM(CASE WHEN status >= 500 THEN 1 ELSE 0 END) * 1000000 // COUNT(*) AS BIGINT) AS error_rate_ppm "
                      "FROM obs GROUP BY method, route",
    "red_duration": _red_duration_sql(),
    "throughput": R + "SELECT instance, t_us - t_us % 15000000 AS window_start_us, COUNT(*) AS requests "
                      "FROM requests GROUP BY ALL",
    "label_cardinality": R + f", {_OBS} SELECT COUNT(DISTINCT (method, route, status)) AS series_by_route, "
                             "COUNT(DISTINCT (method, path, status)) AS series_by_path, COUNT(*) AS requests FROM obs",
    "load_report": _load_report_sql(),
    "in_flight": _in_flight_sql(),
}
