"""M-family: request, limiter, event and saga metrics as aggregations.

All are group-bys with map-side partial aggregation; none orders the
whole table. Percentiles are exact via a value histogram (the group's
rows never meet in one task), with ``percentile_approx`` as the
sketch option.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_server_error, route_label

# Default latency histogram upper bounds, in seconds.
DEFAULT_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
METRICS_PATH = "/metrics"

# Metric family names.
HTTP_REQUESTS = "http_requests_total"
HTTP_ERRORS = "http_request_errors_total"
HTTP_DURATION = "http_request_duration_seconds"
HTTP_IN_FLIGHT = "http_requests_in_flight"
LIMIT_DECISIONS = "ratelimit_decisions_total"
LIMIT_REMAINING = "ratelimit_remaining_tokens"
EVENTS_PUBLISHED = "saga_events_published_total"
EVENTS_CONSUMED = "saga_events_consumed_total"
ORDER_OUTCOMES = "saga_order_outcomes_total"


def _le_label(b: float) -> str:
    return ("%g" % b)


def service_of(path) -> Column:
    """The service a gateway path is proxied to."""
    p = F.col(path) if isinstance(path, str) else path
    return (F.when(p.startswith("/auth/"), "auth").when(p.startswith("/catalog/"), "catalog")
             .when(p.startswith("/orders/"), "orders").when(p.startswith("/payment/"), "payment")
             .otherwise("gateway"))


def observed(requests: DataFrame) -> DataFrame:
    """Requests the metrics middleware records: all but the scrape itself,
    labelled with the route pattern (bounded label cardinality)."""
    return (requests.where(F.col("path") != METRICS_PATH)
                    .withColumn("route", route_label("method", "path")))


def red_requests(requests: DataFrame) -> DataFrame:
    """M1: requests by service, method, route, status."""
    return (observed(requests)
            .groupBy(service_of("path").alias("service"), "method", "route", "status")
            .agg(F.count(F.lit(1)).alias("requests")))


def red_errors(requests: DataFrame) -> DataFrame:
    """M2 + P6: 5xx count and error rate (parts per million) per method, route."""
    return (observed(requests).groupBy("method", "route")
            .agg(F.count(F.lit(1)).alias("requests"),
                 F.sum(F.when(is_server_error("status"), 1).otherwise(0)).cast("bigint").alias("errors"))
            .withColumn("error_rate_ppm", (F.col("errors") * 1_000_000 / F.col("requests")).cast("bigint")))


def red_duration(requests: DataFrame, buckets: list[float] = DEFAULT_BUCKETS) -> DataFrame:
    """M3: cumulative latency histogram (le buckets, +Inf), sum and count
    per method, route; one pass of conditional sums, then ``stack``."""
    obs = observed(requests)
    aggs = [F.sum(F.when(F.col("duration_us") <= int(round(b * 1_000_000)), 1).otherwise(0))
             .cast("bigint").alias(f"b{i}") for i, b in enumerate(buckets)]
    wide = obs.groupBy("method", "route").agg(*aggs, F.count(F.lit(1)).alias("count"),
                                              F.sum("duration_us").cast("bigint").alias("sum_us"))
    pairs = ", ".join(f"'{_le_label(b)}', b{i}" for i, b in enumerate(buckets)) + ", '+Inf', count"
    n = len(buckets) + 1
    return wide.select("method", "route", "count", "sum_us",
                       F.expr(f"stack({n}, {pairs}) AS (le, cumulative)"))


def throughput(requests: DataFrame, period_us: int = 15_000_000) -> DataFrame:
    """Requests per tumbling window per gateway instance."""
    start = F.col("t_us") - F.pmod(F.col("t_us"), F.lit(period_us))
    return (requests.groupBy("instance", start.alias("window_start_us"))
            .agg(F.count(F.lit(1)).alias("requests")))


def label_cardinality(requests: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct series of the request counter labelled by route pattern
    versus by raw path (the cardinality the route label prevents).
    ``approx=True`` uses HyperLogLog sketches (``approx_count_distinct``,
    about 2% error) instead of exact distinct counts."""
    obs = observed(requests)
    if approx:
        by_route = F.approx_count_distinct(F.concat_ws("|", "method", "route", F.col("status").cast("string")), rsd=0.02)
        by_path = F.approx_count_distinct(F.concat_ws("|", "method", "path", F.col("status").cast("string")), rsd=0.02)
    else:
        by_route = F.countDistinct("method", "route", "status")
        by_path = F.countDistinct("method", "path", "status")
    return obs.agg(by_route.alias("series_by_route"), by_path.alias("series_by_path"),
                   F.count(F.lit(1)).alias("requests"))


def exact_percentiles(df: DataFrame, group: list[str], value: str, ps: list[float],
                      names: list[str]) -> DataFrame:
    """Exact interpolated percentiles (``quantile_cont``) per group.

    Works on the (group, value) histogram: rank r's value is the smallest
    value whose cumulative count exceeds r. The ranking works on that much
    smaller histogram in two levels: values are cut into ranges (sixteen to
    a doubling, so at most a couple of thousand a group), counts are summed
    inside each range, and the ranges' totals are carried over; no task
    holds a group's whole histogram.
    """
    h = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    v = F.col(value).cast("double")
    h = h.withColumn("_r", F.coalesce(F.signum(v) * F.floor(F.log2(F.abs(v) + 1) * 16), F.lit(0.0)))
    upto = Window.unboundedPreceding
    totals = h.groupBy(*group, "_r").agg(F.sum("_c").alias("_t"))
    wr = Window.partitionBy(*group)
    carry = (totals.withColumn("_before", F.sum("_t").over(wr.orderBy("_r").rowsBetween(upto, 0)) - F.col("_t"))
                   .withColumn("_n", F.sum("_t").over(wr)).drop("_t"))
    inside = Window.partitionBy(*group, "_r").orderBy(value).rowsBetween(upto, 0)
    same = F.col("h._r") == F.col("c._r")
    for g in group:  # a NULL group is a group, too
        same = same & F.col(f"h.{g}").eqNullSafe(F.col(f"c.{g}"))
    h = (h.alias("h").join(carry.alias("c"), same).select("h.*", "c._before", "c._n")
          .withColumn("_cum", F.col("_before") + F.sum("_c").over(inside)))
    aggs = []
    for p, nm in zip(ps, names):
        pos = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [F.min(F.when(F.col("_cum") > lo, F.col(value))).alias(f"_{nm}_lo"),
                 F.min(F.when(F.col("_cum") > hi, F.col(value))).alias(f"_{nm}_hi"),
                 F.first(pos - lo).alias(f"_{nm}_f")]
    r = h.groupBy(*group).agg(*aggs)
    return r.select(*group, *[(F.col(f"_{nm}_lo") + (F.col(f"_{nm}_hi") - F.col(f"_{nm}_lo")) * F.col(f"_{nm}_f"))
                               .alias(nm) for nm in names])


def load_report(requests: DataFrame, step: str = "route", approx: bool = False) -> DataFrame:
    """Per step count, failures, rates and latency avg/min/med/p90/p95/p99/max
    in milliseconds (3 decimals). ``approx=True`` uses ``percentile_approx``."""
    obs = observed(requests).withColumn("_ms", F.col("duration_us"))
    ps, names = [0.5, 0.9, 0.95, 0.99], ["med_ms", "p90_ms", "p95_ms", "p99_ms"]
    base = obs.groupBy(step).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.when(F.col("status") >= 400, 1).otherwise(0)).cast("bigint").alias("failures"),
        F.round(F.avg("_ms") / 1000, 3).alias("avg_ms"),
        F.round(F.min("_ms") / 1000, 3).alias("min_ms"),
        F.round(F.max("_ms") / 1000, 3).alias("max_ms"),
        ((F.max("t_us") - F.min("t_us"))).alias("span_us"))
    if approx:
        pct = obs.groupBy(step).agg(*[F.percentile_approx("_ms", p, 10000).alias(n) for p, n in zip(ps, names)])
    else:
        pct = exact_percentiles(obs, [step], "_ms", ps, names)
    pct = pct.select(step, *[F.round(F.col(n) / 1000, 3).alias(n) for n in names])
    out = base.join(pct, step)
    return out.select(
        step, "requests", "failures",
        (F.col("failures") * 1_000_000 / F.col("requests")).cast("bigint").alias("failure_rate_ppm"),
        F.when(F.col("span_us") > 0, (F.col("requests") * 1_000_000_000 / F.col("span_us")).cast("bigint"))
         .alias("rate_per_1000s"),
        "avg_ms", "min_ms", "med_ms", "p90_ms", "p95_ms", "p99_ms", "max_ms")


def in_flight(requests: DataFrame, scrape_us: int = 15_000_000, chunk_us: int = 60_000_000) -> DataFrame:
    """M4: requests in flight per gateway instance: the highest value seen
    at scrape instants, and the exact peak over continuous time.

    Scrapes: each request is counted at the grid instants inside
    [start, end), so the work is per request. Peak: a +1/-1 sweep done in
    two levels so no single task orders the whole log: running sums inside
    time chunks, plus a carry per chunk from the (small) chunk table.
    """
    r = requests.select("instance", F.col("t_us").alias("s"), (F.col("t_us") + F.col("duration_us")).alias("e"))
    first = F.floor((F.col("s") + (scrape_us - 1)) / scrape_us)
    last = F.floor((F.col("e") - 1) / scrape_us)
    scrapes = (r.where(last >= first)
                .select("instance", F.explode(F.sequence(first, last)).alias("_i"))
                .groupBy("instance", "_i").agg(F.count(F.lit(1)).alias("n"))
                .groupBy("instance").agg(F.max("n").alias("max_at_scrape"),
                                         F.count(F.lit(1)).alias("busy_scrapes")))
    # one pass over the requests: each becomes a +1 start and a -1 end mark
    mark = F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")),
                             F.struct(F.col("e").alias("t"), F.lit(-1).alias("d"))))
    marks = (r.select("instance", mark.alias("_m"))
              .select("instance", F.col("_m.t").alias("t"), F.col("_m.d").alias("d"))
              .withColumn("_ch", F.floor(F.col("t") / chunk_us)))
    chunks = marks.groupBy("instance", "_ch").agg(F.sum("d").alias("_net"))
    wc = Window.partitionBy("instance").orderBy("_ch")
    carry = chunks.withColumn("_carry", F.coalesce(F.sum("_net").over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Ends sort before starts at the same instant: intervals are [start, end).
    wi = Window.partitionBy("instance", "_ch").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    level = (marks.withColumn("_lvl", F.sum("d").over(wi))
                  .groupBy("instance", "_ch").agg(F.max("_lvl").alias("_peak")))
    peak = (level.join(carry, ["instance", "_ch"])
                 .groupBy("instance").agg(F.max(F.col("_peak") + F.col("_carry")).cast("bigint").alias("peak_in_flight")))
    return peak.join(scrapes, "instance", "left").select(
        "instance", "peak_in_flight",
        F.coalesce("max_at_scrape", F.lit(0)).cast("bigint").alias("max_at_scrape"),
        F.coalesce("busy_scrapes", F.lit(0)).cast("bigint").alias("busy_scrapes"))

