"""Registered limiter queries (L1-L7) over the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import limit_key, rate_headers
from ..operators.limits import fixed_window, rate_limit, rate_limits, shared_and_split, trailing_window_count
from ..sources.views import requests
from .limiter_oracles import limiter_oracles, limiter_report_oracles
from .params import LIMIT, WINDOW_US


RESULT_COLS = ["request_id", "key", "allowed", "limit", "remaining", "reset_after_us", "retry_after_us"]


# Columns a limiter fold needs: mapInArrow is a boundary column pruning
# cannot cross, so each query projects before it folds.
FOLD_INPUT = ["request_id", "seq", "t_us", "subject", "remote_addr"]


def _limited(spark: SparkSession, sf_dir: str, algorithm: str, anchor: str = "grid") -> DataFrame:
    req = requests(spark, sf_dir).select(*FOLD_INPUT)
    out = rate_limit(req, limit_key("subject", "remote_addr"), algorithm, LIMIT, WINDOW_US, anchor=anchor)
    return out.select(*RESULT_COLS)


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 + P1 + P4: token bucket per user-or-ip key, with response headers."""
    out = _limited(spark, sf_dir, "token_bucket")
    return out.select(*RESULT_COLS, *rate_headers("limit", "remaining", "reset_after_us",
                                                  "retry_after_us", "allowed")[2:])


def sliding_window_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: exact sliding log."""
    return _limited(spark, sf_dir, "sliding_window_log")


def swc_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: sliding window counter on the global grid (the shared-store form)."""
    return _limited(spark, sf_dir, "sliding_window_counter", "grid")


def swc_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: sliding window counter anchored at each key's first request."""
    return _limited(spark, sf_dir, "sliding_window_counter", "first_request")


QUERIES = {
    "token_bucket": token_bucket,
    "sliding_window_log": sliding_window_log,
    "swc_grid": swc_grid,
    "swc_anchored": swc_anchored,
}

# ------------------------------------------------- limiter reports


# name -> (algorithm, anchor)
ALGOS = {
    "token_bucket": ("token_bucket", "grid"),
    "sliding_window_log": ("sliding_window_log", "grid"),
    "swc_grid": ("sliding_window_counter", "grid"),
    "swc_anchored": ("sliding_window_counter", "first_request"),
}


def all_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log decided by each algorithm, tagged ``algorithm``."""
    req = requests(spark, sf_dir).select(*FOLD_INPUT)
    return rate_limits(req, limit_key("subject", "remote_addr"), ALGOS, LIMIT, WINDOW_US, carry=["request_id"])


def limiter_decisions(spark, sf):
    """M5: allowed / denied per algorithm."""
    d = all_decisions(spark, sf)
    return d.groupBy("algorithm", F.when(F.col("allowed"), "allowed").otherwise("denied").alias("decision")) \
            .agg(F.count(F.lit(1)).alias("n"))


def limiter_remaining_last(spark, sf):
    """M6: the remaining-tokens gauge: the last decision's value per algorithm."""
    d = all_decisions(spark, sf)
    return d.groupBy("algorithm").agg(F.max_by("remaining", F.struct("t_us", "seq")).alias("remaining"))


def limiter_waits(spark, sf):
    """Advertised waits per algorithm (denials, total/max retry, max reset)."""
    d = all_decisions(spark, sf)
    den = ~F.col("allowed")
    return d.groupBy("algorithm").agg(
        F.sum(F.when(den, 1).otherwise(0)).cast("bigint").alias("denied"),
        F.sum(F.when(den, F.col("retry_after_us")).otherwise(0)).cast("bigint").alias("sum_retry_us"),
        F.max(F.when(den, F.col("retry_after_us"))).alias("max_retry_us"),
        F.max("reset_after_us").alias("max_reset_us"))


# Estimate of retained bytes: 16 bytes per stored number plus 64 per key.
STATE_NUMBERS = {"token_bucket": 2, "sliding_window_log": 1, "swc_grid": 3, "swc_anchored": 3}


def limiter_state_size(spark, sf):
    """Retained state entries per key and algorithm, and a byte
    estimate (16 bytes per stored number plus 64 per key): flat for the
    bucket and counters, linear in retained timestamps for the log."""
    d = all_decisions(spark, sf)
    per = d.groupBy("algorithm", "key").agg(F.max("state_entries").cast("int").alias("max_entries"))
    nums = F.when(F.col("algorithm") == "token_bucket", 2).when(F.col("algorithm") == "sliding_window_log", 1).otherwise(3)
    mult = F.when(F.col("algorithm") == "sliding_window_log", F.col("max_entries")).otherwise(1)
    return per.withColumn("est_bytes", (mult * nums * 16 + 64).cast("bigint"))


def _per_instance(spark, sf):
    req = requests(spark, sf).select(*FOLD_INPUT, "instance")
    both = shared_and_split(req, limit_key("subject", "remote_addr"), "instance", LIMIT, WINDOW_US)
    return both.withColumnRenamed("allowed_split", "allowed_per_instance")


def shared_vs_per_instance(spark, sf):
    """One shared budget per key versus one budget per key and gateway."""
    j = _per_instance(spark, sf)
    return j.groupBy("key").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.col("allowed_shared").cast("int")).cast("bigint").alias("allowed_shared"),
        F.sum(F.col("allowed_per_instance").cast("int")).cast("bigint").alias("allowed_per_instance"))


def shared_limit_verdict(spark, sf):
    """The shared limiter passes if it admits under 3/4 of what
    per-instance limiters would."""
    j = _per_instance(spark, sf)
    s = j.agg(F.sum(F.col("allowed_shared").cast("int")).cast("bigint").alias("allowed"),
              F.sum((~F.col("allowed_shared")).cast("int")).cast("bigint").alias("denied"),
              F.sum(F.col("allowed_per_instance").cast("int")).cast("bigint").alias("per_instance_allowed"),
              F.countDistinct("instance").alias("instances"))
    return s.withColumn("pass", F.col("allowed") * 4 < F.col("per_instance_allowed") * 3)


def boundary_burst(spark, sf):
    """L7 on the request log: the most requests any key had admitted inside
    any trailing window, per algorithm, with the plain fixed window as the
    baseline (its bursts reach 2 x limit across a window edge)."""
    d = all_decisions(spark, sf).select("algorithm", "key", "t_us", "allowed")
    req = requests(spark, sf).select(*FOLD_INPUT)
    fw = fixed_window(req, limit_key("subject", "remote_addr"), LIMIT, WINDOW_US) \
        .select(F.lit("fixed_window").alias("algorithm"), "key", "t_us", "allowed")
    a = d.unionByName(fw).where("allowed")
    inwin = trailing_window_count(a, ["algorithm", "key"], "t_us", WINDOW_US, out="n")
    per_key = inwin.groupBy("algorithm", "key").agg(F.max("n").alias("max_in_window"))
    return per_key.groupBy("algorithm").agg(
        F.max("max_in_window").alias("max_in_window"),
        F.sum(F.when(F.col("max_in_window") > LIMIT, 1).otherwise(0)).cast("bigint").alias("keys_over_limit"))


QUERIES.update({
    "limiter_decisions": limiter_decisions,
    "limiter_remaining_last": limiter_remaining_last,
    "limiter_waits": limiter_waits,
    "limiter_state_size": limiter_state_size,
    "shared_vs_per_instance": shared_vs_per_instance,
    "shared_limit_verdict": shared_limit_verdict,
    "boundary_burst": boundary_burst,
})

ORACLES = {**limiter_oracles(), **limiter_report_oracles()}
