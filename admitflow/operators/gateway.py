"""The gateway pipeline as a classification of the request log.

Order of the pipeline: gateway-served endpoints (/healthz, /metrics), then
routing (no group matches -> 404), then authentication on the protected
groups (no subject -> 401, the limiter never sees the request), then the
limiter (error -> 503 fail-closed or pass fail-open; denied -> 429), then
the upstream (502 when it fails, else its status). Public /auth/* routes
carry no identity, so the limiter keys them by client IP.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import client_ip
from .limits import rate_limit

# The gateway route groups (token-protected prefixes, the
# public prefix, and the endpoints the gateway serves itself).
PROTECTED_PREFIXES = ("/catalog/", "/orders/", "/payment/")
PUBLIC_PREFIX = "/auth/"
# The identity endpoint. The gateway strips the identity header
# and the public /auth/* group restores none, so the service always answers
# 401 to it through the gateway (after the limiter counted it).
IDENTITY_PATH = "/auth/me"
GATEWAY_PATHS = ("/healthz", "/metrics")


def stage(path: Column) -> Column:
    prot = None
    for pre in PROTECTED_PREFIXES:
        prot = path.startswith(pre) if prot is None else prot | path.startswith(pre)
    return (F.when(path.isin(*GATEWAY_PATHS), "gateway")
             .when(path.startswith(PUBLIC_PREFIX), "public")
             .when(prot, "protected")
             .otherwise("unrouted"))


def gateway_outcome(requests: DataFrame, algorithm: str, limit: int, window_us: int,
                    limiter_error: Column | None = None, on_error: str = "closed",
                    keep: list[str] | None = None, time_col: str = "t_us", seq_col: str = "seq") -> DataFrame:
    """Append ``stage, outcome_status, outcome`` (and the limiter columns for
    requests that reached it) to every request; ``keep`` names the request
    columns carried to the output (default: all). Only the columns the
    outcome needs cross into the limiter fold."""
    if on_error not in ("closed", "open"):
        raise ValueError("on_error must be 'closed' or 'open'")
    carry = list(keep) if keep is not None else list(requests.columns)
    need = list(dict.fromkeys(carry + [time_col, seq_col, "status", "path"]))
    err = limiter_error if limiter_error is not None else F.lit(False)
    # NULL subject: no identity; NULL limiter_error: no error; NULL path: no route.
    st = (requests.withColumn("stage", stage(F.coalesce("path", F.lit("")))).withColumn("_lerr", F.coalesce(err, F.lit(False)))
                  .withColumn("_auth", (F.col("stage") != "protected") | (F.coalesce("subject", F.lit("")) != "")))
    reaches = F.col("stage").isin("public", "protected") & F.col("_auth") & ~F.col("_lerr")
    key = F.when(F.col("stage") == "protected", F.concat(F.lit("user:"), F.col("subject"))) \
           .otherwise(F.concat(F.lit("ip:"), client_ip("remote_addr")))
    # Rows reaching the limiter are routed, authenticated and met a working
    # limiter, so only their own columns and the key go through the fold.
    to_limit = st.where(reaches).select(*need, key.alias("key"))
    limited = (rate_limit(to_limit, "key", algorithm, limit, window_us, time_col=time_col, seq_col=seq_col)
               .withColumn("stage", stage(F.col("path")))
               .withColumn("_auth", F.lit(True)).withColumn("_lerr", F.lit(False)))
    rest = st.where(~reaches).select(*need, "stage", "_auth", "_lerr")
    both = limited.unionByName(rest, allowMissingColumns=True)
    upstream = (F.when(F.col("status") == 502, F.lit(502))
                 .when(F.col("path") == IDENTITY_PATH, F.lit(401)).otherwise(F.col("status")))
    code = (F.when(F.col("stage") == "gateway", F.lit(200))
             .when(F.col("stage") == "unrouted", F.lit(404))
             .when(~F.col("_auth"), F.lit(401))
             .when(F.col("_lerr") & F.lit(on_error == "closed"), F.lit(503))
             .when(F.col("_lerr"), upstream)
             .when(~F.col("allowed"), F.lit(429))
             .otherwise(upstream))
    why = (F.when(F.col("stage") == "gateway", "served")
            .when(F.col("stage") == "unrouted", "unrouted")
            .when(~F.col("_auth"), "unauthorized")
            .when(F.col("_lerr") & F.lit(on_error == "closed"), "limiter_unavailable")
            .when(~F.coalesce(F.col("allowed"), F.lit(True)), "rate_limited")
            .when(F.col("status") == 502, "upstream_error")
            .when(F.col("path") == IDENTITY_PATH, "upstream_unauthorized")
            .otherwise("upstream"))
    lim_cols = ["key", "allowed", "limit", "remaining", "reset_after_us", "retry_after_us", "state_entries"]
    return both.select(*carry, "stage", *lim_cols, code.cast("int").alias("outcome_status"), why.alias("outcome"))
