"""The gateway pipeline order on literal requests."""

from pyspark.sql import functions as F

from admitflow.operators.gateway import gateway_outcome

SCHEMA = "request_id long, seq long, t_us long, subject string, remote_addr string, path string, status int, down boolean"


def run(spark, rows, on_error="closed"):
    df = spark.createDataFrame(rows, SCHEMA)
    out = gateway_outcome(df, "token_bucket", 2, 60_000_000, limiter_error=F.col("down"), on_error=on_error)
    return {r.request_id: (r.outcome_status, r.outcome) for r in out.collect()}


def test_pipeline_order(spark):
    rows = [
        (1, 1, 0, "", "192.0.2.1:1", "/healthz", 200, False),
        (2, 2, 0, "", "192.0.2.1:1", "/nowhere", 200, False),
        (3, 3, 0, "", "192.0.2.1:1", "/orders/", 201, False),           # no token: 401, no quota used
        (4, 4, 0, "u1", "192.0.2.1:1", "/orders/", 201, False),
        (5, 5, 1, "u1", "192.0.2.1:1", "/orders/", 201, False),
        (6, 6, 2, "u1", "192.0.2.1:1", "/orders/", 201, False),         # third in a minute: 429
        (7, 7, 3, "u2", "192.0.2.1:1", "/payment/charges/9", 502, False),
        (8, 8, 4, "u3", "192.0.2.1:1", "/orders/", 201, True),          # limiter down, fail closed
        (9, 9, 5, "", "192.0.2.7:1", "/auth/me", 200, False),           # identity never reaches it
    ]
    got = run(spark, rows)
    assert got == {1: (200, "served"), 2: (404, "unrouted"), 3: (401, "unauthorized"), 4: (201, "upstream"),
                   5: (201, "upstream"), 6: (429, "rate_limited"), 7: (502, "upstream_error"),
                   8: (503, "limiter_unavailable"), 9: (401, "upstream_unauthorized")}


def test_fail_open_passes(spark):
    got = run(spark, [(1, 1, 0, "u1", "192.0.2.1:1", "/orders/", 201, True)], on_error="open")
    assert got == {1: (201, "upstream")}
