"""DuckDB oracles of the registered limiter queries."""

from __future__ import annotations

from . import sqlviews as V
from .limiter_sql import sliding_counter_sql, sliding_log_sql, token_bucket_sql
from .params import LIMIT, WINDOW_US

KEY = V.limit_key("subject", "remote_addr")


def _tb() -> str:
    inner = token_bucket_sql(KEY, LIMIT, WINDOW_US)
    return (f"SELECT *, {V.seconds_ceil('reset_after_us')} AS x_ratelimit_reset, "
            f"CASE WHEN allowed THEN NULL ELSE greatest(1, {V.seconds_ceil('retry_after_us')}) END AS retry_after_s "
            f"FROM ({inner}) t")


def limiter_oracles() -> dict[str, str]:
    return {
        "token_bucket": _tb(),
        "sliding_window_log": sliding_log_sql(KEY, LIMIT, WINDOW_US),
        "swc_grid": sliding_counter_sql(KEY, LIMIT, WINDOW_US, anchored=False),
        "swc_anchored": sliding_counter_sql(KEY, LIMIT, WINDOW_US, anchored=True),
    }


def _all_sql() -> str:
    parts = [
        ("token_bucket", token_bucket_sql(KEY, LIMIT, WINDOW_US)),
        ("sliding_window_log", sliding_log_sql(KEY, LIMIT, WINDOW_US)),
        ("swc_grid", sliding_counter_sql(KEY, LIMIT, WINDOW_US, anchored=False)),
        ("swc_anchored", sliding_counter_sql(KEY, LIMIT, WINDOW_US, anchored=True)),
    ]
    u = " UNION ALL ".join(f"SELECT '{n}' AS algorithm, * FROM ({s}) x{i}" for i, (n, s) in enumerate(parts))
    return f"WITH {V.REQUESTS}, dec AS (SELECT d.*, r.t_us, r.seq FROM ({u}) d JOIN requests r USING (request_id)) "


def _per_instance_sql() -> str:
    inst = f"({KEY}) || '@' || instance"
    return (f"WITH {V.REQUESTS}, sh AS ({token_bucket_sql(KEY, LIMIT, WINDOW_US)}), "
            f"pi AS ({token_bucket_sql(inst, LIMIT, WINDOW_US)}), "
            "j AS (SELECT sh.request_id, sh.key, r.instance, sh.allowed AS allowed_shared, pi.allowed AS allowed_per_instance "
            "FROM sh JOIN pi USING (request_id) JOIN requests r USING (request_id)) ")


def limiter_report_oracles() -> dict[str, str]:
    A = _all_sql()
    W = WINDOW_US
    fixed = (f"SELECT 'fixed_window' AS algorithm, key, t_us, rn <= {LIMIT} AS allowed FROM (SELECT {KEY} AS key, t_us, "
             f"row_number() OVER (PARTITION BY {KEY}, t_us // {W} ORDER BY t_us, seq) AS rn FROM requests) f")
    return {
        "limiter_decisions": A + "SELECT algorithm, CASE WHEN allowed THEN 'allowed' ELSE 'denied' END AS decision, "
                                 "COUNT(*) AS n FROM dec GROUP BY ALL",
        "limiter_remaining_last": A + "SELECT algorithm, arg_max(remaining, (t_us, seq)) AS remaining FROM dec GROUP BY algorithm",
        "limiter_waits": A + "SELECT algorithm, CAST(SUM(CASE WHEN NOT allowed THEN 1 ELSE 0 END) AS BIGINT) AS denied, "
                             "CAST(SUM(CASE WHEN NOT allowed THEN retry_after_us ELSE 0 END) AS BIGINT) AS sum_retry_us, "
                             "max(CASE WHEN NOT allowed THEN retry_after_us END) AS max_retry_us, max(reset_after_us) AS max_reset_us "
                             "FROM dec GROUP BY algorithm",
        "shared_vs_per_instance": _per_instance_sql() + "SELECT key, COUNT(*) AS requests, "
                                  "CAST(SUM(CAST(allowed_shared AS INTEGER)) AS BIGINT) AS allowed_shared, "
                                  "CAST(SUM(CAST(allowed_per_instance AS INTEGER)) AS BIGINT) AS allowed_per_instance FROM j GROUP BY key",
        "shared_limit_verdict": _per_instance_sql() + ", s AS (SELECT CAST(SUM(CAST(allowed_shared AS INTEGER)) AS BIGINT) AS allowed, "
                                "CAST(SUM(CAST(NOT allowed_shared AS INTEGER)) AS BIGINT) AS denied, "
                                "CAST(SUM(CAST(allowed_per_instance AS INTEGER)) AS BIGINT) AS per_instance_allowed, "
                                "COUNT(DISTINCT instance) AS instances FROM j) "
                                "SELECT *, allowed * 4 < per_instance_allowed * 3 AS pass FROM s",
        "limiter_state_size": (
            f"WITH {V.REQUESTS}, lg AS ({sliding_log_sql(KEY, LIMIT, WINDOW_US, with_entries=True)}), "
            "k AS (SELECT DISTINCT key FROM lg) "
            "SELECT 'token_bucket' AS algorithm, key, CAST(1 AS INTEGER) AS max_entries, CAST(96 AS BIGINT) AS est_bytes FROM k "
            "UNION ALL SELECT 'swc_grid', key, 1, 112 FROM k UNION ALL SELECT 'swc_anchored', key, 1, 112 FROM k "
            "UNION ALL SELECT 'sliding_window_log', key, CAST(max(state_entries) AS INTEGER), "
            "CAST(max(state_entries) * 16 + 64 AS BIGINT) FROM lg GROUP BY key"),
        "boundary_burst": A + f", a AS (SELECT algorithm, key, t_us FROM dec WHERE allowed UNION ALL "
                              f"SELECT algorithm, key, t_us FROM ({fixed}) fw WHERE allowed), "
                              f"c AS (SELECT algorithm, key, COUNT(*) OVER (PARTITION BY algorithm, key ORDER BY t_us "
                              f"RANGE BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS n FROM a), "
                              "pk AS (SELECT algorithm, key, max(n) AS m FROM c GROUP BY ALL) "
                              f"SELECT algorithm, max(m) AS max_in_window, CAST(SUM(CASE WHEN m > {LIMIT} THEN 1 ELSE 0 END) AS BIGINT) "
                              "AS keys_over_limit FROM pk GROUP BY algorithm",
    }
