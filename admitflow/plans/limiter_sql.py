"""Recursive-CTE oracles for the limiter folds (DuckDB).

Each key's requests are numbered in (t_us, seq) order and the state is
carried from row n to row n+1 by the recursive step, which is the
textbook serial definition the Spark fold must reproduce.
"""

from __future__ import annotations

from .sqlviews import REQUESTS


def _base(key_sql: str, source: str = "requests", extra: str = "") -> str:
    return (f"base AS MATERIALIZED (SELECT request_id, {key_sql} AS key, t_us, seq{extra}, "
            f"row_number() OVER (PARTITION BY {key_sql} ORDER BY t_us, seq) AS rn FROM {source})")


def token_bucket_sql(key_sql: str, C: int, W: int, prelude: str = REQUESTS, source: str = "requests") -> str:
    CW = C * W
    return f"""WITH RECURSIVE {prelude},
{_base(key_sql, source)},
fold(key, rn, t_us, tok, allowed) AS (
  SELECT key, rn, t_us, CAST({CW - W} AS BIGINT), true FROM base WHERE rn = 1
  UNION ALL
  SELECT key, rn, t_us, CASE WHEN lvl >= {W} THEN lvl - {W} ELSE lvl END, lvl >= {W}
  FROM (SELECT b.key, b.rn, b.t_us, least(CAST({CW} AS BIGINT), f.tok + least(b.t_us - f.t_us, {W}) * {C}) AS lvl
        FROM fold f JOIN base b ON b.key = f.key AND b.rn = f.rn + 1) s
)
SELECT b.request_id, b.key, f.allowed,
  CAST({C} AS INTEGER) AS "limit",
  CAST(CASE WHEN f.allowed THEN f.tok // {W} ELSE 0 END AS BIGINT) AS remaining,
  CAST(({CW} - f.tok + {C - 1}) // {C} AS BIGINT) AS reset_after_us,
  CAST(CASE WHEN f.allowed THEN 0 ELSE ({W} - f.tok + {C - 1}) // {C} END AS BIGINT) AS retry_after_us
FROM fold f JOIN base b ON b.key = f.key AND b.rn = f.rn"""


def sliding_log_sql(key_sql: str, C: int, W: int, prelude: str = REQUESTS, source: str = "requests",
                    with_entries: bool = False) -> str:
    entries = ",\n  CAST(len(f.log) AS INTEGER) AS state_entries" if with_entries else ""
    return f"""WITH RECURSIVE {prelude},
{_base(key_sql, source)},
fold(key, rn, t_us, log, allowed) AS (
  SELECT key, rn, t_us, [t_us], true FROM base WHERE rn = 1
  UNION ALL
  SELECT key, rn, t_us,
    CASE WHEN len(kept) < {C} THEN list_append(kept, t_us) ELSE kept END,
    len(kept) < {C}
  FROM (SELECT b.key, b.rn, b.t_us, list_filter(f.log, lambda x: x > b.t_us - {W}) AS kept
        FROM fold f JOIN base b ON b.key = f.key AND b.rn = f.rn + 1) s
)
SELECT b.request_id, b.key, f.allowed,
  CAST({C} AS INTEGER) AS "limit",
  CAST(CASE WHEN f.allowed THEN {C} - len(f.log) ELSE 0 END AS BIGINT) AS remaining,
  CAST(CASE WHEN len(f.log) = 0 THEN 0 ELSE least(greatest(list_max(f.log) + {W} - f.t_us, 0), {W}) END AS BIGINT) AS reset_after_us,
  CAST(CASE WHEN f.allowed THEN 0 ELSE least(greatest(list_min(f.log) + {W} - f.t_us, 0), {W}) END AS BIGINT) AS retry_after_us{entries}
FROM fold f JOIN base b ON b.key = f.key AND b.rn = f.rn"""


def sliding_counter_sql(key_sql: str, C: int, W: int, anchored: bool, prelude: str = REQUESTS,
                        source: str = "requests") -> str:
    CW = C * W
    anchor = "min(t_us) OVER (PARTITION BY " + key_sql + ")" if anchored else "0"
    base = (f"base AS MATERIALIZED (SELECT request_id, key, t_us, seq, rn, (t_us - a) // {W} AS idx, "
            f"(t_us - a) - ((t_us - a) // {W}) * {W} AS e FROM (SELECT request_id, {key_sql} AS key, t_us, seq, "
            f"{anchor} AS a, row_number() OVER (PARTITION BY {key_sql} ORDER BY t_us, seq) AS rn FROM {source}) z)")
    return f"""WITH RECURSIVE {prelude},
{base},
fold(key, rn, idx, e, curr, prev, allowed, load) AS (
  SELECT key, rn, idx, e, CAST(1 AS BIGINT), CAST(0 AS BIGINT), true, CAST({W} AS BIGINT) FROM base WHERE rn = 1
  UNION ALL
  SELECT key, rn, idx, e,
    CASE WHEN p * ({W} - e) + c * {W} + {W} <= {CW} THEN c + 1 ELSE c END,
    p,
    p * ({W} - e) + c * {W} + {W} <= {CW},
    p * ({W} - e) + c * {W} + {W}
  FROM (SELECT b.key, b.rn, b.idx, b.e,
          CASE WHEN b.idx = f.idx THEN f.curr ELSE 0 END AS c,
          CASE WHEN b.idx = f.idx THEN f.prev WHEN b.idx = f.idx + 1 THEN f.curr ELSE 0 END AS p
        FROM fold f JOIN base b ON b.key = f.key AND b.rn = f.rn + 1) s
)
SELECT b.request_id, b.key, f.allowed,
  CAST({C} AS INTEGER) AS "limit",
  CAST(CASE WHEN f.allowed THEN ({CW} - f.load) // {W} ELSE 0 END AS BIGINT) AS remaining,
  CAST({W} - f.e AS BIGINT) AS reset_after_us,
  CAST(CASE WHEN f.allowed THEN 0
    WHEN f.prev = 0 THEN ({W} - f.e) + CASE WHEN f.curr = 0 THEN 0
         ELSE (greatest(0, f.curr - {C} + 1) * {W} + f.curr - 1) // f.curr END
    WHEN {C} - 1 - f.curr <= 0 THEN {W} - f.e
    WHEN {W} - (({C} - 1 - f.curr) * {W}) // f.prev - f.e <= 0 THEN 1000
    ELSE least({W} - (({C} - 1 - f.curr) * {W}) // f.prev - f.e, {W} - f.e) END AS BIGINT) AS retry_after_us
FROM fold f JOIN base b ON b.key = f.key AND b.rn = f.rn"""
