"""DuckDB spellings of the domain views and scalar functions.

These are the independent oracle side: the same definitions as
:mod:`admitflow.sources.views` and :mod:`admitflow.functions.scalars`,
written once more in SQL over the raw driver tables.
"""

from __future__ import annotations

from ..functions.scalars import (BRACKET_HOSTPORT, CORRELATION_OK, EMAIL_BARE, EMAIL_MAX_BYTES,
                                 EMAIL_NAMED, JWT_MARKER, JWT_PATTERN, PLAIN_HOSTPORT, ROUTES,
                                 _route_regex)
from ..sources.views import CATALOG_EPOCH_US


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


REQUESTS = """
requests AS (
  SELECT event_id AS request_id, event_id AS seq, epoch_us(ts) AS t_us, user_id, event_type, k,
    CASE WHEN user_id % 10 = 0 THEN '' ELSE 'u' || CAST(user_id AS VARCHAR) END AS subject,
    '192.0.2.' || CAST(user_id % 250 AS VARCHAR) || ':' || CAST(event_id % 60000 + 1024 AS VARCHAR) AS remote_addr,
    'gateway-' || CAST(k % 2 + 1 AS VARCHAR) AS instance,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN event_type = 'signup' THEN '/auth/signup'
         WHEN event_type = 'purchase' THEN '/orders/'
         WHEN event_type = 'view' THEN '/catalog/products/' || CAST(k AS VARCHAR)
         WHEN event_type = 'click' AND k >= 95 THEN '/metrics'
         WHEN event_type = 'click' THEN '/catalog/products'
         WHEN event_type = 'error' THEN '/payment/charges/' || CAST(event_id AS VARCHAR) END AS path,
    CAST(CASE WHEN event_type = 'signup' THEN 201
         WHEN event_type = 'purchase' THEN CASE WHEN k < 90 THEN 201 ELSE 409 END
         WHEN event_type = 'view' THEN CASE WHEN k < 95 THEN 200 ELSE 404 END
         WHEN event_type = 'click' THEN 200
         WHEN event_type = 'error' THEN CASE WHEN k < 50 THEN 500 WHEN k < 75 THEN 502 ELSE 404 END END AS INTEGER) AS status,
    CAST(ROUND(value * 10000) AS BIGINT) AS duration_us,
    CASE WHEN k % 20 = 0 THEN 'bad id' WHEN k % 20 = 1 THEN '' ELSE 'c-' || CAST(event_id AS VARCHAR) END AS correlation_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
)"""

PRODUCTS = f"""
products AS (
  SELECT p_partkey AS product_id, p_brand || '-' || CAST(p_partkey AS VARCHAR) AS sku, p_name AS name,
    CAST(ROUND(p_retailprice * 100) AS BIGINT) AS price_cents, 'USD' AS currency,
    CAST(p_size * 20 AS INTEGER) AS stock, CAST(0 AS INTEGER) AS reserved,
    {CATALOG_EPOCH_US} + (p_partkey * 7919 % 1000) * 1000000 AS created_us
  FROM part
)"""

ORDERS = """
orders_v AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, epoch_us(o_orderdate) AS created_us,
    CAST(ROUND(o_totalprice * 100) AS BIGINT) AS total_cents, 'USD' AS currency,
    CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'P' THEN 'cancelled' ELSE 'pending' END AS status
  FROM orders
)"""

ORDER_LINES = """
order_lines AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
    l_linenumber AS line_no, CAST(ROUND(l_extendedprice * 100 / l_quantity) AS BIGINT) AS unit_cents,
    epoch_us(l_shipdate) AS ship_us, l_suppkey AS supp_id, l_extendedprice AS extended_price
  FROM lineitem
)"""

SIGNUPS = """
signups AS (
  SELECT c_custkey AS signup_id, c_custkey AS user_id,
    CASE WHEN c_custkey % 29 = 0 THEN 'not-an-email-' || CAST(c_custkey AS VARCHAR)
         WHEN c_custkey % 4 = 0 THEN upper(addr)
         WHEN c_custkey % 4 = 1 THEN '  ' || addr || ' '
         WHEN c_custkey % 4 = 2 THEN replace(c_name, '#', ' ') || ' <' || addr || '>'
         ELSE addr END AS raw_email
  FROM (SELECT *, 'user' || CAST(c_custkey // 2 AS VARCHAR) || '@example.test' AS addr FROM customer) c
)"""

SAGA_EVENTS = """
saga_events AS (
  SELECT o_orderkey * 10 + n AS seq,
    'e-' || CAST(o_orderkey AS VARCHAR) || '-' || CAST(CASE n WHEN 1 THEN 0 WHEN 3 THEN 2 ELSE n END AS VARCHAR) AS envelope_id,
    etype AS type,
    CASE etype WHEN 'OrderCreated' THEN 'order.created' WHEN 'PaymentSucceeded' THEN 'payment.succeeded'
         ELSE 'payment.failed' END AS topic,
    CAST(((oid % 3) + 3) % 3 AS INTEGER) AS partition,
    o_orderkey * 10 + n AS "offset",
    CAST(oid AS VARCHAR) AS key,
    'o-' || CAST(o_orderkey AS VARCHAR) AS correlation_id,
    epoch_us(o_orderdate) + n * 1000000 AS occurred_us,
    CASE WHEN n <= 1 THEN '{"order_id":"' || CAST(oid AS VARCHAR) || '","user_id":"' || CAST(o_custkey AS VARCHAR)
                          || '","amount_cents":' || CAST(amount AS VARCHAR) || ',"currency":"USD"}'
         WHEN n = 5 THEN '{"order_id":' || CAST(oid AS VARCHAR) || '}'
         WHEN etype = 'PaymentSucceeded' THEN '{"order_id":"' || CAST(oid AS VARCHAR) || '","payment_id":"p-'
                          || CAST(oid AS VARCHAR) || '","amount_cents":' || CAST(amount AS VARCHAR) || ',"currency":"USD"}'
         ELSE '{"order_id":"' || CAST(oid AS VARCHAR) || '","reason":"'
              || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'card declined' END || '"}' END AS payload
  FROM (
    SELECT o.*, t.n,
      CASE WHEN t.n = 6 THEN -o_orderkey - 1 ELSE o_orderkey END AS oid,
      CAST(ROUND(o_totalprice * 100) AS BIGINT) AS amount,
      CASE WHEN t.n <= 1 THEN 'OrderCreated'
           WHEN t.n IN (2, 3) THEN CASE WHEN o_orderstatus = 'F' THEN 'PaymentSucceeded' ELSE 'PaymentFailed' END
           WHEN t.n = 4 THEN CASE WHEN o_orderstatus = 'F' THEN 'PaymentFailed' ELSE 'PaymentSucceeded' END
           WHEN t.n = 5 THEN 'PaymentSucceeded'
           ELSE CASE WHEN o_orderstatus = 'F' THEN 'PaymentSucceeded' ELSE 'PaymentFailed' END END AS etype
    FROM orders o, (SELECT range AS n FROM range(7)) t
    WHERE t.n = 0 OR (t.n = 1 AND o_orderkey % 7 = 0)
       OR (t.n = 2 AND o_orderstatus IN ('F', 'P'))
       OR (t.n = 3 AND o_orderstatus IN ('F', 'P') AND o_orderkey % 5 = 0)
       OR (t.n = 4 AND o_orderstatus IN ('F', 'P') AND o_orderkey % 11 = 0)
       OR (t.n = 5 AND o_orderkey % 101 = 0)
       OR (t.n = 6 AND o_orderkey % 97 = 0)
  ) x
)"""

LOGS = """
logs AS (
  SELECT start_us + (CASE line_no WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN o_orderkey % 100 + 40
                      WHEN 4 THEN o_orderkey % 250 + 90 ELSE 3 END) * 1000 AS ts_us,
    CASE WHEN line_no = 0 THEN 'gateway' WHEN line_no IN (1, 2, 4) THEN 'orders'
         WHEN line_no = 3 THEN 'payment' ELSE 'catalog' END AS service,
    CASE WHEN line_no = 5 THEN 'warn' WHEN o_orderkey % 7 = 0 THEN 'Error' WHEN o_orderkey % 7 = 1 THEN 'DEBUG'
         WHEN line_no = 4 AND o_orderstatus = 'P' THEN 'WARN' ELSE 'INFO' END AS level,
    CASE line_no WHEN 0 THEN 'request completed' WHEN 1 THEN 'order created' WHEN 2 THEN 'event published'
         WHEN 3 THEN 'charge recorded'
         WHEN 4 THEN CASE WHEN o_orderstatus = 'F' THEN 'order confirmed' ELSE 'order cancelled' END
         ELSE 'reservation retried' END AS msg,
    CASE WHEN line_no = 5 THEN NULL ELSE 'o-' || CAST(o_orderkey AS VARCHAR) END AS correlation_id,
    CAST(o_orderkey AS VARCHAR) AS order_id,
    line_no
  FROM (
    SELECT o.*, epoch_us(o_orderdate) + (o_orderkey % 86400) * 1000000 AS start_us, t.line_no
    FROM orders o, (SELECT range AS line_no FROM range(6)) t
    WHERE t.line_no <= 2 OR (t.line_no = 3 AND o_orderkey % 13 <> 0)
       OR (t.line_no = 4 AND o_orderstatus IN ('F', 'P')) OR (t.line_no = 5 AND o_orderkey % 50 = 0)
  ) x
)"""

LOG_LINES = LOGS + """,
log_lines AS (
  SELECT ts_us, line_no,
    '{"time":"' || strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') || '","level":"' || level
    || '","msg":"' || msg || '","service":"' || service || '"'
    || CASE WHEN correlation_id IS NULL THEN '' ELSE ',"correlation_id":"' || correlation_id || '"' END
    || ',"order_id":"' || order_id || '"'
    || CASE WHEN service = 'payment' THEN ',"attempt":' || CAST(line_no - 2 AS VARCHAR) ELSE '' END || '}' AS line
  FROM logs
)"""

CONSUMER_OFFSETS = SAGA_EVENTS + """,
consumer_offsets AS (
  SELECT CASE WHEN e.topic = 'order.created' THEN 'payment' ELSE 'orders' END AS consumer_group,
    e.topic, e.partition, COUNT(*) AS end_offset,
    CAST(SUM(CASE WHEN o.o_orderstatus IN ('F', 'P') OR o.o_orderstatus IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS committed
  FROM saga_events e LEFT JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = e.key
  GROUP BY 1, 2, 3
)"""


def client_ip(s: str) -> str:
    return (f"CASE WHEN regexp_matches({s}, {q(BRACKET_HOSTPORT)}) THEN regexp_extract({s}, {q(BRACKET_HOSTPORT)}, 1) "
            f"WHEN regexp_matches({s}, {q(PLAIN_HOSTPORT)}) THEN regexp_extract({s}, {q(PLAIN_HOSTPORT)}, 1) "
            f"ELSE {s} END")


def limit_key(subject: str, remote_addr: str) -> str:
    return (f"CASE WHEN {subject} IS NOT NULL AND {subject} <> '' THEN 'user:' || {subject} "
            f"ELSE 'ip:' || ({client_ip(remote_addr)}) END")


def correlation_valid(c: str) -> str:
    return f"({c} IS NOT NULL AND regexp_matches({c}, {q(CORRELATION_OK)}))"


def seconds_ceil(us: str) -> str:
    return f"CAST(CASE WHEN {us} <= 0 THEN 0 ELSE ({us} + 999999) // 1000000 END AS BIGINT)"


def route_label(method: str, path: str) -> str:
    arms = " ".join(f"WHEN {method} = {q(m)} AND regexp_matches({path}, {q(_route_regex(p))}) THEN {q(p)}"
                    for m, p in ROUTES)
    return f"CASE {arms} ELSE 'unmatched' END"


def normalize_currency(raw: str) -> str:
    return f"CASE WHEN {raw} IS NULL OR upper(trim({raw})) = '' THEN 'USD' ELSE upper(trim({raw})) END"


def email_reason(raw: str) -> str:
    e = f"trim({raw})"
    return (f"CASE WHEN {raw} IS NULL OR {e} = '' THEN 'email is required' "
            f"WHEN strlen({e}) > {EMAIL_MAX_BYTES} THEN 'email is too long' "
            f"WHEN NOT (regexp_matches({e}, {q(EMAIL_BARE)}) OR regexp_matches({e}, {q(EMAIL_NAMED)})) "
            f"THEN 'email is not a valid address' END")


def normalize_email(raw: str) -> str:
    e = f"trim({raw})"
    return (f"CASE WHEN ({email_reason(raw)}) IS NOT NULL THEN NULL "
            f"WHEN regexp_matches({e}, {q(EMAIL_NAMED)}) THEN regexp_extract({e}, {q(EMAIL_NAMED)}, 1) ELSE {e} END")


def clamp_param(raw: str, default: int, lo: int, hi: int) -> str:
    n = f"(CASE WHEN regexp_matches({raw}, '^[+-]?[0-9]{{1,18}}$') THEN CAST({raw} AS BIGINT) END)"
    return (f"CAST(CASE WHEN {n} IS NULL THEN {default} WHEN {n} < {lo} THEN {lo} WHEN {n} > {hi} THEN {hi} "
            f"ELSE {n} END AS INTEGER)")


def log_level(raw: str) -> str:
    return (f"CASE WHEN {raw} IN ('debug', 'DEBUG') THEN 'debug' WHEN {raw} IN ('warn', 'WARN') THEN 'warn' "
            f"WHEN {raw} IN ('error', 'ERROR') THEN 'error' ELSE 'info' END")


def redact(text: str) -> str:
    return f"regexp_replace({text}, {q(JWT_PATTERN)}, {q(JWT_MARKER)}, 'g')"


def count_tokens(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, {q(JWT_PATTERN)})) AS BIGINT)"
