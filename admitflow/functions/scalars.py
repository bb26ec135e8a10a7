"""Row-level functions: every one returns a Column built from Spark SQL
built-ins, so it stays inside whole-stage codegen (no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import messages as M

SECOND_US = 1_000_000

# Host:port splitting (bracketed IPv6 host, or a host with no
# colon), the accepted correlation id alphabet (0x21..0x7e, 1..128 bytes) and
# the JWT shape replaced by the redaction marker.
BRACKET_HOSTPORT = r"^\[([^\[\]]*)\]:([^\[\]]*)$"
PLAIN_HOSTPORT = r"^([^:\[\]]*):([^:\[\]]*)$"
CORRELATION_OK = r"^[!-~]{1,128}$"
JWT_PATTERN = r"eyJhbGciOi[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
JWT_MARKER = "<JWT-REDACTED>"

# The HTTP routes of the four services (method, pattern).
ROUTES = [
    ("GET", "/healthz"),
    ("GET", "/catalog/products"),
    ("POST", "/catalog/products"),
    ("GET", "/catalog/products/{id}"),
    ("POST", "/catalog/products/{id}/stock"),
    ("POST", "/catalog/reservations"),
    ("POST", "/catalog/reservations/release"),
    ("POST", "/catalog/reservations/commit"),
    ("POST", "/orders/"),
    ("GET", "/orders/"),
    ("GET", "/orders/{id}"),
    ("POST", "/payment/charges"),
    ("GET", "/payment/charges/{orderID}"),
    ("POST", "/auth/signup"),
    ("POST", "/auth/login"),
    ("GET", "/auth/me"),
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def client_ip(remote_addr) -> Column:
    """Host part of host:port (IPv6 brackets removed); the whole string
    when it does not split. Forwarding headers are never consulted."""
    s = _c(remote_addr)
    return (F.when(s.rlike(BRACKET_HOSTPORT), F.regexp_extract(s, BRACKET_HOSTPORT, 1))
             .when(s.rlike(PLAIN_HOSTPORT), F.regexp_extract(s, PLAIN_HOSTPORT, 1))
             .otherwise(s))


def limit_key(subject, remote_addr) -> Column:
    """``user:<subject>`` when authenticated, else ``ip:<client ip>``.
    The prefixes keep the two namespaces disjoint."""
    sub = _c(subject)
    return (F.when(sub.isNotNull() & (sub != ""), F.concat(F.lit("user:"), sub))
             .otherwise(F.concat(F.lit("ip:"), client_ip(remote_addr))))


def correlation_valid(cid) -> Column:
    """1..128 bytes, each printable ASCII other than space."""
    c = _c(cid)
    return c.isNotNull() & c.rlike(CORRELATION_OK) & ~c.contains("\n")


def ensure_correlation(cid, request_id) -> Column:
    """Keep a valid id, otherwise mint a 32-hex id. The new id is the
    md5 of the request id, so reruns agree (no random ids in results)."""
    return F.when(correlation_valid(cid), _c(cid)).otherwise(F.md5(_c(request_id).cast("string")))


def seconds_ceil(us) -> Column:
    """Whole seconds, rounded up; 0 for non-positive durations."""
    u = _c(us)
    return F.when(u <= 0, F.lit(0)).otherwise(F.floor((u + (SECOND_US - 1)) / SECOND_US)).cast("long")


def rate_headers(limit, remaining, reset_after_us, retry_after_us, allowed) -> list[Column]:
    """X-RateLimit-Limit / -Remaining / -Reset and, on denial only,
    Retry-After = max(1, ceil seconds)."""
    return [
        _c(limit).cast("long").alias("x_ratelimit_limit"),
        _c(remaining).cast("long").alias("x_ratelimit_remaining"),
        seconds_ceil(reset_after_us).alias("x_ratelimit_reset"),
        F.when(~_c(allowed), F.greatest(F.lit(1).cast("long"), seconds_ceil(retry_after_us)))
         .alias("retry_after_s"),
    ]


def _route_regex(pattern: str) -> str:
    parts = []
    for seg in pattern.split("/"):
        parts.append("[^/]+" if seg.startswith("{") and seg.endswith("}") else seg.replace(".", r"\."))
    return "^" + "/".join(parts) + "$"


def route_label(method, path, routes: list[tuple[str, str]] = ROUTES) -> Column:
    """P5: the route pattern a request matched, else ``unmatched``.

    ``routes`` is the plug point for another service's table of (method,
    pattern); ``{name}`` matches one path segment. A route table is small
    and fixed, so it compiles into one CASE chain: no join, no broadcast,
    stays in codegen."""
    m, p = _c(method), _c(path)
    expr = None
    for meth, pat in routes:
        cond = (m == meth) & p.rlike(_route_regex(pat))
        expr = F.when(cond, F.lit(pat)) if expr is None else expr.when(cond, F.lit(pat))
    return expr.otherwise(F.lit("unmatched"))


def is_server_error(status) -> Column:
    """Only 5xx is a service error; 4xx is the client's."""
    return _c(status) >= 500


def available(stock, reserved) -> Column:
    """Sellable units."""
    return _c(stock) - _c(reserved)


def normalize_currency(raw) -> Column:
    """upper(trim), empty -> USD."""
    s = F.upper(F.trim(_c(raw)))
    return F.when(s.isNull() | (s == ""), F.lit("USD")).otherwise(s)


def currency_ok_for_catalog(raw) -> Column:
    """The catalog also demands a three-letter code (payment does not)."""
    return F.length(normalize_currency(raw)) == 3


# The accepted address forms (a documented subset of RFC 5322:
# a bare addr-spec, or a display name with the addr-spec in angle brackets).
EMAIL_BARE = r"^[^\s<>@,;:\"]+@[^\s<>@,;:\"]+$"
EMAIL_NAMED = r"^[^<>@]*<([^\s<>@,;:\"]+@[^\s<>@,;:\"]+)>$"
EMAIL_MAX_BYTES = M.EMAIL_MAX_BYTES


def email_reason(raw) -> Column:
    """First failing rule, or NULL when the address is usable."""
    e = F.trim(_c(raw))
    return (F.when(e.isNull() | (e == ""), F.lit(M.EMAIL_REQUIRED))
             .when(F.octet_length(e) > EMAIL_MAX_BYTES, F.lit(M.EMAIL_TOO_LONG))
             .when(~(e.rlike(EMAIL_BARE) | e.rlike(EMAIL_NAMED)), F.lit(M.EMAIL_INVALID)))


def normalize_email(raw) -> Column:
    """The bare address (display name dropped), NULL when invalid."""
    e = F.trim(_c(raw))
    return (F.when(email_reason(raw).isNotNull(), F.lit(None).cast("string"))
             .when(e.rlike(EMAIL_NAMED), F.regexp_extract(e, EMAIL_NAMED, 1))
             .otherwise(e))


def email_key(raw) -> Column:
    """Lookup key of an address (case-insensitive uniqueness)."""
    return F.lower(normalize_email(raw))


def clamp_param(raw, default: int, lo: int, hi: int) -> Column:
    """P10: default when empty or not an integer, else clamped to [lo, hi]."""
    s = _c(raw)
    # 64-bit integers only: longer numbers are not integers to the parser.
    n = F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("long"))
    return (F.when(n.isNull(), F.lit(default))
             .when(n < lo, F.lit(lo)).when(n > hi, F.lit(hi)).otherwise(n)).cast("int")


def log_level(raw) -> Column:
    """Exactly lower- or upper-case debug / warn / error; all else info."""
    s = _c(raw)
    return (F.when(s.isin("debug", "DEBUG"), F.lit("debug"))
             .when(s.isin("warn", "WARN"), F.lit("warn"))
             .when(s.isin("error", "ERROR"), F.lit("error"))
             .otherwise(F.lit("info")))


def charge_outcome(declined: Column) -> tuple[Column, Column]:
    """P20: processor stand-in. ``declined`` is any boolean Column (the
    pluggable charge rule); returns (status, failure_reason)."""
    status = F.when(declined, F.lit("failed")).otherwise(F.lit("succeeded"))
    reason = F.when(declined, F.lit(M.CARD_DECLINED))
    return status, reason


def redact_tokens(text) -> Column:
    """Replace JWT-shaped text with the marker; idempotent."""
    return F.regexp_replace(_c(text), JWT_PATTERN, JWT_MARKER)


def count_tokens(text) -> Column:
    """Number of JWT-shaped substrings (non-overlapping)."""
    return F.regexp_count(_c(text), F.lit(JWT_PATTERN)).cast("long")
