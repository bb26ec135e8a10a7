"""Registered source/sink queries (S1, S6, S7), strict body decoding
and the compensating / confirming settlement (E6, E7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import EVENT_FIELDS, strict_decode
from ..functions.scalars import count_tokens, redact_tokens
from ..operators import metrics as M
from ..operators import saga as SG
from ..operators.gateway import gateway_outcome
from ..sources import views as VW
from ..sources.events import parse_envelopes, records_from_deliveries
from ..sources.tables import read_table
from . import sqlviews as V
from .ledger_queries import settled_ledger
from .params import LIMIT, WINDOW_US
from .request_queries import limiter_down
from .saga_queries import DECODED, _decoded, _effects, _payments

# A token prefix (the base64 of '{"alg":"HS256"}').
TOKEN_HEAD = "eyJhbGciOiJIUzI1NiJ9"


def _with_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Injects a bearer token into every fifth text (the driver text holds
    none), built from the row's id so both engines agree."""
    i = F.col(id_col).cast("string")
    tok = F.concat(F.lit(TOKEN_HEAD + "."), F.md5(i), F.lit("."), F.md5(F.concat(i, F.lit("sig"))))
    return df.select(F.col(id_col).alias("id"),
                     F.when(F.col(id_col) % 5 == 0, F.concat(F.col(text_col), F.lit(" Authorization: Bearer "), tok))
                      .otherwise(F.col(text_col)).alias("text"))


def q_redact_tokens(spark, sf):
    """S7 over whole documents, pages and conversation turns."""
    docs = _with_tokens(read_table(spark, sf, "documents"), "doc_id", "text").withColumn("source", F.lit("documents"))
    pages = _with_tokens(read_table(spark, sf, "pages"), "page_id", "html").withColumn("source", F.lit("pages"))
    conv = read_table(spark, sf, "conversations").withColumn("rid", F.col("conv_id") * 1000 + F.col("turn"))
    conv = _with_tokens(conv, "rid", "text").withColumn("source", F.lit("conversations"))
    allx = docs.unionByName(pages).unionByName(conv)
    red = redact_tokens("text")
    return allx.select("source", "id", count_tokens("text").alias("tokens"),
                       F.md5(red).alias("redacted_md5"), F.octet_length(red).cast("bigint").alias("redacted_bytes"))


def q_src_events(spark, sf):
    """Kafka-shaped records of the delivery log, parsed back into
    envelopes (the same reader serves a live topic)."""
    recs = records_from_deliveries(VW.saga_events(spark, sf))
    env = parse_envelopes(recs)
    return env.select("topic", "partition", "offset", "key", "id", "type", "correlation_id", "payload")


def q_metric_samples(spark, sf):
    """Counters and the latency histogram as one long table
    (name, labels, value), labels in exposition order."""
    req = VW.requests(spark, sf)

    def lbl(*pairs):
        parts = []
        for i, (k, c) in enumerate(pairs):
            parts += [F.lit(("," if i else "") + f'{k}="'), F.col(c).cast("string"), F.lit('"')]
        return F.concat(*parts)
    reqs = M.red_requests(req).select(F.lit(M.HTTP_REQUESTS).alias("name"),
                                      lbl(("method", "method"), ("route", "route"), ("service", "service"),
                                          ("status", "status")).alias("labels"),
                                      F.col("requests").cast("double").alias("value"))
    errs = M.red_errors(req).select(F.lit(M.HTTP_ERRORS).alias("name"),
                                    lbl(("method", "method"), ("route", "route")).alias("labels"),
                                    F.col("errors").cast("double").alias("value"))
    hist = M.red_duration(req)
    buckets = hist.select(F.lit(M.HTTP_DURATION + "_bucket").alias("name"),
                          lbl(("le", "le"), ("method", "method"), ("route", "route")).alias("labels"),
                          F.col("cumulative").cast("double").alias("value"))
    sums = hist.where(F.col("le") == "+Inf").select(
        F.lit(M.HTTP_DURATION + "_sum").alias("name"), lbl(("method", "method"), ("route", "route")).alias("labels"),
        (F.col("sum_us") / 1_000_000).alias("value"))
    counts = hist.where(F.col("le") == "+Inf").select(
        F.lit(M.HTTP_DURATION + "_count").alias("name"), lbl(("method", "method"), ("route", "route")).alias("labels"),
        F.col("count").cast("double").alias("value"))
    eff = _effects(spark, sf)
    consumed = SG.events_consumed(eff).select(
        F.lit(M.EVENTS_CONSUMED).alias("name"),
        lbl(("outcome", "outcome"), ("topic", "topic"), ("type", "type")).alias("labels"),
        F.col("consumed").cast("double").alias("value"))
    outcomes = SG.saga_outcomes(eff).select(
        F.lit(M.ORDER_OUTCOMES).alias("name"), lbl(("outcome", "outcome")).alias("labels"),
        F.col("per_delivery").cast("double").alias("value"))
    ev = VW.saga_events(spark, sf)
    published = SG.events_published(ev, SG.republish_outcome(SG.decode_deliveries(ev), _payments(spark, sf))).select(
        F.lit(M.EVENTS_PUBLISHED).alias("name"), lbl(("topic", "topic"), ("type", "type")).alias("labels"),
        F.col("published").cast("double").alias("value"))
    # The gateway's limiter: decisions it made and the remaining-tokens gauge
    # after the last one (only requests that reached the limiter count).
    gw = (gateway_outcome(req.select("request_id", "seq", "t_us", "k", "subject", "remote_addr", "path", "status"),
                          "token_bucket", LIMIT, WINDOW_US, limiter_error=limiter_down(),
                          keep=["request_id", "seq", "t_us"])
          .where(F.col("allowed").isNotNull()).withColumn("algorithm", F.lit("token_bucket")))
    decisions = gw.groupBy("algorithm", F.when(F.col("allowed"), "allowed").otherwise("denied").alias("decision")) \
        .agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(M.LIMIT_DECISIONS).alias("name"), lbl(("algorithm", "algorithm"), ("decision", "decision")).alias("labels"),
        F.col("n").cast("double").alias("value"))
    remaining = gw.groupBy("algorithm").agg(F.max_by("remaining", F.struct("t_us", "seq")).alias("r")).select(
        F.lit(M.LIMIT_REMAINING).alias("name"), lbl(("algorithm", "algorithm")).alias("labels"),
        F.col("r").cast("double").alias("value"))
    out = reqs
    for p in (errs, buckets, sums, counts, consumed, outcomes, published, decisions, remaining):
        out = out.unionByName(p)
    return out


def strict_bodies(spark, sf) -> DataFrame:
    """Order-create request bodies derived from the OrderCreated payloads,
    a quarter of them broken in one of three ways."""
    ev = VW.saga_events(spark, sf).where(F.col("type") == "OrderCreated")
    s = F.col("seq")
    body = (F.when(s % 4 == 1, F.concat(F.col("payload"), F.lit('{"order_id":"x"}')))
             .when(s % 4 == 2, F.concat(F.lit('{"unit_cents":5,'), F.expr("substring(payload, 2)")))
             .when(s % 4 == 3, F.expr("substring(payload, 1, length(payload) - 1)"))
             .otherwise(F.col("payload")))
    return ev.select("seq", body.alias("body"))


def q_strict_decode(spark, sf):
    """P11 (rows-only): first reason a request body is refused."""
    b = strict_bodies(spark, sf)
    return b.select("seq", strict_decode(F.col("body"), EVENT_FIELDS["OrderCreated"]).alias("reason"))


# Attempts that a product's catalog shard refuses: one or two in an outage.
FAILS_FOR = "CASE WHEN product_id % 97 = 0 THEN 2 WHEN product_id % 41 = 0 THEN 1 ELSE 0 END"


def _settlement(spark, sf, status, op):
    r = SG.resolve_orders(_decoded(spark, sf), VW.orders(spark, sf)).where(F.col("status") == status)
    r = r.select(F.col("order_id").cast("bigint").alias("order_id"))
    s = SG.settle(r, VW.order_lines(spark, sf), op, F.expr(FAILS_FOR), VW.ledger_commands(spark, sf), VW.products(spark, sf), VW.LEDGER_ORDER)
    return s.withColumn("order_id", F.col("order_id").cast("string"))


def q_compensate(spark, sf):
    """Cancelled orders release what the ledger holds for them."""
    return SG.compensate(_settlement(spark, sf, "cancelled", "release"))


def q_confirm(spark, sf):
    """Confirmed orders commit what the ledger holds for them."""
    return SG.confirm(_settlement(spark, sf, "confirmed", "commit"))


def q_consumed_outcomes(spark, sf):
    """M8: deliveries consumed by outcome, those that had to be repeated included."""
    effects = SG.delivery_effects(_decoded(spark, sf), VW.orders(spark, sf))
    return SG.consumed_outcomes(effects, _settlement(spark, sf, "cancelled", "release"))


QUERIES = {
    "redact_tokens": q_redact_tokens,
    "src_events": q_src_events,
    "metric_samples": q_metric_samples,
    "strict_decode": q_strict_decode,
    "compensate": q_compensate,
    "confirm": q_confirm,
    "consumed_outcomes": q_consumed_outcomes,
}

# ---------------------------------------------------------------- oracles


def _tok(i: str) -> str:
    return f"'{TOKEN_HEAD}.' || md5(CAST({i} AS VARCHAR)) || '.' || md5(CAST({i} AS VARCHAR) || 'sig')"


def _inj(src: str, idc: str, txt: str, name: str) -> str:
    return (f"SELECT '{name}' AS source, {idc} AS id, CASE WHEN {idc} % 5 = 0 THEN {txt} || ' Authorization: Bearer ' || "
            f"{_tok(idc)} ELSE {txt} END AS text FROM {src}")


_REDACT = ("WITH t AS (" + _inj("documents", "doc_id", "text", "documents") + " UNION ALL "
           + _inj("pages", "page_id", "html", "pages") + " UNION ALL "
           + _inj("(SELECT conv_id * 1000 + turn AS rid, text FROM conversations) c", "rid", "text", "conversations")
           + f") SELECT source, id, {V.count_tokens('text')} AS tokens, md5({V.redact('text')}) AS redacted_md5, "
           f"CAST(strlen({V.redact('text')}) AS BIGINT) AS redacted_bytes FROM t")

_LBL = "'method=\"' || method || '\",route=\"' || route || '\"'"

ORACLES = {
    "redact_tokens": _REDACT,
    "src_events": f"WITH {V.SAGA_EVENTS} SELECT topic, partition, \"offset\", key, envelope_id AS id, type, correlation_id, "
                  "payload FROM saga_events",
    "compensate": settled_ledger(DECODED, "cancelled", "release", FAILS_FOR)
                  + " SELECT order_id, items, units AS released_units, holds AS released_holds, first AS released_first_attempt, "
                    "without_hold, attempts, CASE WHEN attempts = 1 THEN 'cancelled' ELSE 'pending' END AS status_after_first, "
                    "'cancelled' AS status FROM settlement",
    "confirm": settled_ledger(DECODED, "confirmed", "commit", FAILS_FOR)
               + " SELECT order_id, items, units AS committed_units, holds AS committed_holds, without_hold, attempts, "
                 "'confirmed' AS status FROM settlement",
    "consumed_outcomes": settled_ledger(DECODED, "cancelled", "release", FAILS_FOR)
                         + " SELECT topic, type, COUNT(*) AS consumed, 'success' AS outcome FROM effects "
                           "WHERE (topic IN ('payment.succeeded', 'payment.failed') AND effect IN ('applied', 'duplicate')) "
                           "OR (topic = 'order.created' AND effect = 'applied') GROUP BY topic, type "
                           "UNION ALL SELECT 'payment.failed', 'PaymentFailed', CAST(SUM(attempts - 1) AS BIGINT), 'retry' "
                           "FROM settlement HAVING SUM(attempts - 1) > 0",
}


def _metric_samples_sql() -> str:
    from . import request_queries as RQ
    from . import saga_queries as SQ

    def lab(*pairs):
        return " || ',' || ".join(f"'{k}=\"' || CAST({c} AS VARCHAR) || '\"'" for k, c in pairs)
    mr = [("method", "method"), ("route", "route")]
    parts = [
        f"SELECT 'http_requests_total' AS name, {lab(*mr, ('service', 'service'), ('status', 'status'))} AS labels, "
        f"CAST(requests AS DOUBLE) AS value FROM ({RQ.ORACLES['red_requests']}) a",
        f"SELECT 'http_request_errors_total', {lab(*mr)}, CAST(errors AS DOUBLE) FROM ({RQ.ORACLES['red_errors']}) b",
        f"SELECT 'http_request_duration_seconds_bucket', {lab(('le', 'le'), *mr)}, CAST(cumulative AS DOUBLE) "
        f"FROM ({RQ.ORACLES['red_duration']}) c",
        f"SELECT 'http_request_duration_seconds_sum', {lab(*mr)}, sum_us / 1000000 FROM ({RQ.ORACLES['red_duration']}) d "
        "WHERE le = '+Inf'",
        f"SELECT 'http_request_duration_seconds_count', {lab(*mr)}, CAST(count AS DOUBLE) FROM ({RQ.ORACLES['red_duration']}) e "
        "WHERE le = '+Inf'",
        f"SELECT 'saga_events_consumed_total', {lab(('outcome', 'outcome'), ('topic', 'topic'), ('type', 'type'))}, "
        f"CAST(consumed AS DOUBLE) FROM ({SQ.ORACLES['events_consumed']}) f",
        f"SELECT 'saga_order_outcomes_total', {lab(('outcome', 'outcome'))}, CAST(per_delivery AS DOUBLE) "
        f"FROM ({SQ.ORACLES['saga_outcomes']}) g",
        f"SELECT 'saga_events_published_total', {lab(('topic', 'topic'), ('type', 'type'))}, CAST(published AS DOUBLE) "
        f"FROM ({SQ.ORACLES['events_published']}) h",
    ]
    prelude, fold = RQ.gateway_fold_sql()
    dec = f"(WITH {prelude} SELECT l.allowed, l.remaining, r.t_us, r.seq FROM ({fold}) l JOIN requests r USING (request_id)) x"
    parts.append(f"SELECT 'ratelimit_decisions_total', 'algorithm=\"token_bucket\",decision=\"' || "
                 f"CASE WHEN allowed THEN 'allowed' ELSE 'denied' END || '\"', CAST(COUNT(*) AS DOUBLE) FROM {dec} "
                 "GROUP BY allowed")
    parts.append(f"SELECT 'ratelimit_remaining_tokens', 'algorithm=\"token_bucket\"', "
                 f"CAST(arg_max(remaining, (t_us, seq)) AS DOUBLE) FROM {dec}")
    return " UNION ALL ".join(parts)


ORACLES["metric_samples"] = _metric_samples_sql()
