"""Registered saga / event queries (E1-E11, J3, J7, M7-M9, M13-M15, P12,
P16, S2) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.jsonx import EVENT_FIELDS
from ..operators import ledger as LG
from ..operators import saga as SG
from ..sources import views as VW
from ..sources.events import envelope_records
from . import sqlviews as V
from .ledger_queries import LEDGER, OPEN_HOLDS

DAY_US = 86_400_000_000
STUCK_AFTER_US = 7 * DAY_US


def declined() -> F.Column:
    """The processor stand-in used by the registered queries."""
    return F.col("amount_cents") % 10 == 0


def _decoded(spark, sf):
    return SG.decode_deliveries(VW.saga_events(spark, sf))


def _payments(spark, sf):
    return SG.charge_once(_decoded(spark, sf), declined())


def q_decode_event(spark, sf):
    d = _decoded(spark, sf)
    return d.select("seq", "topic", "type", "decodable", "decode_error",
                    F.when(F.col("decodable"), F.col("order_id")).alias("order_id"))


def q_charge_once(spark, sf):
    return _payments(spark, sf)


def q_public_payments(spark, sf):
    """The payment view without the owner's user id."""
    return _payments(spark, sf).select("payment_id", "order_id", "amount_cents", "currency", "status", "failure_reason")


def q_republish_outcome(spark, sf):
    return SG.republish_outcome(_decoded(spark, sf), _payments(spark, sf))


def q_resolve_orders(spark, sf):
    r = SG.resolve_orders(_decoded(spark, sf), VW.orders(spark, sf))
    return r.select("order_id", "status", "failure_reason", "decided_seq")


def _effects(spark, sf):
    return SG.delivery_effects(_decoded(spark, sf), VW.orders(spark, sf))


def q_delivery_effects(spark, sf):
    return _effects(spark, sf).select("seq", "topic", "order_id", "effect")


def q_events_consumed(spark, sf):
    return SG.events_consumed(_effects(spark, sf))


def q_saga_outcomes(spark, sf):
    return SG.saga_outcomes(_effects(spark, sf))


def q_events_published(spark, sf):
    ev = VW.saga_events(spark, sf)
    return SG.events_published(ev, SG.republish_outcome(SG.decode_deliveries(ev), _payments(spark, sf)))


def q_dedupe_envelopes(spark, sf):
    return SG.dedupe_envelopes(VW.saga_events(spark, sf))


def q_saga_pairs(spark, sf):
    return SG.saga_pairs(_decoded(spark, sf), VW.orders(spark, sf))


def q_unknown_orders(spark, sf):
    """Payment events whose order does not exist (skipped by the saga)."""
    d = _decoded(spark, sf).where(F.col("topic").isin(*SG.PAYMENT_TOPICS) & F.col("decodable")
                                  & F.col("order_id").isNotNull())
    known = VW.orders(spark, sf).select(F.col("order_id").cast("string").alias("order_id"))
    return d.join(known, "order_id", "left_anti").select("seq", "order_id", "type")


def q_status_counts(spark, sf):
    """Orders by resolved status and payments by status."""
    r = SG.resolve_orders(_decoded(spark, sf), VW.orders(spark, sf))
    o = r.groupBy(F.lit("orders").alias("entity"), "status").agg(F.count(F.lit(1)).alias("n"))
    p = _payments(spark, sf).groupBy(F.lit("payments").alias("entity"), "status").agg(F.count(F.lit(1)).alias("n"))
    return o.unionByName(p)


def q_consumer_lag(spark, sf):
    """Lag by group, topic, partition with rollup subtotals."""
    off = VW.consumer_offsets(spark, sf)
    return (off.rollup("consumer_group", "topic", "partition")
               .agg(F.sum(F.greatest(F.col("end_offset") - F.col("committed"), F.lit(0))).cast("bigint").alias("lag")))


def q_drain_eta(spark, sf):
    """Payment backlog over the observed settle rate. The settle rate
    is a one-row aggregate read as scalar subqueries (no cross join)."""
    off = VW.consumer_offsets(spark, sf).where(F.col("consumer_group") == "payment")
    o = VW.orders(spark, sf)
    settled = o.select(F.sum(F.when(F.col("status") != "pending", 1).otherwise(0)).cast("bigint")).scalar()
    span = o.select(F.max("created_us") - F.min("created_us")).scalar()
    b = off.agg(F.sum(F.col("end_offset") - F.col("committed")).cast("bigint").alias("backlog"))
    eta = (F.col("backlog").cast("double") * (F.col("span_us").cast("double") / 1_000_000)
           / F.col("settled").cast("double"))
    return (b.select("backlog", settled.alias("settled"), span.alias("span_us"))
             .withColumn("eta_s", eta.cast("bigint")))


def q_stuck_pending(spark, sf):
    """Pending orders older than 7 days at the latest order time, with
    the units that the ledger still holds for them."""
    o = VW.orders(spark, sf)
    r = SG.resolve_orders(_decoded(spark, sf), o)
    results = LG.run_ledger(VW.ledger_commands(spark, sf), VW.products(spark, sf), VW.LEDGER_ORDER, returned=LG.HOLD_COLUMNS)
    holds = LG.open_holds(results, VW.LEDGER_ORDER).withColumn("order_id", F.col("order_id").cast("string"))
    now = o.select(F.max("created_us")).scalar()
    return SG.stuck_pending(r, holds, now, STUCK_AFTER_US)


def q_sink_envelope(spark, sf):
    """Payment outcomes wrapped as keyed envelopes (value JSON + header)."""
    return envelope_records(_payments(spark, sf))


QUERIES = {
    "decode_event": q_decode_event,
    "charge_once": q_charge_once,
    "public_payments": q_public_payments,
    "republish_outcome": q_republish_outcome,
    "resolve_orders": q_resolve_orders,
    "delivery_effects": q_delivery_effects,
    "events_consumed": q_events_consumed,
    "saga_outcomes": q_saga_outcomes,
    "events_published": q_events_published,
    "dedupe_envelopes": q_dedupe_envelopes,
    "saga_pairs": q_saga_pairs,
    "unknown_orders": q_unknown_orders,
    "status_counts": q_status_counts,
    "consumer_lag": q_consumer_lag,
    "drain_eta": q_drain_eta,
    "stuck_pending": q_stuck_pending,
    "sink_envelope": q_sink_envelope,
}

# ---------------------------------------------------------------- oracles

_KINDS = {"string": "('VARCHAR')", "int": "('BIGINT', 'UBIGINT')", "array": "('ARRAY')"}


def _fields_ok() -> str:
    arms = []
    for etype, fields in EVENT_FIELDS.items():
        conds = " AND ".join(f"(json_type(payload, '$.{f}') IS NULL OR json_type(payload, '$.{f}') = 'NULL' "
                             f"OR json_type(payload, '$.{f}') IN {_KINDS[k if isinstance(k, str) else 'array']})" for f, k in fields.items())
        arms.append(f"WHEN type = '{etype}' THEN {conds}")
    return "CASE " + " ".join(arms) + " ELSE false END"


DECODED = V.SAGA_EVENTS + f""",
dec0 AS (
  SELECT *, CASE WHEN type <> (CASE topic WHEN 'order.created' THEN 'OrderCreated' WHEN 'payment.succeeded' THEN 'PaymentSucceeded'
                                WHEN 'payment.failed' THEN 'PaymentFailed' END) THEN 'unexpected event type'
                 WHEN NOT coalesce(json_valid(payload), false) THEN 'payload is not a JSON object'
                 WHEN json_type(payload) <> 'OBJECT' THEN 'payload is not a JSON object'
                 WHEN NOT ({_fields_ok()}) THEN 'payload field has the wrong type' END AS decode_error
  FROM saga_events
),
dec AS (
  SELECT *, decode_error IS NULL AS decodable,
    CASE WHEN decode_error IS NULL THEN json_extract_string(payload, '$.order_id') END AS order_id,
    CASE WHEN decode_error IS NULL THEN json_extract_string(payload, '$.user_id') END AS user_id,
    CASE WHEN decode_error IS NULL THEN CAST(json_extract(payload, '$.amount_cents') AS BIGINT) END AS amount_cents,
    CASE WHEN decode_error IS NULL THEN json_extract_string(payload, '$.currency') END AS currency_raw,
    CASE WHEN decode_error IS NULL THEN json_extract_string(payload, '$.reason') END AS reason
  FROM dec0
),
oc AS (SELECT * FROM dec WHERE topic = 'order.created' AND decodable AND order_id IS NOT NULL AND order_id <> ''),
payments AS (
  SELECT order_id, 'pay-' || order_id AS payment_id, user_id, CAST(coalesce(amount_cents, 0) AS BIGINT) AS amount_cents,
    {V.normalize_currency('currency_raw')} AS currency,
    CASE WHEN amount_cents % 10 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
    CASE WHEN amount_cents % 10 = 0 THEN 'card declined' END AS failure_reason, seq AS charged_seq
  FROM oc WHERE seq = (SELECT min(seq) FROM oc o2 WHERE o2.order_id = oc.order_id)
),
known AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_custkey AS user_id, epoch_us(o_orderdate) AS created_us FROM orders),
ft AS (
  SELECT order_id, min(seq) AS decided_seq, arg_min(type, seq) AS decided_type, arg_min(reason, seq) AS decided_reason
  FROM dec WHERE topic IN ('payment.succeeded', 'payment.failed') AND decodable AND order_id IS NOT NULL AND order_id <> ''
    AND order_id IN (SELECT order_id FROM known)
  GROUP BY order_id
),
resolved AS (
  SELECT k.order_id, k.user_id, k.created_us,
    CASE ft.decided_type WHEN 'PaymentSucceeded' THEN 'confirmed' WHEN 'PaymentFailed' THEN 'cancelled' ELSE 'pending' END AS status,
    CASE WHEN ft.decided_type = 'PaymentFailed' THEN coalesce(nullif(ft.decided_reason, ''), 'payment failed') END AS failure_reason,
    ft.decided_seq
  FROM known k LEFT JOIN ft USING (order_id)
),
effects AS (
  SELECT d.seq, d.topic, d.type, d.order_id, d.envelope_id,
    CASE WHEN NOT d.decodable THEN 'undecodable'
         WHEN d.order_id IS NULL OR d.order_id = '' THEN 'no_order_id'
         WHEN d.topic <> 'order.created' AND k.order_id IS NULL THEN 'unknown_order'
         WHEN d.topic <> 'order.created' AND d.seq = ft.decided_seq THEN 'applied'
         WHEN d.topic <> 'order.created' AND d.type = ft.decided_type THEN 'duplicate'
         WHEN d.topic <> 'order.created' THEN 'late_ignored'
         WHEN d.seq = p.charged_seq THEN 'applied' ELSE 'duplicate' END AS effect
  FROM dec d LEFT JOIN ft ON ft.order_id = d.order_id LEFT JOIN known k ON k.order_id = d.order_id
    LEFT JOIN payments p ON p.order_id = d.order_id
),
republished AS (
  SELECT oc.seq, oc.order_id,
    CASE WHEN p.status = 'succeeded' THEN 'payment.succeeded' ELSE 'payment.failed' END AS topic,
    CASE WHEN p.status = 'succeeded' THEN 'PaymentSucceeded' ELSE 'PaymentFailed' END AS type,
    oc.seq = p.charged_seq AS fresh_charge
  FROM oc JOIN payments p USING (order_id)
)"""

D = f"WITH {DECODED} "


ORACLES = {
    "decode_event": D + "SELECT seq, topic, type, decodable, decode_error, order_id FROM dec",
    "charge_once": D + "SELECT * FROM payments",
    "public_payments": D + "SELECT payment_id, order_id, amount_cents, currency, status, failure_reason FROM payments",
    "republish_outcome": D + "SELECT * FROM republished",
    "resolve_orders": D + "SELECT order_id, status, failure_reason, decided_seq FROM resolved",
    "delivery_effects": D + "SELECT seq, topic, order_id, effect FROM effects",
    "events_consumed": D + "SELECT topic, type, COUNT(*) AS consumed, 'success' AS outcome FROM effects "
                           "WHERE (topic IN ('payment.succeeded', 'payment.failed') AND effect IN ('applied', 'duplicate')) "
                           "OR (topic = 'order.created' AND effect = 'applied') GROUP BY topic, type",
    "saga_outcomes": D + "SELECT CASE WHEN type = 'PaymentSucceeded' THEN 'confirmed' ELSE 'compensated' END AS outcome, "
                         "COUNT(*) AS per_delivery, COUNT(DISTINCT order_id) AS per_order FROM effects "
                         "WHERE topic IN ('payment.succeeded', 'payment.failed') AND effect IN ('applied', 'duplicate') GROUP BY 1",
    "events_published": D + "SELECT topic, type, COUNT(DISTINCT envelope_id) AS published FROM saga_events "
                            "WHERE topic = 'order.created' GROUP BY topic, type "
                            "UNION ALL SELECT topic, type, COUNT(*) FROM republished GROUP BY topic, type",
    "dedupe_envelopes": D + "SELECT f.envelope_id, f.seq, f.deliveries, e.type, e.topic FROM (SELECT envelope_id, min(seq) AS seq, "
                            "COUNT(*) AS deliveries FROM saga_events GROUP BY envelope_id) f JOIN saga_events e USING (seq)",
    "saga_pairs": D + "SELECT c.order_id, c.created_seq, ft.decided_type AS outcome_type, ft.decided_seq AS outcome_seq, "
                      "ft.decided_type IS NULL AS pending FROM (SELECT order_id, min(seq) AS created_seq FROM oc GROUP BY order_id) c "
                      "LEFT JOIN ft USING (order_id)",
    "unknown_orders": D + "SELECT seq, order_id, type FROM dec WHERE topic IN ('payment.succeeded', 'payment.failed') AND decodable "
                          "AND order_id IS NOT NULL AND order_id NOT IN (SELECT order_id FROM known)",
    "status_counts": D + "SELECT 'orders' AS entity, status, COUNT(*) AS n FROM resolved GROUP BY status "
                         "UNION ALL SELECT 'payments', status, COUNT(*) FROM payments GROUP BY status",
    "consumer_lag": f"WITH {V.CONSUMER_OFFSETS} SELECT consumer_group, topic, partition, "
                    "CAST(SUM(greatest(end_offset - committed, 0)) AS BIGINT) AS lag FROM consumer_offsets "
                    "GROUP BY ROLLUP (consumer_group, topic, partition)",
    "drain_eta": f"WITH {V.CONSUMER_OFFSETS}, {V.ORDERS}, b AS (SELECT CAST(SUM(end_offset - committed) AS BIGINT) AS backlog "
                 "FROM consumer_offsets WHERE consumer_group = 'payment'), r AS (SELECT CAST(SUM(CASE WHEN status <> 'pending' "
                 "THEN 1 ELSE 0 END) AS BIGINT) AS settled, max(created_us) - min(created_us) AS span_us FROM orders_v) "
                 "SELECT backlog, settled, span_us, CAST(trunc(CAST(backlog AS DOUBLE) * (CAST(span_us AS DOUBLE) / 1000000) / CAST(settled AS DOUBLE)) AS BIGINT) AS eta_s FROM b, r",
    "stuck_pending": LEDGER + f", {DECODED}" + OPEN_HOLDS +
                     ", held AS (SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(SUM(lq) AS BIGINT) AS held_units FROM lastchg "
                     "WHERE lr = 'reserved' GROUP BY 1), nw AS (SELECT max(created_us) AS now_us FROM known) "
                     "SELECT r.order_id, CAST(trunc((nw.now_us - r.created_us) / 86400000000) AS BIGINT) AS age_days, "
                     "CAST(coalesce(h.held_units, 0) AS BIGINT) AS held_units FROM resolved r CROSS JOIN nw "
                     "LEFT JOIN held h USING (order_id) WHERE r.status = 'pending' AND nw.now_us - r.created_us > "
                     f"{STUCK_AFTER_US}",
    "sink_envelope": D + ", env AS (SELECT *, CASE WHEN status = 'succeeded' THEN 'PaymentSucceeded' ELSE 'PaymentFailed' END AS etype "
                         "FROM payments) SELECT CASE WHEN status = 'succeeded' THEN 'payment.succeeded' ELSE 'payment.failed' END AS topic, "
                         "order_id AS key, 'o-' || order_id AS correlation_id, "
                         "json_object('id', 'evt-' || payment_id, 'type', etype, 'correlation_id', 'o-' || order_id, "
                         "'payload', CASE WHEN status = 'succeeded' THEN json_object('order_id', order_id, 'payment_id', payment_id, "
                         "'amount_cents', amount_cents, 'currency', currency) ELSE json_object('order_id', order_id, 'reason', "
                         "failure_reason) END)::VARCHAR AS value FROM env",
}
