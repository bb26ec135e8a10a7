"""E-family: payments, order resolution and delivery audit over an
at-least-once event log.

Order comes from ``seq`` (the delivery order: partition + offset), never
from event time. Every "first X per order" is a ``min_by`` / ``min``
aggregate per order id (map-side partial aggregation, no window buffer
per order) joined back on the order id; the joins are shuffle joins on
the key whose sides Catalyst and AQE size at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.jsonx import decode_event, event_field, payload_struct
from ..functions.scalars import charge_outcome, normalize_currency

PAYMENT_TOPICS = ("payment.succeeded", "payment.failed")
# The type each topic must carry.
TOPIC_TYPES = {"order.created": "OrderCreated", "payment.succeeded": "PaymentSucceeded",
               "payment.failed": "PaymentFailed"}


def expected_type(topic: Column) -> Column:
    e = None
    for t, ty in TOPIC_TYPES.items():
        e = F.when(topic == t, F.lit(ty)) if e is None else e.when(topic == t, F.lit(ty))
    return e


def decode_deliveries(events: DataFrame) -> DataFrame:
    """P12 over a delivery log: ``decodable, decode_error, order_id`` plus
    the typed payload fields used downstream (NULL when undecodable)."""
    parsed = events.withColumn("_v", payload_struct(F.col("payload")))
    _, why = decode_event(F.col("type"), F.col("_v"), expected_type(F.col("topic")))
    # decode_error is the one large expression; everything else refers to
    # it once, so collapsing projections never duplicates it.
    d = parsed.withColumn("decode_error", why).withColumn("decodable", F.col("decode_error").isNull())
    fields = [("order_id", "string"), ("user_id", "string"), ("amount_cents", "bigint"),
              ("currency_raw", "string"), ("reason", "string")]
    # Fields are read unconditionally (NULL when absent or uncastable);
    # consumers filter on ``decodable`` before trusting them.
    cols = [F.col("_f").getField(n).alias(n) for n, _ in fields]
    f = F.struct(*[event_field(F.col("_v"), "currency" if n == "currency_raw" else n, t).alias(n) for n, t in fields])
    return d.withColumn("_f", f).select(*[c for c in d.columns if c != "_v"], *cols)


def _has_id(c: str = "order_id") -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def charge_once(decoded: DataFrame, declined: Column) -> DataFrame:
    """E1 + P20: exactly one payment row per order: the first decodable
    OrderCreated with an order id; its outcome is final (a decline is not
    retried). ``declined`` is the charge rule as a Column predicate over
    ``amount_cents``. One ``min_by`` aggregate per order: partial
    aggregation keeps a redelivery storm on one order cheap."""
    # Filter on the topic only (it reaches the scan); decodability is a
    # condition inside the aggregate so each payload is parsed once.
    oc = decoded.where(F.col("topic") == "order.created")
    ok = F.col("decodable") & _has_id()
    first = (oc.groupBy("order_id")
               .agg(F.min_by(F.struct("seq", "user_id", "amount_cents", "currency_raw"),
                             F.when(ok, F.col("seq"))).alias("_w"))
               .where(F.col("_w").isNotNull()))
    w = first.select("order_id", F.col("_w.seq").alias("charged_seq"), F.col("_w.user_id").alias("user_id"),
                     F.coalesce(F.col("_w.amount_cents"), F.lit(0)).cast("bigint").alias("amount_cents"),
                     F.col("_w.currency_raw").alias("currency_raw"))
    status, reason = charge_outcome(declined)
    return w.select(
        "order_id",
        F.concat(F.lit("pay-"), F.col("order_id")).alias("payment_id"),
        "user_id", "amount_cents",
        normalize_currency("currency_raw").alias("currency"),
        status.alias("status"),
        reason.alias("failure_reason"),
        "charged_seq")


def republish_outcome(decoded: DataFrame, payments: DataFrame) -> DataFrame:
    """E2 + J4: every OrderCreated delivery (duplicates too) publishes the
    *stored* outcome of its order to the topic of that status."""
    oc = decoded.where((F.col("topic") == "order.created") & F.col("decodable") & _has_id())
    p = payments.select("order_id", "status", "charged_seq")
    j = oc.select("seq", "order_id").join(p, "order_id")
    return j.select("seq", "order_id",
                    F.when(F.col("status") == "succeeded", "payment.succeeded").otherwise("payment.failed").alias("topic"),
                    F.when(F.col("status") == "succeeded", "PaymentSucceeded").otherwise("PaymentFailed").alias("type"),
                    (F.col("seq") == F.col("charged_seq")).alias("fresh_charge"))


def first_terminal(decoded: DataFrame) -> DataFrame:
    """The first decodable payment event per order id (known or not; the
    callers join to the orders they know)."""
    pay = decoded.where(F.col("topic").isin(*PAYMENT_TOPICS))
    ok = F.col("decodable") & _has_id()
    return pay.groupBy("order_id").agg(
        F.min_by(F.struct("seq", "type", "reason"), F.when(ok, F.col("seq"))).alias("_f")).where(
        F.col("_f").isNotNull()).select(
        "order_id", F.col("_f.seq").alias("decided_seq"), F.col("_f.type").alias("decided_type"),
        F.col("_f.reason").alias("decided_reason"))


def resolve_orders(decoded: DataFrame, orders: DataFrame) -> DataFrame:
    """E3 + E5: pending until the first terminal event, which wins; a
    cancellation's reason is the payload's, or ``payment failed``."""
    ft = first_terminal(decoded)
    o = orders.select(F.col("order_id").cast("string").alias("order_id"), "user_id", "created_us")
    j = o.join(ft, "order_id", "left")
    status = (F.when(F.col("decided_type") == "PaymentSucceeded", "confirmed")
               .when(F.col("decided_type") == "PaymentFailed", "cancelled").otherwise("pending"))
    reason = F.when(status == "cancelled",
                    F.coalesce(F.nullif(F.col("decided_reason"), F.lit("")), F.lit(M.PAYMENT_FAILED)))
    return j.select("order_id", "user_id", "created_us", status.alias("status"),
                    reason.alias("failure_reason"), "decided_seq")


def delivery_effects(decoded: DataFrame, orders: DataFrame) -> DataFrame:
    """What each delivery did: applied, duplicate, late_ignored,
    unknown_order, undecodable or no_order_id. One summary aggregate per
    order (first payment event, first OrderCreated) is joined back to the
    deliveries together with the set of known orders."""
    is_pay = F.col("topic").isin(*PAYMENT_TOPICS)
    ok = F.col("decodable") & _has_id()
    # The summary is joined back without an explicit repartition: AQE
    # broadcasts it when small, and otherwise the shuffle join's skew
    # handling splits a hot partition on the deliveries' side, including the
    # one where deliveries without an order id (NULL key) meet. The price is
    # reading the payloads in both branches.
    summary = (decoded.groupBy("order_id")
                      .agg(F.min_by(F.struct("seq", "type"), F.when(ok & is_pay, F.col("seq"))).alias("_p"),
                           F.min(F.when(ok & ~is_pay, F.col("seq"))).alias("charged_seq"))
                      .select("order_id", F.col("_p.seq").alias("decided_seq"), F.col("_p.type").alias("decided_type"),
                              "charged_seq"))
    known = orders.select(F.col("order_id").cast("string").alias("order_id"), F.lit(True).alias("_known"))
    d = decoded.join(summary, "order_id", "left").join(known, "order_id", "left")
    effect = (F.when(~F.col("decodable"), "undecodable")
               .when(~_has_id(), "no_order_id")
               .when(is_pay & F.col("_known").isNull(), "unknown_order")
               .when(is_pay & (F.col("seq") == F.col("decided_seq")), "applied")
               .when(is_pay & (F.col("type") == F.col("decided_type")), "duplicate")
               .when(is_pay, "late_ignored")
               .when(F.col("seq") == F.col("charged_seq"), "applied")
               .otherwise("duplicate"))
    return d.select("seq", "topic", "type", F.when(F.col("decodable"), F.col("order_id")).alias("order_id"),
                    "envelope_id", effect.alias("effect"))


def events_consumed(effects: DataFrame) -> DataFrame:
    """M8: successful consumptions by topic and type. Duplicates of a
    payment event count again (the status update is a same-state no-op
    that succeeds); republished charges, skipped and undecodable
    deliveries are not counted."""
    counted = ((F.col("topic").isin(*PAYMENT_TOPICS) & F.col("effect").isin("applied", "duplicate"))
               | ((F.col("topic") == "order.created") & (F.col("effect") == "applied")))
    return (effects.where(counted).groupBy("topic", "type").agg(F.count(F.lit(1)).alias("consumed"))
                   .withColumn("outcome", F.lit("success")))


def saga_outcomes(effects: DataFrame) -> DataFrame:
    """M9: confirmed / compensated, counted per delivery (as the counter
    does) and per distinct order."""
    e = effects.where(F.col("topic").isin(*PAYMENT_TOPICS) & F.col("effect").isin("applied", "duplicate"))
    outcome = F.when(F.col("type") == "PaymentSucceeded", "confirmed").otherwise("compensated")
    return e.groupBy(outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("per_delivery"), F.countDistinct("order_id").alias("per_order"))


def events_published(events: DataFrame, republished: DataFrame) -> DataFrame:
    """M7: OrderCreated publications (one per envelope) plus every outcome
    the payment service publishes (fresh or republished)."""
    created = (events.where(F.col("topic") == "order.created")
                     .select("topic", "type", "envelope_id").distinct()
                     .groupBy("topic", "type").agg(F.count(F.lit(1)).alias("published")))
    outcomes = republished.groupBy("topic", "type").agg(F.count(F.lit(1)).alias("published"))
    return created.unionByName(outcomes)


def dedupe_envelopes(events: DataFrame) -> DataFrame:
    """The first delivery of each envelope id."""
    first = events.groupBy("envelope_id").agg(F.min_by(F.struct("seq", "type", "topic"), F.col("seq")).alias("_f"),
                                              F.count(F.lit(1)).alias("deliveries"))
    return first.select("_f.seq", "envelope_id", "deliveries", "_f.type", "_f.topic")


def saga_pairs(decoded: DataFrame, orders: DataFrame) -> DataFrame:
    """Each order's OrderCreated with its payment outcome; no outcome
    means still pending."""
    oc = (decoded.where((F.col("topic") == "order.created") & F.col("decodable") & _has_id())
                 .groupBy("order_id").agg(F.min("seq").alias("created_seq")))
    known = orders.select(F.col("order_id").cast("string").alias("order_id"))
    ft = first_terminal(decoded).join(known, "order_id", "left_semi")
    j = oc.join(ft, "order_id", "left")
    return j.select("order_id", "created_seq", F.col("decided_type").alias("outcome_type"),
                    F.col("decided_seq").alias("outcome_seq"), F.col("decided_type").isNull().alias("pending"))


def stuck_pending(resolved: DataFrame, holds: DataFrame, now_us: Column, max_age_us: int) -> DataFrame:
    """Orders still pending after ``max_age_us`` and the units they hold."""
    held = holds.groupBy("order_id").agg(F.sum("quantity").cast("bigint").alias("held_units"))
    p = resolved.where((F.col("status") == "pending"))
    p = p.withColumn("_now", now_us).where(F.col("_now") - F.col("created_us") > max_age_us)
    return p.join(held, "order_id", "left").select(
        "order_id", ((F.col("_now") - F.col("created_us")) / 86_400_000_000).cast("bigint").alias("age_days"),
        F.coalesce("held_units", F.lit(0)).cast("bigint").alias("held_units"))


def settle(settled: DataFrame, lines: DataFrame, op: str, fails_for: Column, commands: DataFrame, products: DataFrame,
           order_cols: list[str]) -> DataFrame:
    """Settle ``settled`` orders on the stock ledger: ``op`` (``release`` or
    ``commit``) for every product of an order's ``lines`` (order_id,
    product_id) is fed, after all ``commands``, into the fold that made the
    holds, so a hold that was refused, or is settled already, settles nothing.

    An attempt goes through an order's products in product order and stops at
    the first that fails; ``fails_for`` (over product_id, NULL: 0) is the
    number of attempts a product's service refuses. The event is delivered
    again until an attempt gets through; both operations are idempotent by
    the hold. Per order: items, units and holds settled, holds settled by the
    first attempt, items without a hold to settle, and attempts."""
    from .fold import hot_keys_and_last
    from .ledger import run_ledger
    done = {"release": "released", "commit": "committed"}[op]
    items = settled.select("order_id").join(lines.select("order_id", "product_id").distinct(), "order_id")
    items = items.withColumn("_fails", F.coalesce(fails_for, F.lit(0)).cast("long"))
    # One order's items: all of them are in its last attempt.
    order, attempt = Window.partitionBy("order_id"), Window.partitionBy("order_id", "attempt")
    tries = items.withColumn("attempts", F.max("_fails").over(order) + 1).withColumn("items", F.count(F.lit(1)).over(order))
    tries = tries.withColumn("attempt", F.explode(F.expr("sequence(1L, attempts)")))
    tries = tries.withColumn("_stop", F.min(F.when(F.col("_fails") >= F.col("attempt"), F.col("product_id"))).over(attempt))
    tries = tries.where(F.col("_stop").isNull() | (F.col("product_id") < F.col("_stop")))
    # Hot products are told by commands and lines: the settled orders and their
    # tries, which cost far more, are then made by the fold alone.
    near = commands.select("product_id", "t_us").unionByName(lines.select("product_id", F.lit(None).cast("long").alias("t_us")))
    *hot, last = hot_keys_and_last(near, "product_id", "t_us")
    after = F.lit(last or 0).cast("long")
    per = ["attempt", "attempts", "items"]
    fed = tries.select("product_id", (after + F.col("attempt")).alias("t_us"), "order_id", F.lit(op).alias("op"), *per)
    both = commands.withColumns({c: F.lit(None).cast("long") for c in per}).unionByName(fed, allowMissingColumns=True)
    results = run_ledger(both, products, order_cols, returned=["order_id", *per, "result", "hold_qty"], only="attempt", hot=hot)
    hit = F.col("result") == done
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    got = results.groupBy("order_id").agg(
        F.max("attempts").alias("attempts"), F.max("items").alias("items"),
        count(hit).alias("holds"), F.sum(F.when(hit, F.col("hold_qty")).otherwise(0)).alias("units"),
        count(hit & (F.col("attempt") == 1)).alias("first"))
    j = settled.select("order_id").join(got, "order_id", "left")
    n = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("items", "units", "holds", "first")}
    return j.select("order_id", *[v.alias(c) for c, v in n.items()], (n["items"] - n["holds"]).alias("without_hold"),
                    F.coalesce("attempts", F.lit(1)).cast("bigint").alias("attempts"))


def compensate(settlement: DataFrame) -> DataFrame:
    """A cancelled order releases every hold, then is cancelled. While a
    release fails it stays pending, and the event is delivered again."""
    status = F.when(F.col("attempts") == 1, "cancelled").otherwise("pending")
    return settlement.select("order_id", "items", F.col("units").alias("released_units"), F.col("holds").alias("released_holds"),
                             F.col("first").alias("released_first_attempt"), "without_hold", "attempts",
                             status.alias("status_after_first"), F.lit("cancelled").alias("status"))


def settlement_retries(settlement: DataFrame) -> DataFrame:
    """The retry table of E6 / E7: an order's failed attempts."""
    return settlement.where("attempts > 1").select("order_id", F.explode(F.expr("sequence(1L, attempts - 1)")).alias("failed_attempt"))


def confirm(settlement: DataFrame) -> DataFrame:
    """A confirmed order commits every hold, then is confirmed."""
    return settlement.select("order_id", "items", F.col("units").alias("committed_units"), F.col("holds").alias("committed_holds"),
                             "without_hold", "attempts", F.lit("confirmed").alias("status"))


def consumed_outcomes(effects: DataFrame, releases: DataFrame) -> DataFrame:
    """M8 with both outcomes: ``success`` as :func:`events_consumed`, and
    ``retry``, one for each delivery of a PaymentFailed whose release failed.
    A partition is read in order and its head is delivered again until it gets
    through, so a retry is counted before anything behind it."""
    retries = settlement_retries(releases).agg(F.count(F.lit(1)).alias("consumed")).where("consumed > 0")
    retries = retries.select(F.lit("payment.failed").alias("topic"), F.lit("PaymentFailed").alias("type"), "consumed", F.lit("retry").alias("outcome"))
    return events_consumed(effects).unionByName(retries)
