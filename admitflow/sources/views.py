"""Domain views over the driver tables (request log, catalog, orders,
saga deliveries, service logs, sign-ups, consumer offsets).

Every view is a narrow projection of one driver table (at most an explode
of a fixed-size array), so it adds no shuffle and keeps parquet pruning.
Each has a DuckDB twin in :mod:`admitflow.plans.sqlviews` that spells the
same expressions in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages as M
from .tables import iso_utc, micros, read_table

DAY_US = 86_400_000_000
MINUTE_US = 60_000_000
SECOND_US = 1_000_000

# Epoch (2024-01-01T00:00:00Z) used to stamp catalog rows.
CATALOG_EPOCH_US = 1_704_067_200_000_000


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gateway request log derived from ``events`` (one row per request)."""
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    uid = F.col("user_id")
    rid = F.col("event_id")
    path = (F.when(et == "signup", F.lit("/auth/signup"))
             .when(et == "purchase", F.lit("/orders/"))
             .when(et == "view", F.concat(F.lit("/catalog/products/"), k.cast("string")))
             .when((et == "click") & (k >= 95), F.lit("/metrics"))
             .when(et == "click", F.lit("/catalog/products"))
             .when(et == "error", F.concat(F.lit("/payment/charges/"), rid.cast("string"))))
    status = (F.when(et == "signup", 201)
               .when(et == "purchase", F.when(k < 90, 201).otherwise(409))
               .when(et == "view", F.when(k < 95, 200).otherwise(404))
               .when(et == "click", 200)
               .when(et == "error", F.when(k < 50, 500).when(k < 75, 502).otherwise(404)))
    corr = (F.when(k % 20 == 0, F.lit("bad id"))
             .when(k % 20 == 1, F.lit(""))
             .otherwise(F.concat(F.lit("c-"), rid.cast("string"))))
    return ev.select(
        rid.alias("request_id"),
        rid.alias("seq"),
        micros(ev, "ts").alias("t_us"),
        uid.alias("user_id"),
        et.alias("event_type"),
        k.alias("k"),
        F.when(uid % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("u"), uid.cast("string"))).alias("subject"),
        F.concat(F.lit("192.0.2."), (uid % 250).cast("string"), F.lit(":"),
                 (rid % 60000 + 1024).cast("string")).alias("remote_addr"),
        F.concat(F.lit("gateway-"), (k % 2 + 1).cast("string")).alias("instance"),
        F.when(et.isin("signup", "purchase"), F.lit("POST")).otherwise(F.lit("GET")).alias("method"),
        path.alias("path"),
        status.cast("int").alias("status"),
        F.round(F.col("value") * 10000).cast("bigint").alias("duration_us"),
        corr.alias("correlation_id"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows from ``part``; ``created_us`` has ties (id breaks them)."""
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.concat(F.col("p_brand"), F.lit("-"), F.col("p_partkey").cast("string")).alias("sku"),
        F.col("p_name").alias("name"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("price_cents"),
        F.lit("USD").alias("currency"),
        (F.col("p_size") * 20).cast("int").alias("stock"),
        F.lit(0).cast("int").alias("reserved"),
        (F.lit(CATALOG_EPOCH_US) + (F.col("p_partkey") * 7919 % 1000) * SECOND_US).alias("created_us"),
    )


# Driver order status codes and the order states they stand for.
ORDER_STATUS = {"F": "confirmed", "P": "cancelled", "O": "pending"}


def orders(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """Orders from ``orders``: F confirmed, P cancelled, O pending.

    ``status`` filters on the raw status code, so the predicate reaches the
    parquet reader (a filter on the derived label would not)."""
    o = read_table(spark, sf_dir, "orders")
    if status is not None:
        codes = [c for c, name in ORDER_STATUS.items() if name == status]
        o = o.where(F.col("o_orderstatus").isin(*codes))
    st = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        micros(o, "o_orderdate").alias("created_us"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total_cents"),
        F.lit("USD").alias("currency"),
        F.when(st == "F", "confirmed").when(st == "P", "cancelled").otherwise("pending").alias("status"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order items from ``lineitem``; ``ship_us`` and the trailing columns give
    a total order for ledger commands within a product."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_linenumber").alias("line_no"),
        F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("bigint").alias("unit_cents"),
        micros(li, "l_shipdate").alias("ship_us"),
        F.col("l_suppkey").alias("supp_id"),
        F.col("l_extendedprice").alias("extended_price"),
    )


def signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-up attempts from ``customer``: pairs share a mailbox, spelt in
    different cases and forms; a few are malformed."""
    c = read_table(spark, sf_dir, "customer")
    ck = F.col("c_custkey")
    addr = F.concat(F.lit("user"), F.floor(ck / 2).cast("string"), F.lit("@example.test"))
    display = F.regexp_replace(F.col("c_name"), "#", " ")
    raw = (F.when(ck % 29 == 0, F.concat(F.lit("not-an-email-"), ck.cast("string")))
            .when(ck % 4 == 0, F.upper(addr))
            .when(ck % 4 == 1, F.concat(F.lit("  "), addr, F.lit(" ")))
            .when(ck % 4 == 2, F.concat(display, F.lit(" <"), addr, F.lit(">")))
            .otherwise(addr))
    return c.select(ck.alias("signup_id"), ck.alias("user_id"), raw.alias("raw_email"))


def _pmod3(c):
    return ((c % 3) + 3) % 3


def saga_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event deliveries derived from ``orders`` (FIXTURES table of n = 0..6).

    ``seq = order_key * 10 + n`` is the delivery order; it also serves as
    the partition offset. Payloads are spelt by concatenation so both
    engines produce identical text.
    """
    o = read_table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    st = F.col("o_orderstatus")
    settled = st.isin("F", "P")
    n = F.col("n")
    keep = ((n == 0)
            | ((n == 1) & (ok % 7 == 0))
            | ((n == 2) & settled)
            | ((n == 3) & settled & (ok % 5 == 0))
            | ((n == 4) & settled & (ok % 11 == 0))
            | ((n == 5) & (ok % 101 == 0))
            | ((n == 6) & (ok % 97 == 0)))
    base = (o.select(ok, F.col("o_custkey"), st, F.col("o_totalprice"),
                     micros(o, "o_orderdate").alias("day_us"),
                     F.explode(F.sequence(F.lit(0), F.lit(6))).alias("n"))
             .where(keep))
    succeeded_first = st == "F"
    etype = (F.when(n <= 1, F.lit("OrderCreated"))
              .when(n.isin(2, 3), F.when(succeeded_first, "PaymentSucceeded").otherwise("PaymentFailed"))
              .when(n == 4, F.when(succeeded_first, "PaymentFailed").otherwise("PaymentSucceeded"))
              .when(n == 5, F.lit("PaymentSucceeded"))
              .otherwise(F.when(succeeded_first, "PaymentSucceeded").otherwise("PaymentFailed")))
    order_id = F.when(n == 6, -ok - 1).otherwise(ok)
    oid = order_id.cast("string")
    amount = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    reason = F.when(ok % 3 == 0, F.lit("")).otherwise(F.lit(M.CARD_DECLINED))
    payload = (F.when(n <= 1, F.concat(F.lit('{"order_id":"'), oid, F.lit('","user_id":"'),
                                       F.col("o_custkey").cast("string"), F.lit('","amount_cents":'),
                                       amount, F.lit(',"currency":"USD"}')))
                .when(n == 5, F.concat(F.lit('{"order_id":'), oid, F.lit("}")))
                .when(etype == "PaymentSucceeded",
                      F.concat(F.lit('{"order_id":"'), oid, F.lit('","payment_id":"p-'), oid,
                               F.lit('","amount_cents":'), amount, F.lit(',"currency":"USD"}')))
                .otherwise(F.concat(F.lit('{"order_id":"'), oid, F.lit('","reason":"'), reason, F.lit('"}'))))
    # Redeliveries (n = 1, 3) repeat the envelope id of the first delivery.
    env_n = F.when(n == 1, 0).when(n == 3, 2).otherwise(n)
    topic = (F.when(etype == "OrderCreated", F.lit("order.created"))
              .when(etype == "PaymentSucceeded", F.lit("payment.succeeded"))
              .otherwise(F.lit("payment.failed")))
    seq = ok * 10 + n
    return base.select(
        seq.alias("seq"),
        F.concat(F.lit("e-"), ok.cast("string"), F.lit("-"), env_n.cast("string")).alias("envelope_id"),
        etype.alias("type"),
        topic.alias("topic"),
        _pmod3(order_id).cast("int").alias("partition"),
        seq.alias("offset"),
        oid.alias("key"),
        F.concat(F.lit("o-"), ok.cast("string")).alias("correlation_id"),
        (F.col("day_us") + n * SECOND_US).alias("occurred_us"),
        payload.alias("payload"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service log lines derived from ``orders``: one request spelt by the
    gateway, orders and payment services; the payment line is missing when
    ``order_key % 13 = 0``; every 50th order adds a line with no id."""
    o = read_table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    st = F.col("o_orderstatus")
    i = F.col("line_no")
    keep = ((i <= 2)
            | ((i == 3) & (ok % 13 != 0))
            | ((i == 4) & st.isin("F", "P"))
            | ((i == 5) & (ok % 50 == 0)))
    start = micros(o, "o_orderdate") + (ok % 86400) * SECOND_US
    base = (o.select(ok, st, start.alias("start_us"),
                     F.explode(F.sequence(F.lit(0), F.lit(5))).alias("line_no"))
             .where(keep))
    service = (F.when(i == 0, "gateway").when(i.isin(1, 2, 4), "orders")
                .when(i == 3, "payment").otherwise("catalog"))
    msg = (F.when(i == 0, "request completed").when(i == 1, "order created")
            .when(i == 2, "event published").when(i == 3, "charge recorded")
            .when(i == 4, F.when(st == "F", "order confirmed").otherwise("order cancelled"))
            .otherwise("reservation retried"))
    offset_ms = (F.when(i == 0, 0).when(i == 1, 5).when(i == 2, 7)
                  .when(i == 3, ok % 100 + 40).when(i == 4, ok % 250 + 90).otherwise(3))
    level = (F.when(i == 5, "warn")
              .when(ok % 7 == 0, "Error").when(ok % 7 == 1, "DEBUG")
              .when((i == 4) & (st == "P"), "WARN").otherwise("INFO"))
    corr = F.when(i == 5, F.lit(None).cast("string")).otherwise(F.concat(F.lit("o-"), ok.cast("string")))
    return base.select(
        (F.col("start_us") + offset_ms * 1000).alias("ts_us"),
        service.alias("service"),
        level.alias("level"),
        msg.alias("msg"),
        corr.alias("correlation_id"),
        ok.cast("string").alias("order_id"),
        i.cast("bigint").alias("line_no"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log rows as raw JSON text (what a log shipper stores)."""
    lg = logs(spark, sf_dir)
    iso = iso_utc(F.col("ts_us"))
    corr = F.when(F.col("correlation_id").isNull(), F.lit("")).otherwise(
        F.concat(F.lit(',"correlation_id":"'), F.col("correlation_id"), F.lit('"')))
    extra = F.when(F.col("service") == "payment", F.concat(F.lit(',"attempt":'), (F.col("line_no") - 2).cast("string"))).otherwise(F.lit(""))
    line = F.concat(F.lit('{"time":"'), iso, F.lit('","level":"'), F.col("level"), F.lit('","msg":"'),
                    F.col("msg"), F.lit('","service":"'), F.col("service"), F.lit('"'), corr,
                    F.lit(',"order_id":"'), F.col("order_id"), F.lit('"'), extra, F.lit("}"))
    return lg.select(F.col("ts_us"), F.col("line_no"), line.alias("line"))


def consumer_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per consumer group, topic and partition: end offset (messages
    written) and committed offset (messages whose order has settled).

    ``payment`` consumes ``order.created``; ``orders`` consumes both
    payment topics. Offsets count messages, so lag = end - committed.
    """
    ev = saga_events(spark, sf_dir)
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus"))
    # Orders is one row per key and the side carrying the status; a shuffle
    # join on the key keeps both sides partitioned at any size.
    j = ev.join(o, "key", "left")
    group = F.when(F.col("topic") == "order.created", "payment").otherwise("orders")
    processed = F.col("o_orderstatus").isin("F", "P") | F.col("o_orderstatus").isNull()
    return (j.groupBy(group.alias("consumer_group"), "topic", "partition")
             .agg(F.count(F.lit(1)).alias("end_offset"),
                  F.sum(F.when(processed, 1).otherwise(0)).cast("bigint").alias("committed")))


def ledger_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog commands derived from order lines, per product:

    n=0 reserve at ship time; n=1 commit (order F) or release (order P)
    30 days later; n=2 the reserve redelivered a day after that (orders
    with key % 7 = 0, settled); n=3 restock of the line's quantity 10 days
    after shipping (orders with key % 10 = 3). Position within a product:
    (t_us, n, order_id, line_no, supp_id, quantity, extended_price), which
    has no ties on the driver data.
    """
    li = order_lines(spark, sf_dir)
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"),
                                                   F.col("o_orderstatus").alias("_st"))
    j = li.join(o, "order_id", "left")
    n = F.col("n")
    settled = F.col("_st").isin("F", "P")
    keep = ((n == 0) | ((n == 1) & settled) | ((n == 2) & settled & (F.col("order_id") % 7 == 0))
            | ((n == 3) & (F.col("order_id") % 10 == 3)))
    base = j.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(3)))).where(keep)
    op = (F.when(n.isin(0, 2), "reserve").when((n == 1) & (F.col("_st") == "F"), "commit")
           .when(n == 1, "release").otherwise("add_stock"))
    t = (F.col("ship_us") + F.when(n == 1, 30 * DAY_US).when(n == 2, 31 * DAY_US)
         .when(n == 3, 10 * DAY_US).otherwise(0))
    return base.select("product_id", t.alias("t_us"), n.cast("int").alias("n"), "order_id", "line_no",
                       "supp_id", F.col("quantity").cast("long").alias("quantity"), "extended_price",
                       op.alias("op"))


LEDGER_ORDER = ["n", "order_id", "line_no", "supp_id", "quantity", "extended_price"]
