"""Catalog, order, charge and sign-up rules on literal requests (the
reference's own cases)."""

from pyspark.sql import functions as F

from admitflow.functions import scalars as S
from admitflow.operators import commerce as C
from admitflow.plans.admission import admit_orders

LINES = "order_id long, product_id long, quantity int, line_no int, supp_id long, unit_cents long"


def products(spark, rows):
    return spark.createDataFrame(rows, "product_id long, price_cents long, currency string, stock int, reserved int")


def test_pricing_three_times_2500(spark):
    lines = spark.createDataFrame([(1, 10, 3, 1, 0, 0)], LINES)
    p = products(spark, [(10, 2500, "USD", 10, 0)])
    r = C.price_orders(lines, p).collect()[0]
    assert (r.total_cents, r.currency, r.all_known, r.mixed_currency) == (7500, "USD", True, False)


def test_unknown_product_rejects_the_whole_order_and_last_currency_wins(spark):
    lines = spark.createDataFrame([(1, 10, 1, 1, 0, 0), (1, 99, 1, 2, 0, 0), (2, 10, 1, 1, 0, 0), (2, 11, 1, 2, 0, 0)],
                                  LINES)
    p = products(spark, [(10, 100, "USD", 5, 0), (11, 200, "EUR", 5, 0)])
    r = {x.order_id: x for x in C.price_orders(lines, p).collect()}
    assert r[1].all_known is False and r[1].total_cents is None
    assert (r[2].total_cents, r[2].currency, r[2].mixed_currency) == (300, "EUR", True)


def test_order_validation_reasons_in_line_order(spark):
    orders = spark.createDataFrame([(i,) for i in range(1, 6)], "order_id long")
    lines = spark.createDataFrame([
        (1, 10, 2, 1, 0, 0),                                 # fine
        (2, 10, 0, 1, 0, 0),                                 # zero quantity
        (3, 10, 1, 1, 0, 0), (3, 10, 1, 2, 0, 0),            # product repeated
        (4, 10, -1, 1, 0, 0), (4, 10, 1, 2, 0, 0),           # first failing line decides
    ], LINES)
    r = {x.order_id: x.reason for x in C.validate_orders(orders, lines).collect()}
    assert r == {1: None, 2: "each item needs a positive quantity",
                 3: "each product may appear only once per order",
                 4: "each item needs a positive quantity", 5: "an order must have at least one item"}


def test_second_line_out_of_stock_keeps_nothing(spark):
    lines = spark.createDataFrame([(1, 10, 2, 1, 0, 0), (1, 11, 6, 2, 0, 0), (2, 10, 5, 1, 0, 0)], LINES)
    p = products(spark, [(10, 1, "USD", 5, 0), (11, 1, "USD", 5, 0)])
    r = {x.order_id: x.admitted for x in admit_orders(lines, p).collect()}
    # order 1 fails on its second line, so its first line holds nothing and
    # order 2 gets all 5 units of product 10.
    assert r == {1: False, 2: True}


def test_product_create_rules(spark):
    req = spark.createDataFrame([
        (1, "W-1", "Widget", 2500, 10, "usd"), (2, " ", "Widget", 1, 1, ""), (3, "W-3", "", 1, 1, ""),
        (4, "W-4", "x", -1, 1, ""), (5, "W-5", "x", 1, -1, ""), (6, "W-6", "x", 1, 1, "DOLLARS"),
    ], "request_id long, sku string, name string, price_cents long, stock int, currency_raw string")
    r = {x.request_id: (x.reason, x.currency) for x in C.validate_products(req).collect()}
    assert r[1] == (None, "USD")
    assert [r[i][0] for i in range(2, 7)] == ["sku is required", "name is required", "price_cents must not be negative",
                                              "stock must not be negative", "currency must be a 3-letter code"]


def test_one_account_per_address_case_insensitive(spark):
    s = spark.createDataFrame([(1, "Alice@Example.com"), (2, "alice@example.com"), (3, "Bob <bob@b.test>"),
                               (4, "bob@b.test"), (5, "nope")], "signup_id long, raw_email string")
    s = s.withColumn("email_key", S.email_key("raw_email"))
    w = {x.signup_id: (x.first, x.email_key) for x in C.first_wins(s, "email_key", "signup_id").collect()}
    assert [w[i][0] for i in range(1, 6)] == [True, False, True, False, False]
    assert w[5][1] is None


def test_owner_scope_hides_other_users_orders(spark):
    o = spark.createDataFrame([(1, 7, "pending"), (2, 8, "confirmed")], "order_id long, user_id long, status string")
    r = {x.order_id: (x.outcome, x.status) for x in C.owner_scope(o, F.lit(7)).collect()}
    assert r == {1: ("found", "pending"), 2: ("not_found", None)}


def test_order_counts_are_taken_in_parts_of_bounded_size(spark, monkeypatch):
    lines = spark.createDataFrame([(o, p) for o in [*range(40), 3, None] for p in (1, 2, None) if (o or 0) % 3 or p], "order_id long, product_id long")
    orders = spark.createDataFrame([(o,) for o in [*range(30), 7, None]], "order_id long")
    want = {p: len({r.order_id for r in lines.collect() if r.product_id == p and r.order_id is not None and r.order_id < 30}) for p in (1, 2, None)}
    monkeypatch.setattr(C, "LINES_PER_TASK", 5)
    df = C.orders_holding_product(lines, orders)
    assert "hashpartitioning(order_id" in df._jdf.queryExecution().executedPlan().toString()
    assert f", {lines.count() // 5 + 1})" in df._jdf.queryExecution().executedPlan().toString()
    assert {r.product_id: r.n_orders for r in df.collect()} == want
