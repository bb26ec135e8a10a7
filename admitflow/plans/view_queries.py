"""Registered queries: public views (P16), order pages with items (W2),
reservation rules (P15), the remaining constraints (C1, C2) and the numbered
steps of traces (TR2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import scalars as S
from ..operators import commerce as C
from ..operators import trace as TR
from ..sources import views as VW
from . import sqlviews as V
from .saga_queries import DECODED, _payments


def q_public_products(spark, sf):
    """The product view, with what is available."""
    p = VW.products(spark, sf)
    return p.select("product_id", "sku", "name", "price_cents", "currency", "stock", "reserved",
                    S.available("stock", "reserved").alias("available"), "created_us")


def q_public_users(spark, sf):
    """The account view: id and normalised email, nothing secret."""
    s = VW.signups(spark, sf).withColumn("email_key", S.email_key("raw_email"))
    won = C.first_wins(s, "email_key", "signup_id").where("first")
    return won.select("user_id", S.normalize_email("raw_email").alias("email"))


def q_public_orders(spark, sf):
    """The order view with its items."""
    o = VW.orders(spark, sf)
    items = C.orders_with_items(o, VW.order_lines(spark, sf)).select("order_id", "n_items", "items")
    return o.select("order_id", "user_id", "status", "total_cents", "currency", "created_us").join(items, "order_id")


def q_user_order_pages(spark, sf):
    """Every user's newest orders with their items; lines are grouped
    for the orders of the pages only."""
    page = C.orders_for_user(VW.orders(spark, sf))
    lines = VW.order_lines(spark, sf).join(page.select("order_id"), "order_id", "left_semi")
    items = C.orders_with_items(page, lines).select("order_id", "n_items", "items")
    return page.select("user_id", "order_id", "rn", "status").join(items, "order_id")


def q_validate_reservations(spark, sf):
    """Reservation requests: both ids present, quantity positive."""
    li = VW.order_lines(spark, sf)
    o = F.when(F.col("order_id") % 79 == 0, F.lit("")).otherwise(F.col("order_id").cast("string"))
    p = F.when(F.col("product_id") % 71 == 0, F.lit(None)).otherwise(F.col("product_id").cast("string"))
    q = F.when(F.col("order_id") % 89 == 0, F.lit(0)).otherwise(F.col("quantity"))
    r = li.select("order_id", "line_no", "product_id", o.alias("_o"), p.alias("_p"), q.cast("long").alias("requested"))
    return r.select("order_id", "line_no", "product_id", "requested",
                    C.reservation_reason(F.col("_o"), F.col("_p"), F.col("requested")).alias("reason"))


def _reservations(spark, sf):
    return VW.order_lines(spark, sf).groupBy("order_id", "product_id").agg(F.sum("quantity").alias("quantity"))


def q_audit_money_checks(spark, sf):
    """The CHECKs of reservations and payments."""
    r, p = _reservations(spark, sf), _payments(spark, sf)
    return C.audit_checks([
        ("reservations", "quantity > 0", r, F.col("quantity") > 0, "order_id"),
        ("payments", "amount_cents >= 0", p, F.col("amount_cents") >= 0, "order_id"),
        ("payments", "status in (succeeded, failed)", p, F.col("status").isin("succeeded", "failed"), "order_id")])


def q_audit_money_unique(spark, sf):
    """One payment an order; one reservation an order and product. The
    reservations are what the order lines ask for, before they are merged."""
    return C.audit_unique([("payments.order_id", _payments(spark, sf), ["order_id"]),
                           ("reservations.pk", VW.order_lines(spark, sf), ["order_id", "product_id"])])


def q_trace_steps(spark, sf):
    """TR2: the steps of every trace, numbered in order."""
    return TR.trace_steps(VW.logs(spark, sf))


QUERIES = {
    "public_products": q_public_products,
    "public_users": q_public_users,
    "public_orders": q_public_orders,
    "user_order_pages": q_user_order_pages,
    "validate_reservations": q_validate_reservations,
    "audit_money_checks": q_audit_money_checks,
    "audit_money_unique": q_audit_money_unique,
    "trace_steps": q_trace_steps,
}

# ---------------------------------------------------------------- oracles

_EK = V.normalize_email("raw_email")
_ITEMS = ("it AS (SELECT order_id, COUNT(*) AS n, string_agg(CAST(product_id AS VARCHAR) || ':' || CAST(quantity AS VARCHAR) || ':' || "
          "CAST(unit_cents AS VARCHAR), ';' ORDER BY product_id, line_no, quantity, unit_cents) AS items FROM order_lines GROUP BY order_id)")
_ITEM_COLUMNS = "CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, coalesce(it.items, '') AS items"


def _check(table: str, rule: str, source: str, ok: str) -> str:
    return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST(coalesce(SUM(CASE WHEN coalesce({ok}, false) THEN 0 ELSE 1 END), 0) AS BIGINT) "
            f"AS violations, min(CASE WHEN NOT coalesce({ok}, false) THEN CAST(order_id AS VARCHAR) END) AS sample FROM {source}")


def _unique(name: str, source: str, cols: str) -> str:
    return (f"SELECT '{name}' AS constraint_name, COUNT(*) AS duplicate_keys, CAST(coalesce(SUM(c - 1), 0) AS BIGINT) AS surplus_rows "
            f"FROM (SELECT {cols}, COUNT(*) AS c FROM {source} GROUP BY {cols} HAVING COUNT(*) > 1) d")


ORACLES = {
    "public_products": f"WITH {V.PRODUCTS} SELECT product_id, sku, name, price_cents, currency, stock, reserved, "
                       "stock - reserved AS available, created_us FROM products",
    "public_users": f"WITH {V.SIGNUPS}, k AS (SELECT user_id, signup_id, {_EK} AS email FROM signups), "
                    "f AS (SELECT *, row_number() OVER (PARTITION BY lower(email) ORDER BY signup_id) AS rn FROM k WHERE email IS NOT NULL) "
                    "SELECT user_id, email FROM f WHERE rn = 1",
    "public_orders": f"WITH {V.ORDERS}, {V.ORDER_LINES}, {_ITEMS} SELECT o.order_id, o.user_id, o.status, o.total_cents, 'USD' AS currency, "
                     f"o.created_us, {_ITEM_COLUMNS} FROM orders_v o LEFT JOIN it USING (order_id)",
    "user_order_pages": f"WITH {V.ORDERS}, {V.ORDER_LINES}, {_ITEMS}, r AS (SELECT *, row_number() OVER "
                        "(PARTITION BY user_id ORDER BY created_us DESC, order_id) AS rn FROM orders_v) "
                        f"SELECT r.user_id, r.order_id, r.rn, r.status, {_ITEM_COLUMNS} FROM r LEFT JOIN it USING (order_id) WHERE r.rn <= 20",
    "validate_reservations": f"WITH {V.ORDER_LINES} SELECT order_id, line_no, product_id, "
                             "CAST(CASE WHEN order_id % 89 = 0 THEN 0 ELSE quantity END AS BIGINT) AS requested, "
                             "CASE WHEN order_id % 79 = 0 OR product_id % 71 = 0 THEN 'order_id and product_id are required' "
                             "WHEN order_id % 89 = 0 OR quantity <= 0 THEN 'quantity must be positive' END AS reason FROM order_lines",
    "audit_money_checks": f"WITH {DECODED}, {V.ORDER_LINES}, res AS (SELECT order_id, product_id, SUM(quantity) AS quantity FROM order_lines GROUP BY 1, 2) "
                          + " UNION ALL ".join([_check("reservations", "quantity > 0", "res", "quantity > 0"),
                                                _check("payments", "amount_cents >= 0", "payments", "amount_cents >= 0"),
                                                _check("payments", "status in (succeeded, failed)", "payments", "status IN ('succeeded', 'failed')")]),
    "audit_money_unique": f"WITH {DECODED}, {V.ORDER_LINES} " + _unique("payments.order_id", "payments", "order_id") + " UNION ALL "
                          + _unique("reservations.pk", "order_lines", "order_id, product_id"),
    "trace_steps": f"WITH {V.LOGS} SELECT correlation_id, row_number() OVER (PARTITION BY correlation_id ORDER BY ts_us, service, line_no) AS step, "
                   "ts_us, service, msg FROM logs WHERE correlation_id IS NOT NULL",
}
