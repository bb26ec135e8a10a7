"""Registered catalog / orders / users queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import scalars as S
from ..operators import commerce as C
from ..sources import views as VW
from ..sources.tables import read_table
from . import sqlviews as V


def product_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Product-create requests derived from ``part`` (some break a rule)."""
    p = read_table(spark, sf, "part")
    pk = F.col("p_partkey")
    price = F.round(F.col("p_retailprice") * 100).cast("bigint")
    return p.select(
        pk.alias("request_id"),
        F.when(pk % 41 == 0, F.lit(" ")).otherwise(F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string"))).alias("sku"),
        F.when(pk % 43 == 0, F.lit("")).otherwise(F.col("p_name")).alias("name"),
        F.when(pk % 47 == 0, -price).otherwise(price).alias("price_cents"),
        F.when(pk % 53 == 0, F.lit(-1)).otherwise(F.col("p_size") * 20).cast("int").alias("stock"),
        F.when(pk % 59 == 0, F.lit("DOLLARS")).when(pk % 2 == 0, F.lit(" usd"))
         .when(pk % 7 == 0, F.lit("")).otherwise(F.lit("USD")).alias("currency_raw"))


PRODUCT_REQUESTS_SQL = """
preq AS (
  SELECT p_partkey AS request_id,
    CASE WHEN p_partkey % 41 = 0 THEN ' ' ELSE p_brand || '-' || CAST(p_size AS VARCHAR) END AS sku,
    CASE WHEN p_partkey % 43 = 0 THEN '' ELSE p_name END AS name,
    CASE WHEN p_partkey % 47 = 0 THEN -CAST(ROUND(p_retailprice * 100) AS BIGINT) ELSE CAST(ROUND(p_retailprice * 100) AS BIGINT) END AS price_cents,
    CAST(CASE WHEN p_partkey % 53 = 0 THEN -1 ELSE p_size * 20 END AS INTEGER) AS stock,
    CASE WHEN p_partkey % 59 = 0 THEN 'DOLLARS' WHEN p_partkey % 2 = 0 THEN ' usd' WHEN p_partkey % 7 = 0 THEN ''
         ELSE 'USD' END AS currency_raw
  FROM part
)"""

PRODUCT_REASON_SQL = (
    "CASE WHEN sku IS NULL OR trim(sku) = '' THEN 'sku is required' "
    "WHEN name IS NULL OR trim(name) = '' THEN 'name is required' "
    "WHEN price_cents < 0 THEN 'price_cents must not be negative' "
    "WHEN stock < 0 THEN 'stock must not be negative' "
    f"WHEN length({V.normalize_currency('currency_raw')}) <> 3 THEN 'currency must be a 3-letter code' END")


def q_validate_products(spark, sf):
    """P13."""
    v = C.validate_products(product_requests(spark, sf))
    return v.select("request_id", "currency", "reason")


def q_dedupe_skus(spark, sf):
    """E10 over the valid create requests."""
    v = C.validate_products(product_requests(spark, sf)).where(F.col("reason").isNull())
    return C.dedupe_skus(v.withColumn("sku", F.trim("sku"))).select("request_id", "sku", "outcome")


def q_normalize_currency(spark, sf):
    """P8 over raw currency strings derived from ``customer``."""
    c = read_table(spark, sf, "customer")
    ck = F.col("c_custkey")
    raw = (F.when(ck % 5 == 0, F.lit(" usd ")).when(ck % 5 == 1, F.lit("eur")).when(ck % 5 == 2, F.lit(""))
            .when(ck % 5 == 3, F.lit("DOLLARS")).otherwise(F.lit("Gbp ")))
    return c.select(ck.alias("customer_id"), raw.alias("raw"), S.normalize_currency(raw).alias("currency"),
                    S.currency_ok_for_catalog(raw).alias("catalog_ok"))


def q_normalize_email(spark, sf):
    """P9 over sign-up addresses."""
    s = VW.signups(spark, sf)
    return s.select("signup_id", S.normalize_email("raw_email").alias("email"),
                    S.email_key("raw_email").alias("email_key"), S.email_reason("raw_email").alias("reason"))


def q_dedupe_users(spark, sf):
    """One account per lower(email), first sign-up wins."""
    s = VW.signups(spark, sf).withColumn("email_key", S.email_key("raw_email"))
    w = C.first_wins(s, "email_key", "signup_id")
    out = (F.when(F.col("email_key").isNull(), "invalid").when(F.col("first"), "created").otherwise("email_taken"))
    return w.select("signup_id", "email_key", out.alias("outcome"))


def charge_requests(spark, sf):
    o = VW.orders(spark, sf)
    oid = F.col("order_id")
    return o.select(oid.alias("request_id"),
                    F.when(oid % 79 == 0, F.lit("")).otherwise(oid.cast("string")).alias("order_id"),
                    F.when(oid % 89 == 0, F.lit(0)).when(oid % 83 == 0, F.lit(-100))
                     .otherwise(F.col("total_cents")).cast("bigint").alias("amount_cents"))


def q_validate_charges(spark, sf):
    """Charge requests: order id present, amount positive."""
    r = charge_requests(spark, sf)
    reason = (F.when(F.col("order_id").isNull() | (F.col("order_id") == ""), M.ORDER_ID_REQUIRED)
               .when(F.col("amount_cents") <= 0, M.AMOUNT_NOT_POSITIVE))
    return r.select("request_id", reason.alias("reason"))


def q_product_available(spark, sf):
    """P7."""
    p = VW.products(spark, sf)
    return p.select("product_id", "stock", "reserved", S.available("stock", "reserved").alias("available"))


def q_list_products(spark, sf):
    """Third page of 50, newest first."""
    return C.list_products(VW.products(spark, sf), limit=50, offset=100).select("product_id", "sku", "created_us")


def q_validate_orders(spark, sf):
    return C.validate_orders(VW.orders(spark, sf), VW.order_lines(spark, sf))


def q_price_orders(spark, sf):
    return C.price_orders(VW.order_lines(spark, sf), VW.products(spark, sf))


def q_orders_with_items(spark, sf):
    return C.orders_with_items(VW.orders(spark, sf), VW.order_lines(spark, sf))


def q_orders_holding_product(spark, sf):
    return C.orders_holding_product(VW.order_lines(spark, sf), VW.orders(spark, sf))


def q_orders_without_items(spark, sf):
    return C.orders_without_items(VW.orders(spark, sf), VW.order_lines(spark, sf))


def q_orders_for_user(spark, sf):
    return C.orders_for_user(VW.orders(spark, sf)).select("user_id", "order_id", "created_us", "status", "rn")


def q_owner_scope(spark, sf):
    o = VW.orders(spark, sf)
    req = F.when(F.col("order_id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1)
    return C.owner_scope(o, req)


def q_fk_orphans(spark, sf):
    lines, orders, products = VW.order_lines(spark, sf), VW.orders(spark, sf), VW.products(spark, sf)
    return C.fk_orphans({"order_items.order_id": (lines, orders, "order_id"),
                         "order_items.product_id": (lines, products, "product_id")})


def q_src_orders(spark, sf):
    """The orders table scan with a pushed-down filter and pruned columns."""
    return VW.orders(spark, sf, status="pending").select("order_id", "user_id", "total_cents")


def audit_rules(spark, sf):
    p, li, o = VW.products(spark, sf), VW.order_lines(spark, sf), VW.orders(spark, sf)
    col = F.col
    return [
        ("products", "price_cents >= 0", p, col("price_cents") >= 0, "product_id"),
        ("products", "stock >= 0", p, col("stock") >= 0, "product_id"),
        ("products", "reserved >= 0", p, col("reserved") >= 0, "product_id"),
        ("products", "reserved <= stock", p, col("reserved") <= col("stock"), "product_id"),
        ("order_items", "quantity > 0", li, col("quantity") > 0, "order_id"),
        ("order_items", "unit_cents >= 0", li, col("unit_cents") >= 0, "order_id"),
        ("orders", "status in (pending, confirmed, cancelled)", o,
         col("status").isin("pending", "confirmed", "cancelled"), "order_id"),
        ("orders", "total_cents >= 0", o, col("total_cents") >= 0, "order_id"),
    ]


def q_audit_checks(spark, sf):
    return C.audit_checks(audit_rules(spark, sf))


def q_audit_unique(spark, sf):
    s = VW.signups(spark, sf).select(S.email_key("raw_email").alias("email_key")).where(F.col("email_key").isNotNull())
    return C.audit_unique([
        ("users.lower(email)", s, ["email_key"]),
        ("products.sku", VW.products(spark, sf), ["sku"]),
        ("order_items.pk", VW.order_lines(spark, sf), ["order_id", "product_id"]),
        ("orders.pk", VW.orders(spark, sf), ["order_id"]),
    ])


QUERIES = {
    "validate_products": q_validate_products,
    "dedupe_skus": q_dedupe_skus,
    "normalize_currency": q_normalize_currency,
    "normalize_email": q_normalize_email,
    "dedupe_users": q_dedupe_users,
    "validate_charges": q_validate_charges,
    "product_available": q_product_available,
    "list_products": q_list_products,
    "validate_orders": q_validate_orders,
    "price_orders": q_price_orders,
    "orders_with_items": q_orders_with_items,
    "orders_holding_product": q_orders_holding_product,
    "orders_without_items": q_orders_without_items,
    "orders_for_user": q_orders_for_user,
    "owner_scope": q_owner_scope,
    "fk_orphans": q_fk_orphans,
    "src_orders": q_src_orders,
    "audit_checks": q_audit_checks,
    "audit_unique": q_audit_unique,
}

# ---------------------------------------------------------------- oracles

_EK = V.normalize_email("raw_email")


def _audit_checks_sql() -> str:
    rules = [
        ("products", "price_cents >= 0", "products", "price_cents >= 0", "product_id"),
        ("products", "stock >= 0", "products", "stock >= 0", "product_id"),
        ("products", "reserved >= 0", "products", "reserved >= 0", "product_id"),
        ("products", "reserved <= stock", "products", "reserved <= stock", "product_id"),
        ("order_items", "quantity > 0", "order_lines", "quantity > 0", "order_id"),
        ("order_items", "unit_cents >= 0", "order_lines", "unit_cents >= 0", "order_id"),
        ("orders", "status in (pending, confirmed, cancelled)", "orders_v",
         "status IN ('pending', 'confirmed', 'cancelled')", "order_id"),
        ("orders", "total_cents >= 0", "orders_v", "total_cents >= 0", "order_id"),
    ]
    arms = [f"SELECT '{t}' AS table_name, '{r}' AS rule, CAST(SUM(CASE WHEN coalesce({ok}, false) THEN 0 ELSE 1 END) AS BIGINT) AS violations, "
            f"min(CASE WHEN coalesce({ok}, false) THEN NULL ELSE CAST({idc} AS VARCHAR) END) AS sample FROM {src}"
            for t, r, src, ok, idc in rules]
    return f"WITH {V.PRODUCTS}, {V.ORDER_LINES}, {V.ORDERS} " + " UNION ALL ".join(arms)


def _audit_unique_sql() -> str:
    specs = [("users.lower(email)", f"(SELECT lower({_EK}) AS email_key FROM signups) s WHERE email_key IS NOT NULL", "email_key"),
             ("products.sku", "products", "sku"),
             ("order_items.pk", "order_lines", "order_id, product_id"),
             ("orders.pk", "orders_v", "order_id")]
    arms = [f"SELECT '{n}' AS constraint_name, COUNT(*) AS duplicate_keys, CAST(coalesce(SUM(c - 1), 0) AS BIGINT) AS surplus_rows "
            f"FROM (SELECT {cols}, COUNT(*) AS c FROM {src} GROUP BY {cols} HAVING COUNT(*) > 1) d"
            for n, src, cols in specs]
    return f"WITH {V.SIGNUPS}, {V.PRODUCTS}, {V.ORDER_LINES}, {V.ORDERS} " + " UNION ALL ".join(arms)


ORACLES = {
    "validate_products": f"WITH {PRODUCT_REQUESTS_SQL} SELECT request_id, {V.normalize_currency('currency_raw')} AS currency, "
                         f"{PRODUCT_REASON_SQL} AS reason FROM preq",
    "dedupe_skus": f"WITH {PRODUCT_REQUESTS_SQL}, ok AS (SELECT request_id, trim(sku) AS sku FROM preq WHERE ({PRODUCT_REASON_SQL}) IS NULL) "
                   "SELECT request_id, sku, CASE WHEN request_id = min(request_id) OVER (PARTITION BY sku) THEN 'created' "
                   "ELSE 'sku_taken' END AS outcome FROM ok",
    "normalize_currency": "WITH c AS (SELECT c_custkey AS customer_id, CASE c_custkey % 5 WHEN 0 THEN ' usd ' WHEN 1 THEN 'eur' "
                          "WHEN 2 THEN '' WHEN 3 THEN 'DOLLARS' ELSE 'Gbp ' END AS raw FROM customer) "
                          f"SELECT customer_id, raw, {V.normalize_currency('raw')} AS currency, "
                          f"length({V.normalize_currency('raw')}) = 3 AS catalog_ok FROM c",
    "normalize_email": f"WITH {V.SIGNUPS} SELECT signup_id, {_EK} AS email, lower({_EK}) AS email_key, "
                       f"{V.email_reason('raw_email')} AS reason FROM signups",
    "dedupe_users": f"WITH {V.SIGNUPS}, s AS (SELECT signup_id, lower({_EK}) AS email_key FROM signups) "
                    "SELECT signup_id, email_key, CASE WHEN email_key IS NULL THEN 'invalid' "
                    "WHEN signup_id = min(signup_id) OVER (PARTITION BY email_key) THEN 'created' ELSE 'email_taken' END AS outcome FROM s",
    "validate_charges": f"WITH {V.ORDERS}, r AS (SELECT order_id AS request_id, CASE WHEN order_id % 79 = 0 THEN '' "
                        "ELSE CAST(order_id AS VARCHAR) END AS oid, CAST(CASE WHEN order_id % 89 = 0 THEN 0 WHEN order_id % 83 = 0 "
                        "THEN -100 ELSE total_cents END AS BIGINT) AS amount_cents FROM orders_v) "
                        "SELECT request_id, CASE WHEN oid IS NULL OR oid = '' THEN 'order_id is required' "
                        "WHEN amount_cents <= 0 THEN 'amount_cents must be positive' END AS reason FROM r",
    "product_available": f"WITH {V.PRODUCTS} SELECT product_id, stock, reserved, stock - reserved AS available FROM products",
    "list_products": f"WITH {V.PRODUCTS} SELECT product_id, sku, created_us FROM products "
                     "ORDER BY created_us DESC, product_id LIMIT 50 OFFSET 100",
    "validate_orders": f"WITH {V.ORDERS}, {V.ORDER_LINES}, ln AS (SELECT *, row_number() OVER (PARTITION BY order_id, product_id "
                       "ORDER BY line_no, supp_id, quantity, unit_cents) > 1 AS dup FROM order_lines), "
                       "r AS (SELECT *, CASE WHEN product_id IS NULL THEN 'each item needs a product_id' "
                       "WHEN quantity <= 0 THEN 'each item needs a positive quantity' "
                       "WHEN dup THEN 'each product may appear only once per order' END AS why FROM ln), "
                       "per AS (SELECT order_id, COUNT(*) AS n_lines, arg_min(why, (line_no, product_id, supp_id, quantity, unit_cents)) "
                       "FILTER (WHERE why IS NOT NULL) AS first_bad FROM r GROUP BY order_id), "
                       "j AS (SELECT o.order_id, coalesce(p.n_lines, 0) AS n, p.first_bad FROM orders_v o LEFT JOIN per p USING (order_id)) "
                       "SELECT order_id, CAST(n AS BIGINT) AS n_lines, CASE WHEN n = 0 THEN 'an order must have at least one item' "
                       "WHEN n > 50 THEN 'too many items in one order' ELSE first_bad END AS reason, "
                       "(CASE WHEN n = 0 THEN 'x' WHEN n > 50 THEN 'x' ELSE first_bad END) IS NULL AS valid FROM j",
    "price_orders": f"WITH {V.PRODUCTS}, {V.ORDER_LINES} SELECT l.order_id, COUNT(*) AS n_lines, bool_and(p.product_id IS NOT NULL) AS all_known, "
                    "CASE WHEN bool_and(p.product_id IS NOT NULL) THEN CAST(SUM(p.price_cents * l.quantity) AS BIGINT) END AS total_cents, "
                    "arg_max(p.currency, (l.line_no, l.product_id, l.supp_id, l.quantity, l.unit_cents)) AS currency, "
                    "COUNT(DISTINCT p.currency) > 1 AS mixed_currency "
                    "FROM order_lines l LEFT JOIN products p USING (product_id) GROUP BY l.order_id",
    "orders_with_items": f"WITH {V.ORDERS}, {V.ORDER_LINES}, it AS (SELECT order_id, COUNT(*) AS n, "
                         "string_agg(CAST(product_id AS VARCHAR) || ':' || CAST(quantity AS VARCHAR) || ':' || CAST(unit_cents AS VARCHAR), ';' "
                         "ORDER BY product_id, line_no, quantity, unit_cents) AS items FROM order_lines GROUP BY order_id) "
                         "SELECT o.order_id, o.user_id, o.status, o.total_cents, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, "
                         "coalesce(it.items, '') AS items FROM orders_v o LEFT JOIN it USING (order_id)",
    "orders_holding_product": f"WITH {V.ORDERS}, {V.ORDER_LINES} SELECT l.product_id, COUNT(DISTINCT l.order_id) AS n_orders "
                              "FROM order_lines l JOIN orders_v o USING (order_id) GROUP BY l.product_id",
    "orders_without_items": f"WITH {V.ORDERS}, {V.ORDER_LINES} SELECT order_id, user_id, status FROM orders_v o "
                            "WHERE NOT EXISTS (SELECT 1 FROM order_lines l WHERE l.order_id = o.order_id)",
    "orders_for_user": f"WITH {V.ORDERS}, r AS (SELECT user_id, order_id, created_us, status, row_number() OVER "
                       "(PARTITION BY user_id ORDER BY created_us DESC, order_id) AS rn FROM orders_v) "
                       "SELECT * FROM r WHERE rn > 0 AND rn <= 20",
    "owner_scope": f"WITH {V.ORDERS}, r AS (SELECT *, CASE WHEN order_id % 2 = 0 THEN user_id ELSE user_id + 1 END AS requester FROM orders_v) "
                   "SELECT order_id, requester, CASE WHEN user_id = requester THEN 'found' ELSE 'not_found' END AS outcome, "
                   "CASE WHEN user_id = requester THEN status END AS status FROM r",
    "fk_orphans": f"WITH {V.PRODUCTS}, {V.ORDERS}, {V.ORDER_LINES} "
                  "SELECT 'order_items.order_id' AS relation, COUNT(*) AS orphans, min(CAST(order_id AS VARCHAR)) AS sample "
                  "FROM order_lines l WHERE NOT EXISTS (SELECT 1 FROM orders_v o WHERE o.order_id = l.order_id) "
                  "UNION ALL SELECT 'order_items.product_id', COUNT(*), min(CAST(product_id AS VARCHAR)) "
                  "FROM order_lines l WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = l.product_id)",
    "src_orders": f"WITH {V.ORDERS} SELECT order_id, user_id, total_cents FROM orders_v WHERE status = 'pending'",
    "audit_checks": _audit_checks_sql(),
    "audit_unique": _audit_unique_sql(),
}
