"""Catalog, orders, users: validation (P13-P17), joins (J1, J2, J5, J6),
first-wins uniqueness (E9, E10), pages (W1, W2) and audits (E12, C1, C2).

Join strategy is left to Catalyst and AQE: a side whose size statistics
fall under ``spark.sql.autoBroadcastJoinThreshold`` is broadcast, anything
larger is shuffled on the key; AQE re-plans at runtime from real shuffle
sizes and splits skewed partitions. Nothing here hints an unbounded side.

"First wins" is computed as ``min(order) per key`` (a partial aggregate)
joined back on the key, not as a window over the key: a key holding a
third of all rows then never sits in one window buffer, and AQE's skew
join splits the hot side of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.scalars import currency_ok_for_catalog, normalize_currency

# Lines that one task of a join by order takes, on average.
LINES_PER_TASK = 1_000_000


def first_wins(df: DataFrame, key: str | list[str], order: str, winner: str = "first") -> DataFrame:
    """Append boolean ``winner``: the row with the smallest ``order`` per key
    (NULL keys never win and never collide)."""
    keys = [key] if isinstance(key, str) else key
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    firsts = df.where(present).groupBy(*keys).agg(F.min(order).alias("_first"))
    j = df.join(firsts, keys, "left")
    return j.withColumn(winner, F.coalesce(F.col(order) == F.col("_first"), F.lit(False))).drop("_first")


# ------------------------------------------------------------------ catalog

def validate_products(req: DataFrame) -> DataFrame:
    """First failing rule of a product-create request, in handler order.
    Expects ``sku, name, price_cents, stock, currency_raw``."""
    sku, name = F.trim("sku"), F.trim("name")
    reason = (F.when(sku.isNull() | (sku == ""), M.SKU_REQUIRED)
               .when(name.isNull() | (name == ""), M.NAME_REQUIRED)
               .when(F.col("price_cents") < 0, M.PRICE_NEGATIVE)
               .when(F.col("stock") < 0, M.STOCK_NEGATIVE)
               .when(~currency_ok_for_catalog("currency_raw"), M.CURRENCY_CODE))
    return req.withColumn("currency", normalize_currency("currency_raw")).withColumn("reason", reason)


def dedupe_skus(req: DataFrame, order: str = "request_id") -> DataFrame:
    """One product per exact sku; later creates get ``sku_taken``."""
    w = first_wins(req, "sku", order)
    return w.withColumn("outcome", F.when(F.col("first"), "created").otherwise("sku_taken")).drop("first")


def list_products(products: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, id breaks ties; one page (a top-k: the limit is the feature)."""
    return products.orderBy(F.col("created_us").desc(), F.col("product_id").asc()).offset(offset).limit(limit)


# ------------------------------------------------------------------- orders

def line_position(lines: DataFrame) -> Column:
    """Total order of the lines of one order (line numbers repeat in the data)."""
    return F.struct("line_no", "product_id", "supp_id", "quantity", "unit_cents")


def validate_orders(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """1..50 lines; then, in line order, product id present, quantity
    positive, product not repeated. One row per order with the first reason."""
    w = Window.partitionBy("order_id", "product_id").orderBy("line_no", "supp_id", "quantity", "unit_cents")
    ln = lines.withColumn("_dup", F.row_number().over(w) > 1)
    pid = F.col("product_id")
    reason = (F.when(pid.isNull(), M.ITEM_NO_PRODUCT)
               .when(F.col("quantity") <= 0, M.ITEM_BAD_QUANTITY)
               .when(F.col("_dup"), M.ITEM_REPEATED))
    per = (ln.withColumn("_r", reason)
             .groupBy("order_id")
             .agg(F.count(F.lit(1)).alias("n_lines"),
                  F.min_by("_r", F.when(F.col("_r").isNotNull(), line_position(ln))).alias("_first_bad")))
    o = orders.select("order_id").join(per, "order_id", "left")
    n = F.coalesce(F.col("n_lines"), F.lit(0))
    why = (F.when(n == 0, M.NO_ITEMS)
            .when(n > M.MAX_ITEMS_PER_ORDER, M.TOO_MANY_ITEMS)
            .otherwise(F.col("_first_bad")))
    return o.select("order_id", n.cast("bigint").alias("n_lines"), why.alias("reason"),
                    why.isNull().alias("valid"))


def reservation_reason(order_id: Column, product_id: Column, quantity: Column) -> Column:
    """Why a reservation request is refused, or NULL."""
    blank = (F.coalesce(order_id, F.lit("")) == "") | (F.coalesce(product_id, F.lit("")) == "")
    return (F.when(blank, M.RESERVATION_IDS_REQUIRED)
             .when(F.coalesce(quantity, F.lit(0)) <= 0, M.RESERVATION_BAD_QUANTITY))


def price_orders(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Price every line from the catalog; an unknown product rejects the
    whole order; total = sum(price x qty); currency = the last line's (kept
    as the reference does) and a flag for mixed-currency orders."""
    p = products.select("product_id", F.col("price_cents").alias("_price"), F.col("currency").alias("_cur"))
    j = lines.join(p, "product_id", "left")
    return (j.groupBy("order_id")
             .agg(F.count(F.lit(1)).alias("n_lines"),
                  F.bool_and(F.col("_price").isNotNull()).alias("all_known"),
                  F.sum(F.col("_price") * F.col("quantity")).cast("bigint").alias("_total"),
                  F.max_by("_cur", line_position(lines)).alias("currency"),
                  F.coalesce(F.min("_cur") != F.max("_cur"), F.lit(False)).alias("mixed_currency"))
             .select("order_id", "n_lines", "all_known",
                     F.when(F.col("all_known"), F.col("_total")).alias("total_cents"),
                     "currency", "mixed_currency"))


def orders_with_items(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Each order with its items sorted by product, as one text field
    ``product:qty:unit_cents;...`` and an item count (orders without lines
    keep an empty list). Lines are grouped per order before the join."""
    items = (lines.groupBy("order_id")
                  .agg(F.sort_array(F.collect_list(F.struct("product_id", "line_no", "quantity", "unit_cents")))
                        .alias("_items")))
    j = orders.join(items, "order_id", "left")
    text = F.array_join(F.transform(F.coalesce("_items", F.array()),
                                    lambda x: F.concat_ws(":", x.product_id.cast("string"), x.quantity.cast("string"),
                                                          x.unit_cents.cast("string"))), ";")
    return j.select("order_id", "user_id", "status", "total_cents",
                    F.coalesce(F.size("_items"), F.lit(0)).cast("bigint").alias("n_items"),
                    text.alias("items"))


def orders_holding_product(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Distinct orders holding each product. Lines meet their order in
    parts by order id, in which a pair's copies are together, so a task's
    memory follows ``LINES_PER_TASK``; only counts by product are shuffled
    on. The number of lines is read from the files' footers."""
    pairs = lines.select("order_id", "product_id")
    parts = pairs.count() // LINES_PER_TASK + 1
    if parts > int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        pairs = pairs.repartition(parts, "order_id")
    known = pairs.join(orders.select("order_id"), "order_id", "left_semi").distinct()
    return known.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_orders"))


def orders_without_items(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """E12 audit: orders that exist without any line (anti join)."""
    return orders.join(lines.select("order_id"), "order_id", "left_anti").select("order_id", "user_id", "status")


def orders_for_user(orders: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """W2 for every user at once: the page newest-first per user. The
    ``row_number <= k`` filter lets Spark insert a per-partition group
    limit before the shuffle, so a user with many orders ships only k rows
    from each map task."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_us").desc(), F.col("order_id").asc())
    ranked = orders.withColumn("rn", F.row_number().over(w).cast("bigint"))
    return ranked.where((F.col("rn") > offset) & (F.col("rn") <= offset + limit))


def owner_scope(orders: DataFrame, requester: Column) -> DataFrame:
    """Another user's order is ``not_found`` (never ``forbidden``)."""
    found = F.col("user_id") == requester
    return orders.select("order_id", requester.alias("requester"),
                         F.when(found, "found").otherwise("not_found").alias("outcome"),
                         F.when(found, F.col("status")).alias("status"))


def fk_orphans(children: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """Rows whose foreign key has no parent, per relation.
    ``children`` maps a relation name to (child, parent, key)."""
    parts = []
    for name, (child, parent, key) in children.items():
        orphans = child.select(key).join(parent.select(key).distinct(), key, "left_anti")
        parts.append(orphans.agg(F.count(F.lit(1)).alias("orphans"),
                                 F.min(F.col(key).cast("string")).alias("sample"))
                            .select(F.lit(name).alias("relation"), "orphans", "sample"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------- audits

def audit_checks(rules: list[tuple[str, str, DataFrame, Column, str]]) -> DataFrame:
    """Every CHECK constraint as a named rule: violations and the
    smallest violating id. ``rules`` = (table, rule, frame, ok_predicate,
    id_column). Rules over one frame share one pass of conditional sums."""
    by_frame: dict[int, list] = {}
    frames = {}
    for table, rule, df, ok, idc in rules:
        by_frame.setdefault(id(df), []).append((table, rule, ok, idc))
        frames[id(df)] = df
    parts = []
    for fid, rs in by_frame.items():
        df = frames[fid]
        aggs = []
        for i, (table, rule, ok, idc) in enumerate(rs):
            bad = ~F.coalesce(ok, F.lit(False))
            aggs += [F.sum(F.when(bad, 1).otherwise(0)).cast("bigint").alias(f"v{i}"),
                     F.min(F.when(bad, F.col(idc).cast("string"))).alias(f"s{i}")]
        wide = df.agg(*aggs)
        n = len(rs)
        pairs = ", ".join(f"'{t}', '{r}', v{i}, s{i}" for i, (t, r, _, _) in enumerate(rs))
        parts.append(wide.select(F.expr(f"stack({n}, {pairs}) AS (table_name, rule, violations, sample)")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_unique(keys: list[tuple[str, DataFrame, list]]) -> DataFrame:
    """Per unique/primary key: keys that repeat and surplus rows."""
    parts = []
    for name, df, cols in keys:
        g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        parts.append(g.agg(F.count(F.lit(1)).alias("duplicate_keys"),
                           F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("surplus_rows"))
                      .select(F.lit(name).alias("constraint_name"), "duplicate_keys", "surplus_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
