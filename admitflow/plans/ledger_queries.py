"""Registered ledger and admission queries (I1-I8) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as LG
from ..sources import views as VW
from . import sqlviews as V
from .admission import admit_orders

ORDER = VW.LEDGER_ORDER


def _results(spark, sf, returned=None):
    return LG.run_ledger(VW.ledger_commands(spark, sf), VW.products(spark, sf), ORDER, returned=returned)


def q_ledger_reserve(spark, sf):
    """Every reserve command and what it did."""
    r = _results(spark, sf).where(F.col("op") == "reserve")
    return r.select("product_id", "order_id", "line_no", "supp_id", "n", "result", "hold_qty",
                    "stock_after", "reserved_after")


def q_ledger_final(spark, sf):
    """End state per product after all commands."""
    return LG.ledger_final(_results(spark, sf), VW.products(spark, sf), ORDER)


def q_oversell_audit(spark, sf):
    """I7."""
    return LG.oversell_audit(_results(spark, sf, ["product_id", "stock_after", "reserved_after"]))


def q_orphan_holds(spark, sf):
    """I8: holds left behind by reserves redelivered after settlement."""
    holds = LG.open_holds(_results(spark, sf, LG.HOLD_COLUMNS), ORDER)
    return LG.orphan_holds(holds, VW.orders(spark, sf))


def q_admit_orders(spark, sf):
    """Which orders are admitted."""
    return admit_orders(VW.order_lines(spark, sf), VW.products(spark, sf)).select("order_id", "admitted")


QUERIES = {
    "ledger_reserve": q_ledger_reserve,
    "ledger_final": q_ledger_final,
    "oversell_audit": q_oversell_audit,
    "orphan_holds": q_orphan_holds,
    "admit_orders": q_admit_orders,
}

# ---------------------------------------------------------------- oracles

_CMD0 = V.ORDER_LINES + """,
cmd0 AS (
  SELECT l.product_id, l.ship_us + CASE t.n WHEN 1 THEN 30 * 86400000000 WHEN 2 THEN 31 * 86400000000
                                            WHEN 3 THEN 10 * 86400000000 ELSE 0 END AS t_us,
    CAST(t.n AS INTEGER) AS n, l.order_id, l.line_no, l.supp_id, CAST(l.quantity AS BIGINT) AS quantity, l.extended_price,
    CASE WHEN t.n IN (0, 2) THEN 'reserve' WHEN t.n = 1 AND o.o_orderstatus = 'F' THEN 'commit'
         WHEN t.n = 1 THEN 'release' ELSE 'add_stock' END AS op
  FROM order_lines l LEFT JOIN orders o ON o.o_orderkey = l.order_id, (SELECT range AS n FROM range(4)) t
  WHERE t.n = 0 OR (t.n = 1 AND o.o_orderstatus IN ('F', 'P'))
     OR (t.n = 2 AND o.o_orderstatus IN ('F', 'P') AND l.order_id % 7 = 0) OR (t.n = 3 AND l.order_id % 10 = 3)
)"""


def _numbered(source: str) -> str:
    return f"""cmds AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY t_us, n, order_id, line_no, supp_id, quantity, extended_price) AS rn
  FROM {source}
)"""


_FOLD = """fold(product_id, rn, stock, reserved, holds, result, hold_qty) AS (
  SELECT product_id, CAST(0 AS BIGINT), CAST(stock AS BIGINT), CAST(reserved AS BIGINT),
         CAST([] AS STRUCT(o BIGINT, q BIGINT)[]), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT)
  FROM products
  UNION ALL
  SELECT product_id, rn,
    CASE WHEN op = 'commit' AND has THEN greatest(0, s - hq) WHEN op = 'add_stock' AND q > 0 THEN s + q ELSE s END,
    CASE WHEN op = 'reserve' AND ok AND NOT has AND s - r >= q THEN r + q
         WHEN op IN ('release', 'commit') AND has THEN greatest(0, r - hq) ELSE r END,
    CASE WHEN op = 'reserve' AND ok AND NOT has AND s - r >= q THEN list_append(hs, {'o': order_id, 'q': q})
         WHEN op IN ('release', 'commit') AND has THEN list_filter(hs, lambda x: x.o <> order_id) ELSE hs END,
    CASE WHEN op = 'reserve' AND NOT ok THEN 'invalid'
         WHEN op = 'reserve' AND has THEN 'held' WHEN op = 'reserve' AND s - r >= q THEN 'reserved'
         WHEN op = 'reserve' THEN 'insufficient'
         WHEN op = 'release' AND has THEN 'released' WHEN op = 'commit' AND has THEN 'committed'
         WHEN op IN ('release', 'commit') THEN 'no_hold'
         WHEN op = 'add_stock' AND q > 0 THEN 'restocked' ELSE 'invalid' END,
    CASE WHEN op = 'reserve' AND NOT ok THEN NULL WHEN op = 'reserve' AND has THEN hq WHEN op = 'reserve' AND s - r >= q THEN q
         WHEN op IN ('release', 'commit') AND has THEN hq END
  FROM (
    SELECT c.product_id, c.rn, c.op, c.order_id, c.quantity AS q, f.stock AS s, f.reserved AS r, f.holds AS hs,
      len(list_filter(f.holds, lambda x: x.o = c.order_id)) > 0 AS has,
      list_filter(f.holds, lambda x: x.o = c.order_id)[1].q AS hq,
      coalesce(c.order_id IS NOT NULL AND c.quantity > 0, false) AS ok
    FROM fold f JOIN cmds c ON c.product_id = f.product_id AND c.rn = f.rn + 1
  ) z
),
res AS (SELECT c.*, f.result, f.hold_qty, f.stock AS stock_after, f.reserved AS reserved_after
        FROM fold f JOIN cmds c ON c.product_id = f.product_id AND c.rn = f.rn)"""

LEDGER = f"WITH RECURSIVE {V.PRODUCTS}, {_CMD0}, {_numbered('cmd0')}, {_FOLD}"


def settled_ledger(prelude: str, status: str, op: str, fails_for: str) -> str:
    """The ledger with a settlement of ``resolved`` orders (of ``prelude``) of
    one status behind its commands: tables ``per`` (order_id, items,
    attempts) and ``res`` with the settlement rows' ``attempt``."""
    return f"""WITH RECURSIVE {V.PRODUCTS}, {prelude}, {_CMD0},
items AS MATERIALIZED (
  SELECT DISTINCT l.order_id, l.product_id, {fails_for} AS fails
  FROM order_lines l JOIN resolved r ON r.order_id = CAST(l.order_id AS VARCHAR) WHERE r.status = '{status}'
),
per AS MATERIALIZED (SELECT order_id, COUNT(*) AS items, max(fails) + 1 AS attempts FROM items GROUP BY order_id),
tries AS MATERIALIZED (
  SELECT i.order_id, i.product_id, a.attempt FROM items i JOIN per p USING (order_id), LATERAL (SELECT unnest(range(1, p.attempts + 1)) AS attempt) a
  WHERE NOT EXISTS (SELECT 1 FROM items s WHERE s.order_id = i.order_id AND s.fails >= a.attempt AND s.product_id <= i.product_id)
),
cmd1 AS (
  SELECT *, CAST(NULL AS BIGINT) AS attempt FROM cmd0
  UNION ALL BY NAME
  SELECT product_id, (SELECT max(t_us) FROM cmd0) + attempt AS t_us, order_id, '{op}' AS op, attempt FROM tries
), {_numbered('cmd1')}, {_FOLD},
got AS (
  SELECT order_id, COUNT(*) AS holds, SUM(hold_qty) AS units, SUM(CASE WHEN attempt = 1 THEN 1 ELSE 0 END) AS first
  FROM res WHERE attempt IS NOT NULL AND result IN ('released', 'committed') GROUP BY order_id
),
settlement AS (
  SELECT r.order_id, CAST(coalesce(p.items, 0) AS BIGINT) AS items, CAST(coalesce(g.units, 0) AS BIGINT) AS units,
    CAST(coalesce(g.holds, 0) AS BIGINT) AS holds, CAST(coalesce(g.first, 0) AS BIGINT) AS first,
    CAST(coalesce(p.items, 0) - coalesce(g.holds, 0) AS BIGINT) AS without_hold, CAST(coalesce(p.attempts, 1) AS BIGINT) AS attempts
  FROM resolved r LEFT JOIN per p ON CAST(p.order_id AS VARCHAR) = r.order_id LEFT JOIN got g ON CAST(g.order_id AS VARCHAR) = r.order_id
  WHERE r.status = '{status}'
)"""


OPEN_HOLDS = (", lastchg AS (SELECT order_id, product_id, arg_max(result, rn) AS lr, arg_max(hold_qty, rn) AS lq "
              "FROM res WHERE result IN ('reserved', 'released', 'committed') GROUP BY order_id, product_id)")

ORACLES = {
    "ledger_reserve": LEDGER + " SELECT product_id, order_id, line_no, supp_id, n, result, hold_qty, stock_after, reserved_after "
                               "FROM res WHERE op = 'reserve'",
    "ledger_final": LEDGER + ", last AS (SELECT product_id, arg_max(stock_after, rn) AS st, arg_max(reserved_after, rn) AS rs, "
                             "SUM(CASE WHEN result = 'reserved' THEN 1 WHEN result IN ('released', 'committed') THEN -1 ELSE 0 END) AS oh, "
                             "SUM(CASE WHEN result = 'reserved' THEN hold_qty WHEN result IN ('released', 'committed') THEN -hold_qty "
                             "ELSE 0 END) AS hu FROM res GROUP BY product_id) "
                             "SELECT p.product_id, CAST(coalesce(l.st, p.stock) AS BIGINT) AS stock, "
                             "CAST(coalesce(l.rs, p.reserved) AS BIGINT) AS reserved, CAST(coalesce(l.oh, 0) AS BIGINT) AS open_holds, "
                             "CAST(coalesce(l.hu, 0) AS BIGINT) AS held_units FROM products p LEFT JOIN last l USING (product_id)",
    "oversell_audit": LEDGER + " SELECT product_id, max(reserved_after - stock_after) AS max_excess, "
                               "CAST(SUM(CASE WHEN reserved_after > stock_after THEN 1 ELSE 0 END) AS BIGINT) AS violations "
                               "FROM res GROUP BY product_id",
    "orphan_holds": LEDGER + f", {V.ORDERS}" + OPEN_HOLDS + " "
                             "SELECT h.order_id, h.product_id, h.lq AS quantity, coalesce(o.status, 'missing') AS order_status "
                             "FROM lastchg h LEFT JOIN orders_v o USING (order_id) WHERE h.lr = 'reserved' "
                             "AND (o.status IS NULL OR o.status IN ('confirmed', 'cancelled'))",
    # One order a step: its lines against what the steps before left.
    "admit_orders": """WITH RECURSIVE need AS MATERIALIZED (
  SELECT l_orderkey AS o, l_partkey AS p, CAST(SUM(CAST(l_quantity AS INTEGER)) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
ranked AS MATERIALIZED (SELECT o, row_number() OVER (ORDER BY o) AS k FROM (SELECT DISTINCT o FROM need)),
step AS MATERIALIZED (SELECT r.k, n.o, n.p, n.q FROM need n JOIN ranked r USING (o)),
t(kind, id, val) USING KEY (kind, id) AS (
  SELECT 'stock' AS kind, CAST(p_partkey AS BIGINT) AS id, CAST(p_size * 20 AS BIGINT) AS val FROM part
  UNION ALL SELECT 'step', 0, 0
  UNION
  (WITH cur AS (SELECT val + 1 AS k FROM t WHERE kind = 'step'),
   ln AS (SELECT s.o, s.p, s.q, r.val AS have FROM step s JOIN cur c ON s.k = c.k
          LEFT JOIN recurring.t r ON r.kind = 'stock' AND r.id = s.p),
   ok AS (SELECT o, bool_and(coalesce(have >= q, false)) AS fits FROM ln GROUP BY o)
   SELECT 'stock', ln.p, ln.have - ln.q FROM ln JOIN ok USING (o) WHERE ok.fits
   UNION ALL SELECT 'order', ok.o, CAST(ok.fits AS BIGINT) FROM ok
   UNION ALL SELECT 'step', 0, c.k FROM cur c WHERE EXISTS (SELECT 1 FROM ok)))
SELECT id AS order_id, val = 1 AS admitted FROM t WHERE kind = 'order'""",
}
