"""The admission fixpoint equals a serial loop (brute force) on sf0.001."""

import duckdb

from admitflow.plans.admission import admit_orders
from admitflow.sources.views import order_lines, products

from conftest import SF001


import pytest


@pytest.mark.parametrize("chunk", [None, 50])
def test_fixpoint_matches_serial_admission(spark, chunk):
    # 50: many chunks, so the running sums are carried from chunk to chunk.
    kw = {} if chunk is None else {"chunk_lines": chunk}
    res = {r.order_id: r.admitted
           for r in admit_orders(order_lines(spark, SF001), products(spark, SF001), **kw).collect()}
    lines = duckdb.sql(f"SELECT l_orderkey, l_partkey, SUM(CAST(l_quantity AS INTEGER)) FROM "
                       f"read_parquet('{SF001}/lineitem.parquet') GROUP BY 1, 2 ORDER BY 1, 2").fetchall()
    left = dict(duckdb.sql(f"SELECT p_partkey, p_size * 20 FROM read_parquet('{SF001}/part.parquet')").fetchall())
    by_order = {}
    for o, p, q in lines:
        by_order.setdefault(o, []).append((p, q))
    serial = {}
    for o in sorted(by_order):
        ok = all(left.get(p, -1) >= q for p, q in by_order[o])
        if ok:
            for p, q in by_order[o]:
                left[p] -= q
        serial[o] = ok
    assert res == serial
    assert 0 < sum(serial.values()) < len(serial)


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

# random small shops: orders of 1-3 lines over 4 products with tight stock
order_lines_st = st.lists(
    st.lists(st.tuples(st.integers(1, 4), st.integers(1, 6)), min_size=1, max_size=3, unique_by=lambda x: x[0]),
    min_size=1, max_size=25)
stock_st = st.lists(st.integers(0, 12), min_size=4, max_size=4)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(order_lines_st, stock_st)
def test_fixpoint_equals_serial_on_random_shops(spark, orders, stock):
    rows = [(o + 1, p, q, i + 1, 0, 0) for o, lines in enumerate(orders) for i, (p, q) in enumerate(lines)]
    lines = spark.createDataFrame(rows, "order_id long, product_id long, quantity int, line_no int, "
                                        "supp_id long, unit_cents long")
    prods = spark.createDataFrame([(p + 1, stock[p]) for p in range(4)], "product_id long, stock int")
    got = {r.order_id: r.admitted for r in admit_orders(lines, prods).collect()}
    left, want = list(stock), {}
    for o, ls in enumerate(orders):
        ok = all(left[p - 1] >= q for p, q in ls)
        if ok:
            for p, q in ls:
                left[p - 1] -= q
        want[o + 1] = ok
    assert got == want


def test_long_chains_settle_and_rounds_are_removed(spark):
    """Order i takes the last unit of product i only if order i - 1 was
    refused: one round an order."""
    rows, n = [], 30
    for i in range(1, n + 1):
        rows += [(i, i, 1), (i, i + 1, 1)]
    lines = spark.createDataFrame(rows + [(n + 1, 999, 1), (n + 2, 500, 1)], "order_id long, product_id long, quantity int")
    prods = spark.createDataFrame([(i, 1) for i in range(1, n + 2)] + [(500, 9)], "product_id long, stock int")
    got = {r.order_id: (r.admitted, r.decided_round) for r in admit_orders(lines, prods).collect()}
    assert {i: a for i, (a, _) in got.items()} == {i: i % 2 == 1 for i in range(1, n + 1)} | {n + 1: False, n + 2: True}
    assert max(r for _, r in got.values()) > 10
    assert admit_orders(lines.limit(0), prods).count() == 0


def test_chunks_are_for_hot_products_alone(spark):
    from pyspark.sql import functions as F

    from admitflow.plans.admission import prefix_sums, running_sums
    df = spark.createDataFrame([(p if p else None, o, o + 1) for p in range(5) for o in range(40)], "product_id long, order_id long, q long")
    want = sorted(map(tuple, running_sums(df, "product_id", "order_id", {"s": F.col("q")}, None, 7).collect()), key=str)
    hot = spark.createDataFrame([(2,), (4,)], "product_id long")
    got = running_sums(df, "product_id", "order_id", {"s": F.col("q")}, hot, 7)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(r[3] for r in want) == 5 * sum(o * (o + 1) // 2 for o in range(40))

    def shuffles(d):
        return d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(running_sums(df, "product_id", "order_id", {"s": F.col("q")}, None, 7)) == 1
    assert shuffles(prefix_sums(df, "product_id", "order_id", {"s": F.col("q")}, 7)) > 1
