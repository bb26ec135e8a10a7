"""All-or-nothing order admission without a serial loop.

Serial meaning: orders in ``order_id`` order; an order is admitted iff
every one of its lines fits the stock left by the earlier admitted
orders. That crosses product keys, so no single partitioning decides it.
Instead a fixpoint over statuses unknown / yes / no: each round knows per
line ``lo``, the units of earlier admitted orders of its product, and takes a
running sum ``ahead`` of the earlier undecided ones. A line surely fits if
lo + ahead + q <= stock and surely fails if lo + q > stock; an order is yes
when all its lines surely fit, no when any surely fails. The earliest
undecided order is always decidable, so every round makes progress, and
there are at most as many rounds as orders in a chain of dependencies (no
cap: valid data always settles).

Products whose whole demand fits their stock bind nobody; their lines are
left out from the start. A round holds undecided lines only: what the round
before admitted is added to ``lo`` and then dropped. It costs two shuffles of
them (by product chunk for the sums, by order for the verdicts). Its table is
written to the shared checkpoint directory, undecided and decided lines apart;
the undecided part of the round before is then removed. Transient holds of
refused orders, which concurrent requests could see in a live service, do
not exist under serial semantics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Rounds

# A product with more lines than this is hot: its lines are summed in chunks of
# the order-id range, of as many lines on average, so it is spread over tasks.
CHUNK_LINES = 500_000


def prefix_sums(df: DataFrame, key: str, order: str, values: dict[str, Column],
                width: int) -> DataFrame:
    """Exclusive running sums of ``values`` per ``key`` in ``order`` order
    (strictly earlier rows; ``order`` is unique within a key).

    Two levels, so a key with a third of all rows is not one task: totals
    per (key, order // width) chunk, a carry per chunk from the small chunk
    table, then running sums inside each (key, chunk) plus that carry.
    """
    d = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(width)))
    for name, v in values.items():
        d = d.withColumn(f"_v_{name}", v)
    tot = d.groupBy(key, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    wc = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select(key, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(wc), F.lit(0)).alias(f"_c_{n}")
                                        for n in values])
    wi = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = d.join(carry, [key, "_chunk"], "left")
    for n in values:
        out = out.withColumn(n, F.coalesce(F.col(f"_c_{n}"), F.lit(0))
                             + F.coalesce(F.sum(f"_v_{n}").over(wi), F.lit(0)))
    return out.drop("_chunk", *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])


def running_sums(df: DataFrame, key: str, order: str, values: dict[str, Column], hot: DataFrame | None, width: int) -> DataFrame:
    """:func:`prefix_sums`, in two levels for the ``hot`` keys (None: there
    are none) alone: chunks of any other key would be a few lines each."""
    def one_level(d):
        w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return d.withColumns({n: F.coalesce(F.sum(v).over(w), F.lit(0)) for n, v in values.items()})
    if hot is None:
        return one_level(df)
    few = F.broadcast(hot.select(F.col(key).alias("_hot")))
    same = F.col(key).eqNullSafe(F.col("_hot"))
    return one_level(df.join(few, same, "left_anti")).unionByName(prefix_sums(df.join(few, same, "left_semi"), key, order, values, width))


SCHEMA = ["order_id", "product_id", "q", "stock", "lo", "st", "open"]


def admit_orders(lines: DataFrame, products: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Return ``order_id, admitted, decided_round`` for every order with lines.
    A line of an unknown product refuses its order."""
    rounds = Rounds(lines.sparkSession, "admission")
    merged = (lines.groupBy("order_id", "product_id").agg(F.sum("quantity").cast("long").alias("q"))
                   .join(products.select("product_id", F.col("stock").cast("long").alias("stock")),
                         "product_id", "left"))
    merged = rounds.write(merged, "lines")
    demand = rounds.write(merged.groupBy("product_id", "stock").agg(F.sum("q").alias("_total"), F.count(F.lit(1)).alias("_lines")), "demand")
    # One row a product and stock it is listed with; lines are there once for each.
    totals = demand.groupBy("product_id").agg(F.sum("_total").alias("_total"), F.min("stock").alias("stock"))
    binding = totals.where("_total > stock").select("product_id")
    # At most as many products as lines / chunk_lines.
    hot = demand.where(F.col("_lines") > chunk_lines).select("product_id").distinct()
    hot = None if hot.isEmpty() else hot
    held = merged.join(binding, "product_id", "left_semi").unionByName(merged.where("stock IS NULL"))
    now = rounds.write(held.select("order_id", "product_id", "q", "stock", F.lit(0).cast("long").alias("lo"),
                                   F.lit("u").alias("st"), F.lit(1).alias("open")), "round-0", "open")
    n, least, most = now.agg(F.count("*"), F.min("order_id"), F.max("order_id")).first()
    width = max(1, (most - least + 1) * chunk_lines // n + 1) if n and least is not None else 1
    per_order = Window.partitionBy("order_id")
    done, k = [], 0
    while rounds.exists(f"round-{k}/open=1"):
        k += 1
        sums = running_sums(now, "product_id", "order_id",
                            {"_yes": F.when(F.col("st") == "y", F.col("q")).otherwise(0),
                             "_ahead": F.when(F.col("st") == "u", F.col("q")).otherwise(0)}, hot, width)
        open_lines = sums.where("st = 'u'").withColumn("lo", F.col("lo") + F.col("_yes"))
        fits = F.coalesce(F.col("lo") + F.col("_ahead") + F.col("q") <= F.col("stock"), F.lit(False))
        fails = F.coalesce(F.col("lo") + F.col("q") > F.col("stock"), F.lit(True))
        judged = open_lines.withColumn("_fits", F.min(fits).over(per_order)).withColumn("_fails", F.max(fails).over(per_order))
        st = F.when(F.col("_fails"), "n").when(F.col("_fits"), "y").otherwise("u")
        step = judged.withColumn("st", st).withColumn("open", F.when(F.col("st") == "u", 1).otherwise(0)).select(*SCHEMA)
        now = rounds.write(step, f"round-{k}", "open")
        rounds.drop(f"round-{k - 1}/open=1")
        done.append(now.where("open = 0").select("order_id", (F.col("st") == "y").alias("admitted"),
                                                 F.lit(k).alias("decided_round")))
    rounds.drop("demand")
    # Orders of unbound lines alone are admitted at once. An order's open lines
    # are decided together, so one aggregate brings each its verdict.
    decided = merged.select("order_id", F.lit(None).cast("boolean").alias("admitted"), F.lit(None).cast("int").alias("decided_round"))
    for d in done:
        decided = decided.unionByName(d.where("order_id IS NOT NULL"))
    return decided.groupBy("order_id").agg(F.coalesce(F.max("admitted"), F.lit(True)).alias("admitted"),
                                           F.coalesce(F.max("decided_round"), F.lit(1)).alias("decided_round"))
