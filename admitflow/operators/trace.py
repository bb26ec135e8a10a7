"""TR1-TR5: one-id trace reconstruction across services.

Per-trace aggregates only collect bounded things (the set of services);
the ordered steps of a trace stay one row per step (TR1, TR4) so a trace
with millions of lines is never gathered into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The services every checkout trace must pass through.
REQUIRED_SERVICES = ["gateway", "orders", "payment"]


def trace(logs: DataFrame, correlation_id: Column) -> DataFrame:
    """TR1: every line of one id in time order (filter + sort; the filter
    is pushed into the scan when logs are stored by id)."""
    return (logs.where(F.col("correlation_id") == correlation_id)
                .orderBy("ts_us", "line_no"))


def traces(logs: DataFrame) -> DataFrame:
    """TR2: per id: services seen, steps, start, end, duration, first and
    last service."""
    pos = F.struct("ts_us", "line_no")
    return (logs.where(F.col("correlation_id").isNotNull())
                .groupBy("correlation_id")
                .agg(F.array_join(F.array_sort(F.collect_set("service")), ",").alias("services"),
                     F.count(F.lit(1)).alias("steps"),
                     F.min("ts_us").alias("start_us"),
                     F.max("ts_us").alias("end_us"),
                     F.min_by("service", pos).alias("first_service"),
                     F.max_by("service", pos).alias("last_service"))
                .withColumn("duration_us", F.col("end_us") - F.col("start_us")))


def trace_steps(logs: DataFrame, hot_trace_lines: int | None = None) -> DataFrame:
    """TR2: every trace's steps in time order, a row a step with its number.
    A hot trace is numbered inside time chunks, to which the lines of the
    chunks before are added from the small per-chunk table, so no task holds
    a trace (see :func:`step_latency`)."""
    plain, split = _hot_chunks(logs.where(F.col("correlation_id").isNotNull()), hot_trace_lines)
    order = ["ts_us", "service", "line_no"]
    plain = plain.withColumn("step", F.row_number().over(Window.partitionBy("correlation_id").orderBy(*order)))
    before = Window.partitionBy("correlation_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = split.groupBy("correlation_id", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    carry = sizes.select("correlation_id", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    split = split.withColumn("_in", F.row_number().over(Window.partitionBy("correlation_id", "_chunk").orderBy(*order)))
    split = split.join(carry, ["correlation_id", "_chunk"]).withColumn("step", F.col("_in") + F.col("_before"))
    cols = ["correlation_id", F.col("step").cast("bigint").alias("step"), "ts_us", "service", "msg"]
    return plain.select(*cols).unionByName(split.select(*cols))


def trace_gaps(logs: DataFrame, required: list[str] = REQUIRED_SERVICES) -> DataFrame:
    """TR3: ids whose trace misses a required service."""
    seen = (logs.where(F.col("correlation_id").isNotNull())
                .groupBy("correlation_id").agg(F.collect_set("service").alias("_seen")))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(s) for s in required]), F.col("_seen")))
    return (seen.select("correlation_id", missing.alias("_m"))
                .where(F.size("_m") > 0)
                .select("correlation_id", F.array_join("_m", ",").alias("missing")))


# A trace with more lines than this is split into time chunks for TR4.
HOT_TRACE_LINES = None  # None: spark.admitflow.hotKeyRows


def _hot_chunks(lines: DataFrame, hot_trace_lines: int | None) -> tuple[DataFrame, DataFrame]:
    """Lines of ordinary traces, and those of hot ones with the time chunk
    (``_chunk``) they are in."""
    if hot_trace_lines is None:
        from ..session import hot_key_rows
        hot_trace_lines = hot_key_rows(lines.sparkSession)
    hot = F.broadcast(lines.groupBy("correlation_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts_us").alias("_t0"), F.max("ts_us").alias("_t1")).where(F.col("_n") > hot_trace_lines))
    width = F.floor((F.col("_t1") - F.col("_t0")) / F.ceil(F.col("_n") / F.lit(max(1, hot_trace_lines)))) + 1
    tagged = (lines.join(hot, "correlation_id")
                   .withColumn("_chunk", F.floor((F.col("ts_us") - F.col("_t0")) / width)).drop("_n", "_t0", "_t1"))
    return lines.join(hot, "correlation_id", "left_anti"), tagged


def step_latency(logs: DataFrame, hot_trace_lines: int | None = HOT_TRACE_LINES) -> DataFrame:
    """TR4: time from the previous step of the same trace.

    Ordinary traces use ``lag`` over one window per id. A hot trace (more
    than ``hot_trace_lines`` lines) is cut into time chunks of about that many
    lines: ``lag`` runs per (id, chunk) and a chunk's first line takes the last
    step of the previous non-empty chunk from the small per-chunk table, so
    the result is the same and no task holds the whole trace. Both kinds are
    in one plan; the list of hot traces has at most lines / hot_trace_lines
    rows, so it is broadcast.
    """
    lines = logs.where(F.col("correlation_id").isNotNull())
    pos = F.struct("ts_us", "service", "line_no")
    step = F.struct(F.col("ts_us").alias("ts_us"), F.col("service").alias("service"))
    plain, tagged = _hot_chunks(lines, hot_trace_lines)
    w = Window.partitionBy("correlation_id").orderBy("ts_us", "service", "line_no")
    plain = plain.withColumn("_prev", F.lag(step).over(w))
    wi = Window.partitionBy("correlation_id", "_chunk").orderBy("ts_us", "service", "line_no")
    last = tagged.groupBy("correlation_id", "_chunk").agg(F.max_by(step, pos).alias("_last"))
    wc = Window.partitionBy("correlation_id").orderBy("_chunk")
    carry = last.select("correlation_id", "_chunk", F.lag("_last").over(wc).alias("_carry"))
    split = (tagged.withColumn("_in", F.lag(step).over(wi)).join(carry, ["correlation_id", "_chunk"], "left")
                   .withColumn("_prev", F.coalesce("_in", "_carry")).drop("_chunk", "_in", "_carry"))
    d = plain.unionByName(split)
    return d.select("correlation_id", "line_no", "service", "msg", "ts_us",
                    F.col("_prev.service").alias("prev_service"),
                    (F.col("ts_us") - F.col("_prev.ts_us")).alias("gap_us"))


def uncorrelated(logs: DataFrame) -> DataFrame:
    """TR5: lines without an id (absent, never empty)."""
    return logs.where(F.col("correlation_id").isNull())
