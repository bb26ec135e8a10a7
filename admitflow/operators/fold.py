"""the keyed ordered fold.

Greedy admission is order dependent (a denied request must not count), so
it is not a window aggregate. The plan is:

    repartition(key [, segment]) -> sortWithinPartitions(key, segment, t, seq)
      -> mapInArrow(fold)

The fold streams Arrow batches of a sorted partition and carries the state
of the current key across batch boundaries, so it never materialises a key
or a partition: memory is O(1) per key (O(limit) for the sliding log) and
the sort spills. Input columns pass through untouched as Arrow arrays;
only the key, time and the output columns cross into Python lists.

Hot keys are found by one small job over the key column (counts, combined
before the shuffle): keys with more rows than ``spark.admitflow.hotKeyRows``
and than a shuffle partition's share of all rows, so there are fewer of them
than partitions. Without any, a fold is one read and one shuffle. A hot key is
split in two steps, each with the same result as the serial fold:

1. At points where its state provably resets. For every limiter here that is
   a bucket of width ``window`` (aligned to the grid, or to the key's first
   request for the anchored counter) with no request in it: the time gap is
   then > window, which refills a bucket, empties a log and clears both
   counters.
2. Runs that are still long (traffic in every bucket, or a fold that never
   resets, as the ledger's) are cut anywhere and folded by speculation, see
   :mod:`admitflow.operators.speculative`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_by_value

# A stepper factory ``make(cur=None)`` returns ``run(idents, times, anchors,
# *extra_inputs) -> {output name: list}``; per-key state lives in ``cur``
# (exposed as ``run.cur``), carried between calls and resumable, which is
# how the streaming twins restart a fold from stored state.
StepperFactory = Callable[..., Callable[..., dict]]


def _arrow_type(dt: T.DataType) -> pa.DataType:
    return {T.BooleanType: pa.bool_(), T.IntegerType: pa.int32(),
            T.LongType: pa.int64(), T.StringType: pa.string()}[type(dt)]


def values(a: pa.Array) -> list:
    """``a.to_pylist()``, which makes an Arrow scalar of every value and so costs
    more than a fold's step; integers, strings and flags come by way of numpy."""
    if pa.types.is_string(a.type) or pa.types.is_boolean(a.type):
        return a.to_numpy(zero_copy_only=False).tolist()
    if not pa.types.is_integer(a.type):
        return a.to_pylist()
    if not a.null_count:
        return a.to_numpy(zero_copy_only=False).tolist()
    # to_numpy would turn integers with NULLs into floats
    out = a.fill_null(0).to_numpy(zero_copy_only=False).astype(object)
    out[a.is_null().to_numpy(zero_copy_only=False)] = None
    return out.tolist()


# None: read the hot-key threshold from spark.admitflow.hotKeyRows.
HOT_KEY_ROWS = None


def hot_keys(df: DataFrame, key: str, time_col: str, hot_key_rows: int | None = HOT_KEY_ROWS) -> tuple[DataFrame | None, int]:
    """What :func:`hot_keys_and_last` says of hot keys alone."""
    return hot_keys_and_last(df, key, time_col, hot_key_rows)[:2]


def hot_keys_and_last(df: DataFrame, key: str, time_col: str,
                      hot_key_rows: int | None = HOT_KEY_ROWS) -> tuple[DataFrame | None, int, int | None]:
    """(key, _t0: its first time) of the hot keys, None without any, the number
    of rows above which a key is hot, and the last time of any key. At most as many keys as shuffle
    partitions (or as rows / ``hot_key_rows``, where that is given)."""
    spark = df.sparkSession
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(time_col).alias("_t0"), F.max(time_col).alias("_t1"))
    whole = counts.agg(F.sum("_n").alias("rows"), F.max("_n").alias("most"), F.max("_t1").alias("last")).first()
    if hot_key_rows is None:
        from ..session import hot_key_rows as _conf_rows
        parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        hot_key_rows = max(_conf_rows(spark), (whole["rows"] or 0) // parts)
    if (whole["most"] or 0) <= hot_key_rows:
        return None, hot_key_rows, whole["last"]
    hot = counts.where(F.col("_n") > hot_key_rows).select(key, "_t0")
    return spark.createDataFrame(hot.collect(), hot.schema), hot_key_rows, whole["last"]


def reset_runs(rows: DataFrame, key: str, time_col: str, width: int, anchor_first: bool = False) -> DataFrame:
    """Append ``_seg`` to rows of hot keys (with ``_t0``): the index of the
    run of consecutive non-empty ``width`` buckets the row falls in. Runs are
    found on the distinct (key, bucket) table and joined back; a row without a
    time is in run 0."""
    # Hot keys carry their anchor (first request) explicitly, because their
    # later segments do not start at it; other keys take it in the fold.
    rel = F.col(time_col) - (F.col("_t0") if anchor_first else F.lit(0))
    tagged = rows.withColumn("_b", F.floor(rel / F.lit(width)).cast("long"))
    w = Window.partitionBy(key).orderBy("_b")
    runs = (tagged.select(key, "_b").distinct()
                  .withColumn("_seg", F.sum(F.when(F.col("_b") - F.lag("_b").over(w) > 1, 1)
                                             .otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return (tagged.join(runs, [key, "_b"], "left")
                  .withColumn("_seg", F.coalesce(F.col("_seg"), F.lit(0).cast("long"))).drop("_b"))


def keyed_fold(df: DataFrame, key: str, time_col: str, seq_col: str | list[str],
               make_stepper: StepperFactory, out_fields: list[T.StructField],
               split_width: int | None = None, anchor_first: bool = False,
               num_partitions: int | None = None, extra_inputs: list[str] | None = None,
               hot_key_rows: int | None = HOT_KEY_ROWS, lead_cols: list[str] | None = None,
               returned: list[str] | None = None, only: str | None = None,
               hot: tuple[DataFrame | None, int] | None = None) -> DataFrame:
    """Run ``make_stepper``'s fold over each key in (time, seq) order
    (``lead_cols``, if any, come before the time).

    Returns ``df`` with ``out_fields`` appended (one output row per input
    row), or the columns ``returned`` of those, since no others need to cross
    the Python boundary. With ``only`` (a column of ``df``) every row is
    folded, but those come back in which it is not NULL. ``hot`` takes what
    :func:`hot_keys` says of other rows of about these keys and numbers, so that
    a ``df`` that costs much is made once, by the fold; no result depends on it,
    but with ``anchor_first`` the first times must be those of ``df``.
    """
    ship_by_value(make_stepper)
    plan = FoldPlan(key, time_col, [seq_col] if isinstance(seq_col, str) else list(seq_col), make_stepper, list(out_fields),
                    anchor_first, list(extra_inputs or []), list(lead_cols or []), returned or [*df.columns, *[f.name for f in out_fields]], only)
    hot, rows = hot or hot_keys(df, key, time_col, hot_key_rows)
    if hot is None:
        return plan.folded(df, num_partitions)
    few = F.broadcast(hot)
    cold = plan.folded(df.join(few.select(key), key, "left_anti"), num_partitions)
    split = df.join(few, key)
    split = reset_runs(split, key, time_col, split_width, anchor_first) if split_width else split.withColumn("_seg", F.lit(0).cast("long"))
    from .speculative import speculative_fold
    whole = speculative_fold(split, plan, rows)
    whole = whole.where(F.col(f"`{only}`").isNotNull()) if only else whole
    names = [F.col(f"`{c}`") for c in plan.returned]
    return cold.select(*names).unionByName(whole.select(*names))


class FoldPlan:
    """What a fold reads, does and appends."""

    def __init__(self, key: str, time_col: str, ties: list[str], make: StepperFactory, out_fields: list[T.StructField],
                 anchor_first: bool, extra_inputs: list[str], lead_cols: list[str], returned: list[str], only: str | None):
        self.key, self.time, self.ties, self.make, self.out_fields = key, time_col, ties, make, out_fields
        self.anchor_first, self.extra, self.lead = anchor_first, extra_inputs, lead_cols
        self.returned, self.only = returned, only

    @property
    def order(self) -> list[str]:
        return [*self.lead, self.time, *self.ties]

    def appended(self) -> Callable:
        """``columns(run, batch)``: the batch's arrays and those the stepper adds."""
        names = [f.name for f in self.out_fields]
        types = [_arrow_type(f.dataType) for f in self.out_fields]
        key, time, extra, anchor = self.key, self.time, self.extra, self.anchor_first

        def columns(run, b: pa.RecordBatch) -> list[pa.Array]:
            # (key, segment) identifies one independent fold.
            split = "_seg" in b.schema.names
            ident = list(zip(values(b[key]), values(b["_seg"]) if split else repeat(0)))
            anchors = (values(b["_t0"]) if split else [None] * b.num_rows) if anchor else None
            out = run(ident, values(b[time]), anchors, *[values(b[c]) for c in extra])
            return list(b.columns) + [pa.array(out[nm], type=ty) for nm, ty in zip(names, types)]
        return columns

    def folded(self, df: DataFrame, num_partitions: int | None, whole: bool = False) -> DataFrame:
        """Fold every (key, ``_seg``) of ``df``, or every key where it has no
        ``_seg``, from its start, in one shuffle; the columns and rows asked for,
        or all of them."""
        # Spread by a hash of the fold's own: no join or aggregate below is
        # partitioned by it, so the planner cannot take their partitioning for the
        # fold's (AQE would then be free to split a skewed key over tasks).
        keys = [c for c in (self.key, "_seg") if c == self.key or c in df.columns]
        spread = F.xxhash64(*keys)
        # Without an explicit count the shuffle starts at spark.sql.shuffle.partitions
        # and AQE may merge small partitions; hash partitioning keeps keys whole.
        parted = df.repartition(num_partitions, spread) if num_partitions else df.repartition(spread)
        ordered = parted.sortWithinPartitions(*keys, *self.order)
        added = [f.name for f in self.out_fields]
        returned, only = ([*ordered.columns, *added], None) if whole else (self.returned, self.only)
        # What only placed a row has done so by now.
        read = {self.key, self.time, "_seg", "_t0", only, *self.extra, *returned}
        ordered = ordered.select(*[F.col(f"`{c}`") for c in ordered.columns if c in read])
        every = T.StructType(list(ordered.schema.fields) + self.out_fields)
        names, make, columns = every.fieldNames(), self.make, self.appended()

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            run = make()
            for b in batches:
                if b.num_rows:
                    arrays = dict(zip(names, columns(run, b)))
                    out = pa.RecordBatch.from_arrays([arrays[c] for c in returned], names=returned)
                    out = out.filter(arrays[only].is_valid()) if only else out
                    if out.num_rows:
                        yield out

        return ordered.mapInArrow(fold, T.StructType([every[c] for c in returned]))


def check_limit(limit: int, window_us: int) -> None:
    """Bad parameters fail while the plan is built, not inside a task."""
    if not isinstance(limit, int) or limit <= 0:
        raise ValueError(f"limit must be a positive integer, got {limit!r}")
    if not isinstance(window_us, int) or window_us <= 0:
        raise ValueError(f"window must be a positive number of microseconds, got {window_us!r}")
    if limit * window_us >= 2 ** 63:
        raise ValueError("limit * window must stay below 2**63")


def key_column(df: DataFrame, key: str | Column, name: str = "key") -> tuple[DataFrame, str]:
    """Materialise an arbitrary key expression as a named column."""
    if isinstance(key, str):
        return df, key
    return df.withColumn(name, key), name
