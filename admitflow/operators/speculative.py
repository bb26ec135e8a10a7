"""Speculative segment fold: one key's ordered fold in several tasks.

A fold's state after a row depends on all rows before it, so a key without a
reset point folds serially. Here its rows are cut into pieces of about a
partition's rows, at any point in time, and all pieces are folded at once from
a guessed entry state (a fresh start). Each piece's exit state is then compared
with the state its successor was folded from; pieces whose entry was wrong are
folded again from the right one, until none differs. Folds that forget (window
counters, buckets that fill, logs that empty) settle after one or two rounds;
one that never forgets needs a round a piece at most, and then only the first
wrong piece of a key, which surely becomes final, is folded in a round, so the
work is never more than a few times the serial fold's.

Every round's rows and states are tables below the shared checkpoint
directory. States are one row a piece; the driver sees none of them.
Rows of the same instant are in one piece. Rows of the lowest lead column (the
ledger's opening stock) are given to every piece as its fresh start, and come
out once.
"""

from __future__ import annotations

import io
import pickle
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Rounds
from .fold import values

MIN_PIECE_ROWS = 10_000  # smaller pieces are not worth a task
BUCKETS = 64  # time buckets a piece, among which cuts are chosen
GUESSES = 2  # rounds that fold all wrong pieces again; later ones the first of each run


def freeze(state) -> bytes:
    """A state as bytes that are equal for equal states."""
    def plain(x):
        if isinstance(x, dict):
            return ("dict", sorted(((plain(k), plain(v)) for k, v in x.items()), key=repr))
        if isinstance(x, deque):
            return ("deque", [plain(v) for v in x])
        if isinstance(x, (list, tuple)):
            return (type(x).__name__, [plain(v) for v in x])
        return x
    out = io.BytesIO()
    p = pickle.Pickler(out, protocol=4)
    p.fast = True  # no references to equal parts
    p.dump(plain(state))
    return out.getvalue()


def thaw(data: bytes):
    def back(x):
        if not isinstance(x, tuple):
            return x
        kind, parts = x
        if kind == "dict":
            return {back(k): back(v) for k, v in parts}
        parts = [back(v) for v in parts]
        return {"deque": deque, "tuple": tuple, "list": list}[kind](parts)
    return back(pickle.loads(data))


def _long_runs(rows: DataFrame, key: str, time_col: str, piece_rows: int) -> DataFrame:
    """(key, _seg, _b0, _width) of runs of more than ``piece_rows`` rows: their
    first time, and the width of time buckets of which ``BUCKETS`` make a piece."""
    runs = rows.groupBy(key, "_seg").agg(F.count(F.lit(1)).alias("_n"), F.min(time_col).alias("_b0"), F.max(time_col).alias("_b1"))
    runs = runs.where(F.col("_n") > piece_rows)
    width = F.floor((F.col("_b1") - F.col("_b0")) / (F.ceil(F.col("_n") / piece_rows) * BUCKETS)).cast("long") + 1
    return runs.select(key, "_seg", "_b0", width.alias("_width"))


def speculative_fold(rows: DataFrame, plan, hot_rows: int) -> DataFrame:
    """Fold ``rows`` (of hot keys, with ``_seg`` and ``_t0``) by ``plan``, a
    :class:`admitflow.operators.fold.FoldPlan`."""
    key, time_col = plan.key, plan.time
    piece_rows = max(hot_rows, MIN_PIECE_ROWS)
    tables = Rounds(rows.sparkSession, "speculative")
    # One row a run, so at most rows / piece_rows of them.
    runs = tables.write(_long_runs(rows, key, time_col, piece_rows), "runs")
    if runs.isEmpty() or not hasattr(plan.make(), "cur"):  # nothing long, or a state that cannot be taken up again
        tables.drop("runs")
        return plan.folded(rows, None, whole=True)
    # One row a run and bucket: BUCKETS a piece.
    bucketed = rows.join(F.broadcast(runs), [key, "_seg"]).withColumn("_b", F.floor((F.col(time_col) - F.col("_b0")) / F.col("_width")).cast("long"))
    sizes = bucketed.where("_b is not null").groupBy(key, "_seg", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key, "_seg").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    cuts = tables.write(sizes.select(key, "_seg", "_b", F.floor(F.coalesce(before, F.lit(0)) / piece_rows).cast("long").alias("_piece")), "cuts")
    cut = bucketed.join(cuts, [key, "_seg", "_b"], "left").drop("_b", "_b0", "_width")
    cut = cut.unionByName(rows.join(F.broadcast(runs.select(key, "_seg")), [key, "_seg"], "left_anti").withColumn("_piece", F.lit(0).cast("long")))
    cut = cut.withColumn("_piece", F.coalesce("_piece", F.lit(0).cast("long"))).withColumn("_copy", F.lit(False))
    if plan.lead:  # every piece begins as the key does
        last = cuts.groupBy(key, "_seg").agg(F.max("_piece").alias("_last"))
        opening = rows.join(last, [key, "_seg"]).where(F.col(plan.lead[0]) == F.lit(0)).where("_last > 0")
        opening = opening.withColumn("_piece", F.explode(F.expr("sequence(1L, _last)"))).drop("_last").withColumn("_copy", F.lit(True))
        cut = cut.unionByName(opening)
    cut = tables.write(cut, "rows")
    names = [key, "_seg", "_piece"]
    todo = cut.select(*names).distinct().withColumn("_entry", F.lit(None).cast("binary"))
    states, rounds, k = None, [], 0
    while True:
        todo = tables.write(todo, f"todo-{k}")
        done = tables.write(_round(cut, todo, plan), f"round-{k}")
        rounds.append(done)
        exits = done.where("_role = 2").select(*names, F.col("_state").alias("_exit"))
        now = todo.join(exits, names).withColumn("_round", F.lit(k))
        if states is not None:
            now = now.unionByName(states.join(todo.select(*names), names, "left_anti"))
        states = tables.write(now, f"states-{k}")
        if k:
            tables.drop(f"states-{k - 1}")
        before = F.lag("_exit").over(Window.partitionBy(key, "_seg").orderBy("_piece"))  # one row a piece
        wrong = states.withColumn("_right", before).where(F.col("_right").isNotNull() & ~F.col("_entry").eqNullSafe(F.col("_right")))
        if k + 1 >= GUESSES:
            first = wrong.groupBy(key, "_seg").agg(F.min("_piece").alias("_piece"))
            wrong = wrong.join(first, names, "left_semi")
        todo = wrong.select(*names, F.col("_right").alias("_entry"))
        k += 1
        if todo.isEmpty():
            break
    final = states.select(*names, "_round")
    out = None
    for r in range(k):
        rows_of = rounds[r].where("_role = 1 and not _copy").withColumn("_round", F.lit(r))
        kept = rows_of.join(F.broadcast(final.where(F.col("_round") == r).drop("_round")), names, "left_semi")
        out = kept if out is None else out.unionByName(kept)
    tables.drop("runs")
    tables.drop("cuts")
    return out.drop("_seg", "_t0", "_piece", "_copy", "_role", "_state", "_round")


def _round(cut: DataFrame, todo: DataFrame, plan) -> DataFrame:
    """Fold the pieces of ``todo`` from their entry states: their rows with
    the fold's columns (``_role`` 1), and a row with each exit state (2)."""
    key = plan.key
    names = [key, "_seg", "_piece"]
    rows = cut.join(F.broadcast(todo.select(*names)), names, "left_semi").withColumn("_role", F.lit(1)).withColumn("_state", F.lit(None).cast("binary"))
    entries = todo.withColumn("_role", F.lit(0)).withColumnRenamed("_entry", "_state")
    both = rows.unionByName(entries, allowMissingColumns=True)
    ordered = both.withColumn("_fold", F.xxhash64(*names)).repartition("_fold").sortWithinPartitions(*names, "_role", *plan.order).drop("_fold")
    schema = T.StructType(list(ordered.schema.fields) + plan.out_fields)
    columns, make = plan.appended(), plan.make
    field_names = schema.fieldNames()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = last = None
        empty = None

        def exit_row():
            arrays = [pa.nulls(1, t) for t in empty]
            for name, value in zip([*names, "_role", "_state", "_copy"], [*last, 2, freeze(run.cur), False]):
                i = field_names.index(name)
                arrays[i] = pa.array([value], empty[i])
            return pa.RecordBatch.from_arrays(arrays, names=field_names)

        for b in batches:
            ident = list(zip(*(values(b[c]) for c in names)))
            at = 0
            while at < b.num_rows:
                end = at + 1
                while end < b.num_rows and ident[end] == ident[at]:
                    end += 1
                if ident[at] != last:
                    if run is not None:
                        yield exit_row()
                    last = ident[at]
                    state = b["_state"][at].as_py()  # the entry row comes first
                    run = make(thaw(state)) if state is not None else make()
                    at += 1
                if end > at:
                    part = b.slice(at, end - at)
                    arrays = columns(run, part)
                    empty = empty or [a.type for a in arrays]
                    yield pa.RecordBatch.from_arrays(arrays, names=field_names)
                at = end
        if run is not None:
            yield exit_row()

    return ordered.mapInArrow(fold, schema)
