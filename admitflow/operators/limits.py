"""Rate-limit admission over a keyed request table.

``rate_limit(df, key, algorithm, limit, window_us)`` appends
``allowed, limit, remaining, reset_after_us, retry_after_us, state_entries``
to every request. All arithmetic is exact integers in microseconds:

* token bucket: the level is kept in 1/W-token units, full = C*W; an
  elapsed e refills min(e, W)*C; a request is admitted iff level >= W.
* sliding window log: admitted times newer than now - W; admit iff fewer
  than C remain; denied requests leave nothing behind.
* sliding window counter: admit iff prev*(W-e) + curr*W + W <= C*W, with
  windows on the global grid floor(t/W) (``anchor='grid'``) or starting at
  the key's first request (``anchor='first_request'``).

Waits are rounded up to the microsecond so a client that waits exactly
``retry_after_us`` is admitted. Input time must be data (an event or
arrival column), never executor time; ties are broken by ``seq``.
A clock that runs backwards adds no refill and does not move the
bucket's last-seen time back.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fold import check_limit, key_column, keyed_fold

ALGORITHMS = ("token_bucket", "sliding_window_log", "sliding_window_counter")
ANCHORS = ("grid", "first_request")


OUT_FIELDS = [
    T.StructField("allowed", T.BooleanType()),
    T.StructField("limit", T.IntegerType()),
    T.StructField("remaining", T.LongType()),
    T.StructField("reset_after_us", T.LongType()),
    T.StructField("retry_after_us", T.LongType()),
    T.StructField("state_entries", T.IntegerType()),
]


def _ceil_div(a: int, b: int) -> int:
    return -((-a) // b)


def token_bucket_stepper(C: int, W: int):
    def make(cur=None):
        full = C * W
        cur = cur if cur is not None else [None, 0, 0]  # ident, level, last

        def run(ident, times, anchors):
            n = len(times)
            allowed = [False] * n
            remaining = [0] * n
            reset = [0] * n
            retry = [0] * n
            k, tok, last = cur
            for i in range(n):
                t = times[i]
                if t is None:  # no time: undecidable, reported as NULL, state untouched
                    allowed[i] = remaining[i] = reset[i] = retry[i] = None
                    continue
                if ident[i] != k:
                    k = ident[i]
                    tok = full
                    last = t
                else:
                    e = t - last
                    if e > 0:
                        tok = min(full, tok + min(e, W) * C)
                        last = t
                if tok >= W:
                    tok -= W
                    allowed[i] = True
                    remaining[i] = tok // W
                else:
                    retry[i] = _ceil_div(W - tok, C)
                reset[i] = _ceil_div(full - tok, C)
            cur[0], cur[1], cur[2] = k, tok, last
            return {"allowed": allowed, "limit": [C] * n, "remaining": remaining,
                    "reset_after_us": reset, "retry_after_us": retry, "state_entries": [1] * n}
        run.cur = cur
        return run
    return make


def sliding_log_stepper(C: int, W: int):
    def make(cur=None):
        cur = cur if cur is not None else [None, deque()]

        def run(ident, times, anchors):
            n = len(times)
            allowed = [False] * n
            remaining = [0] * n
            reset = [0] * n
            retry = [0] * n
            entries = [0] * n
            k, log = cur
            for i in range(n):
                t = times[i]
                if t is None:
                    allowed[i] = remaining[i] = reset[i] = retry[i] = entries[i] = None
                    continue
                if ident[i] != k:
                    k = ident[i]
                    log = deque()
                cutoff = t - W
                while log and log[0] <= cutoff:
                    log.popleft()
                if len(log) < C:
                    log.append(t)
                    allowed[i] = True
                    remaining[i] = C - len(log)
                else:
                    retry[i] = min(max(log[0] + W - t, 0), W)
                if log:
                    reset[i] = min(max(log[-1] + W - t, 0), W)
                entries[i] = len(log)
            cur[0], cur[1] = k, log
            return {"allowed": allowed, "limit": [C] * n, "remaining": remaining,
                    "reset_after_us": reset, "retry_after_us": retry, "state_entries": entries}
        run.cur = cur
        return run
    return make


def sliding_counter_stepper(C: int, W: int, anchored: bool = False):
    """Grid windows, or (``anchored``) windows starting at the key's first
    request: the anchor is the row's ``anchors`` value when given, else
    the time of the first row the fold sees for the key (rows arrive in
    time order, so that is the key's first request)."""
    def make(cur=None):
        full = C * W
        # ident, window index, curr, prev, anchor
        cur = cur if cur is not None else [None, 0, 0, 0, 0]

        def run(ident, times, anchors):
            n = len(times)
            allowed = [False] * n
            remaining = [0] * n
            reset = [0] * n
            retry = [0] * n
            k, win, curr, prev, a0 = cur
            for i in range(n):
                if times[i] is None:
                    allowed[i] = remaining[i] = reset[i] = retry[i] = None
                    continue
                if ident[i] != k:
                    a0 = 0
                    if anchored:
                        a0 = anchors[i] if anchors is not None and anchors[i] is not None else times[i]
                rel = times[i] - a0
                idx = rel // W
                e = rel - idx * W
                if ident[i] != k:
                    k = ident[i]
                    win, curr, prev = idx, 0, 0
                elif idx == win + 1:
                    prev, curr = curr, 0
                elif idx > win + 1:
                    prev, curr = 0, 0
                win = idx
                load = prev * (W - e) + curr * W + W
                rest = W - e
                if load <= full:
                    curr += 1
                    allowed[i] = True
                    remaining[i] = (full - load) // W
                else:
                    # Admitted later in this window once prev * (W - e') <= full - W - curr * W,
                    # that is e' = W - floor(that / prev); with no room for it even then, or
                    # with nothing to wait out, when the next window has begun and this one's
                    # count has faded enough.
                    room = (C - 1 - curr) * W
                    if prev and room > 0:
                        r = min(rest, W - room // prev - e)
                    elif prev:
                        r = rest
                    else:
                        r = rest + _ceil_div(max(0, curr - C + 1) * W, curr)
                    retry[i] = r
                reset[i] = rest
            cur[0], cur[1], cur[2], cur[3], cur[4] = k, win, curr, prev, a0
            return {"allowed": allowed, "limit": [C] * n, "remaining": remaining,
                    "reset_after_us": reset, "retry_after_us": retry, "state_entries": [1] * n}
        run.cur = cur
        return run
    return make


def rate_limit(df: DataFrame, key: str | Column, algorithm, limit: int, window_us: int,
               time_col: str = "t_us", seq_col: str = "seq", anchor: str = "grid",
               split_hot_keys: bool = True, num_partitions: int | None = None,
               hot_key_rows: int | None = None) -> DataFrame:
    """Append the limiter decision to every row of ``df``.

    ``key`` is a column name or any Column (e.g. :func:`limit_key`);
    rows of one key are decided in (``time_col``, ``seq_col``) order.
    """
    check_limit(limit, window_us)
    if callable(algorithm):
        # User-defined limiter: algorithm(limit, window_us) returns a stepper
        # factory with the same contract as the built-ins (make(cur=None) ->
        # run(ident, times, anchors) -> dict of the OUT_FIELDS lists).
        df, kname = key_column(df, key, "key")
        return keyed_fold(df, kname, time_col, seq_col, algorithm(limit, window_us), OUT_FIELDS,
                          num_partitions=num_partitions)
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}, got {algorithm!r}")
    if anchor not in ANCHORS:
        raise ValueError(f"anchor must be one of {ANCHORS}, got {anchor!r}")
    df, kname = key_column(df, key, "key")
    anchored = algorithm == "sliding_window_counter" and anchor == "first_request"
    if algorithm == "sliding_window_counter":
        make = sliding_counter_stepper(limit, window_us, anchored)
    else:
        make = {"token_bucket": token_bucket_stepper,
                "sliding_window_log": sliding_log_stepper}[algorithm](limit, window_us)
    extra = {} if hot_key_rows is None else {"hot_key_rows": hot_key_rows}
    return keyed_fold(df, kname, time_col, seq_col, make, OUT_FIELDS,
                      split_width=window_us if split_hot_keys else None,
                      anchor_first=anchored, num_partitions=num_partitions, **extra)


def _side_by_side(makes: dict):
    """One stepper that runs several over the same rows."""
    def make(cur=None):
        runs = {name: m(cur[name] if cur else None) for name, m in makes.items()}

        def run(ident, times, anchors):
            return {f"{name}_{k}": v for name, r in runs.items() for k, v in r(ident, times, anchors).items()}
        run.cur = {name: r.cur for name, r in runs.items()}
        return run
    return make


def _per_value(make_one, name: str):
    """A stepper that keeps one state per value of an extra input within a
    key (a few values, such as the gateways), beside one for the whole key."""
    def make(cur=None):
        whole = make_one(cur["whole"] if cur else None)
        parts = {v: make_one(c) for v, c in (cur["parts"] if cur else {}).items()}
        cur = {"whole": whole.cur, "parts": {v: r.cur for v, r in parts.items()}}

        def run(ident, times, anchors, values):
            out = {f"all_{k}": v for k, v in whole(ident, times, anchors).items()}
            rows: dict = {}
            for i, v in enumerate(values):
                rows.setdefault(v, []).append(i)
            for v, at in rows.items():
                if v not in parts:
                    parts[v] = make_one()
                    cur["parts"][v] = parts[v].cur
                got = parts[v]([ident[i] for i in at], [times[i] for i in at], None)
                for k, x in got.items():
                    col = out.setdefault(f"{name}_{k}", [None] * len(times))
                    for i, y in zip(at, x):
                        col[i] = y
            return out
        run.cur = cur
        return run
    return make


def _prefixed(name: str) -> list[T.StructField]:
    return [T.StructField(f"{name}_{f.name}", f.dataType) for f in OUT_FIELDS]


def rate_limits(df: DataFrame, key: str | Column, algorithms: dict[str, tuple[str, str]], limit: int, window_us: int,
                time_col: str = "t_us", seq_col: str = "seq", carry: list[str] | None = None) -> DataFrame:
    """Decide every row by several limiters (name -> (algorithm, anchor)) and
    return a row per limiter, tagged ``algorithm``. Limiters whose hot keys
    split at the same points share one shuffle, sort and pass: all on the
    grid, and the counters anchored at a key's first request."""
    check_limit(limit, window_us)
    df, kname = key_column(df, key, "key")
    cols = [kname, time_col, seq_col, *(carry or [])]
    out = None
    for anchored in (False, True):
        some = {n: a for n, (a, anchor) in algorithms.items() if (a == "sliding_window_counter" and anchor == "first_request") == anchored}
        if not some:
            continue
        steppers = {"token_bucket": token_bucket_stepper, "sliding_window_log": sliding_log_stepper,
                    "sliding_window_counter": lambda c, w: sliding_counter_stepper(c, w, anchored)}
        folded = keyed_fold(df.select(*cols), kname, time_col, seq_col,
                            _side_by_side({n: steppers[a](limit, window_us) for n, a in some.items()}),
                            [f for n in some for f in _prefixed(n)], split_width=window_us, anchor_first=anchored)
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("algorithm"), *[F.col(f"{n}_{f.name}").alias(f.name) for f in OUT_FIELDS])
                                   for n in some]))
        rows = folded.select(*cols, each.alias("_d")).select("_d.algorithm", *cols, *[f"_d.{f.name}" for f in OUT_FIELDS])
        out = rows if out is None else out.unionByName(rows)
    return out


def shared_and_split(df: DataFrame, key: str | Column, split: str, limit: int, window_us: int,
                     time_col: str = "t_us", seq_col: str = "seq") -> DataFrame:
    """Token buckets of whole keys and of each (key, ``split`` value) in one
    pass: appends ``allowed_shared`` and ``allowed_split``."""
    check_limit(limit, window_us)
    df, kname = key_column(df, key, "key")
    out = keyed_fold(df, kname, time_col, seq_col, _per_value(token_bucket_stepper(limit, window_us), "split"),
                     _prefixed("all") + _prefixed("split"), split_width=window_us, extra_inputs=[split])
    keep = [F.col(c) for c in df.columns]
    return out.select(*keep, F.col("all_allowed").alias("allowed_shared"), F.col("split_allowed").alias("allowed_split"))


def fixed_window(df: DataFrame, key: str | Column, limit: int, window_us: int,
                 time_col: str = "t_us", seq_col: str = "seq") -> DataFrame:
    """Plain fixed window on the grid: the first ``limit`` requests of each
    (key, window) are admitted. No fold: a ranking window suffices, and the
    (key, window) partitioning spreads a hot key over its windows."""
    check_limit(limit, window_us)
    df, kname = key_column(df, key, "key")
    w_idx = F.floor(F.col(time_col) / F.lit(window_us)).cast("long")
    df = df.withColumn("_w", w_idx)
    w = Window.partitionBy(kname, "_w").orderBy(time_col, seq_col)
    return (df.withColumn("_rn", F.row_number().over(w))
              .withColumn("allowed", F.col("_rn") <= limit)
              .drop("_rn", "_w"))


def trailing_window_count(df: DataFrame, key: str | list[str], time_col: str, window_us: int,
                          out: str = "in_window") -> DataFrame:
    """Rows of the same key in (t - window, t] for every row, without one
    window per key: the time axis is cut into chunks of width ``window``,
    and each row is also copied into the next chunk's partition, because
    (t - window, t] only reaches back into the previous chunk. Counting per
    (key, chunk) and keeping the chunk's own rows is exact, and a key's
    history is spread over its chunks."""
    keys = [key] if isinstance(key, str) else list(key)
    chunk = F.floor(F.col(time_col) / F.lit(window_us)).cast("long")
    # one pass: each row becomes (its chunk, own) and (next chunk, copy)
    copies = F.explode(F.array(F.struct(chunk.alias("c"), F.lit(True).alias("own")),
                               F.struct((chunk + 1).alias("c"), F.lit(False).alias("own"))))
    both = df.withColumn("_x", copies).withColumn("_c", F.col("_x.c")).withColumn("_own", F.col("_x.own")).drop("_x")
    w = Window.partitionBy(*keys, "_c").orderBy(time_col).rangeBetween(-(window_us - 1), 0)
    both = both.withColumn(out, F.count(F.lit(1)).over(w))
    return both.where(F.col("_own")).drop("_c", "_own")
