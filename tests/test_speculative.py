"""Folds of one key in several tasks equal the serial fold."""

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from admitflow.operators import speculative as SP
from admitflow.operators.fold import hot_keys
from admitflow.operators.ledger import run_ledger
from admitflow.operators.limits import rate_limit, rate_limits, shared_and_split

SEC = 1_000_000
HOT = {"spark.admitflow.hotKeyRows": "200"}


@pytest.fixture
def small_pieces(spark, monkeypatch):
    monkeypatch.setattr(SP, "MIN_PIECE_ROWS", 200)
    old = {k: spark.conf.get(k, None) for k in [*HOT, "spark.sql.shuffle.partitions"]}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    for k, v in HOT.items():
        spark.conf.set(k, v)
    folded = []
    real = SP._round

    def counted(cut, todo, plan):
        folded.append(todo.count())
        return real(cut, todo, plan)

    monkeypatch.setattr(SP, "_round", counted)
    yield folded
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def requests(spark, gap, n=4_000, seed=1):
    """One key has a third of all rows and no gap as long as a window."""
    r = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += r.randrange(gap)
        key = "hot" if i % 3 == 0 else f"k{r.randrange(300)}"
        rows.append((key, None if i % 501 == 7 else t // 2 * 2, i, r.choice("ab")))
    rows += [(None, 5, n, "a"), ("hot", t, n + 1, "a"), ("hot", t, n + 2, "b")]
    return spark.createDataFrame(rows, "key string, t_us long, seq long, via string").repartition(5)


def serial(spark, make):
    old = spark.conf.get("spark.admitflow.hotKeyRows")
    spark.conf.set("spark.admitflow.hotKeyRows", str(1 << 40))
    try:
        return Counter(map(tuple, make().collect()))
    finally:
        spark.conf.set("spark.admitflow.hotKeyRows", old)


@pytest.mark.parametrize("algorithm,anchor", [("token_bucket", "grid"), ("sliding_window_log", "grid"), ("sliding_window_counter", "grid"),
                                              ("sliding_window_counter", "first_request")])
def test_limiters_on_a_hot_key_without_a_gap(spark, small_pieces, algorithm, anchor):
    req = requests(spark, 2 * SEC)
    make = lambda: rate_limit(req, "key", algorithm, 5, 20 * SEC, anchor=anchor)
    want = serial(spark, make)
    assert not small_pieces
    assert Counter(map(tuple, make().collect())) == want
    assert small_pieces[0] >= 4  # the hot key is folded in that many tasks at once
    assert sum(small_pieces) <= 5 * small_pieces[0]


def test_counters_settle_without_folding_every_piece_in_turn(spark, small_pieces):
    """A saturated counter forgets its past, so all pieces are right after the second round."""
    req = requests(spark, SEC // 10, 9_000)
    make = lambda: rate_limit(req, "key", "sliding_window_counter", 3, 2 * SEC)
    assert Counter(map(tuple, make().collect())) == serial(spark, make)
    assert small_pieces[0] >= 5 and len(small_pieces) <= 3


def test_several_limiters_and_budgets_in_one_fold(spark, small_pieces):
    req = requests(spark, 2 * SEC)
    both = lambda: rate_limits(req, "key", {"b": ("token_bucket", "grid"), "l": ("sliding_window_log", "grid"),
                                            "c": ("sliding_window_counter", "first_request")}, 5, 20 * SEC)
    assert Counter(map(tuple, both().collect())) == serial(spark, both)
    split = lambda: shared_and_split(req, "key", "via", 5, 20 * SEC)
    assert Counter(map(tuple, split().collect())) == serial(spark, split)
    assert small_pieces


def test_ledger_of_a_hot_product(spark, small_pieces):
    r = random.Random(4)
    rows = []
    for i in range(3_000):
        op = r.choice(["reserve", "reserve", "release", "commit", "add_stock", "odd"])
        rows.append((i, "p1" if i % 3 == 0 else f"p{r.randrange(2, 200)}", None if i % 307 == 0 else i // 3, op, f"o{r.randrange(60)}", r.randrange(4)))
    cmds = spark.createDataFrame(rows, "seq long, product_id string, t_us long, op string, order_id string, quantity long").repartition(5)
    products = spark.createDataFrame([(f"p{i}", 30, 0) for i in range(1, 190)], "product_id string, stock int, reserved int")
    make = lambda: run_ledger(cmds, products, ["seq"])
    assert Counter(map(tuple, make().collect())) == serial(spark, make)
    assert small_pieces[0] >= 4


def test_limiter_without_a_resumable_state_folds_serially(spark, small_pieces):
    def every_second(limit, window):
        def make(cur=None):
            seen = {}

            def run(ident, times, anchors):
                out = []
                for k in ident:
                    seen[k] = seen.get(k, 0) + 1
                    out.append(seen[k] % 2 == 0)
                n = len(times)
                return {"allowed": out, "limit": [limit] * n, "remaining": [0] * n, "reset_after_us": [0] * n, "retry_after_us": [0] * n, "state_entries": [1] * n}
            return run
        return make
    req = requests(spark, 2 * SEC)
    make = lambda: rate_limit(req, "key", every_second, 5, 20 * SEC)
    assert Counter(map(tuple, make().collect())) == serial(spark, make)
    assert not small_pieces


def test_states_freeze_to_equal_bytes():
    a, b = {"x": [1, deque([2, None])], "y": {("k", 0): 3}}, {"y": {("k", 0): 3}, "x": [1, deque([2, None])]}
    assert SP.freeze(a) == SP.freeze(b) and SP.thaw(SP.freeze(a)) == a
    assert type(SP.thaw(SP.freeze(a))["x"][1]) is deque
    text = "o1"
    assert SP.freeze([text, text]) == SP.freeze(["o1", "".join(["o", "1"])])


def test_hot_keys_are_fewer_than_partitions(spark):
    df = spark.range(1_000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 50).cast("string").alias("key"), F.col("id").alias("t_us"))
    spark.conf.set("spark.admitflow.hotKeyRows", "1")
    try:
        hot, rows = hot_keys(df, "key", "t_us")
    finally:
        spark.conf.unset("spark.admitflow.hotKeyRows")
    assert rows == 1_000 // int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [r.key for r in hot.collect()] == ["0"]
    assert hot_keys(df.limit(0), "key", "t_us")[0] is None
