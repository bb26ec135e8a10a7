"""Property tests on the limiter kernels (the code every fold runs), over
generated request sequences: the sliding log never admits more than the
limit in any trailing window; a client that waits exactly retry_after is
admitted; remaining and reset stay in range."""

from hypothesis import given, settings
from hypothesis import strategies as st

from admitflow.operators.limits import sliding_counter_stepper, sliding_log_stepper, token_bucket_stepper

W = 1_000_000
KERNELS = {
    "token_bucket": lambda C: token_bucket_stepper(C, W),
    "sliding_window_log": lambda C: sliding_log_stepper(C, W),
    "grid": lambda C: sliding_counter_stepper(C, W, False),
    "first_request": lambda C: sliding_counter_stepper(C, W, True),
}

gaps = st.lists(st.integers(min_value=0, max_value=3 * W), min_size=1, max_size=60)
limits = st.integers(min_value=1, max_value=5)


def times_of(gs):
    t, out = 10 * W, []
    for g in gs:
        t += g
        out.append(t)
    return out


def decide(kind, C, times):
    run = KERNELS[kind](C)()
    return run([("k", 0)] * len(times), times, None)


@settings(max_examples=150, deadline=None)
@given(gaps, limits)
def test_log_never_exceeds_limit_in_a_trailing_window(gs, C):
    times = times_of(gs)
    out = decide("sliding_window_log", C, times)
    admitted = [t for t, a in zip(times, out["allowed"]) if a]
    for t in admitted:
        assert sum(1 for u in admitted if t - W < u <= t) <= C


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(KERNELS)), gaps, limits)
def test_waiting_retry_after_is_admitted(kind, gs, C):
    times = times_of(gs)
    out = decide(kind, C, times)
    for i, allowed in enumerate(out["allowed"]):
        if not allowed:
            probe = times[: i + 1] + [times[i] + out["retry_after_us"][i]]
            assert decide(kind, C, probe)["allowed"][-1], (kind, C, i)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(KERNELS)), gaps, limits)
def test_outputs_stay_in_range(kind, gs, C):
    out = decide(kind, C, times_of(gs))
    for a, rem, reset, retry in zip(out["allowed"], out["remaining"], out["reset_after_us"], out["retry_after_us"]):
        assert 0 <= rem <= C - 1
        assert reset >= 0 and retry >= 0
        assert (retry == 0) if a else (retry > 0)
        if not a:
            assert rem == 0
    assert out["allowed"][0]  # a fresh key is never denied its first request


# ------------------------------------------------------------------ ledger

from admitflow.operators.ledger import _ledger_stepper  # noqa: E402

commands = st.lists(st.tuples(st.sampled_from(["reserve", "release", "commit", "add_stock"]),
                              st.integers(min_value=0, max_value=6),     # order
                              st.integers(min_value=-1, max_value=8)),   # quantity
                    min_size=1, max_size=80)


def run_ledger_kernel(cmds, stock0, product="p"):
    run = _ledger_stepper()()
    n = len(cmds)
    return run([(product, 0)] * n, list(range(n)), None, [c[0] for c in cmds], [f"o{c[1]}" for c in cmds],
               [c[2] for c in cmds], [stock0] * n, [0] * n), run.cur


@settings(max_examples=200, deadline=None)
@given(commands, st.integers(min_value=0, max_value=20))
def test_ledger_never_oversells_and_holds_add_up(cmds, stock0):
    out, cur = run_ledger_kernel(cmds, stock0)
    for s, r in zip(out["stock_after"], out["reserved_after"]):
        assert 0 <= r <= s
    _, stock, reserved, holds = cur
    assert reserved == sum(holds.values()) and all(q > 0 for q in holds.values())


@settings(max_examples=100, deadline=None)
@given(commands, commands, st.integers(min_value=0, max_value=20))
def test_ledger_products_are_independent(a, b, stock0):
    # interleaving another product's commands changes nothing for this one
    alone, _ = run_ledger_kernel(a, stock0)
    run = _ledger_stepper()()
    seq = [("p", c) for c in a] + [("q", c) for c in b]
    seq.sort(key=lambda x: x[0])  # the fold sees each product's commands together, in order
    n = len(seq)
    out = run([(p, 0) for p, _ in seq], list(range(n)), None, [c[0] for _, c in seq],
              [f"o{c[1]}" for _, c in seq], [c[2] for _, c in seq], [stock0] * n, [0] * n)
    mine = [i for i, (p, _) in enumerate(seq) if p == "p"]
    assert [out["result"][i] for i in mine] == alone["result"]
