"""TR1-TR5 on the derived service logs."""

from pyspark.sql import functions as F

from admitflow.operators import trace as TR
from admitflow.sources import views as VW

from conftest import SF001


def test_hot_trace_split_gives_the_same_latencies(spark):
    logs = VW.logs(spark, SF001)
    # one id holding every line: a trace far larger than the others
    hot = logs.withColumn("correlation_id", F.when(F.col("correlation_id").isNotNull(), F.lit("o-hot")))
    plain = TR.step_latency(hot, hot_trace_lines=10 ** 9)
    split = TR.step_latency(hot, hot_trace_lines=0)
    assert plain.count() == split.count() > 0
    assert plain.exceptAll(split).count() == 0


def test_gaps_find_the_missing_payment_line(spark):
    gaps = {r.correlation_id: r.missing for r in TR.trace_gaps(VW.logs(spark, SF001)).collect()}
    assert gaps and set(gaps.values()) == {"payment"}
    assert all(int(c[2:]) % 13 == 0 for c in gaps)


def test_uncorrelated_lines_have_no_id(spark):
    u = TR.uncorrelated(VW.logs(spark, SF001))
    assert u.count() > 0 and u.where(F.col("correlation_id").isNotNull()).count() == 0


def test_hot_trace_split_numbers_the_same_steps(spark):
    logs = VW.logs(spark, SF001)
    hot = logs.withColumn("correlation_id", F.when(F.col("line_no") % 3 == 0, F.lit("o-hot")).otherwise(F.col("correlation_id")))
    plain = TR.trace_steps(hot, hot_trace_lines=10 ** 9)
    split = TR.trace_steps(hot, hot_trace_lines=5)
    assert plain.count() == split.count() > 0
    assert plain.exceptAll(split).count() == 0
