"""The registry of queries: name -> callable(spark, sf_dir) -> DataFrame,
and the DuckDB oracle of each query SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import commerce_queries as CQ
from . import limiter_queries as LQ
from . import request_queries as RQ
from . import saga_queries as SQ
from . import ledger_queries as GQ
from . import trace_queries as TQ
from . import source_queries as XQ
from . import stream_queries as SQX
from . import view_queries as WQ

MODULES = (LQ, RQ, CQ, SQ, GQ, TQ, XQ, WQ, SQX)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict = {}
    for m in MODULES:
        q.update(m.QUERIES)
    return q


def oracle_sql() -> dict[str, str]:
    o: dict = {}
    for m in MODULES:
        o.update(m.ORACLES)
    return o
