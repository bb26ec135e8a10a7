"""P11 strict body decoding."""

import pytest
from pyspark.sql import functions as F

from admitflow.functions.jsonx import MAX_BODY_BYTES, strict_decode

ALLOWED = ["order_id", "items"]


@pytest.mark.parametrize("body,reason", [
    ('{"order_id":"1","items":[]}', None),
    ('{"order_id":"1","unit_cents":5}', "unknown field"),
    ('{"order_id":"1"}{"order_id":"2"}', "request body must contain a single JSON object"),
    ('{"order_id":"1"} trailing', "request body must contain a single JSON object"),
    ('{"order_id":', "malformed JSON"),
    ("[1,2]", "malformed JSON"),
    ('{"order_id":"' + "x" * MAX_BODY_BYTES + '"}', "request body too large"),
])
def test_strict_decode(spark, body, reason):
    df = spark.createDataFrame([(body,)], "b string")
    assert df.select(strict_decode(F.col("b"), ALLOWED).alias("r")).collect()[0].r == reason


TYPED = {"user_id": "string", "n": "int", "items": [{"product_id": "string", "quantity": "int"}]}


@pytest.mark.parametrize("body,reason", [
    ('{"user_id":"5","n":3,"items":[{"product_id":"a","quantity":2},null]}', None),
    ('{"user_id":null,"items":null}', None),
    ('{}', None),
    ('{"user_id":5}', "field has the wrong type"),
    ('{"n":5.5}', "field has the wrong type"),
    ('{"n":"5"}', "field has the wrong type"),
    ('{"items":{"product_id":"a"}}', "field has the wrong type"),
    ('{"items":[{"product_id":"a","quantity":"x"}]}', "field has the wrong type"),
    ('{"items":[7]}', "field has the wrong type"),
    ('{"items":[{"product_id":"a","quantiy":2}]}', "unknown field"),
    ('{"items":[{"product_id":"a","x":{"y":1}}]}', "unknown field"),
])
def test_strict_decode_types(spark, body, reason):
    df = spark.createDataFrame([(body,)], "b string")
    assert df.select(strict_decode(F.col("b"), TYPED).alias("r")).collect()[0].r == reason


@pytest.mark.parametrize("payload,good", [
    ('{"order_id":"1","items":[{"product_id":"5","quantity":2}]}', True),
    ('{"order_id":"1","items":[]}', True),
    ('{"order_id":"1","items":[{"product_id":"5","extra":1}]}', True),
    ('{"order_id":"1","items":[{"product_id":5,"quantity":2}]}', False),
    ('{"order_id":"1","items":[{"product_id":"5","quantity":"x"}]}', False),
    ('{"order_id":"1","items":["x"]}', False),
    ('{"order_id":"1","items":"x"}', False),
])
def test_event_items_are_typed(spark, payload, good):
    from admitflow.functions.jsonx import decode_event, payload_struct
    df = spark.createDataFrame([(payload,)], "p string").select(payload_struct(F.col("p")).alias("p"))
    ok, _ = decode_event(F.lit("OrderCreated"), F.col("p"), "OrderCreated")
    assert df.select(ok.alias("ok")).first().ok == good
