"""Row-level functions (P1-P10, P18, S7) against the reference's cases."""

import pytest
from pyspark.sql import functions as F

from admitflow.functions import scalars as S


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).collect()[0].o


@pytest.mark.parametrize("addr,host", [("192.0.2.10:1234", "192.0.2.10"), ("[2001:db8::1]:80", "2001:db8::1"),
                                       ("192.0.2.10", "192.0.2.10"), ("[::1]", "[::1]"),
                                       ("2001:db8::1:80", "2001:db8::1:80"), ("host:", "host")])
def test_client_ip(spark, addr, host):
    assert one(spark, S.client_ip(F.col("v")), addr) == host


def test_limit_key_namespaces(spark):
    df = spark.createDataFrame([("user-1", "192.0.2.10:1234"), ("", "192.0.2.10:1234"), (None, "x")],
                               "s string, a string")
    assert [r.k for r in df.select(S.limit_key(F.col("s"), F.col("a")).alias("k")).collect()] == \
        ["user:user-1", "ip:192.0.2.10", "ip:x"]


@pytest.mark.parametrize("cid,ok", [("abc-123", True), ("a" * 128, True), ("a" * 129, False), ("a" * 200, False),
                                    ("", False), ("a\nb", False), ("ab\n", False), ("a\r\nb", False),
                                    ("a\tb", False), ("a\x00b", False), ("a b", False), ("é", False)])
def test_correlation_validity(spark, cid, ok):
    assert one(spark, S.correlation_valid(F.col("v")), cid) is ok


def test_minted_correlation_id_is_stable_hex(spark):
    df = spark.createDataFrame([("bad id", 7)], "c string, r long")
    v = df.select(S.ensure_correlation(F.col("c"), F.col("r")).alias("o")).collect()[0].o
    assert len(v) == 32 and int(v, 16) >= 0


def test_rate_headers(spark):
    df = spark.createDataFrame([(100, 0, 1_500_000, 1, False), (100, 5, 0, 0, True)],
                               "l int, r long, reset long, retry long, a boolean")
    rows = df.select(*S.rate_headers(F.col("l"), F.col("r"), F.col("reset"), F.col("retry"), F.col("a"))).collect()
    assert tuple(rows[0]) == (100, 0, 2, 1) and tuple(rows[1]) == (100, 5, 0, None)


@pytest.mark.parametrize("method,path,route", [
    ("GET", "/orders/abc-123", "/orders/{id}"), ("POST", "/orders/", "/orders/"),
    ("GET", "/catalog/products/7", "/catalog/products/{id}"), ("POST", "/catalog/products/7/stock",
                                                               "/catalog/products/{id}/stock"),
    ("GET", "/nope", "unmatched"), ("DELETE", "/orders/1", "unmatched"), ("GET", "/orders/a/b", "unmatched")])
def test_route_label(spark, method, path, route):
    df = spark.createDataFrame([(method, path)], "m string, p string")
    assert df.select(S.route_label(F.col("m"), F.col("p")).alias("o")).collect()[0].o == route


@pytest.mark.parametrize("raw,norm,reason", [
    ("  Alice@Example.COM ", "Alice@Example.COM", None), ("Alice <a@b.test>", "a@b.test", None),
    ("", None, "email is required"), ("not-an-email", None, "email is not a valid address"),
    ("x" * 250 + "@b.test", None, "email is too long")])
def test_normalize_email(spark, raw, norm, reason):
    assert one(spark, S.normalize_email(F.col("v")), raw) == norm
    assert one(spark, S.email_reason(F.col("v")), raw) == reason


@pytest.mark.parametrize("raw,val", [("", 20), ("abc", 20), ("7", 7), ("0", 1), ("500", 100), ("+5", 5), ("-3", 1),
                                     (" 5", 20), ("99999999999999999999", 20)])
def test_clamp_param(spark, raw, val):
    assert one(spark, S.clamp_param(F.col("v"), 20, 1, 100), raw) == val


@pytest.mark.parametrize("raw,lvl", [("debug", "debug"), ("DEBUG", "debug"), ("Debug", "info"), ("WARN", "warn"),
                                     ("error", "error"), ("", "info"), ("verbose", "info")])
def test_log_level(spark, raw, lvl):
    assert one(spark, S.log_level(F.col("v")), raw) == lvl


def test_currency(spark):
    assert one(spark, S.normalize_currency(F.col("v")), " usd ") == "USD"
    assert one(spark, S.normalize_currency(F.col("v")), "") == "USD"
    assert one(spark, S.currency_ok_for_catalog(F.col("v")), "DOLLARS") is False


def test_redaction_is_idempotent(spark):
    t = "x eyJhbGciOiJIUzI1NiJ9.abc_-1.def y eyJhbGciOiXX.a.b"
    once = one(spark, S.redact_tokens(F.col("v")), t)
    assert once == "x <JWT-REDACTED> y <JWT-REDACTED>"
    assert one(spark, S.redact_tokens(F.col("v")), once) == once
    assert one(spark, S.count_tokens(F.col("v")), t) == 2
