"""Personal data in whole texts, with DataFrame functions only.

Regular expressions propose spans, checksum and range validators confirm
them, and words near a span raise its score. Kinds and their rules:

* ``email``, ``ip``, ``card``, ``phone``: leftmost non-overlapping matches of
  the patterns below; an address part above 255, a card number that fails
  Luhn or has not 13 to 19 digits, a phone number without 9 to 15 digits are
  dropped, and nothing is retried inside a dropped match. Confirmed spans
  are always reported; context only raises their score.
* ``iban``: confirmed by its mod-97 remainder.
* ``ssn``: US social security shape and number ranges; reported only where a
  context word lifts its score to ``THRESHOLD``.

Positions are code points, end exclusive. The patterns are possessive and
start only where a run of their first character class starts, so a text is
read in linear time and long runs need no stack. Edge cases: a null text is
empty and has no spans; U+FDD0 (never assigned to a character) marks the cuts
and is read as U+FFFD in texts that hold it; other columns pass through; an
empty table gives an empty table; repeated rows give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban", "ssn")
THRESHOLD = 0.6

_MARK, _STAND_IN = "﷐", "�"
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# Score of a confirmed span without context, and the words that add CONTEXT_GAIN.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT_GAIN = 0.3
CONTEXT_CHARS = 40
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|server|host|login",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|anruf|appel|llam",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social security|\bssa\b|taxpayer",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_IP_OK = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn remainder of a digit string is 0."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def iban_ok(value: Column) -> Column:
    """The account number's remainder by 97 is 1 (letters count from 10)."""
    x = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(x, 5, 34), F.substring(x, 1, 4)), "")
    rest = F.aggregate(turned, F.lit(0), lambda a, c: F.when(F.ascii(c) < 58, a * 10 + F.ascii(c) - 48)
                       .otherwise(a * 100 + F.ascii(c) - 55) % 97)
    return rest % 97 == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP_OK)
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(13, 19), luhn_ok(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return iban_ok(value)
    if kind == "ssn":
        return value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.lit(True)


def _parts(text: Column, kind: str) -> Column:
    """The text cut around matches: gap, match, gap, match, ..., gap."""
    return F.split(F.regexp_replace(text, PATTERNS[kind], f"{_MARK}$0{_MARK}"), _MARK, -1)


def _near(parts: Column, i: Column, kind: str) -> Column:
    near = F.concat(F.right(F.get(parts, i - 1), F.lit(CONTEXT_CHARS)), F.lit(" "),
                    F.left(F.get(parts, i + 1), F.lit(CONTEXT_CHARS)))
    return F.lower(near).rlike(CONTEXT[kind])


def _score(parts: Column, i: Column, kind: str) -> Column:
    return F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(_near(parts, i, kind), CONTEXT_GAIN).otherwise(0.0))


def _kept(parts: Column, x: Column, i: Column, kind: str) -> Column:
    """Whether part ``i`` is a confirmed span of the kind."""
    ok = (i % 2 == 1) & _valid(kind, x)
    return ok if SCORES[kind] >= THRESHOLD else ok & (_score(parts, i, kind) >= THRESHOLD)


_BLOCK = 64


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def _with_spans(df: DataFrame, kind: str) -> DataFrame:
    """Add ``_s_<kind>``: the spans of one kind in text order. Starts are
    running sums of the part lengths, taken block by block so that a text
    with very many matches does not cost their square."""
    p, n, b = f"_p_{kind}", f"_n_{kind}", f"_b_{kind}"
    out = df.withColumn(p, _parts(F.col("_t"), kind))
    out = out.withColumn(n, F.transform(p, F.length))
    blocks = F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int"))
    out = out.withColumn(b, F.transform(blocks, lambda k: _total(F.slice(F.col(n), k * _BLOCK + 1, _BLOCK))))
    out = out.withColumn(b, F.transform(b, lambda x, k: _total(F.slice(F.col(b), F.lit(1), k))))
    parts, lens = F.col(p), F.col(n)

    def span(x, i):
        start = F.get(F.col(b), F.floor(i / _BLOCK).cast("int")) + _total(
            F.slice(lens, (F.floor(i / _BLOCK) * _BLOCK + 1).cast("int"), (i % _BLOCK).cast("int")))
        return F.when(_kept(parts, x, i, kind), F.struct(
            F.lit(kind).alias("kind"), start.cast("long").alias("start"),
            (start + F.length(x)).cast("long").alias("end"), _score(parts, i, kind).alias("score")))

    spans = F.filter(F.transform(parts, span), lambda s: s.isNotNull())
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    out = out.withColumn(f"_s_{kind}", F.when(F.size(p) > 1, spans).otherwise(empty))
    return out.drop(p, n, b)


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _MARK, _STAND_IN)


def _as_row(df: DataFrame) -> Column:
    """All columns as one, so that helper columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add column ``out``: array of (kind, start, end, score) by kind in the
    order of ``KINDS``, then start. Input columns of any name stay."""
    names = df.columns
    tmp = df.select(_as_row(df))
    tmp = tmp.withColumn("_t", _clean(F.col("_row").getField(text)))
    for k in KINDS:
        tmp = _with_spans(tmp, k)
    spans = F.concat(*[F.col(f"_s_{k}") for k in KINDS])
    keep = [F.col("_row").getField(c).alias(c) for c in names if c != out]
    return tmp.select(*keep, spans.alias(out))


def _replaced(parts: Column, kind: str) -> Column:
    return F.transform(parts, lambda x, i: F.when(_kept(parts, x, i, kind), F.lit(f"[{kind.upper()}]")).otherwise(x))


def redact_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace confirmed spans by ``[KIND]``, kind by kind in the order of
    ``KINDS`` on the text left by the kinds before; null texts stay null,
    texts without spans stay as they are."""
    names = df.columns
    tmp = df.select(_as_row(df))
    source = F.col("_row").getField(text)
    tmp = tmp.withColumn("_t", _clean(source)).withColumn("_hit", F.lit(False))
    for k in KINDS:
        tmp = tmp.withColumn("_p", _parts(F.col("_t"), k))
        parts = F.col("_p")
        tmp = tmp.withColumn("_q", F.when(F.size(parts) > 1, _replaced(parts, k)))
        tmp = tmp.withColumn("_u", F.when(F.col("_q").isNotNull(), F.array_join("_q", "")).otherwise(F.col("_t")))
        tmp = tmp.withColumn("_hit", F.col("_hit") | (F.col("_u") != F.col("_t"))).withColumn("_t", F.col("_u"))
    new = F.when(F.col("_hit"), F.col("_t")).otherwise(source)
    return tmp.select(*[(new if c == text else F.col("_row").getField(c)).alias(c) for c in names])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def pii_digest(df: DataFrame) -> DataFrame:
    """One row per document of ``find_pii``'s spans: counts of the base
    kinds, a hash over the base spans, and all spans as text."""
    found = find_pii(df.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [_count("pii", k).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("pii")).alias("spans"))
