"""Strict JSON decoding with Spark's VARIANT functions.

``from_json`` coerces (the number 12345 becomes the string "12345") and
reads only the first of two concatenated documents, so it cannot reject
what a strict decoder rejects. Instead each payload is parsed once into a
VARIANT; field types come from ``schema_of_variant`` and the object keys
from ``json_object_keys``. All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BODY_BYTES = 1 << 20

# The event payload fields and their JSON kinds.
EVENT_FIELDS = {
    "OrderCreated": {"order_id": "string", "user_id": "string", "amount_cents": "int",
                     "currency": "string", "items": [{"product_id": "string", "quantity": "int"}]},
    "PaymentSucceeded": {"order_id": "string", "payment_id": "string", "amount_cents": "int",
                         "currency": "string"},
    "PaymentFailed": {"order_id": "string", "reason": "string"},
}

# A kind is the name of a scalar, or [fields] for an array of objects.
_KIND = {"string": ["STRING"], "int": ["BIGINT", "INT", "SMALLINT", "TINYINT"]}


ALL_FIELDS = sorted({f for fs in EVENT_FIELDS.values() for f in fs})
BAD_RECORD = "_bad_record"


def payload_struct(payload: Column) -> Column:
    """Parse a payload once: every known field as a VARIANT (so its JSON
    kind is still visible) plus the raw text when the payload is not a
    JSON object. NULL for an empty payload."""
    schema = ", ".join(f"{f} VARIANT" for f in ALL_FIELDS) + f", {BAD_RECORD} STRING"
    return F.from_json(payload, schema, {"columnNameOfCorruptRecord": BAD_RECORD, "mode": "PERMISSIVE"})


def _type(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _value_ok(v: Column, kind) -> Column:
    """Missing, null or of the right kind, array elements included."""
    t = _type(v)
    if not isinstance(kind, list):
        return t.isin("VOID", *_KIND[kind])

    def element_ok(x):
        ok = F.lit(True)
        for f, k in kind[0].items():
            ok = ok & _value_ok(F.try_variant_get(x, f"$.{f}", "variant"), k)
        return (_type(x) == "VOID") | (_type(x).startswith("OBJECT") & ok)

    return (t == "VOID") | (t.startswith("ARRAY") & F.coalesce(F.forall(_elements(v), element_ok), F.lit(True)))


def _field_ok(p: Column, field: str, kind) -> Column:
    return _value_ok(p.getField(field), kind)


def _unknown_inside(v: Column, kind) -> Column:
    """Some element of an array of objects has a field that is not listed."""
    if not isinstance(kind, list):
        return F.lit(False)
    names = F.array(*[F.lit(f) for f in kind[0]])

    def odd(x):
        keys = F.coalesce(F.json_object_keys(F.to_json(x)), F.array().cast("array<string>"))
        return F.size(F.array_except(keys, names)) > 0

    return F.coalesce(F.exists(_elements(v), odd), F.lit(False))


def decode_event(type_col: Column, p: Column, expected: Column | str) -> tuple[Column, Column]:
    """(decodable, reason). ``p`` is :func:`payload_struct` of the
    payload. The envelope type must equal ``expected`` before the payload
    is read; then it must be a JSON object whose known fields have the
    right JSON kinds (missing or null fields decode to zero values,
    unknown fields are allowed)."""
    exp = F.lit(expected) if isinstance(expected, str) else expected
    checks = None
    for etype, fields in EVENT_FIELDS.items():
        ok = F.lit(True)
        for f, kind in fields.items():
            ok = ok & _field_ok(p, f, kind)
        checks = F.when(type_col == etype, ok) if checks is None else checks.when(type_col == etype, ok)
    checks = checks.otherwise(F.lit(False))
    reason = (F.when(type_col != exp, F.lit("unexpected event type"))
               .when(p.isNull() | p.getField(BAD_RECORD).isNotNull(), F.lit("payload is not a JSON object"))
               .when(~checks, F.lit("payload field has the wrong type")))
    return reason.isNull(), reason


def event_field(p: Column, field: str, as_type: str = "string") -> Column:
    """A field of a parsed payload, NULL when absent or not castable; only
    meaningful on rows ``decode_event`` accepted."""
    return F.try_variant_get(p.getField(field), "$", as_type)


def strict_decode(body: Column, allowed: list[str] | dict) -> Column:
    """Reason a request body is rejected, or NULL. Order: too large,
    malformed or not an object, a second document after the first, an
    unknown field (nested ones too), a field of the wrong type. ``allowed``
    names the fields, as a list (any type) or with their kinds. A single document is proven by parsing the body inside
    a wrapper that also carries a key derived from the body: trailing
    text breaks the wrapper."""
    tag = F.concat(F.lit("k"), F.md5(body))
    wrapped = F.concat(F.lit('{"w":'), body, F.lit(',"'), tag, F.lit('":1}'))
    wv = F.try_parse_json(wrapped)
    # The wrapper parses, and still holds the tag key, only if the body was
    # exactly one JSON value (the tag cannot occur inside the body itself).
    single = F.schema_of_variant(wv).contains(F.concat(tag, F.lit(":")))
    v = F.try_parse_json(body)
    keys = F.json_object_keys(body)
    unknown = F.size(F.array_except(F.coalesce(keys, F.array().cast("array<string>")),
                                    F.array(*[F.lit(a) for a in allowed])))
    unknown_inside, typed = F.lit(False), F.lit(True)
    for f, kind in (allowed.items() if isinstance(allowed, dict) else ()):
        field = F.try_variant_get(v, f"$.{f}", "variant")
        unknown_inside, typed = unknown_inside | _unknown_inside(field, kind), typed & _value_ok(field, kind)
    return (F.when(F.octet_length(body) > MAX_BODY_BYTES, F.lit("request body too large"))
             .when(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)),
                   F.lit("malformed JSON"))
             .when(~F.coalesce(single, F.lit(False)), F.lit("request body must contain a single JSON object"))
             .when((unknown > 0) | unknown_inside, F.lit("unknown field"))
             .when(~typed, F.lit("field has the wrong type")))
