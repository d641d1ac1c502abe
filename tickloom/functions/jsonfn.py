"""JSON access on text columns: members, elements, kinds, building, base64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the message that starts a chain.
START_FORMAT = '{"ConfigID": %s, "Command": "START", "Ts": %s, "Delay": %s}'


def member(doc: Column, path: str, as_type: str = "string") -> Column:
    """Value at ``path`` ('$.a.b[0]'); NULL when absent, of another type, or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(doc), path, as_type)


def elements(doc: Column, path: str = "$") -> Column:
    """JSON array at ``path`` as an array of variants, ready to explode."""
    return F.try_variant_get(F.try_parse_json(doc), path, "array<variant>")


def kind(doc: Column) -> Column:
    """'object', 'array', 'string', 'number', 'boolean' or 'null'; NULL if no JSON."""
    shape = F.schema_of_variant(F.try_parse_json(doc))
    return (
        F.when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", "null")
        .when(shape.isNotNull(), "number")
    )


def keys(doc: Column) -> Column:
    return F.json_object_keys(doc)


def length(doc: Column) -> Column:
    return F.json_array_length(doc)


def decoded(text: Column) -> Column:
    """base64 to UTF-8 text."""
    return F.decode(F.unbase64(text), "UTF-8")


def encoded(text: Column) -> Column:
    return F.base64(F.encode(text, "UTF-8"))


def start_signal(chain_id: Column, ts: Column, delay_seconds: Column) -> Column:
    """START message for a chain, as JSON text."""
    return F.format_string(
        START_FORMAT,
        chain_id, F.unix_seconds(ts.cast("timestamp")), F.coalesce(delay_seconds, F.lit(0)),
    )
