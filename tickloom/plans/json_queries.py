"""JSON access and conformance (N1-N6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import jsonfn
from tickloom.operators import conform
from tickloom.plans.registry import query

# Conversations as JSON documents: one object per turn.
TURN = "to_json(named_struct('conv', conv_id, 'turn', turn, 'role', role, 'tags', array(role, lang), 'text', text))"
TURN_SQL = "to_json({'conv': conv_id, 'turn': turn, 'role': role, 'tags': [role, lang], 'text': text})"


def turns(t):
    d = t.raw("conversations").withColumn("lang", F.when(F.col("turn") % 3 == 0, F.col("role")).otherwise(F.lit("xx")))
    return d.select("conv_id", "turn", F.expr(TURN).alias("doc"))


TURNS_SQL = f"""WITH c AS (SELECT *, CASE WHEN turn % 3 = 0 THEN role ELSE 'xx' END AS lang FROM conversations),
    d AS (SELECT *, {TURN_SQL} AS doc FROM c) """


@query("n01_array_elements", TURNS_SQL + "SELECT conv_id, turn, unnest([role, lang]) AS tag FROM d")
def n01(t):
    return turns(t).select("conv_id", "turn", F.explode(jsonfn.elements(F.col("doc"), "$.tags")).alias("e")).select(
        "conv_id", "turn", F.try_variant_get("e", "$", "string").alias("tag")
    )


@query(
    "n02_member_access",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events""",
)
def n02(t):
    doc = F.col("props")
    return t.raw("events").select(
        "event_id", jsonfn.member(doc, "$.k", "bigint").alias("k"), jsonfn.member(doc, "$.none").alias("missing")
    )


@query(
    "n03_base64",
    "SELECT doc_id, base64(encode(text)) AS encoded, text AS decoded FROM documents",
)
def n03(t):
    d = t.raw("documents").select("doc_id", jsonfn.encoded(F.col("text")).alias("encoded"))
    return d.select("doc_id", F.regexp_replace("encoded", r"\s", "").alias("encoded"), jsonfn.decoded(F.col("encoded")).alias("decoded"))


@query(
    "n04_keys_and_kinds",
    TURNS_SQL
    + """SELECT conv_id, turn, array_to_string(json_keys(doc), ',') AS key_list, lower(json_type(doc)) AS doc_kind,
    CASE WHEN json_type(doc, '$.turn') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' ELSE lower(json_type(doc, '$.turn')) END AS turn_kind,
    CAST(json_array_length(doc, '$.tags') AS INT) AS n_tags,
    CAST(to_json([role, CAST(turn AS VARCHAR)]) AS VARCHAR) AS pair FROM d""",
)
def n04(t):
    doc = F.col("doc")
    tags = F.get_json_object(doc, "$.tags")
    return turns(t).select(
        "conv_id", "turn", F.array_join(jsonfn.keys(doc), ",").alias("key_list"), jsonfn.kind(doc).alias("doc_kind"),
        jsonfn.kind(F.get_json_object(doc, "$.turn")).alias("turn_kind"), jsonfn.length(tags).alias("n_tags"),
        F.to_json(F.array(jsonfn.member(doc, "$.role"), jsonfn.member(doc, "$.turn"))).alias("pair"),
    )


@query(
    "n05_json_from_values",
    """SELECT event_id, concat('{"ConfigID": ', user_id, ', "Command": "START", "Ts": ', CAST(floor(epoch(ts)) AS BIGINT), ', "Delay": ', user_id % 3, '}') AS payload,
    concat('{"user":', user_id, ',"type":"', event_type, '"}') AS doc FROM events""",
)
def n05(t):
    return t.raw("events").select(
        "event_id",
        jsonfn.start_signal(F.col("user_id"), F.col("ts"), F.col("user_id") % 3).alias("payload"),
        F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"))).alias("doc"),
    )


PROPS_SCHEMA = {
    "type": "object",
    "required": ["k"],
    "additionalProperties": False,
    "maxProperties": 1,
    "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90, "not": {"multipleOf": 7}}},
}
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(
    "n06_json_conform",
    f"SELECT event_id, {_K} BETWEEN 10 AND 90 AND {_K} % 7 <> 0 AS conforms FROM events",
)
def n06(t):
    return conform.conformance(t.raw("events").select("event_id", "props"), "props", PROPS_SCHEMA).select("event_id", "conforms")


TURN_SCHEMA = {
    "type": "object",
    "definitions": {"word": {"type": "string", "minLength": 2, "pattern": "^[a-z]+$"}},
    "required": ["conv", "turn", "role", "text"],
    "properties": {
        "role": {"enum": ["user", "assistant"]},
        "turn": {"type": "integer", "minimum": 0, "maximum": 4, "exclusiveMaximum": True},
        "text": {"type": "string", "minLength": 20, "maxLength": 400},
    },
    "anyOf": [{"properties": {"role": {"enum": ["user"]}}}, {"properties": {"turn": {"minimum": 2}}}],
    "patternProperties": {"^t[a-z]gs$": {"uniqueItems": True, "items": {"$ref": "#/definitions/word"}}},
    "minProperties": 5,
}


@query(
    "n06_rule_summary",
    TURNS_SQL
    + """, r AS (SELECT NOT (role IN ('user', 'assistant') AND turn < 4 AND length(text) BETWEEN 20 AND 400) AS bp,
      NOT (role = 'user' OR turn >= 2) AS ba, role = lang OR NOT regexp_matches(role, '^[a-z][a-z]+$') AS bpp FROM d)
    SELECT count(*) AS checked, count(*) FILTER (NOT (bp OR ba OR bpp)) AS conforming, 0 AS broken_json, 0 AS broken_type,
    count(*) FILTER (bp) AS broken_properties, 0 AS broken_required, count(*) FILTER (ba) AS "broken_anyOf",
    0 AS "broken_minProperties", count(*) FILTER (bpp) AS "broken_patternProperties" FROM r""",
)
def n06_summary(t):
    return conform.violation_summary(turns(t), "doc", TURN_SCHEMA)


# A thread: each turn nested below the one after it, checked by a schema that refers to itself.
THREAD_SCHEMA = {
    "definitions": {
        "node": {
            "type": "object",
            "required": ["n"],
            "properties": {"n": {"maximum": 80}, "next": {"$ref": "#/definitions/node"}},
        }
    },
    "$ref": "#/definitions/node",
}


@query(
    "n06_recursive_schema",
    f"SELECT event_id, {_K} <= 80 AND {_K} % 10 <= 4 AS conforms FROM events",
)
def n06_recursive(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    last = F.when(k % 10 > 4, F.lit('{"m": 1}')).otherwise(F.lit('{"n": 1}'))
    doc = F.concat(F.lit('{"n": '), k.cast("string"), F.lit(', "next": {"n": 2, "next": '), last, F.lit("}}"))
    docs = t.raw("events").select("event_id", doc.alias("doc"))
    return conform.conformance(docs, "doc", THREAD_SCHEMA).select("event_id", "conforms")


# Events as values of four kinds: an object with two or three members, an array of two or three elements, a string, a number.
KINDS_DOC = """CASE event_id % 4 WHEN 0 THEN concat('{"b":"', y, '","a":', k, CASE WHEN k % 2 = 0 THEN ',"c":true}' ELSE '}' END)
    WHEN 1 THEN concat('[', k, ',', u, CASE WHEN k % 3 = 0 THEN concat(',"', y, '"]') ELSE ']' END)
    WHEN 2 THEN concat('"', y, '"') ELSE CAST(CAST(k / 4 AS DECIMAL(10,2)) AS STRING) END"""
_O, _A, _S, _N = (f"event_id % 4 = {i}" for i in range(4))
# Every keyword: a schema for it, and which values break it.
KEYWORDS = {
    "type": ({"type": ["object", "integer"]}, f"{_A} OR {_S} OR {_N} AND k % 4 <> 0"),
    "properties": ({"properties": {"a": {"maximum": 50}}}, f"{_O} AND k > 50"),
    "required": ({"required": ["a", "c"]}, f"{_O} AND k % 2 <> 0"),
    "items": ({"items": {"minimum": 2}}, f"{_A} AND (k < 2 OR u < 2)"),
    "items_tuple": ({"items": [{"minimum": 20}, {"maximum": 3}]}, f"{_A} AND (k < 20 OR u > 3)"),
    "additionalItems_false": ({"items": [{}, {}], "additionalItems": False}, f"NOT ({_A}) OR k % 3 = 0"),
    "additionalItems": ({"items": [{}, {}], "additionalItems": {"enum": ["view", "click"]}}, f"NOT ({_A}) OR k % 3 = 0 AND y NOT IN ('view', 'click')"),
    "minimum": ({"minimum": 10}, f"{_N} AND k < 40"),
    "maximum": ({"maximum": 15}, f"{_N} AND k > 60"),
    "exclusiveMinimum": ({"minimum": 10, "exclusiveMinimum": True}, f"NOT ({_N}) OR k <= 40"),
    "exclusiveMaximum": ({"maximum": 15, "exclusiveMaximum": True}, f"NOT ({_N}) OR k >= 60"),
    "anyOf": ({"anyOf": [{"type": "string"}, {"type": "number", "minimum": 5}]}, f"NOT ({_S}) AND NOT ({_N} AND k >= 20)"),
    "allOf": ({"allOf": [{"type": "number"}, {"maximum": 20}]}, f"NOT ({_N}) OR k > 80"),
    "oneOf": ({"oneOf": [{"type": "number"}, {"minimum": 12}]}, f"{_N} AND k >= 48"),
    "uniqueItems": ({"uniqueItems": True}, f"NOT ({_A}) OR k = u"),
    "additionalProperties_false": ({"properties": {"a": {}, "b": {}}, "additionalProperties": False}, f"{_O} AND k % 2 = 0"),
    "additionalProperties": ({"properties": {"a": {}}, "additionalProperties": {"enum": ["view", "error"]}}, f"{_O} AND (k % 2 = 0 OR y NOT IN ('view', 'error'))"),
    "ref": ({"definitions": {"word/short": {"maxLength": 4}}, "$ref": "#/definitions/word~1short"}, f"{_S} AND length(y) > 4"),
    "enum": ({"enum": ["view", 2.5, [3, 3.0, "click"]]}, f"NOT ({_S} AND y = 'view' OR {_N} AND k = 10 OR {_A} AND k = 3 AND u = 3 AND y = 'click')"),
    "minLength": ({"minLength": 5}, f"{_S} AND length(y) < 5"),
    "maxLength": ({"maxLength": 5}, f"{_S} AND length(y) > 5"),
    "not": ({"not": {"type": "array", "minItems": 3}}, f"{_A} AND k % 3 = 0"),
    "maxProperties": ({"maxProperties": 2}, f"{_O} AND k % 2 = 0"),
    "minProperties": ({"minProperties": 3}, f"{_O} AND k % 2 <> 0"),
    "maxItems": ({"maxItems": 2}, f"{_A} AND k % 3 = 0"),
    "minItems": ({"minItems": 3}, f"{_A} AND k % 3 <> 0"),
    "dependencies": ({"dependencies": {"a": ["c"]}}, f"{_O} AND k % 2 <> 0"),
    "dependencies_schema": ({"dependencies": {"c": {"properties": {"a": {"maximum": 30}}}}}, f"{_O} AND k % 2 = 0 AND k > 30"),
    "pattern": ({"pattern": "^[cv]"}, f"{_S} AND y NOT LIKE 'c%' AND y NOT LIKE 'v%'"),
    "patternProperties": ({"patternProperties": {"^[ax]$": {"multipleOf": 5}}}, f"{_O} AND k % 5 <> 0"),
    "multipleOf": ({"multipleOf": 0.5}, f"{_N} AND k % 2 <> 0"),
}


@query(
    "n06_all_keywords",
    f"WITH e AS (SELECT event_id, event_type AS y, user_id % 5 AS u, {_K} AS k FROM events) "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS keyword, count(*) AS checked, count(*) FILTER ({breaks}) AS broken FROM e" for name, (_, breaks) in KEYWORDS.items()
    ),
)
def n06_keywords(t):
    """Values of four kinds against a schema for each keyword: how many break it."""
    e = t.raw("events").selectExpr("event_id", "event_type AS y", "user_id % 5 AS u", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k")
    docs = e.select(F.expr(KINDS_DOC).alias("doc"))
    counted = docs.agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(F.size(conform.broken(F.col("doc"), schema)) > 0).alias(f"n_{name}") for name, (schema, _) in KEYWORDS.items()],
    )
    one = F.explode(F.array(*[F.struct(F.lit(name).alias("keyword"), F.col(f"n_{name}").alias("broken")) for name in KEYWORDS])).alias("r")
    return counted.select("checked", one).select("r.keyword", "checked", "r.broken")
