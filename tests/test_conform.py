"""JSON conformance: a passing and a failing row per keyword, and the compiler against the plain checker."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tickloom.functions import jsoncheck
from tickloom.operators import conform

# schema, conforming value, violating value (JSON text)
CASES = [
    ({"type": "string"}, '"a"', "1"),
    ({"type": ["string", "null"]}, "null", "[]"),
    ({"type": "integer"}, "1.0", "1.5"),
    ({"type": "object"}, "{}", "[]"),
    ({"properties": {"a": {"type": "number"}}}, '{"a":1,"b":"x"}', '{"a":"x"}'),
    ({"required": ["a", "b"]}, '{"a":1,"b":2}', '{"a":1}'),
    ({"items": {"type": "number"}}, "[1,2]", '[1,"x"]'),
    ({"items": [{"type": "number"}, {"type": "string"}]}, '[1,"x",true]', '["x"]'),
    ({"items": [{}], "additionalItems": False}, "[1]", "[1,2]"),
    ({"items": [{}], "additionalItems": {"type": "string"}}, '[1,"x"]', "[1,2]"),
    ({"minimum": 2}, "2", "1.99"),
    ({"maximum": 2}, '"big"', "2.01"),
    ({"minimum": 2, "exclusiveMinimum": True}, "2.1", "2.0"),
    ({"maximum": 2, "exclusiveMaximum": True}, "1", "2"),
    ({"exclusiveMinimum": True}, "1", '"text"'),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, "7", "3"),
    ({"allOf": [{"type": "number"}, {"minimum": 5}]}, "7", "3"),
    ({"oneOf": [{"type": "number"}, {"minimum": 5}]}, "3", "7"),
    ({"uniqueItems": True}, '[1,"1",true,{"a":1}]', "[1,2,1.0]"),
    ({"uniqueItems": True}, '[{"a":1},{"a":2}]', '[{"a":1,"b":2},{"b":2,"a":1}]'),
    ({"uniqueItems": True}, '[[1e2],[101]]', "[[1e2],[100]]"),
    ({"uniqueItems": True}, '[{"a":["1.0"]},{"a":["1"]},{"a":"\\\\"},{"a":"\\""}]', '[{"a":[-0.50,{"b":1E1}]},{"a":[-0.5,{"b":10}]}]'),
    ({"additionalProperties": False, "properties": {"a": {}}}, '{"a":1}', '{"b":1}'),
    ({"additionalProperties": {"type": "string"}, "patternProperties": {"^n": {}}}, '{"n1":1,"x":"s"}', '{"x":1}'),
    ({"definitions": {"a/b": {"type": "string"}}, "$ref": "#/definitions/a~1b"}, '"x"', "1"),
    ({"enum": [1, "a", {"k": [1, None]}]}, '{"k":[1.0,null]}', '{"k":[1]}'),
    ({"minLength": 2}, '"äö"', '"ä"'),
    ({"maxLength": 2}, '"äö"', '"äöü"'),
    ({"not": {"type": "null"}}, "0", "null"),
    ({"maxProperties": 1}, '{"a":1}', '{"a":1,"b":1}'),
    ({"minProperties": 1}, '{"a":1}', "{}"),
    ({"maxItems": 1}, "[1]", "[1,2]"),
    ({"minItems": 1}, "[1]", "[]"),
    ({"dependencies": {"a": ["b"]}}, '{"a":1,"b":1}', '{"a":1}'),
    ({"dependencies": {"a": {"minProperties": 2}}}, '{"b":1}', '{"a":1}'),
    ({"pattern": "^a.c$"}, '"abc"', '"abcd"'),
    ({"patternProperties": {"^s": {"type": "string"}}}, '{"s":"x","t":1}', '{"s1":1}'),
    ({"multipleOf": 0.1}, "0.3", "0.35"),
    ({"properties": {"it's \\ \"q\"": {"type": "null"}}}, '{"it\'s \\\\ \\"q\\"":null}', '{"it\'s \\\\ \\"q\\"":1}'),
]


@pytest.mark.parametrize("schema,good,bad", CASES, ids=[json.dumps(c[0])[:60] for c in CASES])
def test_keywords(spark, schema, good, bad):
    df = spark.createDataFrame([(good,), (bad,)], "doc string").coalesce(1)
    assert [r.conforms for r in conform.conformance(df, "doc", schema).collect()] == [True, False]
    tree = conform.load_schema(schema)
    assert jsoncheck.conforms(tree, jsoncheck.parse(good)) and not jsoncheck.conforms(tree, jsoncheck.parse(bad))


def test_absent_and_unparsable(spark):
    df = spark.createDataFrame([(None,), ("{oops",)], "doc string").coalesce(1)
    got = [r.broken for r in conform.conformance(df, "doc", {"type": "object", "enum": [{}]}).collect()]
    assert got == [["enum"], ["json"]]


def test_key_test_reaches_into_arrays_and_strings(spark):
    schema = {"dependencies": {"a": ["b"]}, "properties": {"a": {"enum": [1]}}}
    docs = ['["a","b"]', '["a"]', '"a"', '["b"]']
    df = spark.createDataFrame([(d,) for d in docs], "doc string").coalesce(1)
    got = [r.broken for r in conform.conformance(df, "doc", schema).collect()]
    tree = conform.load_schema(schema)
    assert got == [jsoncheck.broken_rules(tree, jsoncheck.parse(d)) for d in docs]


LEAF = st.one_of(st.none(), st.booleans(), st.integers(-3, 12), st.sampled_from([0.5, 1.0, 2.25]), st.sampled_from(["", "a", "ab", "abc", "b"]))
VALUE = st.recursive(LEAF, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from("abc"), x, max_size=3)), max_leaves=6)

RECURSIVE = [
    {"properties": {"a": {"$ref": "#"}, "b": {"minimum": 1}}},
    {"items": {"$ref": "#"}, "properties": {"b": {"$ref": "#"}}, "not": {"enum": [2, "ab"]}},
    {"anyOf": [{"type": ["number", "null"]}, {"type": "array", "items": {"$ref": "#"}}, {"type": "object", "additionalProperties": {"$ref": "#"}, "minProperties": 1}]},
    {
        "definitions": {
            "odd": {"type": "object", "properties": {"a": {"$ref": "#/definitions/even"}}, "patternProperties": {"^[bc]": {"not": {"$ref": "#/definitions/odd"}}}},
            "even": {"oneOf": [{"$ref": "#/definitions/odd"}, {"items": [{}, {"$ref": "#/definitions/odd"}], "additionalItems": {"$ref": "#/definitions/even"}, "type": "array"}]},
        },
        "allOf": [{"$ref": "#/definitions/even"}], "maxProperties": 2,
    },
]


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
@pytest.mark.parametrize("schema", RECURSIVE, ids=range(len(RECURSIVE)))
def test_self_references_equal_the_plain_checker(spark, schema, data):
    """Equal documents, equal values at several depths, absent and unparsable text; rows and other columns stay."""
    texts = [json.dumps(v) for v in data.draw(st.lists(VALUE, min_size=12, max_size=12))]
    texts += [texts[0], '{"a":{"a":{"a":[[],[[{"b":1}]]]}}}', '[[[[2]]]]', '{"a":{"a":{"b":1}},"b":{"a":{"b":1}}}', "{oops", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, doc string").repartition(3)
    got = {r.id: r.broken for r in conform.conformance(df, "doc", schema).collect()}
    tree = conform.load_schema(schema)

    def plain(text):
        if text is None:
            return jsoncheck.broken_rules(tree, jsoncheck.ABSENT)
        return ["json"] if text == "{oops" else jsoncheck.broken_rules(tree, jsoncheck.parse(text))

    assert got == {i: plain(x) for i, x in enumerate(texts)}


def test_self_reference_at_one_value_has_no_verdict(spark):
    df = spark.createDataFrame([("1",)], "doc string")
    for schema in ({"anyOf": [{"$ref": "#"}]}, {"definitions": {"a": {"not": {"$ref": "#/definitions/b"}}, "b": {"$ref": "#/definitions/a"}}, "$ref": "#/definitions/a"}):
        with pytest.raises(ValueError):
            conform.conformance(df, "doc", schema)
    assert conform.violation_summary(df, "doc", RECURSIVE[0]).first().conforming == 1


NAMES = st.sampled_from(["null", "boolean", "number", "integer", "string", "array", "object"])


def schemas(sub):
    return st.fixed_dictionaries(
        {},
        optional={
            "type": st.one_of(NAMES, st.lists(NAMES, max_size=3)),
            "properties": st.dictionaries(st.sampled_from("abc"), sub, max_size=2),
            "required": st.lists(st.sampled_from("abc"), max_size=2),
            "items": st.one_of(sub, st.lists(sub, max_size=2)),
            "additionalItems": st.one_of(st.booleans(), sub),
            "minimum": st.integers(0, 5), "maximum": st.integers(3, 9), "exclusiveMinimum": st.booleans(), "exclusiveMaximum": st.booleans(),
            "anyOf": st.lists(sub, max_size=2), "allOf": st.lists(sub, max_size=2), "oneOf": st.lists(sub, max_size=2),
            "uniqueItems": st.booleans(), "additionalProperties": st.one_of(st.booleans(), sub),
            "enum": st.lists(VALUE, max_size=3), "minLength": st.integers(0, 2), "maxLength": st.integers(0, 3), "not": sub,
            "maxProperties": st.integers(0, 2), "minProperties": st.integers(0, 2), "maxItems": st.integers(0, 2), "minItems": st.integers(0, 2),
            "dependencies": st.dictionaries(st.sampled_from("abc"), st.one_of(st.lists(st.sampled_from("abc"), max_size=2), sub), max_size=1),
            "pattern": st.sampled_from(["^a", "b$", "c"]), "patternProperties": st.dictionaries(st.sampled_from(["^a", "[bc]"]), sub, max_size=1),
            "multipleOf": st.sampled_from([2, 0.5, 3]),
        },
    )


SCHEMA = st.recursive(st.just({}), schemas, max_leaves=5)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(SCHEMA, st.lists(VALUE, min_size=20, max_size=20))
def test_compiled_schema_equals_plain_checker(spark, schema, values):
    texts = [json.dumps(v) for v in values]
    df = spark.createDataFrame([(x,) for x in texts], "doc string").coalesce(1)
    got = [r.broken for r in conform.conformance(df, "doc", schema).collect()]
    tree = conform.load_schema(schema)
    assert got == [jsoncheck.broken_rules(tree, jsoncheck.parse(x)) for x in texts]
