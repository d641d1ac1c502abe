"""One JSON value against a schema, rule by rule.

The plain statement of what each keyword means. Column work does not go
through here: schemas are compiled to expressions (``operators/conform.py``).
It serves schemas that refer back to themselves, whose depth only the data
knows, and decides what a rule says about an absent value.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

ABSENT = object()


def parse(text: str):
    return json.loads(text, parse_float=Decimal, parse_int=Decimal, parse_constant=_refuse)


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def kind(value) -> str | None:
    if value is ABSENT:
        return None
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (Decimal, int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def same(a, b) -> bool:
    """Equal as JSON: 1 equals 1.0, true does not equal 1, key order does not matter."""
    if kind(a) != kind(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def has(value, key: str) -> bool:
    """Key of an object, string element of an array, or the string itself."""
    if isinstance(value, dict):
        return key in value
    if isinstance(value, list):
        return any(isinstance(v, str) and v == key for v in value)
    return isinstance(value, str) and value == key


def child(value, key: str):
    return value.get(key, ABSENT) if isinstance(value, dict) else ABSENT


def resolve(root, reference: str):
    """The schema a root-anchored pointer leads to, or ABSENT. Escapes are undone once per part."""
    at = root
    for part in reference.split("/")[1:]:
        part = part.replace("~1", "/", 1).replace("~0", "~", 1)
        if isinstance(at, dict) and part in at:
            at = at[part]
        elif isinstance(at, list) and re.fullmatch(r"-?\d+", part) and -len(at) <= int(part) < len(at):
            at = at[int(part)]
        else:
            return ABSENT
    return at


def broken_rules(schema, value, root=None) -> list[str]:
    """Names of the keywords of ``schema`` that ``value`` breaks."""
    if not isinstance(schema, dict):
        return []
    root = schema if root is None else root
    return [k for k, rule in RULES.items() if k in schema and not rule(schema, value, root)]


def conforms(schema, value, root=None) -> bool:
    return not broken_rules(schema, value, root)


def _is_type(name, value) -> bool:
    if value is ABSENT:
        return True
    if name == "integer":
        return kind(value) == "number" and value == int(value)
    return kind(value) == name


def _type(s, v, root):
    names = s["type"] if isinstance(s["type"], list) else [s["type"]]
    return not names or any(_is_type(n, v) for n in names)


def _items(s, v, root):
    if not isinstance(v, list):
        return True
    if isinstance(s["items"], dict):
        return all(conforms(s["items"], e, root) for e in v)
    return all(conforms(sub, e, root) for sub, e in zip(s["items"], v))


def _additional_items(s, v, root):
    rule, items = s["additionalItems"], s.get("items")
    if rule is False:
        return not isinstance(items, list) or v is ABSENT or (isinstance(v, list) and len(v) <= len(items))
    if not isinstance(rule, dict) or v is ABSENT:
        return True
    if not isinstance(v, list):
        return False
    return all(conforms(rule, e, root) for e in v[len(items):]) if isinstance(items, list) else True


def _additional_properties(s, v, root):
    if not isinstance(v, dict):
        return True
    patterns = s.get("patternProperties", {})
    extra = [k for k in v if k not in s.get("properties", {}) and not any(re.search(p, k) for p in patterns)]
    rule = s["additionalProperties"]
    if isinstance(rule, bool):
        return rule or not extra
    return all(conforms(rule, v[k], root) for k in extra)


def _exclusive(bound):
    def rule(s, v, root):
        if not s[f"exclusive{bound.capitalize()}"] or v is ABSENT:
            return True
        return kind(v) == "number" and not (bound in s and v == s[bound])

    return rule


def _dependencies(s, v, root):
    for prop, need in s["dependencies"].items():
        if has(v, prop):
            if isinstance(need, list):
                if not all(has(v, d) for d in need):
                    return False
            elif not conforms(need, v, root):
                return False
    return True


def _unique(s, v, root):
    if not s["uniqueItems"] or v is ABSENT:
        return True
    return isinstance(v, list) and not any(same(a, b) for i, a in enumerate(v) for b in v[:i])


def _pattern_properties(s, v, root):
    return not isinstance(v, dict) or all(
        conforms(sub, x, root) for p, sub in s["patternProperties"].items() for k, x in v.items() if re.search(p, k)
    )


def _when(wanted: str, test):
    return lambda s, v, root: kind(v) != wanted or test(s, v)


RULES = {
    "type": _type,
    "properties": lambda s, v, r: all(conforms(sub, child(v, k), r) for k, sub in s["properties"].items() if has(v, k)),
    "required": _when("object", lambda s, v: all(k in v for k in s["required"])),
    "items": _items,
    "additionalItems": _additional_items,
    "minimum": _when("number", lambda s, v: v >= s["minimum"]),
    "maximum": _when("number", lambda s, v: v <= s["maximum"]),
    "exclusiveMinimum": _exclusive("minimum"),
    "exclusiveMaximum": _exclusive("maximum"),
    "anyOf": lambda s, v, r: not s["anyOf"] or any(conforms(x, v, r) for x in s["anyOf"]),
    "allOf": lambda s, v, r: all(conforms(x, v, r) for x in s["allOf"]),
    "oneOf": lambda s, v, r: sum(conforms(x, v, r) for x in s["oneOf"]) == 1,
    "uniqueItems": _unique,
    "additionalProperties": _additional_properties,
    "$ref": lambda s, v, r: conforms(resolve(r, s["$ref"]), v, r),
    "enum": lambda s, v, r: v is not ABSENT and any(same(v, x) for x in s["enum"]),
    "minLength": _when("string", lambda s, v: len(v) >= s["minLength"]),
    "maxLength": _when("string", lambda s, v: len(v) <= s["maxLength"]),
    "not": lambda s, v, r: not conforms(s["not"], v, r),
    "maxProperties": _when("object", lambda s, v: len(v) <= s["maxProperties"]),
    "minProperties": _when("object", lambda s, v: len(v) >= s["minProperties"]),
    "maxItems": _when("array", lambda s, v: len(v) <= s["maxItems"]),
    "minItems": _when("array", lambda s, v: len(v) >= s["minItems"]),
    "dependencies": _dependencies,
    "pattern": _when("string", lambda s, v: re.search(s["pattern"], v) is not None),
    "patternProperties": _pattern_properties,
    "multipleOf": _when("number", lambda s, v: s["multipleOf"] != 0 and v % s["multipleOf"] == 0),
}
