"""Conformance of a JSON text column with a schema.

The schema is read on the driver and becomes one boolean expression per
top-level keyword over the parsed VARIANT value, so checking is a projection:
no shuffle and no Python worker.

A schema that refers back to itself is as deep as the data. It is cut at those
references, and a work list holds which part of a value meets which part of the
schema. The list is expanded level by level, from the documents inwards, until
nothing is reached; equal pairs of value and part are one row. Then verdicts are
folded back from the innermost level: each row's expression looks up those of the
rows that it reaches. Levels are as many as values are nested.

Notes: patterns are Java regular expressions. Text with repeated object keys
parses only if ``spark.sql.variant.allowDuplicateKeys`` is set. Where a rule
would raise on a value of the wrong kind, the value breaks the rule.
"""

from __future__ import annotations

import json
import re
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import jsoncheck
from tickloom.session import cut_lineage

UNPARSABLE = "json"
_REACHED = "ARRAY<STRUCT<part: INT, v: VARIANT>>"
_NONE_REACHED = f"CAST(array() AS {_REACHED})"
# Strings, numbers and what lies between, in JSON text whose escaped quotes have been replaced.
_TOKENS = r'"[^"]*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'


class RecursiveSchema(Exception):
    """The schema refers back to itself through this reference."""


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _all(parts: list[str]) -> str:
    return "(" + " AND ".join(parts) + ")" if parts else "true"


def _any(parts: list[str]) -> str:
    return "(" + " OR ".join(parts) + ")" if parts else "false"


class _Compiler:
    """Schema to SQL text. A node is a lambda variable with v (value), t (kind), o, a, s, d, f."""

    def __init__(self, root, cuts: tuple[str, ...] = ()):
        self.root = root
        self.names = count(1)
        # References whose verdicts are looked up in a column ``known`` in place of being worked out.
        self.cuts = cuts

    def name(self, prefix: str) -> str:
        return f"{prefix}{next(self.names)}"

    def bind(self, value: str, body) -> str:
        """Classify ``value`` once and hand the node to ``body``."""
        w, n = self.name("w"), self.name("n")
        kind = (
            f"CASE WHEN startswith({w}.y, 'OBJECT') THEN 'object' WHEN startswith({w}.y, 'ARRAY') THEN 'array'"
            f" WHEN {w}.y = 'STRING' THEN 'string' WHEN {w}.y = 'BOOLEAN' THEN 'boolean'"
            f" WHEN {w}.y = 'VOID' THEN 'null' ELSE 'number' END"
        )
        number = f"NOT ({w}.y IN ('STRING', 'BOOLEAN', 'VOID') OR startswith({w}.y, 'OBJECT') OR startswith({w}.y, 'ARRAY'))"
        views = {
            "v": f"{w}.v",
            "t": kind,
            "o": f"try_variant_get({w}.v, '$', 'map<string,variant>')",
            "a": f"try_variant_get({w}.v, '$', 'array<variant>')",
            "s": f"CASE WHEN {w}.y = 'STRING' THEN try_variant_get({w}.v, '$', 'string') END",
            "d": f"CASE WHEN {number} THEN try_variant_get({w}.v, '$', 'decimal(38,18)') END",
            "f": f"CASE WHEN {number} THEN try_variant_get({w}.v, '$', 'double') END",
        }
        test = body(n)
        # Only the views of the value that the rules look at are worked out.
        used = [f"'{x}', {how}" for x, how in views.items() if re.search(rf"\b{n}\.{x}\b", test)]
        if not used:
            return test
        return (
            f"transform(transform(array(named_struct('v', {value}, 'y', schema_of_variant({value}))),"
            f" {w} -> named_struct({', '.join(used)})), {n} -> {test})[0]"
        )

    def check(self, schema, value: str, seen: tuple = ()) -> str:
        """Does the value conform? Never NULL for a parsed value."""
        if not isinstance(schema, dict):
            return "true"
        rules = [k for k in jsoncheck.RULES if k in schema]
        if not rules:
            return "true"
        return self.bind(value, lambda n: _all([self.rule(k, schema, n, seen) for k in rules]))

    def rule(self, keyword: str, schema: dict, n: str, seen: tuple) -> str:
        return getattr(self, "_" + keyword.lstrip("$"))(schema, n, seen)

    def absent_ok(self, schema) -> bool:
        return jsoncheck.conforms(schema, jsoncheck.ABSENT, self.root) if schema is not jsoncheck.ABSENT else True

    def number(self, n: str, op: str, bound) -> str:
        """Compare as decimals; numbers outside decimal(38,18) compare as doubles."""
        as_double = f"{n}.f {op} CAST({_text(str(bound))} AS DOUBLE)"
        as_decimal = f"{n}.d {op} try_cast({_text(str(bound))} AS DECIMAL(38,18))"
        return f"coalesce({as_decimal}, {as_double})"

    def has(self, n: str, key: str) -> str:
        e = self.name("e")
        return (
            f"CASE {n}.t WHEN 'object' THEN map_contains_key({n}.o, {_text(key)})"
            f" WHEN 'array' THEN exists({n}.a, {e} -> schema_of_variant({e}) = 'STRING' AND"
            f" try_variant_get({e}, '$', 'string') = {_text(key)})"
            f" WHEN 'string' THEN {n}.s = {_text(key)} ELSE false END"
        )

    def equals(self, literal, n: str) -> str:
        kind = jsoncheck.kind(literal)
        parts = [f"{n}.t = '{kind}'"]
        if kind == "boolean":
            parts.append(f"try_variant_get({n}.v, '$', 'boolean') = {str(literal).lower()}")
        elif kind == "number":
            parts.append(self.number(n, "=", literal))
        elif kind == "string":
            parts.append(f"{n}.s = {_text(literal)}")
        elif kind == "array":
            parts.append(f"size({n}.a) = {len(literal)}")
            parts += [self.bind(f"get({n}.a, {i})", lambda m, x=x: self.equals(x, m)) for i, x in enumerate(literal)]
        elif kind == "object":
            parts.append(f"size({n}.o) = {len(literal)}")
            for k, x in literal.items():
                held = self.bind(f"try_element_at({n}.o, {_text(k)})", lambda m, x=x: self.equals(x, m))
                parts.append(f"map_contains_key({n}.o, {_text(k)}) AND {held}")
        # CASE keeps the value tests away from values of another kind.
        return f"CASE WHEN {parts[0]} THEN coalesce({_all(parts[1:])}, false) ELSE false END"

    def only(self, n: str, kind: str, test: str) -> str:
        return f"CASE WHEN {n}.t = '{kind}' THEN {test} ELSE true END"

    def must(self, n: str, kind: str, test: str) -> str:
        return f"CASE WHEN {n}.t = '{kind}' THEN {test} ELSE false END"

    def _type(self, s, n, seen):
        names = s["type"] if isinstance(s["type"], list) else [s["type"]]
        tests = []
        for name in names:
            if name == "integer":
                tests.append(f"CASE WHEN {n}.t = 'number' THEN coalesce({n}.d = floor({n}.d), {n}.f = floor({n}.f)) ELSE false END")
            else:
                tests.append(f"{n}.t = {_text(name)}")
        return _any(tests) if tests else "true"

    def _properties(self, s, n, seen):
        parts = []
        for k, sub in s["properties"].items():
            inside = self.check(sub, f"try_element_at({n}.o, {_text(k)})", seen)
            other = "true" if self.absent_ok(sub) else f"NOT {self.has(n, k)}"
            parts.append(
                f"CASE WHEN {n}.t = 'object' THEN CASE WHEN map_contains_key({n}.o, {_text(k)}) THEN {inside} ELSE true END"
                f" ELSE {other} END"
            )
        return _all(parts)

    def _required(self, s, n, seen):
        return self.only(n, "object", _all([f"map_contains_key({n}.o, {_text(k)})" for k in s["required"]]))

    def _items(self, s, n, seen):
        items = s["items"]
        if isinstance(items, dict):
            e = self.name("e")
            return self.only(n, "array", f"forall({n}.a, {e} -> {self.check(items, e, seen)})")
        if not isinstance(items, list):
            raise ValueError("items must be a schema or a list of schemas")
        parts = [
            f"CASE WHEN size({n}.a) > {i} THEN {self.check(sub, f'get({n}.a, {i})', seen)} ELSE true END"
            for i, sub in enumerate(items)
        ]
        return self.only(n, "array", _all(parts))

    def _additionalItems(self, s, n, seen):
        rule, items = s["additionalItems"], s.get("items")
        if rule is False:
            return self.must(n, "array", f"size({n}.a) <= {len(items)}") if isinstance(items, list) else "true"
        if not isinstance(rule, dict):
            return "true"
        if not isinstance(items, list):
            return self.must(n, "array", "true")
        e = self.name("e")
        rest = f"slice({n}.a, {len(items) + 1}, greatest(size({n}.a) - {len(items)}, 0))"
        return self.must(n, "array", f"forall({rest}, {e} -> {self.check(rule, e, seen)})")

    def _minimum(self, s, n, seen):
        return self.only(n, "number", self.number(n, ">=", s["minimum"]))

    def _maximum(self, s, n, seen):
        return self.only(n, "number", self.number(n, "<=", s["maximum"]))

    def _exclusive(self, s, n, bound):
        flag = s[f"exclusive{bound.capitalize()}"]
        if not isinstance(flag, bool):
            raise ValueError(f"exclusive{bound.capitalize()} must be true or false")
        if not flag:
            return "true"
        return self.must(n, "number", f"NOT {self.number(n, '=', s[bound])}" if bound in s else "true")

    def _exclusiveMinimum(self, s, n, seen):
        return self._exclusive(s, n, "minimum")

    def _exclusiveMaximum(self, s, n, seen):
        return self._exclusive(s, n, "maximum")

    def _anyOf(self, s, n, seen):
        return _any([self.check(x, f"{n}.v", seen) for x in s["anyOf"]]) if s["anyOf"] else "true"

    def _allOf(self, s, n, seen):
        return _all([self.check(x, f"{n}.v", seen) for x in s["allOf"]])

    def _oneOf(self, s, n, seen):
        return "(" + " + ".join(f"int({self.check(x, f'{n}.v', seen)})" for x in s["oneOf"]) + " = 1)" if s["oneOf"] else "false"

    def _uniqueItems(self, s, n, seen):
        if not s["uniqueItems"]:
            return "true"
        e = self.name("e")
        return self.must(n, "array", f"size(array_distinct(transform({n}.a, {e} -> {self.canonical(e)}))) = size({n}.a)")

    def canonical(self, value: str) -> str:
        """Text that equal values share: keys come sorted, and numbers, however nested, are written by their value."""
        k = self.name("k")
        plain = f"replace(replace(to_json({value}), {_text(chr(92) * 2)}, {_text(chr(1))}), {_text(chr(92) + chr(34))}, {_text(chr(2))})"
        number = f"coalesce(CAST(try_cast({k} AS DECIMAL(38,18)) AS STRING), CAST(try_cast({k} AS DOUBLE) AS STRING))"
        return (
            f"array_join(transform(regexp_extract_all({plain}, {_text(_TOKENS)}, 0),"
            f" {k} -> CASE WHEN {k} RLIKE '^-?[0-9]' THEN {number} ELSE {k} END), '')"
        )

    def _additionalProperties(self, s, n, seen):
        rule, e = s["additionalProperties"], self.name("e")
        if rule is True:
            return "true"
        known = [f"{e}.key = {_text(k)}" for k in s.get("properties", {})]
        known += [f"{e}.key RLIKE {_text(p)}" for p in s.get("patternProperties", {})]
        test = "false" if rule is False else self.check(rule, f"{e}.value", seen)
        return self.only(n, "object", f"forall(map_entries({n}.o), {e} -> {_any([*known, test])})")

    def _ref(self, s, n, seen):
        pointer = s["$ref"]
        if pointer in self.cuts:
            return f"coalesce(try_element_at(known, {self.pair(self.cuts.index(pointer), f'{n}.v')}), false)"
        if pointer in seen:
            raise RecursiveSchema(pointer)
        target = jsoncheck.resolve(self.root, pointer)
        if target is self.root:
            raise RecursiveSchema(pointer)
        return "true" if target is jsoncheck.ABSENT else self.check(target, f"{n}.v", (*seen, pointer))

    def _enum(self, s, n, seen):
        return _any([self.equals(x, n) for x in s["enum"]])

    def _minLength(self, s, n, seen):
        return self.only(n, "string", f"char_length({n}.s) >= {s['minLength']}")

    def _maxLength(self, s, n, seen):
        return self.only(n, "string", f"char_length({n}.s) <= {s['maxLength']}")

    def _not(self, s, n, seen):
        return f"NOT {self.check(s['not'], f'{n}.v', seen)}"

    def _maxProperties(self, s, n, seen):
        return self.only(n, "object", f"size({n}.o) <= {s['maxProperties']}")

    def _minProperties(self, s, n, seen):
        return self.only(n, "object", f"size({n}.o) >= {s['minProperties']}")

    def _maxItems(self, s, n, seen):
        return self.only(n, "array", f"size({n}.a) <= {s['maxItems']}")

    def _minItems(self, s, n, seen):
        return self.only(n, "array", f"size({n}.a) >= {s['minItems']}")

    def _dependencies(self, s, n, seen):
        parts = []
        for prop, need in s["dependencies"].items():
            if isinstance(need, list):
                test = _all([self.has(n, d) for d in need])
            else:
                test = self.check(need, f"{n}.v", seen)
            parts.append(f"CASE WHEN {self.has(n, prop)} THEN {test} ELSE true END")
        return _all(parts)

    def _pattern(self, s, n, seen):
        return self.only(n, "string", f"{n}.s RLIKE {_text(s['pattern'])}")

    def _patternProperties(self, s, n, seen):
        parts = []
        for pattern, sub in s["patternProperties"].items():
            e = self.name("e")
            test = f"CASE WHEN {e}.key RLIKE {_text(pattern)} THEN {self.check(sub, f'{e}.value', seen)} ELSE true END"
            parts.append(f"forall(map_entries({n}.o), {e} -> {test})")
        return self.only(n, "object", _all(parts))

    def _multipleOf(self, s, n, seen):
        m = s["multipleOf"]
        if m == 0:
            return self.only(n, "number", "false")
        as_decimal = f"{n}.d % try_cast({_text(str(m))} AS DECIMAL(38,18)) = 0"
        return self.only(n, "number", f"coalesce({as_decimal}, {n}.f % CAST({_text(str(m))} AS DOUBLE) = 0)")

    # --- what a value's rules reach through the cut references

    def pair(self, part: int | str, value: str) -> str:
        """Key of a value that meets a part of the schema."""
        return f"concat(CAST({part} AS STRING), ':', sha2(to_json({value}), 256))"

    def reach(self, schema, value: str, seen: tuple = ()) -> str | None:
        """Array of (part, value) that checking ``value`` may look up; None if there is none. It may hold some too many."""
        if not isinstance(schema, dict):
            return None
        members = f"try_variant_get({value}, '$', 'map<string,variant>')"
        elements = f"try_variant_get({value}, '$', 'array<variant>')"
        found: list[str] = []

        def add(sub, at: str, test: str | None = None) -> None:
            inside = self.reach(sub, at, seen)
            if inside:
                found.append(f"CASE WHEN {test} THEN {inside} END" if test else inside)

        def each(sub, array: str) -> None:
            e = self.name("e")
            inside = self.reach(sub, e, seen)
            if inside:
                found.append(f"flatten(transform({array}, {e} -> {inside}))")

        if "$ref" in schema:
            pointer = schema["$ref"]
            if pointer in self.cuts:
                found.append(f"array(named_struct('part', {self.cuts.index(pointer)}, 'v', {value}))")
            elif (target := jsoncheck.resolve(self.root, pointer)) is not jsoncheck.ABSENT:
                add(target, value)
        for k, sub in schema.get("properties", {}).items():
            add(sub, f"try_element_at({members}, {_text(k)})", f"map_contains_key({members}, {_text(k)})")
        for sub in (*schema.get("patternProperties", {}).values(), schema.get("additionalProperties")):
            each(sub, f"map_values({members})")
        items = schema.get("items")
        for i, sub in enumerate(items if isinstance(items, list) else ()):
            add(sub, f"get({elements}, {i})", f"size({elements}) > {i}")
        for sub in (items, schema.get("additionalItems")):
            each(sub, elements)
        same = [schema.get("not"), *schema.get("dependencies", {}).values()]
        for sub in (*same, *schema.get("anyOf", ()), *schema.get("allOf", ()), *schema.get("oneOf", ())):
            add(sub, value)
        return f"concat({', '.join(f'coalesce({f}, {_NONE_REACHED})' for f in found)})" if found else None

    def same_value_parts(self, schema) -> set[int]:
        """Parts that a schema sends the very same value to."""
        if not isinstance(schema, dict):
            return set()
        pointer = schema.get("$ref")
        out = {self.cuts.index(pointer)} if pointer in self.cuts else set()
        subs = [schema.get("not"), *schema.get("dependencies", {}).values(), *schema.get("anyOf", ()), *schema.get("allOf", ()), *schema.get("oneOf", ())]
        if pointer is not None and pointer not in self.cuts:
            subs.append(jsoncheck.resolve(self.root, pointer))
        return out.union(*(self.same_value_parts(x) for x in subs))


def load_schema(schema: str | dict) -> dict:
    """Schema text or tree, with exact numbers."""
    return jsoncheck.parse(schema if isinstance(schema, str) else json.dumps(schema))


def rules_of(schema: dict) -> list[str]:
    return [k for k in jsoncheck.RULES if k in schema]


def broken(column: Column, schema: str | dict) -> Column:
    """Array of the top-level keywords the JSON text breaks; empty if it conforms.

    Text that is no JSON breaks the rule 'json'. A NULL is an absent value: most
    rules have nothing to say about it. A schema that refers back to itself is no
    single expression; use ``conformance``.
    """
    tree = load_schema(schema)
    return F.when(column.isNull(), _absent(tree)).otherwise(_compiled(column, tree))


def _absent(tree: dict) -> Column:
    return F.array(*[F.lit(r) for r in jsoncheck.broken_rules(tree, jsoncheck.ABSENT)]).cast("array<string>")


def _compiled(column: Column, tree: dict, cuts: tuple[str, ...] = ()) -> Column:
    c = _Compiler(tree, cuts)

    def verdicts(n: str) -> str:
        flags = [f"CASE WHEN {c.rule(k, tree, n, ())} THEN NULL ELSE {_text(k)} END" for k in rules_of(tree)]
        return f"array_compact(array({', '.join(flags)}))" if flags else "CAST(array() AS ARRAY<STRING>)"

    body = c.bind("x", verdicts)
    expression = f"x -> CASE WHEN x IS NULL THEN array('{UNPARSABLE}') ELSE {body} END"
    return F.call_function("transform", F.array(F.try_parse_json(column)), F.expr(expression))[0]


def _recursive_references(tree: dict) -> tuple[str, ...]:
    """References that must be cut so that the rest of the schema is a finite expression."""
    cuts: tuple[str, ...] = ()
    while True:
        c = _Compiler(tree, cuts)
        parts = [tree, *(jsoncheck.resolve(tree, pointer) for pointer in cuts)]
        try:
            for part in parts:
                c.check(part, "x")
            break
        except RecursiveSchema as e:
            cuts = (*cuts, e.args[0])
    # A part that sends a value on to itself, without going inwards, has no verdict.
    onward = [c.same_value_parts(part) for part in parts[1:]]
    for start in range(len(cuts)):
        met, todo = set(), list(onward[start])
        while todo:
            if (i := todo.pop()) == start:
                raise ValueError(f"{cuts[start]} refers to itself at the same value")
            if i not in met:
                met.add(i)
                todo += onward[i]
    return cuts


def _by_levels(df: DataFrame, column: str, tree: dict, cuts: tuple[str, ...]) -> DataFrame:
    """``df`` with ``broken``, by a work list that follows the schema's references into the values."""
    c = _Compiler(tree, cuts)
    parts = [jsoncheck.resolve(tree, pointer) for pointer in cuts]
    inwards = " ".join(f"WHEN {i} THEN {c.reach(p, 'v') or _NONE_REACHED}" for i, p in enumerate(parts))
    verdict = " ".join(f"WHEN {i} THEN {c.check(p, 'x')}" for i, p in enumerate(parts))

    def reached(values: DataFrame, found: str) -> DataFrame:
        rows = values.select(F.col("id").alias("parent"), F.explode(F.expr(found)).alias("r")).select("parent", "r.part", "r.v")
        return cut_lineage(rows.withColumn("id", F.expr(c.pair("part", "v"))))

    def known_to(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
        """Per parent, the verdicts of what it reaches, as a map."""
        pairs = edges.select("parent", "id").distinct().join(verdicts, "id")
        return pairs.groupBy(F.col("parent").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("id", "ok"))).alias("known"))

    def with_known(rows: DataFrame, known: DataFrame | None) -> DataFrame:
        nothing = F.expr("CAST(map() AS MAP<STRING, BOOLEAN>)")
        if known is None:
            return rows.withColumn("known", nothing)
        return rows.join(known, "id", "left").withColumn("known", F.coalesce("known", nothing))

    texts = df.where(F.col(column).isNotNull()).select(F.col(column).alias("text")).distinct()
    documents = cut_lineage(texts.select(F.sha2("text", 256).alias("id"), "text"))
    levels = [reached(documents.select("id", F.try_parse_json("text").alias("v")), c.reach(tree, "v") or _NONE_REACHED)]
    while not levels[-1].isEmpty():
        values = levels[-1].dropDuplicates(["id"]).select("id", "part", "v")
        levels.append(reached(values, f"CASE part {inwards} END"))
    known = None
    for edges in levels[-2::-1]:
        values = with_known(edges.dropDuplicates(["id"]).select("id", "part", "v"), known)
        # The value is named x, as an expression looks at it several times.
        held = F.call_function("transform", F.array("v"), F.expr(f"x -> CASE part {verdict} END"))[0]
        known = cut_lineage(known_to(edges, values.select("id", held.alias("ok"))))
    judged = with_known(documents, known).select("id", _compiled(F.col("text"), tree, cuts).alias("__broken"))
    out = df.withColumn("__id", F.sha2(F.col(column), 256)).join(judged.withColumnRenamed("id", "__id"), "__id", "left")
    return out.withColumn("broken", F.coalesce("__broken", _absent(tree))).drop("__id", "__broken")


def conformance(df: DataFrame, column: str, schema: str | dict) -> DataFrame:
    """``df`` with ``broken`` (array of rules) and ``conforms``."""
    tree = load_schema(schema)
    cuts = _recursive_references(tree)
    judged = _by_levels(df, column, tree, cuts) if cuts else df.withColumn("broken", broken(F.col(column), schema))
    return judged.withColumn("conforms", F.size("broken") == 0)


def violation_summary(df: DataFrame, column: str, schema: str | dict) -> DataFrame:
    """One row: checked rows, conforming rows, and violations per rule of the schema."""
    rules = [UNPARSABLE, *rules_of(load_schema(schema))]
    found = conformance(df.select(column), column, schema).select(F.col("broken").alias("b"))
    return found.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.size("b") == 0).alias("conforming"),
        *[F.count_if(F.array_contains("b", r)).alias(f"broken_{r.lstrip('$')}") for r in rules],
    )
