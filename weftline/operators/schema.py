"""JSON Schema as column expressions: a schema is data, and its rules run over any number of documents in one narrow stage.

A document is a JSON text, parsed once into a VARIANT. ``compile_schema`` turns a schema into an expression that yields
(path, rule) for each rule that a document breaks, so no row meets another and nothing runs on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULT = "struct<path:string,rule:string>"
NOTES = frozenset("$schema $id $comment $defs title description default examples".split())
RULES = frozenset("type enum const required properties additionalProperties items minItems maxItems uniqueItems minLength maxLength pattern format minimum maximum exclusiveMinimum exclusiveMaximum $ref".split())
ARRAY_RULES = frozenset("items minItems maxItems uniqueItems".split())
#: Date and time with an offset, as JSON Schema's ``date-time`` asks for.
DATE_TIME = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it; f gives an array."""
    return F.flatten(F.transform(F.array(value), f))


def _is_kind(value: Column, name: str) -> Column:
    """A VARIANT is of a plain kind: string, boolean, null or number."""
    found = F.schema_of_variant(value)
    return ~F.left(found, F.lit(4)).isin("STRI", "BOOL", "VOID", "OBJE", "ARRA") if name == "number" else found == {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[name]


def _is_value(value: Column, allowed: list) -> Column:
    """Equal to one of strings, numbers, booleans and null."""
    out = F.lit(False)
    if texts := [a for a in allowed if isinstance(a, str)]:
        out = F.try_variant_get(value, "$", "string").isin(texts) & _is_kind(value, "string")
    for a in allowed:
        if isinstance(a, bool) or a is None:
            out = out | (F.to_json(value) == json.dumps(a))
        elif isinstance(a, (int, float)):
            out = out | (_is_kind(value, "number") & (F.try_variant_get(value, "$", "double") == float(a)))
        elif not isinstance(a, str):
            raise ValueError(f"enum and const take plain values, not {a!r}")
    return out


def compile_schema(schema: dict) -> Callable[[Column], Column]:
    """From a VARIANT column to the array of (path, rule) that it breaks; an empty array means a valid document.

    A rule's name is its keyword, with the property's name after a colon for ``required`` and ``additionalProperties``. A
    keyword says nothing of values of other types than its own. Keywords outside ``RULES`` and ``NOTES``, forms of
    ``additionalProperties`` other than true and false, other formats than date-time, and recursive references raise an
    error: no rule is left out without a word. Patterns are Java's. Repeated items are found by their JSON text, so
    1 and 1.0 differ there.
    """
    root = schema

    def resolve(node: dict, seen: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
        while "$ref" in node:
            ref = node["$ref"]
            if ref in seen or not ref.startswith("#/"):
                raise ValueError(f"reference is recursive or leads out of the schema: {ref}")
            target = root
            for step in ref[2:].split("/"):
                target = target[step]
            node, seen = {**target, **{k: v for k, v in node.items() if k != "$ref"}}, (*seen, ref)
        return node, seen

    none = F.array().cast(f"array<{FAULT}>")

    def joined(own: list[Column], deeper: list[Column]) -> Column:
        here = [F.array_compact(F.array(*own)).cast(f"array<{FAULT}>")] if own else []
        return F.flatten(F.array(none, *here, *(F.coalesce(d.cast(f"array<{FAULT}>"), none) for d in deeper)))

    def faults(value: Column, path: Column, node: dict, seen: tuple[str, ...]) -> tuple[list[Column], list[Column]]:
        """Of a VARIANT that is cheap to name: faults or nulls, and arrays of faults or nulls. A value that isn't there has none: its tests are null.

        Only what may be an object or an array is opened, once; its fields and items are taken from there. A plain value's
        rules look at the value first and at its kind, which costs more, where they would be broken.
        """
        node, seen = resolve(node, seen)
        if unknown := node.keys() - RULES - NOTES:
            raise ValueError(f"unknown keywords: {sorted(unknown)}")
        types = [node["type"]] if isinstance(node.get("type"), str) else node.get("type", [])
        if not node.get("additionalProperties", True) or node.keys() & {"properties", "required"} or "object" in types or node.keys() & ARRAY_RULES or "array" in types:
            opened = F.struct(value.alias("v"), F.try_variant_get(value, "$", "map<string,variant>").alias("fields"), F.try_variant_get(value, "$", "array<variant>").alias("items"))
            return [], [_with(opened, lambda x: joined(*judged(x["v"], x["fields"], x["items"], path, node, types, seen)))]
        return judged(value, None, None, path, node, types, seen)

    def judged(value: Column, fields: Column | None, items: Column | None, path: Column, node: dict, types: list[str], seen: tuple[str, ...]) -> tuple[list[Column], list[Column]]:
        text, number = (F.try_variant_get(value, "$", t) for t in ("string", "double"))
        own: list[Column] = []
        deeper: list[Column] = []

        def broken(rule: str, where: Column) -> None:
            own.append(F.when(where, F.struct(path.alias("path"), F.lit(rule).alias("rule"))))

        def named(rule: str, keys: Column) -> Column:
            return F.transform(keys, lambda k: F.struct(path.alias("path"), F.concat(F.lit(f"{rule}:"), k).alias("rule")))

        def is_type(name: str) -> Column:
            if name in ("object", "array"):
                return (fields if name == "object" else items).isNotNull()
            if name == "integer":
                return (F.schema_of_variant(value) == "BIGINT") | ((number == F.floor(number)) & _is_kind(value, "number"))
            return _is_kind(value, name)

        if types:
            other = ~reduce(or_, map(is_type, types))
            broken("type", other if fields is None else other & value.isNotNull())
        if "enum" in node:
            broken("enum", ~_is_value(value, node["enum"]))
        if "const" in node:
            broken("const", ~_is_value(value, [node["const"]]))
        for rule, test in (("minLength", lambda x: F.length(text) < x), ("maxLength", lambda x: F.length(text) > x), ("pattern", lambda x: ~text.rlike(x))):
            if rule in node:
                broken(rule, test(node[rule]) & _is_kind(value, "string"))
        if "format" in node:
            if node["format"] != "date-time":
                raise ValueError(f"unknown format: {node['format']}")
            broken("format", ~text.rlike(DATE_TIME) & _is_kind(value, "string"))
        for rule, test in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x), ("exclusiveMinimum", lambda x: number <= x), ("exclusiveMaximum", lambda x: number >= x)):
            if rule in node:
                broken(rule, test(node[rule]) & _is_kind(value, "number"))
        for rule, test in (("minItems", lambda x: F.size(items) < x), ("maxItems", lambda x: F.size(items) > x)):
            if rule in node:
                broken(rule, items.isNotNull() & test(node[rule]))
        if node.get("uniqueItems"):
            texts = F.transform(items, lambda x: F.to_json(x))
            broken("uniqueItems", items.isNotNull() & (F.size(F.array_distinct(texts)) < F.size(texts)))
        if "items" in node:
            deeper.append(F.flatten(F.transform(items, lambda x, i: joined(*faults(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), node["items"], seen)))))
        properties, needed, extra = node.get("properties", {}), node.get("required", ()), node.get("additionalProperties", True)
        if not isinstance(extra, bool):
            raise ValueError("additionalProperties is true or false")
        texts_of = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
        if needed:
            deeper.append(named("required", F.array_except(texts_of(needed), F.map_keys(fields))))
        if not extra:
            deeper.append(named("additionalProperties", F.array_sort(F.array_except(F.map_keys(fields), texts_of(properties)))))
        for key, child in properties.items():
            there, below = faults(fields[F.lit(key)], F.concat(path, F.lit(f".{key}")), child, seen)
            own += there
            deeper += below
        return own, deeper

    return lambda document: joined(*faults(document, F.lit("$"), root, ()))


def violations(documents: DataFrame, schema: dict, text: str = "model", more: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc, path, rule): every rule of ``schema`` that each document (doc, and its JSON in ``text``) breaks.

    more: from the parsed document to an array of (path, rule) that it breaks besides. A null, blank or broken text, one with a repeated key in an object, or one larger than a VARIANT holds, breaks the rule ``json``.
    """
    checks = compile_schema(schema)
    judged = F.flatten(F.array(checks(F.col("document")), more(F.col("document")))) if more else checks(F.col("document"))
    parsed = documents.select("doc", F.try_parse_json(F.col(text)).alias("document"))
    broken = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule"))).cast(f"array<{FAULT}>")
    found = parsed.select("doc", F.explode(F.when(F.col("document").isNull(), broken).otherwise(judged)).alias("fault"))
    return found.select("doc", "fault.path", "fault.rule")


def valid(documents: DataFrame, schema: dict, text: str = "model") -> DataFrame:
    """The documents that break no rule."""
    document = F.try_parse_json(F.col(text))
    return documents.filter(document.isNotNull() & (F.size(compile_schema(schema)(document)) == 0))
