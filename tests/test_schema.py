import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import schema
from weftline.sources import model as models

DOC = "doc string, model string"


def found(spark, node, *values):
    """The rules that each value breaks."""
    df = spark.createDataFrame([(str(i), json.dumps(v)) for i, v in enumerate(values)], DOC)
    out = [[] for _ in values]
    for r in schema.violations(df, node).collect():
        out[int(r.doc)].append((r.path, r.rule))
    return [sorted(o) for o in out]


@pytest.mark.parametrize(
    ("node", "good", "bad", "rule"),
    [
        ({"type": "string"}, ["", "7"], [7, None, True, [], {}], "type"),
        ({"type": "integer"}, [3, 3.0, -1], [3.5, "3", True, None], "type"),
        ({"type": "number"}, [3, 0.5, 1e300], ["3", False], "type"),
        ({"type": ["string", "null"]}, ["a", None], [1, {}], "type"),
        ({"type": "boolean"}, [True, False], ["true", 0], "type"),
        ({"type": "object"}, [{}, {"a": 1}], [[], "x"], "type"),
        ({"type": "array"}, [[], [1]], [{}, "x"], "type"),
        ({"enum": ["a", 1, True, None]}, ["a", 1, 1.0, True, None], ["b", 2, False, "1", [], {}], "enum"),
        ({"const": "x"}, ["x"], ["y", 1], "const"),
        ({"minLength": 2}, ["ab", "日本", 1, None], ["", "a", "日"], "minLength"),
        ({"maxLength": 2}, ["ab", "", 100], ["abc"], "maxLength"),
        ({"pattern": "^v[0-9]+$"}, ["v1", 5], ["v", "xv1"], "pattern"),
        ({"format": "date-time"}, ["2024-02-29T10:00:00Z", "2024-01-01t00:00:00.5+01:30", 1], ["2024-01-01", "2024-13-01T00:00:00Z", ""], "format"),
        ({"minimum": 1}, [1, 2.5, "0"], [0, 0.99], "minimum"),
        ({"maximum": 1}, [1, -5, "9"], [1.01, 2], "maximum"),
        ({"exclusiveMinimum": 1}, [1.5], [1], "exclusiveMinimum"),
        ({"exclusiveMaximum": 1}, [0.5], [1], "exclusiveMaximum"),
        ({"minItems": 1}, [[1], {}, "x"], [[]], "minItems"),
        ({"maxItems": 1}, [[], [1]], [[1, 2]], "maxItems"),
        ({"uniqueItems": True}, [[], [1, 2], ["a", ["a"]]], [[1, 1], [{"a": 1, "b": 2}, {"b": 2, "a": 1}]], "uniqueItems"),
        ({"required": ["a"]}, [{"a": None}, [], "x"], [{}, {"b": 1}], "required:a"),
        ({"properties": {"a": {}}, "additionalProperties": False}, [{}, {"a": 1}, [1]], [{"b": 1}, {"a": 1, "b": None}], "additionalProperties:b"),
    ],
)
def test_each_keyword_has_its_rows(spark, node, good, bad, rule):
    assert found(spark, node, *good, *bad) == [[]] * len(good) + [[("$", rule)]] * len(bad)


def test_paths_lead_through_arrays_objects_and_references(spark):
    node = {"properties": {"rows": {"items": {"$ref": "#/$defs/row"}}}, "$defs": {"row": {"type": "object", "properties": {"n": {"items": {"maximum": 3}}}}}}
    value = {"rows": [{"n": [1, 9]}, 5, {"n": [4, 4]}, {}]}
    assert found(spark, node, value, {"rows": "none"}, {}) == [[("$.rows[0].n[1]", "maximum"), ("$.rows[1]", "type"), ("$.rows[2].n[0]", "maximum"), ("$.rows[2].n[1]", "maximum")], [], []]


def test_texts_that_are_no_json_break_one_rule(spark):
    texts = [None, "", "  ", "{", '{"a": 1, "a": 2}', "{}"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], DOC)
    assert sorted((r.doc, r.path, r.rule) for r in schema.violations(df, {"type": "object"}).collect()) == [(str(i), "$", "json") for i in range(5)]
    assert [r.doc for r in schema.valid(df, {"type": "object"}).collect()] == ["5"]
    assert schema.violations(df.limit(0), {"type": "object"}).count() == 0


@pytest.mark.parametrize("node", [{"oneOf": []}, {"format": "email"}, {"additionalProperties": {}}, {"enum": [[1]]}, {"$ref": "other.json"}, {"properties": {"a": {"$ref": "#/properties/a"}}}])
def test_what_a_schema_may_not_hold_is_an_error(node):
    with pytest.raises(ValueError):
        schema.compile_schema(node)(F.lit(None).cast("variant"))


def test_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([("m", "{}")], DOC).repartition(2)
    plan = schema.violations(df, models.MODEL_SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_models_are_made_and_checked_by_the_table(spark):
    section = {"id": "overview", "title": "T", "level": 1, "order": 0, "parent_id": None, "content_md": "", "status": "active", "sources": [], "hash": "h"}
    good = models.new_model([section | {"id": i, "order": n} for n, i in enumerate(("overview", "key-features", "development"))])
    cases = {"good": good, "bad version": good | {"schema_version": "1"}, "empty": good | {"sections": []}, "twice": good | {"sections": [*good["sections"], section]}, "more": good | {"more": 1}}
    df = spark.createDataFrame([(k, json.dumps(m)) for k, m in cases.items()], DOC)
    got = {(r.doc, r.path, r.rule) for r in models.problems(df).collect()}
    gone = {("empty", "$.sections", f"missing:{i}") for i in ("overview", "key-features", "development")}
    assert got == {("bad version", "$.schema_version", "pattern"), ("empty", "$.sections", "sections"), ("twice", "$.sections", "repeated:overview"), ("more", "$", "additionalProperties:more"), *gone}
    rows = spark.createDataFrame([(d, s["order"], s["id"], 'say "é"') for d in "ab" for s in good["sections"]], "doc string, ord int, id string, title string")
    names = ("id", "title", F.lit(1).alias("level"), F.col("ord").alias("order"), F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("content_md"), F.lit("active").alias("status"), F.array().cast("array<string>").alias("sources"), F.lit("h").alias("hash"))
    made = models.models_of(rows.select("doc", "ord", F.struct(*names).alias("section")))
    assert models.problems(made).count() == 0 and [s["id"] for s in json.loads(made.first().model)["sections"]] == ["overview", "key-features", "development"]


def test_a_model_is_read_once_and_fields_are_taken_from_its_opened_objects(spark):
    df = spark.createDataFrame([("m", "{}")], DOC)
    plan = models.problems(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("parseJson") <= 1 and not any(f'["{k}"]' in plan for k in ("sections", "start_line", "meta"))
