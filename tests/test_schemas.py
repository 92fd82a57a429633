"""Nested contracts: violations at any depth, and what is wrong with a schema."""

import json

from pyspark.sql import functions as F

from foldlog.operators import schemas as S

GOOD = {
    "title": "t", "description": "d", "type": "object", "required": ["id", "metrics"], "additionalProperties": False,
    "properties": {"id": {"type": "integer"}, "note": {"type": ["string", "null"]}, "any": {"type": "array"}, "metrics": {"type": "object", "required": ["p", "inner"], "additionalProperties": False, "properties": {"p": {"type": "number"}, "inner": {"type": "object", "required": ["x"], "properties": {"x": {"type": "boolean"}}}}}},
}


def found(spark, docs, schemas=None):
    rules = S.compiled(spark.createDataFrame([(n, json.dumps(s) if not isinstance(s, str) else s) for n, s in (schemas or {"a": GOOD}).items()], "name string, body string"), "name", "body")
    df = spark.createDataFrame([(i, n, d if d is None or isinstance(d, str) else json.dumps(d)) for i, (n, d) in enumerate(docs)], "doc long, kind string, body string")
    return sorted((r.doc, r.path, r.problem) for r in S.nested_violations(df, rules, "doc", "kind", "body").collect())


def test_violations_at_any_depth(spark):
    whole = {"id": 1, "note": None, "any": [{"free": 1}], "metrics": {"p": 1, "inner": {"x": True, "more": {"y": 1}}}}
    docs = [whole, {"id": True, "metrics": {"p": "1", "inner": {"x": 1}}}, {"note": 3, "other": 1, "metrics": {"q": 1, "inner": {}}}, {"id": 1.5, "metrics": [1]}, [1], None, "{", {"id": 2, "any": {"a": 1}, "metrics": {"p": 0.5, "inner": "no"}}]
    assert found(spark, [("a", d) for d in docs] + [("none", {"x": 1})]) == sorted([
        (1, "id", "type"), (1, "metrics.p", "type"), (1, "metrics.inner.x", "type"),
        (2, "id", "missing"), (2, "note", "type"), (2, "other", "unknown"), (2, "metrics.q", "unknown"), (2, "metrics.p", "missing"), (2, "metrics.inner.x", "missing"),
        (3, "id", "type"), (3, "metrics", "type"), (4, "", "type"), (5, "", "invalid"), (6, "", "invalid"), (7, "any", "type"), (7, "metrics.inner", "type"),
    ])
    assert found(spark, []) == []


def test_deep_documents(spark):
    schema = json.dumps({"title": "t", "description": "d", "type": "object", "required": [], "properties": {"a": {"type": "object"}}})
    for _ in range(30):
        schema = json.dumps({"title": "t", "description": "d", "type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": json.loads(schema)}})
    deep = '{"a":' * 20_000 + "1" + "}" * 20_000
    assert found(spark, [("s", deep), ("s", '{"a":' * 9 + "{}" + "}" * 9)], {"s": schema}) == [(1, ".".join("a" * 10), "missing")]


def test_bad_schemas(spark):
    of = lambda **x: {**GOOD, **x}
    bad = {
        "type": of(type="text"), "list": of(type="array"), "req": of(required="id"), "undeclared": of(required=["id", "zz"]), "props": of(properties=[1]), "extra": of(additionalProperties="no"),
        "inner": of(required=[], properties={"m": {"type": "object", "required": ["q"], "properties": {"z": 1, "w": {}}}}), "short": {"type": "object", "properties": {}}, "text": "[1]", "broken": "{", "fine": GOOD,
    }
    rows = S.compiled(spark.createDataFrame([(n, s if isinstance(s, str) else json.dumps(s)) for n, s in bad.items()], "name string, body string"), "name", "body")
    got = {(r.schema, r.path, r.problem) for r in S.schema_problems(rows).collect()}
    assert got == {
        ("type", "", "unsupported or missing type"), ("list", "", "root is no object"), ("req", "", "required is no array of strings"), ("undeclared", "zz", "required and not declared"), ("props", "", "properties are no object"),
        ("props", "id", "required and not declared"), ("props", "metrics", "required and not declared"), ("extra", "", "additionalProperties is no boolean"), ("inner", "m.q", "required and not declared"), ("inner", "m.z", "definition is no object"),
        ("inner", "m.w", "unsupported or missing type"), ("short", "", "missing title"), ("short", "", "missing description"), ("short", "", "missing required"), ("text", "", "schema is no object"), ("broken", "", "schema is no object"),
    }


def test_repeated_and_null_ids_are_judged_by_their_own_text(spark):
    rules = S.compiled(spark.createDataFrame([("a", json.dumps(GOOD))], "name string, body string"), "name", "body")
    whole = json.dumps({"id": 1, "metrics": {"p": 1, "inner": {"x": True}}})
    df = spark.createDataFrame([(None, "a", whole), (1, "a", whole), (1, "a", whole.replace("id", "note").replace("1,", "null,", 1)), (2, None, "{}"), (3, None, "{")], "doc long, kind string, body string")
    assert sorted((r.doc, r.path, r.problem) for r in S.nested_violations(df, rules, "doc", "kind", "body").collect()) == [(1, "id", "missing"), (3, "", "invalid")]


def test_documents_are_not_shuffled(spark):
    rules = S.compiled(spark.createDataFrame([("a", json.dumps(GOOD))], "name string, body string"), "name", "body")
    df = spark.range(3).select("id", F.when(F.col("id") > 0, "a").otherwise("b").alias("kind"), F.lit("{}").alias("body"))
    plan = S.nested_violations(df, rules, "id", "kind", "body")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
