"""References as JSON pointers: chains, circles, escapes, odd documents; their queries against SQL."""

import json
import re
from urllib.parse import unquote

import duckdb
import pytest

from loomspark.operators import openapi, pointers
from loomspark.plans import references

SF = "/root/testdata/sf0.001"


def specs(spark, *docs):
    rows = [(f"s{i}", d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "spec_id string, json string")


def by_hand(doc, ref):
    """(state, value) of a reference, followed through the parsed document."""
    seen = set()
    while True:
        at = unquote(ref[1:])
        if at in seen:
            return "cycle", None
        seen.add(at)
        value = doc
        for part in at.split("/")[1:]:
            part = part.replace("~1", "/").replace("~0", "~")
            try:
                value = value[int(part)] if isinstance(value, list) else value[part] if isinstance(value, dict) else {}[part]
            except (KeyError, IndexError, ValueError):
                return "missing", None
        onward = value.get("$ref") if isinstance(value, dict) else None
        if not isinstance(onward, str) or not (onward == "#" or onward.startswith("#/")):
            return "found", value
        ref = onward


def test_chains_circles_and_escapes(spark):
    r = lambda ref: {"$ref": ref}
    odd = {
        "paths": {"/a": {"get": {"parameters": [{"name": "x"}, r("#/paths/~1a/get/parameters/0")]}}, "/b/{id}": {"parameters": [r("#/paths/~1a/get/parameters/1"), r("#/paths/~1b~1%7Bid%7D/parameters/0")]}},
        "d": {"a": r("#/d/b"), "b": r("#/d/c"), "c": r("#/d/a"), "in": r("#/d/a"), "self": r("#/d/self"), "far": r("other.json#/x"), "toFar": r("#/d/far"), "0": {"1": 5}, "né\"e": {"t~/": [[7]]}, "prop": {"$ref": {"type": "string"}}, "none": None},
        "use": [r("#/d/0/1"), r("#/d/n%C3%A9%22e/t~0~1/0/0"), r('#/d/né"e/t~0~1/0'), r("#/d/prop"), r("#/d/none"), r("#/nowhere/at/all"), r("#/d/0/1/2"), r("#"), r("#/d/toFar"), r("#anchor"), r("#/paths/~1a/get/parameters/9"), r("#/d/in"), r("#/d/self")],
    }
    long = {"d": {str(i): r(f"#/d/{i + 1}") for i in range(37)} | {"37": {"name": "end"}}, "c": {str(i): r(f"#/c/{(i + 1) % 5}") for i in range(5)}, "use": r("#/d/0")}
    given = specs(spark, odd, long, "no json $ref", None, [r("#/0"), r("#/0")], {"a": 1})
    got = {(x.spec_id, x.ref): x for x in pointers.targets(given).collect()}
    for name, doc in (("s0", odd), ("s1", long), ("s4", [r("#/0"), r("#/0")])):
        refs = {x for x in re.findall(r'"\$ref": "((?:[^"\\]|\\.)*)"', json.dumps(doc, ensure_ascii=False))}
        refs = {x.replace('\\"', '"') for x in refs if x == "#" or x.startswith("#/")}
        assert {k[1] for k in got if k[0] == name} == refs
        for ref in refs:
            state, value = by_hand(doc, ref)
            assert got[name, ref].state == state, ref
            assert state != "found" or json.loads(got[name, ref].json) == value, ref
    assert got["s1", "#/d/1"].hops == 36 and got["s1", "#/d/1"].pointer == "/d/37"
    assert {k[0] for k in got} == {"s0", "s1", "s4"}
    assert pointers.targets(specs(spark, {"a": 1}, None)).count() == 0 == pointers.targets(given.where("false")).count()


def test_all_nodes(spark):
    doc = {"a": [1, {"b/~": "x"}, []], "e": {}, "n": None, "s": "123", "t": True, "f": 1.5}
    got = {(x.spec_id, x.pointer): (x.depth, json.loads(x.j)) for x in pointers.nodes(specs(spark, doc, "[", None, "7")).selectExpr("spec_id", "pointer", "depth", "to_json(value) as j").collect()}
    want = {"": doc, "/a": doc["a"], "/a/0": 1, "/a/1": doc["a"][1], "/a/1/b~1~0": "x", "/a/2": [], "/e": {}, "/n": None, "/s": "123", "/t": True, "/f": 1.5}
    assert got == {("s0", p): (p.count("/"), v) for p, v in want.items()} | {("s3", ""): (0, 7)}


def test_specifications_follow_any_pointer(spark):
    """A parameter of another path, a response over two components, a model's part inside another model."""
    doc = {
        "swagger": "2.0",
        "paths": {
            "/a": {"get": {"parameters": [{"name": "x", "in": "query", "type": "integer"}], "responses": {"200": {"$ref": "#/responses/one"}}}},
            "/b": {"get": {"parameters": [{"$ref": "#/paths/~1a/get/parameters/0"}, {"$ref": "#/parameters/round"}, {"$ref": "#/parameters/gone"}], "responses": {"404": {"$ref": "#/paths/~1a/get/responses/200"}}}},
        },
        "parameters": {"round": {"$ref": "#/parameters/round"}},
        "responses": {"one": {"$ref": "#/responses/two"}, "two": {"description": "Second", "schema": {"type": "string"}}},
        "definitions": {"M": {"allOf": [{"$ref": "#/definitions/N/properties/inner"}]}, "N": {"properties": {"inner": {"properties": {"deep": {"type": "boolean"}}, "required": ["deep"]}}}},
    }
    given = specs(spark, doc)
    assert {(x.path, x.name, x.type) for x in openapi.parameters(given).collect()} == {("/a", "x", "`integer`"), ("/b", "x", "`integer`")}
    assert {(x.path, x.status, x.description, x.type) for x in openapi.responses(given).collect()} == {("/a", "200", "Second", "`string`"), ("/b", "404", "Second", "`string`")}
    assert ("M", "deep", True) in {(x.model, x.property, x.required) for x in openapi.schema_properties(given).collect()}


def test_models_that_nest_without_end(spark):
    plain = {"swagger": "2.0", "paths": {}, "definitions": {"Text": "a bare string", "Fine": {"properties": {"x": {"type": "string"}}}}}
    given = specs(spark, '{"swagger":"2.0","paths":{},"definitions":{"Cut":{"properties":{"d":' + '{"type":"array","items":' * 900, plain)
    docs = {(x.spec_id, x.slug) for x in openapi.documents(given).collect()}
    assert {("s1", "text"), ("s1", "fine")} <= docs
    nested = '{"type":"array","items":' * 700 + '{"type":"string"}' + "}" * 700
    only = specs(spark, '{"swagger":"2.0","paths":{},"definitions":{"Deep":{"properties":{"d":%s}}}}' % nested)
    assert openapi.documents(only).count() == 1


@pytest.mark.parametrize("name", sorted(references.QUERIES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    made, want = references.QUERIES[name](spark, SF), con.sql(references.ORACLE_SQL[name])
    assert made.columns == want.columns
    assert sorted((tuple(r) for r in made.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_endpoints_are_described_in_one_pass(spark):
    """Types of parameters and of answers are made once each, for all tables of an endpoint."""
    from loomspark.operators import openapi

    specs = openapi.specs_of_parts(spark.read.parquet("/root/testdata/sf0.001/part.parquet"))
    head, ops, known = openapi.heads(specs), openapi.operations(specs), spark.createDataFrame([], "spec_id string, ref string, found string")
    plan = openapi._endpoint_documents(head, ops, known)._jdf.queryExecution().analyzed().toString()
    assert plan.count("type_text(") == 2
