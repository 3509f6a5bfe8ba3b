"""API specifications (versions 2 and 3, JSON or YAML) as rows: endpoints, parameters, responses, models; their documents and bundles.

A specification is taken apart by Spark: paths, operations and components become rows that hold JSON text, references
are joined with the components by (spec_id, pointer), and what belongs to an endpoint is gathered again by its key. Only
the text of one schema, which nests as deep as it likes, is read by Python, in Arrow batches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions import text
from loomspark.operators import graph, pointers

METHODS = ("get", "post", "put", "delete", "patch", "options", "head")
#: How deep compositions are written out, and how many values of an enumeration.
NESTED, VALUES = 3, 6
_MAP = "map<string,string>"
SPEC = (
    "swagger string, openapi string, host string, basePath string, info struct<title:string, version:string, description:string, contact:map<string,string>, license:map<string,string>>, "
    "schemes array<string>, servers array<struct<url:string>>, consumes array<string>, produces array<string>, paths map<string,map<string,string>>, "
    "definitions map<string,string>, parameters map<string,string>, responses map<string,string>, components map<string,map<string,string>>"
)
_PARAM = "name string, `in` string, required boolean, type string, description string, schema string, content map<string,string>, `$ref` string"
_OPERATION = "tags array<string>, operationId string, summary string, description string, parameters array<string>, responses map<string,string>, consumes array<string>, produces array<string>, requestBody string"
_MODEL = "description string, required array<string>, properties map<string,string>, allOf array<string>, oneOf array<string>, anyOf array<string>"


@F.pandas_udf(T.StringType())
def json_of(texts: pd.Series) -> pd.Series:
    """YAML specifications as JSON; null for what is none, as for JSON text that is no object."""
    try:
        import yaml
    except ImportError:  # without a YAML reader only JSON specifications are read
        yaml = None

    def one(value: str | None) -> str | None:
        try:
            found = json.loads(value) if value.lstrip("﻿ \t\r\n").startswith("{") else yaml.load(value, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if yaml else None
            return json.dumps(found, ensure_ascii=False, default=str) if isinstance(found, dict) else None
        except Exception:  # what cannot be read is no specification
            return None

    return texts.map(one, na_action="ignore").astype(object).where(lambda s: s.notna(), None)


def of_text(files: DataFrame) -> DataFrame:
    """(spec_id, json) of (spec_id, text): JSON as it is, YAML that names a version of the format converted; others are dropped."""
    t = F.coalesce("text", F.lit(""))
    plain = t.rlike(r"^\x{FEFF}?\s*\{")
    named = t.rlike(r"(?m)^\s*(openapi|swagger)\s*:")
    df = files.where(plain | named).select("spec_id", F.when(plain, F.regexp_replace("text", r"^\x{FEFF}", "")).otherwise(json_of(F.when(~plain, F.col("text")))).alias("json"))
    return parse(df).select("spec_id", "json")


def parse(specs: DataFrame) -> DataFrame:
    """Adds `spec` to (spec_id, json); what is no specification of version 2 or 3 is dropped."""
    df = specs.withColumn("spec", F.from_json("json", SPEC))
    return df.where("spec.swagger is not null or spec.openapi is not null")


def base_url(spec: Column) -> Column:
    """The address that paths hang on."""
    two = F.when(F.coalesce(spec["host"], F.lit("")) != "", F.concat(F.coalesce(F.get(spec["schemes"], F.lit(0)), F.lit("https")), F.lit("://"), spec["host"], F.coalesce(spec["basePath"], F.lit(""))))
    return F.when(spec["openapi"].isNotNull(), F.coalesce(F.get(spec["servers"], F.lit(0))["url"], F.lit(""))).otherwise(F.coalesce(two, spec["basePath"], F.lit("")))


def heads(specs: DataFrame) -> DataFrame:
    """(spec_id, api, version, about, base, contact, license): a row per specification."""
    s = F.col("spec")
    said = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    return parse(specs).select("spec_id", said(s["info"]["title"], "API Reference").alias("api"), said(s["info"]["version"], "1.0.0").alias("version"), said(s["info"]["description"], "API Documentation").alias("about"), base_url(s).alias("base"), s["info"]["contact"].alias("contact"), s["info"]["license"].alias("license"))


def components(specs: DataFrame) -> DataFrame:
    """(spec_id, pointer, kind, no, name, json): what references point to, with its place."""
    s = F.col("spec")
    none = F.create_map().cast(_MAP)
    flat = lambda m, kind, at: F.transform(F.map_entries(F.coalesce(m, none)), lambda e, i: F.struct(F.concat(F.lit(at), e["key"]).alias("pointer"), F.lit(kind).alias("kind"), i.alias("no"), e["key"].alias("name"), e["value"].alias("json")))
    two = [flat(s["definitions"], "schemas", "#/definitions/"), flat(s["parameters"], "parameters", "#/parameters/"), flat(s["responses"], "responses", "#/responses/")]
    three = [flat(s["components"][k], k, f"#/components/{k}/") for k in ("schemas", "parameters", "responses", "requestBodies")]
    return parse(specs).select("spec_id", F.explode(F.concat(*two, *three)).alias("c")).select("spec_id", "c.*")


def targets(specs: DataFrame) -> DataFrame:
    """(spec_id, ref, found): the JSON that each reference of a specification leads to in the end; those that lead nowhere have no row."""
    return pointers.targets(specs.select("spec_id", "json")).where("state = 'found'").select("spec_id", "ref", F.col("json").alias("found"))


def resolved(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`json` of rows (spec_id, json, ...), replaced where it is a reference with a target; other references stay as they are."""
    ref = F.get_json_object("json", "$['$ref']")
    return rows.withColumn("ref", ref).join(known, ["spec_id", "ref"], "left").withColumn("json", F.coalesce("found", "json")).drop("ref", "found")


def operations(specs: DataFrame) -> DataFrame:
    """(spec_id, path_no, path, method_no, method, op, shared): each operation, in the order of paths and methods."""
    df = parse(specs).select("spec_id", F.col("spec.consumes").alias("consumes"), F.col("spec.produces").alias("produces"), F.posexplode("spec.paths").alias("path_no", "path", "item"))
    listed = F.filter(F.array(*(F.struct(F.lit(i).alias("method_no"), F.lit(m).alias("method"), F.col("item")[m].alias("json")) for i, m in enumerate(METHODS))), lambda s: s["json"].isNotNull())
    df = df.select("spec_id", "consumes", "produces", "path_no", "path", F.from_json(F.col("item")["parameters"], "array<string>").alias("shared"), F.explode(listed).alias("o"))
    return df.select("spec_id", "consumes", "produces", "path_no", "path", "shared", "o.method_no", "o.method", F.from_json("o.json", _OPERATION).alias("op"))


def endpoints(specs: DataFrame) -> DataFrame:
    """(spec_id, tag, path, method, path_no, method_no, slug, summary, description, tags, takes, gives): an endpoint per tag (General if none)."""
    return _endpoints(operations(specs))


def _endpoints(ops: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    tags = F.when(F.size(F.coalesce("op.tags", empty)) > 0, F.col("op.tags")).otherwise(F.array(F.lit("General")))
    slug = F.when(F.coalesce("op.operationId", F.lit("")) != "", text.slug("op.operationId")).otherwise(text.slug(F.concat("method", F.lit("-"), text.path_slug("path"))))
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    summary = F.coalesce(some(F.col("op.summary")), some(F.substring_index("op.description", "\n", 1)), F.concat(F.upper("method"), F.lit(" "), "path"))
    description = F.coalesce(some(F.col("op.description")), some(F.col("op.summary")), F.lit(""))
    media = lambda own, whole: F.array_join(F.coalesce(own, whole, F.array(F.lit("application/json"))), ", ")
    df = ops.select("spec_id", "path", "method", "path_no", "method_no", slug.alias("slug"), summary.alias("summary"), description.alias("description"), tags.alias("tags"), media(F.col("op.consumes"), F.col("consumes")).alias("takes"), media(F.col("op.produces"), F.col("produces")).alias("gives"))
    return df.withColumn("tag", F.explode(F.transform("tags", lambda t: F.trim(t))))


def describe(schema, depth: int = 0) -> str:
    """A schema's type as text: a link to a model, its parts, array of something, type (format), or an enumeration's first values."""
    if not isinstance(schema, dict):
        return "`object`"
    if isinstance(schema.get("$ref"), str) and schema["$ref"]:
        name = schema["$ref"].rsplit("/", 1)[-1]
        return f"[{name}](/schemas/{_slug(name)}.md)"
    for key, sign in (("allOf", " & "), ("oneOf", " \\| "), ("anyOf", " \\| ")):
        if isinstance(schema.get(key), list) and schema[key] and depth < NESTED:
            return sign.join(describe(part, depth + 1) for part in schema[key])
    kind = schema.get("type")
    if kind == "array":
        return "array of " + (describe(schema["items"], depth + 1) if schema.get("items") else "`any`")
    if not kind:
        return "`object`"
    name = f"{kind} ({schema['format']})" if schema.get("format") else f"{kind}"
    values = schema.get("enum")
    if isinstance(values, list) and values:
        return f"`{name}` - one of " + ", ".join(f"`{v}`" for v in values[:VALUES]) + (", …" if len(values) > VALUES else "")
    return f"`{name}`"


def _slug(name: str) -> str:
    """`text.slug` of one value."""
    import re

    kept = re.sub(r"[^A-Za-z0-9_ \t\n\r\f\v-]", "", name.lower().strip(" "))
    return re.sub(r"[ \t\n\r\f\v_-]+", "-", kept).strip("-") or "item"


@F.pandas_udf(T.StringType())
def type_text(schemas: pd.Series) -> pd.Series:
    """`describe` of schemas given as JSON; null stays null."""

    def one(value: str) -> str:
        try:
            return describe(json.loads(value))
        except (ValueError, RecursionError, TypeError):  # no schema, or one that nests without end
            return "`object`"

    return schemas.map(one, na_action="ignore").astype(object).where(lambda s: s.notna(), None)


@F.pandas_udf(T.StringType())
def pretty(schemas: pd.Series) -> pd.Series:
    """JSON with an indent of two; what is no JSON (a bare string, or one that nests without end) as it is."""

    def one(value: str) -> str:
        try:
            return json.dumps(json.loads(value), indent=2, ensure_ascii=False)
        except (ValueError, RecursionError):
            return value

    return schemas.map(one, na_action="ignore").astype(object).where(lambda s: s.notna(), None)


def _in_line(c: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " "))


def parameters(specs: DataFrame) -> DataFrame:
    """(spec_id, path, method, param_no, name, place, required, type, description): the path's parameters, then the operation's, then
    a version 3 request body as one of the place `body`; references are resolved, those that lead nowhere left out."""
    return _parameters(operations(specs), targets(specs))


def _parameters(ops: DataFrame, known: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    own = F.concat(F.coalesce("shared", empty), F.coalesce("op.parameters", empty))
    df = ops.select("spec_id", "path", "method", F.posexplode(own).alias("param_no", "json")).withColumn("place", F.lit(None).cast("string"))
    asked = ops.where("op.requestBody is not null").select("spec_id", "path", "method", F.size(own).alias("param_no"), F.col("op.requestBody").alias("json"), F.lit("body").alias("place"))
    df = resolved(df.unionByName(asked), known).withColumn("p", F.from_json("json", _PARAM))
    first = F.get(F.map_values("p.content"), F.lit(0))
    schema = F.coalesce("p.schema", F.get_json_object(first, "$.schema"))
    place = F.coalesce("place", F.col("p")["in"])
    body = place.isin("body", "formData")
    bare = F.when(body, F.to_json(F.struct(F.coalesce("p.type", F.lit("object")).alias("type")))).otherwise(F.when(F.col("p.type").isNull(), '{"type":"string"}').otherwise(F.col("json")))
    df = df.withColumn("name", F.coalesce("p.name", "place")).where("name is not null")
    return df.select("spec_id", "path", "method", "param_no", "name", place.alias("place"), F.coalesce("p.required", F.lit(False)).alias("required"), type_text(F.coalesce(schema, bare)).alias("type"), _in_line("p.description").alias("description"))


def responses(specs: DataFrame) -> DataFrame:
    """(spec_id, path, method, no, status, description, type): type is '' without a schema; of media types, JSON counts."""
    return _responses(operations(specs), targets(specs))


def _responses(ops: DataFrame, known: DataFrame) -> DataFrame:
    df = ops.select("spec_id", "path", "method", F.posexplode("op.responses").alias("no", "status", "json"))
    df = resolved(df, known).withColumn("r", F.from_json("json", "description string, schema string, content map<string,string>"))
    schema = F.coalesce("r.schema", F.get_json_object(F.col("r.content")["application/json"], "$.schema"))
    return df.select("spec_id", "path", "method", "no", "status", F.coalesce(F.nullif(_in_line("r.description"), F.lit("")), F.lit("Response")).alias("description"), F.coalesce(type_text(schema), F.lit("")).alias("type"))


def models(specs: DataFrame) -> DataFrame:
    """(spec_id, no, model, json, about, parts, joiner): the models and, for compositions, their parts as JSON."""
    return _models(components(specs))


def _models(parts: DataFrame) -> DataFrame:
    m = F.from_json("json", _MODEL)
    some = lambda c: F.when(F.size(c) > 0, c)
    df = parts.where("kind = 'schemas'").select("spec_id", "no", F.col("name").alias("model"), "json", m.alias("m"))
    return df.select("spec_id", "no", "model", "json", "m", F.coalesce("m.description", F.lit("")).alias("about"), F.coalesce(some(F.col("m.allOf")), some(F.col("m.oneOf")), some(F.col("m.anyOf"))).alias("parts"), F.when(F.size("m.allOf") > 0, "allOf").when((F.size("m.oneOf") > 0) | (F.size("m.anyOf") > 0), "oneOf").alias("joiner"))


def schema_properties(specs: DataFrame) -> DataFrame:
    """(spec_id, model, property, prop_no, type, required, read_only, description): a model's own properties and, one level deep, those
    of the parts that it is composed of; of one name the later counts, in the place of the first."""
    return _properties(components(specs), targets(specs))


def _properties(parts: DataFrame, known: DataFrame) -> DataFrame:
    each = _models(parts)
    own = each.select("spec_id", "model", F.size(F.coalesce("parts", F.array().cast("array<string>"))).alias("branch"), "json")
    branches = resolved(each.select("spec_id", "model", F.posexplode("parts").alias("branch", "json")), known)
    both = own.unionByName(branches).withColumn("m", F.from_json("json", _MODEL))
    listed = both.select("spec_id", "model", "branch", F.posexplode("m.properties").alias("no", "property", "json")).withColumn("at", F.struct("branch", "no"))
    merged = listed.groupBy("spec_id", "model", "property").agg(F.min("at").alias("at"), F.max_by("json", "at").alias("json"))
    needed = both.select("spec_id", "model", F.explode("m.required").alias("property")).distinct().withColumn("needed", F.lit(True))
    df = merged.join(needed, ["spec_id", "model", "property"], "left").withColumn("p", F.from_json("json", "readOnly boolean, description string"))
    return df.select("spec_id", "model", "property", (F.col("at.branch") * 1_000_000 + F.col("at.no")).alias("prop_no"), type_text("json").alias("type"), F.coalesce("needed", F.lit(False)).alias("required"), F.coalesce("p.readOnly", F.lit(False)).alias("read_only"), _in_line("p.description").alias("description"))


def documents(specs: DataFrame) -> DataFrame:
    """(spec_id, ord, url, section, slug, title, description, type, tags, markdown): a document per (tag, endpoint), then one per model; none is split further.

    specs: spec_id and json. ord is the place in the specification: of endpoints before models. A specification without a
    base address gives its documents no url.
    """
    specs = graph.cut_lineage(specs.select("spec_id", "json"))
    head = graph.cut_lineage(heads(specs))
    ops, parts, known = graph.cut_lineage(operations(specs)), graph.cut_lineage(components(specs)), graph.cut_lineage(targets(specs))
    return _endpoint_documents(head, ops, known).unionByName(_model_documents(parts, known))


def _rows(df: DataFrame, keys: list[str], row: Column, order: str, name: str) -> DataFrame:
    return df.withColumn("row", row).groupBy(*keys).agg(text.string_agg("row", "", order).alias(name))


def _endpoint_documents(head: DataFrame, ops: DataFrame, known: DataFrame) -> DataFrame:
    keys = ["spec_id", "path", "method"]
    params = _parameters(ops, known)
    body = F.coalesce(F.col("place").isin("body", "formData"), F.lit(False))
    needed = F.when(F.col("required"), "**Yes**").otherwise("No")
    dash = F.coalesce(F.nullif("description", F.lit("")), F.lit("-"))
    in_body = F.concat(F.lit("* **"), "name", F.when(F.col("required"), "** (required): ").otherwise("**: "), "type", F.when(F.col("description") != "", F.concat(F.lit(" - "), "description")).otherwise(""), F.lit("\n"))
    other = F.concat(F.lit("| `"), "name", F.lit("` | "), F.coalesce("place", F.lit("")), F.lit(" | "), "type", F.lit(" | "), needed, F.lit(" | "), dash, F.lit(" |\n"))
    # Both kinds of parameters, and both forms of the answers, are gathered in one pass over their rows.
    params = params.select(*keys, "param_no", F.when(body, in_body).alias("b"), F.when(~body, other).alias("o"))
    params = params.groupBy(*keys).agg(text.string_agg("b", "", "param_no").alias("bodies"), text.string_agg("o", "", "param_no").alias("others"))
    told = lambda *kind: F.concat(F.lit("| `"), "status", F.lit("` | "), *kind, dash, F.lit(" |\n"))
    answers = _responses(ops, known).withColumn("t", told(F.coalesce(F.nullif("type", F.lit("")), F.lit("-")), F.lit(" | "))).withColumn("u", told())
    answers = answers.groupBy(*keys).agg(F.max(F.col("type") != "").alias("typed"), text.string_agg("t", "", "no").alias("t"), text.string_agg("u", "", "no").alias("u"))
    answers = answers.select(*keys, "typed", F.when(F.col("typed"), F.col("t")).otherwise(F.col("u")).alias("answers"))
    df = _endpoints(ops).join(head, "spec_id").join(params, keys, "left").join(answers, keys, "left")
    method = F.upper("method")
    where = F.concat(F.when(F.col("base") == "", "https://api.example.com").otherwise(F.col("base")), "path")
    part = lambda column, *before: F.when(F.col(column).isNotNull(), F.concat(*(F.lit(b) if isinstance(b, str) else b for b in before), column, F.lit("\n"))).otherwise("")
    markdown = F.concat(
        F.lit("**"), "summary", F.lit("**\n\n"), F.when((F.col("description") != "") & (F.col("description") != F.col("summary")), F.concat("description", F.lit("\n\n"))).otherwise(""),
        F.lit("## Request Details\n\n* **HTTP Method**: `"), method, F.lit("`\n* **Endpoint Path**: `"), "path", F.lit("`\n"), F.when(F.col("base") != "", F.concat(F.lit("* **Full URL**: `"), "base", "path", F.lit("`\n"))).otherwise(""),
        F.lit("* **Consumes**: `"), "takes", F.lit("`\n* **Produces**: `"), "gives", F.lit("`\n\n"),
        part("bodies", "## Request Body\n\n"), part("others", "## Parameters\n\n| Parameter | In | Type | Required | Description |\n| --- | --- | --- | --- | --- |\n"),
        part("answers", "## Responses\n\n", F.when(F.col("typed"), "| HTTP Status | Returns | Description |\n| --- | --- | --- |\n").otherwise("| HTTP Status | Description |\n| --- | --- |\n")),
        F.lit("## Code Examples\n\n### cURL\n\n```bash\ncurl -X "), method, F.lit(' "'), where, F.lit('" \\\n  -H "Accept: application/json"\n```\n\n### Python (requests)\n\n```python\nimport requests\n\nurl = "'), where,
        F.lit('"\nheaders = {"Accept": "application/json"}\n\nresponse = requests.'), "method", F.lit("(url, headers=headers)\nprint(response.status_code)\nprint(response.json())\n```"),
    )
    tags = F.concat(F.array(F.lit("api"), F.lit("endpoint")), F.transform("tags", lambda t: text.slug(t)))
    title = F.concat(method, F.lit(" "), "path", F.lit(" - "), "summary")
    place = F.struct(F.lit(0).alias("kind"), F.col("path_no"), F.col("method_no"), F.col("tag").alias("name"))
    return df.select("spec_id", F.to_json(place).alias("ord"), F.when(F.col("base") != "", F.concat("base", "path")).alias("url"), F.col("tag").alias("section"), "slug", title.alias("title"), F.col("summary").alias("description"), F.lit("API Endpoint").alias("type"), tags.alias("tags"), markdown.alias("markdown"))


def _model_documents(parts: DataFrame, known: DataFrame) -> DataFrame:
    keys = ["spec_id", "model"]
    needed = F.when(F.col("required"), "**Yes**").when(F.col("read_only"), "read-only").otherwise("No")
    dash = F.coalesce(F.nullif("description", F.lit("")), F.lit("-"))
    table = _rows(_properties(parts, known), keys, F.concat(F.lit("| `"), "property", F.lit("` | "), "type", F.lit(" | "), needed, F.lit(" | "), dash, F.lit(" |\n")), "prop_no", "props")
    each = _models(parts)
    made = each.select(*keys, F.posexplode("parts").alias("k", "part")).withColumn("part", type_text("part")).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "\u0001").alias("of"))  # a model's own parts
    df = each.join(table, keys, "left").join(made, keys, "left")
    of = F.when(F.col("joiner") == "allOf", F.concat(F.lit("**Composed of**: "), F.replace("of", F.lit("\u0001"), F.lit(", ")))).otherwise(F.concat(F.lit("**One of**: "), F.replace("of", F.lit("\u0001"), F.lit(" or "))))
    kind, ref = F.get_json_object("json", "$.type"), F.get_json_object("json", "$['$ref']")
    rest = F.when((kind == "array") | ref.isNotNull(), F.concat(F.lit("This model is "), type_text("json"), F.lit("."))).otherwise(F.concat(F.lit("```json\n"), pretty("json"), F.lit("\n```")))
    shown = F.when(F.col("props").isNotNull(), F.concat(F.lit("| Property | Type | Required | Description |\n| --- | --- | --- | --- |\n"), F.rtrim("props", F.lit("\n")))).otherwise(rest)
    markdown = F.concat_ws("\n\n", F.nullif("about", F.lit("")), F.when(F.col("of").isNotNull(), of), F.lit("## Schema Properties"), shown)
    place = F.struct(F.lit(1).alias("kind"), F.col("no").alias("path_no"), F.lit(0).alias("method_no"), F.col("model").alias("name"))
    said = F.coalesce(F.nullif("about", F.lit("")), F.concat("model", F.lit(" data model reference.")))
    return df.select("spec_id", F.to_json(place).alias("ord"), F.lit(None).cast("string").alias("url"), F.lit("Schemas").alias("section"), text.slug("model").alias("slug"), F.concat("model", F.lit(" Schema Model")).alias("title"), said.alias("description"), F.lit("Reference").alias("type"), F.array(F.lit("api"), F.lit("schema"), F.lit("model"), text.slug("model")).alias("tags"), markdown.alias("markdown"))


def bundle(specs: DataFrame, as_of: str, actor: str = "process:api-spec-parser") -> DataFrame:
    """(spec_id, path, content): each specification as a bundle of its own: endpoints and models, folder indexes, root index and log.

    Files of one path overwrite each other, the last of the specification stays. specs: spec_id (also the address it was read
    from) and json.
    """
    head = graph.cut_lineage(heads(specs).drop("license", "contact"))
    docs = graph.cut_lineage(documents(specs).withColumn("folder", text.slug("section")))
    note = F.concat(F.lit("src-"), F.left(text.slug("api"), F.lit(20)))
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " "), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    df = docs.join(head, "spec_id")
    front = F.concat(
        F.lit("---\ntype: "), "type", F.lit("\ntitle: "), quote(F.col("title")), F.lit("\ndescription: "), quote(F.col("description")), F.lit("\nresource: "), quote(F.coalesce("url", "spec_id")), F.lit("\ntags: ["), F.array_join("tags", ", "),
        F.lit(f"]\nstatus: stable\ngenerated:\n  by: {actor}\n  at: {as_of}\nverified:\n  by: process:api-spec-parser\n  at: {as_of}\nsources:\n  - id: "), note, F.lit("\n    resource: "), quote(F.col("spec_id")), F.lit("\n---\n\n"),
    )
    name = F.when(F.col("type") == "Reference", F.regexp_replace("title", " Schema Model$", "")).otherwise(F.regexp_replace("title", r"^(\S+ \S+) - .*$", "$1"))
    tail = F.concat(F.lit("\n\n---\n\n[^"), note, F.lit("]: ["), "api", F.lit("]("), "spec_id", F.lit(")\n"))
    order = F.struct(F.get_json_object("ord", "$.kind").cast("int"), F.get_json_object("ord", "$.path_no").cast("int"), F.get_json_object("ord", "$.method_no").cast("int"), F.get_json_object("ord", "$.name"))
    df = df.withColumn("path", F.concat("folder", F.lit("/"), "slug", F.lit(".md"))).withColumn("name", name).withColumn("at", order).withColumn("content", F.concat(front, F.lit("# "), name, F.lit("\n\n"), "markdown", tail))
    files = df.groupBy("spec_id", "path").agg(F.max_by("content", "at").alias("content"))
    line = F.concat(F.lit("* ["), "name", F.lit("](/"), "path", F.lit(") - "), F.regexp_replace("description", r"[\r\n]+", " "), F.lit("\n"))
    lists = df.withColumn("line", line).groupBy("spec_id", "folder").agg(text.string_agg("line", "", "at").alias("lines"), F.min("at").alias("at"))
    upper = F.upper("folder")
    index = lists.select("spec_id", F.concat("folder", F.lit("/index.md")).alias("path"), F.concat(F.lit("# "), upper, F.lit(" API\n\nThis directory contains API endpoint specifications for **"), "folder", F.lit("**.\n\n## Endpoints & Concepts\n\n"), "lines").alias("content"))
    part = F.concat(F.lit("## "), upper, F.lit(" Section\n\n* ["), upper, F.lit(" Directory](/"), "folder", F.lit("/index.md) - Section index and overview.\n"), "lines", F.lit("\n"))
    whole = lists.withColumn("part", part).groupBy("spec_id").agg(text.string_agg("part", "", "at").alias("parts"))
    base = F.when(F.col("base") != "", F.concat(F.lit("* **Base URL**: `"), "base", F.lit("`\n"))).otherwise("")
    root = head.join(whole, "spec_id", "left").select("spec_id", F.lit("index.md").alias("path"), F.concat(F.lit('---\nokf_version: "0.2"\n---\n\n# '), "api", F.lit(" (v"), "version", F.lit(")\n\n"), "about", F.lit("\n\n"), base, F.lit("\n"), F.coalesce("parts", F.lit(""))).alias("content"))
    counted = docs.groupBy("spec_id").agg(F.count_distinct(F.when(F.col("type") == "API Endpoint", F.struct(F.get_json_object("ord", "$.path_no"), F.get_json_object("ord", "$.method_no")))).alias("n"), F.count_distinct("folder").alias("folders"))
    log = head.join(counted, "spec_id", "left").select("spec_id", F.lit("log.md").alias("path"), F.concat(F.lit(f"# Directory Update Log\n\n## {as_of}\n* **Creation**: Ingested the specification "), "spec_id", F.lit("\n* **Structure**: "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" endpoints in "), F.coalesce("folders", F.lit(0)).cast("string"), F.lit(" sections\n")).alias("content"))
    return files.unionByName(index).unionByName(root).unionByName(log)


#: Parts in a specification of `specs_of_parts`, by their keys.
PARTS = 1000


def specs_of_parts(part: DataFrame) -> DataFrame:
    """(spec_id, json): specifications derived from `part`, one for each brand and PARTS keys: a path per part, which can be read and,
    for some, written, a model per type, composed of a common one."""
    key = F.concat("p_brand", F.lit("/"), F.floor(F.col("p_partkey") / PARTS).cast("string"))
    part = part.withColumn("spec_id", key)
    k, name = F.col("p_partkey").cast("string"), F.regexp_replace("p_type", " ", "")
    size = F.struct(F.lit("size").alias("name"), F.lit("query").alias("in"), (F.col("p_size") % 2 == 0).alias("required"), F.lit("integer").alias("type"), F.lit("How\nlarge").alias("description"))
    ref = F.struct(F.concat(F.lit("#/definitions/"), name).alias("$ref"))
    answer = F.create_map(F.lit("200"), F.struct(F.lit("A part").alias("description"), ref.alias("schema")), F.lit("404"), F.struct(F.lit("None").alias("description"), F.lit(None).cast("struct<`$ref`:string>").alias("schema")))
    tags = F.array(F.substring_index("p_type", " ", 1))
    get = F.to_json(F.struct(tags.alias("tags"), F.concat(F.lit("getPart"), k).alias("operationId"), F.col("p_name").alias("summary"), F.array(F.struct(F.lit("#/parameters/key").alias("$ref"))).alias("parameters"), answer.alias("responses")))
    put = F.to_json(F.struct(tags.alias("tags"), F.lit("Replaces a part.\nAll of it.").alias("description"), F.array(F.struct(F.lit("part").alias("name"), F.lit("body").alias("in"), F.lit(True).alias("required"), ref.alias("schema"))).alias("parameters"), F.create_map(F.lit("204"), F.struct(F.lit("Done").alias("description"))).alias("responses")))
    item = F.concat(F.lit('{"parameters":['), F.to_json(size), F.lit('],"get":'), get, F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(',"put":'), put)).otherwise(""), F.lit("}"))
    paths = part.groupBy("spec_id").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("/parts/"), k, F.lit("/{id}")).alias("key"), item.alias("value")))).alias("paths"))  # at most PARTS rows
    model = F.concat(F.lit('{"description":"'), "p_type", F.lit('","allOf":[{"$ref":"#/definitions/Base"},{"properties":{"size":{"type":"integer","enum":[1,2,3,4,5,6,7,8]}}}],"required":["name"],"properties":{"name":{"type":"string"},"like":{"type":"array","items":{"$ref":"#/definitions/Base"}}}}'))
    types = part.select("spec_id", "p_type").distinct().groupBy("spec_id").agg(F.array_sort(F.collect_list(F.struct(name.alias("key"), model.alias("value")))).alias("models"))  # at most PARTS rows
    joined = lambda c: F.array_join(F.transform(c, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    text_ = F.concat(
        F.lit('{"swagger":"2.0","info":{"title":"API of '), F.substring_index("spec_id", "/", 1), F.lit('","version":"1.0.0"},"host":"api.example","basePath":"/v1","parameters":{"key":{"name":"id","in":"path","required":true,"type":"integer","format":"int64"}},"paths":{'), joined("paths"),
        F.lit('},"definitions":{"Base":{"type":"object","required":["id"],"properties":{"id":{"type":"integer","format":"int64"},"seen":{"type":"string","readOnly":true}}},'), joined("models"), F.lit("}}"),
    )
    return paths.join(types, "spec_id").select("spec_id", text_.alias("json"))
