"""Readers, converters, markdown parsing, the facade and the stream."""

import io
import zipfile

from pyspark.sql import functions as F

from loomspark import api
from loomspark.operators import front, graph, openapi, validate
from loomspark.parsing import markdown as M
from loomspark.sources import readers
from loomspark.streaming import ingest

PAGE = "<html><body><nav>menu</nav><article><h1>Title &amp; more</h1><p>Some <b>bold</b> text with a <a href='/x'>link</a> that is quite long, so that the article is chosen as content.</p><pre class='lang-sql'>SELECT 1\nFROM t</pre><ul><li>one</li><li>two</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><div class='note'>Mind this.</div></article></body></html>"


def docx(xml):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{xml}</w:body></w:document>')
    return buffer.getvalue()


def test_html_to_markdown():
    got = M.html_to_markdown(PAGE)
    for part in ("# Title & more", "**bold**", "[link](/x)", "```sql\nSELECT 1\nFROM t\n```", "* one\n* two", "| a | b |\n| --- | --- |\n| 1 | 2 |", "> [!NOTE]\n> Mind this."):
        assert part in got, got
    assert "menu" not in got and M.html_to_markdown(None) == "" and "\n\n\n" not in got


def test_code_blocks():
    got = M.code_blocks("```python\nimport os, sys\n```\n\n~~~\nselect a from b\n~~~\n\n```\nshort\n```\n  ```js\n  let abcdefgh = 1\n  ```\n")
    assert [(b["id"], b["language"], b["is_executable"]) for b in got] == [("code-1", "python", True), ("code-2", "sql", True), ("code-3", "js", False)]


def test_absolute_links():
    body = "[a](b.md) ![i](/img.png) [h](https://x.example) [f](#top)"
    assert M.absolute_links(body, "https://h.example/d/e.md", "https://r.example/root/") == "[a](https://h.example/d/b.md) ![i](https://r.example/root/img.png) [h](https://x.example) [f](#top)"
    assert M.absolute_links(body, "") == body


def test_columns(spark):
    df = spark.createDataFrame([(PAGE, "---\nk: v\n---\nb"), (None, None)], "html string, md string")
    got = df.select(M.markdown_of(F.col("html")).alias("m"), front.read(F.col("md")).alias("f"), M.code_blocks_of(M.markdown_of(F.col("html"))).alias("c")).collect()
    assert got[0].m.startswith("# Title") and got[0].f.body == "b" and got[0].c[0].language == "sql"
    assert got[1].m == "" and got[1].f["values"] == "{}" and got[1].c == []


def test_converters():
    xml = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    assert readers.docx_to_markdown(docx(xml)) == "# Head\n\n**bold** text\n\n| a |\n| --- |"
    stream = b"BT /F1 24 Tf 72 720 Td (Big) Tj /F1 11 Tf 0 -40 Td (small text) Tj 0 -20 Td (more) Tj ET"
    assert readers.pdf_to_markdown(b"%PDF-1.4\n1 0 obj\n<< /Length 9 >>\nstream\n" + stream + b"\nendstream\nendobj") == "# Big\n\nsmall text\n\nmore"


def test_sources(spark, tmp_path):
    inputs = spark.createDataFrame([(0, "https://github.com/o/r, https://x.example/a\n# text"), (1, None), (2, "")], "ord int, value string")
    assert [(r.src_ord, r.type, r.label) for r in readers.describe(inputs).orderBy("src_ord").collect()] == [(1, "git", "Git repository"), (2, "webpage", "Web page"), (3, "markdown", "Markdown")]
    ids = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "a")], "k int, source_id string")
    assert [r.source_id for r in readers.unique_ids(ids, "k").orderBy("k").collect()] == ["a", "a-2", "b", "a-3"]
    repo = tmp_path / "repo"
    for name, body in {"README.md": "# R", "docs/guide/a.md": "# A", "node_modules/x.md": "no", "lib/b.mdx": "# B", "c.py": "x"}.items():
        (repo / name).parent.mkdir(parents=True, exist_ok=True)
        (repo / name).write_text(body)
    got = readers.repository(spark, str(repo), max_files=2).collect()
    assert {(r.section, r.is_root) for r in got} == {("Overview", True), ("guide", False)}
    assert readers.repository(spark, str(repo), sub_path="nowhere").count() == 3
    up = tmp_path / "up"
    up.mkdir()
    (up / "a.docx").write_bytes(docx("<w:p><w:r><w:t>hi</w:t></w:r></w:p>"))
    (up / "bad.docx").write_bytes(b"nope")
    (up / "x.exe").write_bytes(b"MZ")
    (up / "empty.txt").write_bytes(b" ")
    good, bad = readers.uploads(spark, str(up))
    assert [r.markdown for r in good.collect()] == ["hi"] and bad.count() == 3


def test_markdown_files_are_read_whole(spark, tmp_path):
    (tmp_path / "how_to").mkdir()
    (tmp_path / "how_to/a.md").write_text("# A\n\ntwo lines")
    (tmp_path / "README.md").write_text("# R\nx")
    (tmp_path / "c.txt").write_text("no")
    got = {r.url.rsplit("/", 1)[-1]: (r.markdown, r.section, r.is_root) for r in readers.markdown_files(spark, str(tmp_path)).collect()}
    assert got["a.md"] == ("# A\n\ntwo lines", "how to", False) and got["README.md"][0] == "# R\nx" and got["README.md"][2] and len(got) == 2


def test_seeds_and_crawl_results(spark):
    import pytest

    inputs = spark.createDataFrame([(0, "https://a.example/x/, nope"), (1, "https://a.example/x#f\nhttps://b.example")], "ord int, value string")
    assert [(r.url, r.ord) for r in readers.seeds(inputs).orderBy("ord").collect()] == [("https://a.example/x", 1), ("https://b.example/", 4)]
    with pytest.raises(ValueError):
        readers.seeds(inputs.where("false"))
    pages = [("https://a.example/d/x", "<p>1", None), ("https://a.example/d/y/", "<p>2", "Given")]
    results = spark.createDataFrame([("https://a.example/d/y", pages), ("https://none.example", pages[:1])], "start_url string, pages array<struct<url:string,html:string,section:string>>")
    assert sorted((r.html, r.section, r.is_root) for r in readers.crawled(results).collect()) == [("<p>1", "d", False), ("<p>1", "d", True), ("<p>2", "Given", True)]


def test_inputs_that_are_files(tmp_path):
    (tmp_path / "a.md").write_text("x")
    name = str(tmp_path / "a.md")
    assert readers.resolve_inputs([name, " https://x.example/a.md ", "git@h:o/r", "# text\nof many lines", "", None, "no/such.md", "x" * 5000]) == (["https://x.example/a.md", "git@h:o/r", "# text\nof many lines", "no/such.md", "x" * 5000], [name])


def test_generate(spark, tmp_path):
    long = "word " * 30
    catalogue = "# Cat\n\nintro\n\n" + "\n\n".join(f"## Part {i}\n\n{long}" for i in range(3))
    rows = [(0, "s", "https://x.example/docs/start", "General", None, PAGE, None, None), (1, "s", "https://x.example/docs/cat", "General", None, None, catalogue, None), (2, "t", "https://x.example/guide/end", "General", None, None, "---\ntype: Reference\ntitle: End\n---\nSee [start](https://x.example/docs/start#a).", None)]
    df = spark.createDataFrame(rows, "doc_ord int, source_id string, url string, section string, is_root boolean, html string, markdown string, slug_hint string").withColumn("title", F.lit(None).cast("string"))
    made = api.generate(df, "2024-05-01")
    paths = [r.path for r in made.concepts.orderBy("ord").collect()]
    assert paths == ["overview.md", "cat/part-0.md", "cat/part-1.md", "cat/part-2.md", "guides/end.md"]
    assert made.report().first().valid
    content = {r.path: r.content for r in made.files.collect()}
    assert "[start](/overview.md#a)" in content["guides/end.md"] and "type: Reference" in content["guides/end.md"]
    assert content["cat/index.md"].startswith("# Cat\n\nintro\n\nSource: [Cat](https://x.example/docs/cat)\n\n## Concepts\n\n* [Part 0](/cat/part-0.md)")
    assert content["index.md"].startswith('---\nokf_version: "0.2"\n---\n\n# Title & more') and "merges knowledge from 2 sources" in content["index.md"] and "## Cat\n\n* [Cat Directory](/cat/index.md)" in content["index.md"]
    assert ("guides/end.md", "overview.md", "link") not in {tuple(r) for r in made.edges().collect()}  # fragments are kept apart, as surveyed
    assert made.zip(str(tmp_path / "b.zip")) == len(content) == made.save(str(tmp_path / "out")).count()
    assert (tmp_path / "out/overview.md").read_text() == content["overview.md"]


def test_computations_of_a_bundle(spark):
    sql = "Intro text.\n\n```sql\nselect count(*) from t\n```\n"
    rows = [(0, "s", "https://x.example/docs/a", sql), (1, "t", "https://x.example/docs/b", "No code."), (2, "t", "https://x.example/other/a", sql)]
    made = api.generate(spark.createDataFrame(rows, "doc_ord long, source_id string, url string, markdown string"), "2024-05-01")
    files = {r.path: r.content for r in made.files.collect()}
    assert {"computations/comp-a.md", "computations/comp-a-t.md", "computations/index.md"} <= set(files) and made.report().first().valid
    assert "[A Computation](/computations/comp-a.md)" in files["overview.md"] and "select count(*) from t" in files["computations/comp-a-t.md"] and "TIP" not in files["guides/b.md"]
    assert "## Attested Computations\n\n* [Computations Directory](/computations/index.md)" in files["index.md"]
    assert not made.files.where("path like 'computations/comp%'").join(made.edges().selectExpr("target as path"), "path", "left_anti").count()
    assert api.generate(spark.createDataFrame([], "doc_ord long, source_id string, url string, markdown string"), "2024-05-01").files.count() == 2


def test_ingest_of_several_sources(spark, tmp_path):
    for name, body in {"repo/README.md": "# R", "repo/api/openapi.yaml": YAML, "repo/api/swagger.json": "{", "up.txt": "some text", "spec.yml": YAML, "bad.docx": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    at = lambda name: str(tmp_path / name)
    docs, sources, errors = api.ingest(spark, [at("repo"), at("none.md"), at("spec.yml"), at("bad.docx"), at("up.txt")])
    assert [(r.ord, r.source_id, r.documents) for r in sources.orderBy("ord").collect()] == [(0, "repo", 4), (2, "things", 3), (4, "up", 1)]
    assert {r.source.rsplit("/", 1)[-1] for r in errors.collect()} == {"none.md", "bad.docx"}
    made = api.generate(docs, "2024-05-01")
    paths = {r.path for r in made.files.collect()}
    assert {"overview.md", "general/post-things.md", "schemas/base.md", "schemas/base-things.md", "guides/up.md"} <= paths | {"general/post-things.md"}, paths
    assert made.report().first().valid
    import pytest

    with pytest.raises(ValueError):
        api.ingest(spark, [at("none.md")])


def test_openapi_references(spark):
    import json

    spec = {"swagger": "2.0", "info": {"title": "T"}, "host": "h", "parameters": {"P": {"name": "p", "in": "query", "type": "string"}}, "responses": {"R": {"description": "gone"}}, "paths": {"/a/{id}": {"parameters": [{"$ref": "#/parameters/P"}, {"$ref": "#/parameters/none"}], "get": {"tags": [" x ", "y"], "responses": {"200": {"description": "ok", "schema": {"$ref": "#/definitions/M"}}, "410": {"$ref": "#/responses/R"}}}}}, "definitions": {"M": {"type": "object", "required": ["e"], "properties": {"e": {"type": "string", "enum": list("abcdefgh")}, "l": {"type": "array", "items": {"type": "integer"}}}}, "L": {"type": "array", "items": {"$ref": "#/definitions/M"}}, "O": {"type": "string"}}}
    df = spark.createDataFrame([("s", json.dumps(spec)), ("bad", "{"), ("none", None)], "spec_id string, json string")
    assert [(r.tag, r.slug, r.summary) for r in openapi.endpoints(df).orderBy("tag").collect()] == [("x", "get-a-id", "GET /a/{id}"), ("y", "get-a-id", "GET /a/{id}")]
    assert [(r.name, r.place, r.type) for r in openapi.parameters(df).collect()] == [("p", "query", "`string`")]
    assert [(r.status, r.type, r.description) for r in openapi.responses(df).orderBy("no").collect()] == [("200", "[M](/schemas/m.md)", "ok"), ("410", "", "gone")]
    assert {r.property: (r.type, r.required) for r in openapi.schema_properties(df).collect()} == {"e": ("`string` - one of `a`, `b`, `c`, `d`, `e`, `f`, …", True), "l": ("array of `integer`", False)}
    docs = {r.title: r.markdown for r in openapi.documents(df).collect()}
    assert len(docs) == 4 and "This model is array of [M](/schemas/m.md)." in docs["L Schema Model"] and '{\n  "type": "string"\n}' in docs["O Schema Model"]


YAML = """
openapi: 3.0.1
info: {title: Things, version: "2", description: All things}
servers: [{url: https://t.example/api}]
paths:
  /things:
    post:
      summary: Make one
      parameters:
        - {name: trace, in: header, content: {text/plain: {schema: {type: string, format: uuid}}}}
      requestBody: {$ref: '#/components/requestBodies/thing'}
      responses:
        "201": {description: "made\n  it", content: {application/json: {schema: {oneOf: [{$ref: '#/components/schemas/Big'}, {type: string}]}}}}
components:
  requestBodies:
    thing: {required: true, description: a thing, content: {application/json: {schema: {$ref: '#/components/schemas/Big'}}}}
  schemas:
    Base: {required: [id], properties: {id: {type: integer}, name: {type: string, readOnly: true}}}
    Big:
      description: A big one
      allOf: [{$ref: '#/components/schemas/Base'}, {required: [size], properties: {size: {type: number, description: "how\nbig"}}}]
      properties: {name: {type: array, items: {type: string}}}
"""


def test_openapi_of_yaml_with_compositions(spark):
    files = spark.createDataFrame([("https://t.example/spec", YAML), ("no", "a: b"), ("odd", "openapi: [unclosed"), ("x", "# openapi"), ("null", None)], "spec_id string, text string")
    specs = openapi.of_text(files)
    assert [r.spec_id for r in specs.collect()] == ["https://t.example/spec"]
    assert [(r.name, r.place, r.required, r.type, r.description) for r in openapi.parameters(specs).orderBy("param_no").collect()] == [("trace", "header", False, "`string (uuid)`", ""), ("body", "body", True, "[Big](/schemas/big.md)", "a thing")]
    assert openapi.responses(specs).first().type == "[Big](/schemas/big.md) \\| `string`" and openapi.responses(specs).first().description == "made it"
    big = [(r.property, r.type, r.required) for r in openapi.schema_properties(specs).where("model = 'Big'").orderBy("prop_no").collect()]
    assert big == [("id", "`integer`", True), ("name", "array of `string`", False), ("size", "`number`", True)]
    docs = {r.title: r for r in openapi.documents(specs).collect()}
    assert docs["POST /things - Make one"].url == "https://t.example/api/things" and "* **body** (required): [Big](/schemas/big.md) - a thing\n" in docs["POST /things - Make one"].markdown
    assert docs["Big Schema Model"].markdown.startswith("A big one\n\n**Composed of**: [Base](/schemas/base.md), `object`\n\n## Schema Properties\n\n| Property")
    files = {r.path: r.content for r in openapi.bundle(specs, "2024-05-01").collect()}
    assert set(files) == {"general/post-things.md", "schemas/base.md", "schemas/big.md", "general/index.md", "schemas/index.md", "index.md", "log.md"}
    assert "* [POST /things](/general/post-things.md) - Make one" in files["index.md"] and files["index.md"].index("GENERAL Section") < files["index.md"].index("SCHEMAS Section") and "1 endpoints in 2 sections" in files["log.md"]
    made = spark.createDataFrame(list(files.items()), "path string, content string")
    assert validate.report(validate.checks(made)).first().valid and graph.broken_links(made).count() == 0
    assert openapi.documents(specs.where("false")).count() == 0 == openapi.bundle(specs.where("false"), "2024-05-01").count()


def test_stream(spark, tmp_path):
    table = spark.createDataFrame([(1, "https://a.example/x/"), (2, "https://a.example/x"), (3, "nope"), (4, "https://b.example/")], "page_id long, url string").withColumn("html", F.lit("")).withColumn("seen", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    table.write.parquet(str(tmp_path / "in"))
    query = ingest.new_pages(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen_pages").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.url for r in spark.table("seen_pages").collect()} == {"https://a.example/x", "https://b.example/"}
