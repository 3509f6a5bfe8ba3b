"""Truth tables of the column functions."""

import pytest
from pyspark.sql import functions as F

from loomspark.functions import classify, text, url


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "table"),
    [
        (text.slug, {"Hello, World!": "hello-world", "  a__b  c ": "a-b-c", "": "item", None: "item", "---": "item", "Éa": "a"}),
        (text.truncate_slug, {"a" * 70: "a" * 60, "b" * 40 + "-" + "c" * 40: "b" * 40, "short": "short", "a-" + "b" * 80: "a-" + "b" * 58}),
        (text.path_slug, {"/pets/{petId}/photos.json": "pets-petid-photos-json"}),
        (text.strip_html, {"<b>a</b>&nbsp;c": "a c", None: ""}),
        (text.strip_markdown, {"![x](y) [t](u) **b** `c`": "t b c", "[![i](a)](b) text": "text"}),
        (text.first_sentence, {"# H\n\n- list\n\nThis is a longer first sentence. Then more.": "This is a longer first sentence.", "": "", "short": ""}),
        (text.title_from_path, {"docs/my-first_file.md": "My First File", "https://x.example/a/README.md?x=1": "Overview", "": "Untitled Document", "https://x.example": "Untitled Document"}),
        (text.folder_title, {"load-data": "Load Data"}),
        (text.prose_length, {"## H\n\nab *cd*": 7, "```sql\nselect 1\n```\nxy": 2, "": 0}),
        (text.sanitize_filename, {"my bundle!.zip": "my-bundle-"}),
        (url.normalize_url, {"https://a.example/x/?hl=en#f": "https://a.example/x", "https://a.example": "https://a.example/", "https://A.example/x?a=1&hl=de&b=2": "https://a.example/x?a=1&b=2", "nope": None, None: None}),
        (url.source_id, {"https://www.a.example/docs/x": "aexample-docs", "https://a.example": "aexample", "some text": "some-text"}),
        (url.to_raw_url, {"https://github.com/o/r/blob/main/a.md": "https://raw.githubusercontent.com/o/r/main/a.md", "https://gitlab.com/o/r/-/blob/main/a.md": "https://gitlab.com/o/r/-/raw/main/a.md", "x": "x"}),
        (url.link_root, {"https://raw.githubusercontent.com/o/r/main/docs/a.md": "https://raw.githubusercontent.com/o/r/main/", "https://x.example/a": ""}),
        (url.markdown_section, {"https://x.example/how_to/a.md": "how to", "https://x.example/docs/a.md": "Guides", "": "Guides"}),
        (classify.source_type, {"https://github.com/o/r": "git", "git@host.example:o/r": "git", "https://github.com/o/r/blob/main/a.md": "markdown", "https://x.example/openapi": "openapi", "https://x.example/a.json": "openapi", "https://x.example/a": "webpage", '{"a": 1}': "openapi", "openapi: 3.0.0": "openapi", "# Text": "markdown", "": "webpage", "https://docs.google.com/document/d/abc/edit": "upload", "https://x.example/r.git": "git"}),
        (classify.code_language, {"select 1": "sql", "import os": "python", "npm install": "bash", '{"a": [1]}': "json", "key: value": "yaml", "zzz": "text"}),
        (classify.concept_type, {"Overview of X": "Overview", "API docs": "Reference", "How to load": "Playbook", "My dataset": "BigQuery Table", "Other": "Guide", None: "Guide"}),
        (classify.file_role, {"index.md": "root_index", "a/index.md": "index", "log.md": "log", "a/b.md": "concept"}),
        (classify.actor_kind, {"human:ana": "human", "process:ci": "process", "acme/1.2": "producer", None: "unknown"}),
        (classify.repo_section, {"README.md": "Overview", "docs/a.md": "Documentation", "docs/big_topic/a.md": "big topic", "lib/x.md": "lib", "x.md": "Repository"}),
        (classify.repo_rank, {"README.md": 0, "docs/a.md": 1, "api/openapi.yaml": 2, "x/readme.md": 3, "x.md": 4}),
    ],
)
def test_table(spark, f, table):
    assert values(spark, f, list(table)) == list(table.values())


def test_parse_repo(spark):
    got = values(spark, url.parse_repo, ["https://github.com/o/r/tree/dev/docs/x", "git@gitlab.com:g/sub/r.git", "o", "https://h.example/a/b.git"])
    assert (got[0].host, got[0].owner, got[0].repo, got[0].ref, got[0].sub_path) == ("github", "o", "r", "dev", "docs/x")
    assert (got[1].host, got[1].full_name) == ("gitlab", "g/sub/r")
    assert got[2] is None
    assert (got[3].host, got[3].web_url) == ("other", "https://h.example/a/b")


def test_bundle_name(spark):
    df = spark.createDataFrame([("https://www.x.com/docs/en/big/guide", "T", "Acme"), ("https://www.x.com/docs", "T", ""), ("https://www.x.com/", "", ""), ("no", "Title", "")], "u string, t string, s string")
    assert [r.n for r in df.select(url.bundle_name(F.col("u"), F.col("t"), F.col("s")).alias("n")).collect()] == ["acme-big-guide", "t", "x", "title"]


def test_scope(spark):
    df = spark.createDataFrame([("https://a.example/docs/x", "https://a.example/docs/y"), ("https://a.example/x.png", "https://a.example/"), ("https://b.example/docs", "https://a.example/docs"), ("https://a.example/other", "https://a.example/docs")], "c string, s string")
    assert [r.k for r in df.select(url.in_scope(F.col("c"), F.col("s")).alias("k")).collect()] == [True, False, False, False]


def test_trust_tier(spark):
    df = spark.createDataFrame([(None,), ([],), (["process:ci"],), (["process:ci", "human:a"],)], "v array<string>")
    assert [r.t for r in df.select(classify.trust_tier(F.col("v")).alias("t")).collect()] == ["unverified", "unverified", "machineConfirmed", "humanReviewed"]
