"""Front matter: odd texts, values as VARIANT, keys nobody knows, one parse for all readers."""

import functools
import json
from collections.abc import Iterator

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspark import api
from loomspark.functions import batches
from loomspark.operators import front, graph, trust, validate
from loomspark.parsing import front as reading
from loomspark.plans import catalogue, frontmatter

SF = "/root/testdata/sf0.001"
#: Texts that once ended a job, or were read otherwise by one reader than by another.
ODD = {
    "number.md": ("---\n2024: x\n~: y\ntrue: 1\ntype: T\n---\nb", "ok", {"2024": "x", "null": "y", "true": 1, "type": "T"}),
    "alias.md": ("---\na: &a [*a]\n---\nb", "unparseable", {}),
    "growing.md": ("---\na: &a [1,1,1,1,1,1,1,1,1]\n" + "".join(f"{y}: &{y} [{','.join([f'*{x}'] * 9)}]\n" for x, y in zip("abcdef", "bcdefg")) + "---\n", "unparseable", {}),
    "shared.md": ("---\na: &a {b: 1}\nc: [*a, *a]\n---\n", "ok", {"a": {"b": 1}, "c": [{"b": 1}, {"b": 1}]}),
    "dates.md": ("---\nsources: {2024-01-01: x}\nd: 2024-01-01\nt: 1:30\n---\n", "ok", {"sources": {"2024-01-01": "x"}, "d": "2024-01-01", "t": "1:30"}),
    "comment.md": ('---\ntype: "Guide" # c\ntitle: >\n  folded\n  text\n---\n', "ok", {"type": "Guide", "title": "folded text\n"}),
    "colon.md": ("---\ntype: 'a: b'\ntitle: \"x # y\"\n---\n", "ok", {"type": "a: b", "title": "x # y"}),
    "twice.md": ("---\na: 1\na: 2\n---\n", "unparseable", {}),
    "deep.md": ("---\na: " + "[" * 5000 + "\n---\n", "unparseable", {}),
    "bare.md": ("---\ntext only\n---\nb", "no_mapping", {}),
    "void.md": ("---\n---\nb", "no_mapping", {}),
    "open.md": ("---\ntype: T\n", "open", {}),
    "none.md": ("no dashes", "absent", {}),
    "null.md": (None, "absent", {}),
    "bom.md": ("\ufeff---\r\ntype: T\r\n---\r\nb", "ok", {"type": "T"}),
    "object.md": ("---\na: !!python/object:os.x {}\n---\n", "unparseable", {}),
    "surrogate.md": ('---\na: "\\ud800"\n---\n', "unparseable", {}),
    "floats.md": ("---\na: .inf\nb: 1.50\nc: 007\nd: 0x1F\ne: 123456789012345678901234567890\n---\n", "ok", {"a": ".inf", "b": 1.5, "c": "007", "d": "0x1F", "e": 123456789012345678901234567890}),
}


def files(spark):
    return spark.createDataFrame([(p, t[0]) for p, t in ODD.items()], "path string, content string")


def test_any_text_is_read():
    for path, (text, state, values) in ODD.items():
        got = reading.read(text)
        assert got[0] == state and json.loads(got[1]) == values, path
        assert got[2] == ("b" if path in ("number.md", "bom.md") else got[2])
        if state != "ok":
            assert got[2] == (text or "").removeprefix("\ufeff")


def test_no_file_ends_a_job(spark):
    parsed = graph.cut_lineage(front.parsed(files(spark)))
    got = {r.path: r for r in parsed.selectExpr("path", "front.state", "to_json(front.values) as v").collect()}
    assert {p: (r.state, json.loads(r.v)) for p, r in got.items()} == {p: (s, v) for p, (_, s, v) in ODD.items()}
    for source in (files(spark), parsed):
        bad = {(r.path, r.check) for r in validate.checks(source).where("not passed").collect()}
        assert ("comment.md", "type_present") not in bad and ("shared.md", "type_present") in bad and ("growing.md", "front_matter_parses") in bad
        assert {(r.label, r.type) for r in graph.nodes(source).where("id in ('comment.md', 'colon.md', 'alias.md')").collect()} == {("folded text", "Guide"), ("x # y", "a: b"), ("alias", "Concept")}
        assert {r.type for r in validate.type_histogram(source).collect()} == {"T", "Guide", "a: b"}
        assert trust.provenance(source).count() == trust.lifecycle(source, "2024-01-01").count() == len(ODD)


def test_bodies_stay_out_of_python(spark):
    """Texts are read as by the reader of one text, yet a worker sees what stands between the dashes only."""
    texts = [t for t, _, _ in ODD.values()] + ["\ufeff\ufeff---\na: 1\n---\nb", "---\na: 1\n---  ", "---\na: 1\n--- \r\n\n---\n", "---\n---", "----\na: 1\n---\n", "---\na: 1\n---x\n---\nb", "---\na: 1---\n", "---\na: '\u2028'\n---\u2028", "--", "---"]
    body = "word " * 400_000
    texts += ["---\na: 1\n---\n" + body, body]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", front.read(F.col("t")).alias("f"))
    assert {r.i: tuple(r.f) for r in df.collect()} == {i: reading.read(t) for i, t in enumerate(texts)}
    assert "run(CASE WHEN" in (plan := df._jdf.queryExecution().analyzed().toString()) and "regexp_extract" in plan


def test_a_type_that_is_no_text(spark):
    df = spark.createDataFrame([("a.md", "---\ntype: 7\n---\n"), ("b.md", "---\ntype: ' '\n---\n"), ("c.md", "---\ntype: [x]\n---\n"), ("d.md", "---\ntype: Attested Computation\nruntime: 3\n---\n")], "path string, content string")
    assert {(r.path, r.passed) for r in validate.checks(df).where("check = 'type_present'").collect()} == {("a.md", False), ("b.md", False), ("c.md", False), ("d.md", True)}
    assert validate.checks(df).where("check = 'runtime_present' and passed").count() == 1
    one = spark.createDataFrame([("a.md", "---\ntype: T\nverified: {at: x}\n---\n"), ("b.md", "---\nverified: []\n---\n"), ("c.md", "---\nverified: human:x\n---\n")], "path string, content string")
    assert {r.path: r.tier for r in trust.lifecycle(one, "2024-01-01").collect()} == {"a.md": "machineConfirmed", "b.md": "unverified", "c.md": "machineConfirmed"}


def test_unknown_keys_survive_a_bundle(spark):
    text = "---\ntype: Guide\ntitle: T\ntags: [a]\n2024: n\nx-owner: {team: 'a: b', n: [1, 2.5, null, true]}\n\"odd: key\": |\n  two\n  lines\nyes: no\n---\n# T\n\nSome body text."
    docs = spark.createDataFrame([(0, "s", "markdown", "https://x.example/t.md", text), (1, "s", "markdown", "https://x.example/u.md", "---\nk: &k [*k]\n---\nBody of another one."), (2, "s", "markdown", "https://x.example/v.md", "plain")], "doc_ord long, source_id string, source_type string, url string, markdown string")
    made = api.generate(docs, as_of="2024-05-01", split=False)
    assert made.report().first().valid
    values = {r.path: json.loads(r.v) for r in made.parsed.selectExpr("path", "to_json(front.values) as v").collect()}
    said = next(v for v in values.values() if v.get("title") == "T")
    assert {k: said[k] for k in ("2024", "x-owner", "odd: key", "yes")} == {"2024": "n", "x-owner": {"team": "a: b", "n": [1, 2.5, None, True]}, "odd: key": "two\nlines\n", "yes": "no"}
    assert said["type"] == "Guide" and said["tags"][0] == "a" and len(said["sources"]) == 1


def test_written_files_read_the_same(spark):
    parsed = front.parsed(files(spark)).where("front.state = 'ok'")
    again = parsed.select("path", front.written(F.col("front.values"), F.col("front.body")).alias("content"), F.to_json("front.values").alias("before"))
    for r in front.parsed(again).select("path", "before", F.to_json("front.values").alias("after"), "front.state").collect():
        assert r.state == "ok" and json.loads(r.before) == json.loads(r.after), r.path


@pytest.mark.parametrize("name", sorted(frontmatter.QUERIES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    made, want = frontmatter.QUERIES[name](spark, SF), con.sql(frontmatter.ORACLE_SQL[name])
    assert made.columns == want.columns
    assert sorted(tuple(r) for r in made.collect()) == sorted(want.fetchall())


def test_provenance_gives_python_front_matter_only(spark, tmp_path, monkeypatch):
    """Of a bundle's concepts a worker gets the front matter, in small batches, however long the files are."""
    given, make = tmp_path / "given", F.pandas_udf
    log = str(given)

    def noted(texts):
        with open(log, "a") as f:
            f.write(f"{sum(len(x or '') for x in texts)}\n")
        return texts

    def watched(run):
        @functools.wraps(run)
        def over(got):
            return run(map(noted, got) if isinstance(got, Iterator) else noted(got))

        return over if run.__module__ == front.__name__ else run

    monkeypatch.setattr(F, "pandas_udf", lambda kind: lambda run: make(kind)(watched(run)))
    i = F.col("id").cast("string")
    html = F.concat(F.lit("<html><body><article><h1>Page "), i, F.lit("</h1><p>"), F.repeat(F.lit("Words of a page. "), 1200), F.lit("</p></article></body></html>"))
    pages = spark.range(0, 600, 1, 4).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h.example/a/"), i).alias("url"), html.alias("html"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    rows = catalogue.generated_provenance(spark, str(tmp_path)).collect()
    assert {(r.sources, r.status, r.tier) for r in rows} == {(f"https://h.example/a/{n}", "stable", "machineConfirmed") for n in range(600)} and len(rows) == 600
    sizes = [int(n) for n in given.read_text().split()]
    assert max(sizes) < 2 * batches.BYTES and 0 < sum(sizes) < 600 * 2000  # pages of 20,000 characters
