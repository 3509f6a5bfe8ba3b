"""Bundle operators on small inputs, and every query against its SQL on the smallest tables."""

import functools
import os
from collections.abc import Iterator

import pytest
from pyspark.sql import functions as F

from loomspark.operators import attest, bundle, documents, graph, sections, trust, validate
from loomspark.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_paths_are_injective(spark):
    rows = [(0, "f", "a", "s"), (1, "f", "a", "s"), (2, "f", "a", "s"), (3, "f", "a-s", "t"), (4, "f", "index", "s"), (5, "g", "a", "s")]
    df = spark.createDataFrame(rows, "page_id long, folder string, slug string, source_id string")
    got = {r.page_id: r.path for r in documents.resolve_paths(df, "page_id").collect()}
    assert got == {0: "f/a.md", 1: "f/a-s.md", 2: "f/a-s-2.md", 3: "f/a-s-t.md", 4: "f/index-s.md", 5: "g/a.md"}


@pytest.mark.parametrize("seed", range(3))
def test_paths_are_those_of_the_choice_in_order(spark, seed):
    """Against one concept after the other; names that look like suffixed ones of others, and long runs of one name."""
    import random

    r = random.Random(seed)
    rows = [(i, r.choice(["f", "g", ""]), r.choice(["a", "a-s", "a-s-2", "a-s-3", "index", "a-s-s", "b"]), r.choice(["s", "s", "2", "s-2"])) for i in range(150)]
    taken, want = set(), {}
    for i, folder, slug, source in rows:
        n, name = 0, slug
        while name in ("index", "log") or (folder, name) in taken:
            n += 1
            name = f"{slug}-{source}" if n == 1 else f"{slug}-{source}-{n}"
        taken.add((folder, name))
        want[i] = (folder + "/" if folder else "") + name + ".md"
    df = spark.createDataFrame(rows, "page_id long, folder string, slug string, source_id string").repartition(5)
    assert {x.page_id: x.path for x in documents.resolve_paths(df, "page_id").collect()} == want


def test_ranks_in_groups_of_any_size(spark):
    rows = [(i, "hot" if i % 3 else f"c{i % 7}") for i in range(900)]
    got = {x.k: x.n for x in graph.grouped_ranks(spark.createDataFrame(rows, "k long, g string").repartition(7), ["g"], "k", "n").collect()}
    seen = {}
    for k, g in rows:
        assert got[k] == seen.get(g, 0)
        seen[g] = got[k] + 1


def test_documents_say_what_they_are(spark):
    """Adapter, then front matter, then text; tags are united; a heading that repeats the title goes."""
    md = "---\ntitle: From *front*\ntags: B, a\ndate: 2024-02-03T10:00:00\nauthor: Ana\nsection: Setup\nsummary: Short\n---\n# From front\n\nText [x](y.md).\n\n## More"
    rows = [
        (0, "s", "https://x.example/d/a.md", md, None, None, None), (1, "s", "https://x.example/d/b.md", md, "Given", ["Z"], "Ops"), (2, "s", "u/read_me.md", "plain text, and nothing that tells more", None, None, None), (3, "s", "https://x.example/p", None, None, ["t"], None),
    ]
    df = spark.createDataFrame(rows, "doc_ord long, source_id string, url string, markdown string, title string, tags array<string>, section string")
    got = {r.doc_ord: r for r in documents.parse_documents(df, "doc_ord", "2024-05-01").collect()}
    assert (got[0].title, got[0].description, got[0].author, got[0].last_modified, got[0].section, got[0].tags) == ("From front", "Short", "Ana", "2024-02-03", "Setup", ["b", "a", "setup"])
    assert got[0].body == "Text [x](https://x.example/d/y.md).\n\n## More"
    assert (got[1].title, got[1].section, got[1].tags) == ("Given", "Ops", ["b", "a", "ops", "z"]) and got[1].body.startswith("# From front")
    assert (got[2].title, got[2].description, got[2].last_modified, got[2].author) == ("Read Me", "plain text, and nothing that tells more", "2024-05-01", "Documentation Team")
    assert got[3].body == "" and got[3].tags[-1] == "t"


def test_fences_hide_headings(spark):
    df = spark.createDataFrame([(1, "# A\n```\n# no\n~~~\n# no\n```\n   ## B ##\n~~~\n```\n# no\n~~~\n# C"), (2, None)], "id long, md string")
    assert [(r.level, r.heading) for r in sections.headings(df, "id", "md").orderBy("line_no").collect()] == [(1, "A"), (2, "B"), (1, "C")]


def test_thin_sections_fold(spark):
    long = "word " * 30
    md = f"# T\n\nintro\n\n## Zero\n\nthin\n\n## One\n\n{long}\n\n## Two\n\nthin too\n\n## Three\n\n{long}\n\n## Four\n\n{long}"
    got = sections.split_sections(spark.createDataFrame([(1, md), (2, "## a\n\nb"), (3, None)], "id long, md string"), "id", "md").orderBy("sec_ord").collect()
    assert [r.title for r in got] == [None, "One", "Three", "Four"]
    assert got[0].body == "# T\n\nintro\n\n## Zero\n\nthin" and got[1].body.endswith("## Two\n\nthin too")


def test_links_are_rewritten_in_dictionary_order(spark):
    concepts = spark.createDataFrame([(0, "https://a.example/x/", "x.md"), (1, "https://a.example/deep/x", "y.md"), (2, "https://b.example", "root.md")], "ord long, url string, path string")
    docs = spark.createDataFrame([(1, "[a](https://a.example/x#h) [b](/deep/x) [c](https://c.example/none) [d](https://b.example/) ![e](/x)")], "id long, body string")
    got = bundle.rewrite_links(bundle.extract_links(docs, "id", "body"), bundle.url_dictionary(concepts, "ord"), "id").orderBy("pos").collect()
    assert [r.target for r in got] == ["/x.md#h", "/x.md", None, "/root.md", "/x.md"]


def test_bundle_is_valid_and_linked(spark):
    concepts = spark.createDataFrame([(0, "f/a.md", "f", "A", "https://x.example/a", "says", "Guide", "see [b](/f/b.md)"), (1, "f/b.md", "f", 'B "q"', None, None, None, None)], "k long, path string, folder string, title string, url string, description string, type string, body string")
    files = bundle.bundle_files(concepts, "k", "2024-05-01")
    assert {r.path for r in files.collect()} == {"f/a.md", "f/b.md", "f/index.md", "index.md", "log.md"}
    assert validate.report(validate.checks(files)).first().valid
    assert ("f/a.md", "f/b.md", "link") in {tuple(r) for r in graph.cross_links(files).collect()}
    assert graph.broken_links(files).count() == 0


def test_empty_bundle_fails_existence(spark):
    found = validate.report(validate.checks(spark.createDataFrame([], "path string, content string"))).first()
    assert not found.valid and found.errors == 2


def test_closure_survives_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "src long, dst long")
    got = graph.closure(edges, spark.createDataFrame([(1,), (4,)], "start long"))
    assert {tuple(r) for r in got.collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (4, 4, 0)}


def test_crawl_caps_and_failures(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 0), ("x", "e", 0), ("a", "x", 2)], "src string, dst string, pos int")
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "url string")
    seeds = spark.createDataFrame([("a", 0)], "url string, ord int")
    got = graph.crawl(edges, seeds, known, 3).orderBy("ord").collect()
    assert [(r.url, r.depth) for r in got] == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert [r.url for r in graph.crawl(edges, seeds, known, 3, max_pages=2).orderBy("ord").collect()] == ["a", "b"]


def test_crawl_inherits_sections_and_shows_what_failed(spark):
    edges = spark.createDataFrame([("a", "b", 0, "Guides"), ("a", "x", 1, None), ("b", "d", 0, None), ("a", "c", 2, None)], "src string, dst string, pos int, section string")
    seeds = spark.createDataFrame([("a", 0, "Home")], "url string, ord int, section string")
    known = spark.createDataFrame([(u,) for u in "abcd"], "url string")
    got = graph.crawl(edges, seeds, known, max_depth=None, visited=True).orderBy("ord").collect()
    assert [(r.url, r.depth, r.section, r.fetched) for r in got] == [("a", 0, "Home", True), ("b", 1, "Guides", True), ("x", 1, "Home", False), ("c", 1, "Home", True), ("d", 2, "Guides", True)]
    assert graph.crawl(edges, seeds.where("false"), known).count() == 0


def test_front_matter_that_is_no_mapping(spark):
    closed = lambda x: f"---\n{x}\n---\nbody"
    files = [("a.md", closed("type: X\nsources: [{resource: u}, {id: b}]")), ("b.md", closed("type: X\nsources: one")), ("c.md", closed("type: [")), ("d.md", closed("- type: X")), ("e.md", "---\ntype: X\n"), ("f.md", None), ("g.md", closed("type: X\nsources: []"))]
    found = validate.checks(spark.createDataFrame(files, "path string, content string")).where("path != 'index.md' and path != 'log.md'")
    bad = {(r.path, r.check) for r in found.where("not passed").collect()}
    assert bad == {("a.md", "source_resource"), ("b.md", "sources_list"), ("c.md", "front_matter_parses"), ("d.md", "front_matter_mapping"), ("e.md", "front_matter_closed"), ("f.md", "front_matter_present")}
    root = validate.checks(spark.createDataFrame([("index.md", "---\nx: [\n---\n")], "path string, content string"))
    assert {r.check for r in root.where("path = 'index.md' and not passed").collect()} == {"version", "root_index_parses"}
    assert {(r.check, r.passed) for r in found.where("path = 'a.md' and check like 'source%'").collect()} == {("sources_list", True), ("source_resource", True), ("source_resource", False)}


def test_provenance_of_old_and_new_files(spark):
    new = "---\ntype: X\ngenerated:\n  by: p\n  at: 2024-01-01\nverified:\n  - by: human:a\n    at: 2024-02-01\n  - by: human:b\n    at: \"2024-03-01\"\nsources:\n  - id: s\n    resource: https://x.example\n---\nb"
    old = "---\ntype: X\ntimestamp: 2023-01-01\n---\nb\n\n# Citations\n\n* [One](https://one.example/a)\n1. https://two.example/b\n\n# More\n* [no](https://no.example)"
    got = {r.path: (r.generated_at, r.verified_at, r.sources) for r in trust.provenance(spark.createDataFrame([("n", new), ("o", old), ("z", None)], "path string, content string")).collect()}
    assert got == {"n": ("2024-01-01", "2024-03-01", ["https://x.example"]), "o": ("2023-01-01", None, ["https://one.example/a", "https://two.example/b"]), "z": (None, None, [])}
    seen = spark.createDataFrame([("c", 1, "x", 0), ("c", 2, "y", 1), ("c", 2, "z", 2), ("d", None, "w", 3)], "c string, at int, by string, k int")
    assert {tuple(r) for r in trust.latest_verification(seen, "c", "k").collect()} == {("c", 2, "z"), ("d", None, "w")}


def test_listing_search_and_navigation(spark):
    files = spark.createDataFrame([("b/x.md", "[a](/a.md#part) [n](./none.md) [h](https://h.example) [s](#s)"), ("log.md", ""), ("a.md", None), ("index.md", "")], "path string, content string")
    assert [r.path for r in bundle.listing(files).collect()] == ["index.md", "log.md", "a.md", "b/x.md"]
    assert [r.path for r in bundle.search(files, "/X").collect()] == ["b/x.md"]
    assert [(r.target, r.found) for r in graph.navigation(files).orderBy("pos").collect()] == [("a.md", True), ("b/none.md", False)]


def test_bind_refuses_undeclared():
    with pytest.raises(attest.UndeclaredParameter):
        attest.bind("select :a", {"a": True}, {"a": 1, "b": 2})
    with pytest.raises(attest.UndeclaredParameter):
        attest.bind("select :a", {"a": True}, {})
    assert attest.bound_text("select :a, :b", {"a": "o'k", "b": 3}) == "select 'o''k', 3"


def test_staleness(spark):
    df = spark.createDataFrame([(1, None, None), (2, "draft", "2024-01-01"), (3, None, "no date"), (4, None, "2024-01-03")], "id int, status string, stale_after string")
    assert [(r.status, r.stale) for r in trust.staleness(df, "2024-01-02").orderBy("id").collect()] == [("stable", False), ("draft", True), ("stable", False), ("stable", False)]


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_crawl_goes_down_to_the_last_level(spark, tmp_path):
    ids = [2**k - 1 for k in range(24)]
    spark.createDataFrame([(i,) for i in ids], "page_id long").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert [(r.url, r.depth) for r in catalogue.crawl_bfs(spark, str(tmp_path)).orderBy("depth").collect()] == [(i, k) for k, i in enumerate(ids)]


def test_derived_markdown_and_pages_hold_whole_texts(spark, tmp_path):
    texts = ["one\ntwo\n\nthree", "", "\nx", "only", "a\r\nb `c`\n~~~\nd", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.md for r in catalogue._fenced(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        first, _, rest = (text or "").replace("`", "").replace("~", "").partition("\n")
        assert got[i] == f"---\ndoc: {i}\n---\n# T\n\n```text\n{first}\n```\n\n{rest}\n\n~~~sql\nselect {i} as x\n~~~\n"
    pages = [(5, "https://a.example/x", "<p>the swagger of this site</p>"), (7, "https://a.example/y", "<p>nothing</p>"), (8, "https://a.example/z", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id for r in catalogue.spec_discovery(spark, str(tmp_path)).collect()} == {5, 8}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("region nation customer supplier part orders lineitem events documents pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    said = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in said.description]
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect())
    assert got == sorted(tuple(map(plain, r)) for r in said.fetchall())


def test_python_gets_texts_in_small_batches(spark):
    """However many texts a partition has, a worker holds about a megabyte of them."""
    from loomspark.functions import batches
    from loomspark.parsing import markdown

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("0123456789"), 1000).alias("md"))
    df.select(markdown.code_blocks_of(F.col("md")))

    @F.pandas_udf("long")
    def size(texts):
        return texts.str.len().sum() + texts.str.len() * 0

    assert df.select(size("md").alias("n")).agg(F.max("n")).first()[0] < 2 * batches.BYTES
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "3m")
    sections.split_level(df, "id", "md")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "3m"  # what a session has chosen stays
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_a_page_is_read_once_for_its_tags(spark):
    """The expressions over the page are made once, not once for each word that a tag may be."""
    plan = catalogue.page_tags(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<h1[^>]*>") <= 2 and "lambdafunction" not in plan.split("(?is)<h1")[0].rsplit("\n", 1)[-1]


def test_every_python_step_of_a_bundle_gets_small_batches(spark, tmp_path, monkeypatch):
    """From pages and markdown to the checks of the files: a worker is given about a megabyte at once, however many texts a partition has."""
    from loomspark import api
    from loomspark.functions import batches

    folder, make, rows = str(tmp_path), F.pandas_udf, type(spark.range(1)).mapInArrow

    def noted(step, batch):
        parts = batch if isinstance(batch, tuple) else (batch,)
        n = batch.nbytes if hasattr(batch, "schema") else sum(len(x) for p in parts for x in p if isinstance(x, str))
        with open(f"{folder}/{step}", "a") as f:
            f.write(f"{n}\n")
        return batch

    def watched(run):
        step = f"{run.__module__}.{run.__qualname__.split('.')[0]}"

        @functools.wraps(run)
        def over(given):
            return run((noted(step, b) for b in given) if isinstance(given, Iterator) else noted(step, given))

        return over

    monkeypatch.setattr(F, "pandas_udf", lambda kind: lambda run: make(kind)(watched(run)))
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, run, kind: rows(df, watched(run), kind))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    text, i = F.repeat(F.lit("Words of a page. "), 1200), F.col("id").cast("string")
    page = F.concat(F.lit("<html><body><article><h1>Page "), i, F.lit("</h1><p>"), text, F.lit("</p></article></body></html>"))
    file = F.concat(F.lit("---\ntype: Guide\n---\n# File "), i, F.lit("\n\n[next](x.md) "), text)
    docs = spark.range(0, 1200, 1, 4).select(
        F.col("id").alias("doc_ord"), F.lit("s").alias("source_id"), F.lit("url").alias("source_type"), F.concat(F.lit("https://h.example/a/"), i).alias("url"),
        F.when(F.col("id") % 2 == 0, page).alias("html"), F.when(F.col("id") % 2 == 1, file).alias("markdown"),
    )
    assert api.generate(docs, as_of="2024-05-01").report().first().valid
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    given = {p.name: [int(n) for n in p.read_text().split()] for p in tmp_path.iterdir()}
    parsing = "loomspark.parsing"
    assert set(given) == {f"{parsing}.pages.nodes", f"{parsing}.markdown.markdown_of", f"{parsing}.markdown.absolute_links_of", f"{parsing}.markdown.code_blocks_of", "loomspark.operators.sections._outlined", "loomspark.operators.front.read"}
    assert {step: max(sizes) for step, sizes in given.items() if max(sizes) >= 2 * batches.BYTES} == {}
    assert sum(given[f"{parsing}.pages.nodes"]) > 8 * batches.BYTES  # what would have been too much at once
