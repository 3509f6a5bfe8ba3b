"""Fetching, listings and crawls against a server on this machine: redirects, errors, slow and large answers, pages of a listing."""

import json
import threading
import time
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from loomspark import api
from loomspark.operators import graph
from loomspark.sources import http, registry

N = 300
FAST = http.Client(timeout=1.5, delay=0.0, most=200_000)


def links_of(i):
    return [k for k in (2 * i + 1, 2 * i + 2, i // 3) if k < N]


class Site(BaseHTTPRequestHandler):
    seen: Counter = Counter()
    times: list = []

    def log_message(self, *args):
        pass

    def answer(self, status, body=b"", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        try:
            self.wfile.write(body)
        except BrokenPipeError:  # who asked has gone
            pass

    def do_GET(self):
        at = urllib.parse.urlsplit(self.path)
        Site.seen[self.path] += 1
        Site.times.append(time.monotonic())
        parts = at.path.strip("/").split("/")
        asked = urllib.parse.parse_qs(at.query)
        if parts[0] == "docs" and parts[1].isdigit():
            i = int(parts[1])
            if i % 10 == 7:
                return self.answer(404)
            if i % 10 == 3 and not asked:
                return self.answer(302, Location=f"/docs/{i}?moved=1")
            inner = "".join(f"<h2>S{k % 4}</h2><a href='{k}'>to</a>" for k in links_of(i))
            return self.answer(200, f"<html><body><article><h1>P{i}</h1>{inner}<a href='/other/x'>out</a><a href='/docs/pic.png'>pic</a></article></body></html>".encode(), Content_Type="text/html")
        if parts[0] == "round":
            return self.answer(302, Location="/round")
        if parts[0] == "slow":
            time.sleep(4)
        if parts[0] == "big":
            return self.answer(200, b"x" * 300_000)
        if parts[0] == "file":
            return self.answer(302, Location="file:///etc/hostname")
        if parts[0] == "limited":
            return self.answer(429)
        if parts[0] == "repos":
            if self.headers.get("Authorization") != "Bearer t":
                return self.answer(403)
            body = {"default_branch": "trunk"} if len(parts) == 3 else {"tree": [{"type": "blob", "path": "README.md"}, {"type": "tree", "path": "docs"}, {"type": "blob", "path": "docs/é.md"}, {"type": "blob"}, 7]}
            return self.answer(200, json.dumps(body).encode()) if len(parts) == 3 or parts[-1] == "trunk" else self.answer(404)
        if parts[0] == "projects":
            if len(parts) == 2:
                return self.answer(200, b'{"default_branch": "main"}')
            page, size = int(asked["page"][0]), int(asked["per_page"][0])
            if page == 3:
                return self.answer(500)
            rows = [{"type": "blob", "path": f"d/{k}.md"} for k in range((page - 1) * size, min(page * size, 47))]
            return self.answer(200, json.dumps(rows).encode(), **({"X_Total_Pages": "5"} if "counted" in parts[1] else {}))
        if parts[0] == "raw":
            return self.answer(200, f"# File {'/'.join(parts[4:])}".encode()) if parts[3] == "trunk" else self.answer(404)
        if parts[-1] == "guide.md":
            return self.answer(200, "---\ntitle: Guide\n---\n# Guide\n\nSee [more](more.md).".encode())
        if parts[-1] == "api.json":
            return self.answer(200, SPEC.encode())
        if parts[0] == "console":
            return self.answer(200, b"<html><body>swagger-ui <script>const ui = {url: '/v1/api.json'}</script></body></html>")
        return self.answer(200, b"fine")


SPEC = '{"swagger":"2.0","info":{"title":"Things"},"paths":{"/a":{"get":{"summary":"List"}}},"definitions":{"M":{"properties":{"x":{"type":"string"}}}}}'


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_answers_and_errors(spark, site):
    paths = ["/docs/1", "/docs/13", "/docs/7", "/round", "/slow", "/big", "/file", "/limited", "/plain"]
    rows = [(site + p,) for p in paths] + [(site + "/plain",), ("ftp://x.example/a",), ("no address",), (None,), ("http://127.0.0.1:9/none",)]
    got = {r.url: r for r in http.fetch(spark.createDataFrame(rows, "url string"), FAST).collect()}
    assert len(got) == len(paths) + 4
    of = lambda p: got[site + p]
    assert of("/docs/1").status == 200 and b"P1" in of("/docs/1").body and of("/docs/1").content_type == "text/html"
    assert of("/docs/13").final_url.endswith("moved=1") and of("/docs/13").error is None
    assert of("/docs/7").error.startswith("HTTP 404: not found") and of("/limited").error.startswith("HTTP 429: the rate limit")
    assert of("/round").error.startswith("HTTP 302") and "timed out" in of("/slow").error and of("/big").error == "answer is too large" and of("/file").error == "HTTP 302"
    assert got["ftp://x.example/a"].error == got["no address"].error == got[None].error == "no http(s) address" and "refused" in got["http://127.0.0.1:9/none"].error
    assert http.fetch(spark.createDataFrame([], "url string"), FAST).count() == 0


def test_many_pages_each_asked_once(spark, site):
    Site.seen.clear()
    rows = [(f"{site}/docs/{i % N}?moved=1&k={i}",) for i in range(1000)]
    got = http.fetch(spark.createDataFrame(rows, "url string").repartition(7), FAST)
    assert got.count() == 1000 and got.where("error is not null").count() == 100
    assert set(Site.seen.values()) == {1} and len(Site.seen) == 1000


def test_a_host_is_asked_at_its_pace(spark, site):
    Site.times.clear()
    http.fetch(spark.createDataFrame([(f"{site}/plain?{k}",) for k in range(8)], "url string").repartition(4), FAST._replace(delay=0.15))
    assert min(b - a for a, b in zip(Site.times, Site.times[1:])) > 0.1


def test_listings(spark, site):
    whole = http.listing(spark, site, "o/r", token="t").collect()
    assert {(r.ref, r.path) for r in whole} == {("trunk", "README.md"), ("trunk", "docs/é.md")}
    assert [r.error for r in http.listing(spark, site, "o/r").collect()] == ["HTTP 403: no permission, or the rate limit is reached: give a token or wait"]
    assert http.listing(spark, site, "o/r", token="t", ref="gone").first().error.startswith("HTTP 404")
    for name, pages in (("o/counted", 5), ("o/open", 6)):
        df = http.listing(spark, site, name, paged="true", perPage="10", maxPages="6")
        assert {r.path for r in df.where("error is null").collect()} == {f"d/{k}.md" for k in range(47) if k // 10 != 2}
        assert [r.error for r in df.where("error is not null").collect()] == ["HTTP 500"]
        reader = http.ListingReader({"api": site, "repository": name, "paged": "true", "perPage": "10", "maxPages": "6"})
        assert len(reader.partitions()) == pages


def test_a_crawl_is_that_of_the_link_graph(spark, site):
    seeds = spark.createDataFrame([(f"{site}/docs/0", 0), (f"{site}/docs/5", 1)], "url string, ord long")
    pages, errors = http.crawl(spark, seeds, max_pages=60, max_depth=3, client=FAST)
    at = lambda i: f"{site}/docs/{i}"
    edges = spark.createDataFrame([(at(i), at(k), pos, f"S{k % 4}") for i in range(N) for pos, k in enumerate(links_of(i))], "src string, dst string, pos int, section string")
    known = spark.createDataFrame([(at(i),) for i in range(N) if i % 10 != 7], "url string")
    want = {r.url: (r.depth, r.section) for r in graph.crawl(edges, seeds.selectExpr("url", "ord", "'Overview' section"), known, max_depth=3).collect()}
    got = {r.url: (r.depth, r.section) for r in pages.collect()}
    assert got == want and len(got) > 12
    reached = {at(k) for i in range(N) if at(i) in got and got[at(i)][0] < 3 for k in links_of(i)}
    assert {r.url for r in errors.collect()} == {at(i) for i in range(N) if i % 10 == 7 and at(i) in reached} and errors.first().error.startswith("HTTP 404")
    few, _ = http.crawl(spark, seeds, max_pages=5, max_depth=3, client=FAST)
    order = [r.url for r in graph.crawl(edges, seeds, known, max_depth=3, max_pages=5).orderBy("ord").collect()]
    assert [r.url for r in few.orderBy("ord").collect()] == order


def test_ingest_of_addresses_and_texts(spark, site, tmp_path):
    (tmp_path / "local.txt").write_text("a local text")
    options = registry.Options(max_pages=3, max_depth=1, client=FAST, token="t", apis={"github": (site, f"{site}/raw")})
    inputs = [f"{site}/docs/0", f"{site}/guide.md", f"{site}/v1/api.json", f"{site}/console/", "https://github.com/o/r", "# Typed\n\nA text.", SPEC, str(tmp_path / "local.txt"), f"{site}/docs/7", "git@example.org:a/b.git", f"{site}/none.json", "/no/such/folder"]
    docs, sources, errors = api.ingest(spark, inputs, options=options)
    got = {r.ord: (r.source_type, r.documents) for r in sources.collect()}
    assert got == {0: ("webpage", 3), 1: ("markdown", 1), 2: ("openapi", 2), 3: ("openapi", 2), 4: ("git", 2), 5: ("markdown", 1), 6: ("openapi", 2), 7: ("upload", 1)}
    bad = {r.source: r.error for r in errors.collect()}
    assert set(bad) == {f"{site}/docs/7", "git@example.org:a/b.git", f"{site}/none.json", "/no/such/folder"}
    assert "HTTP 404" in bad[f"{site}/docs/7"] and "known host" in bad["git@example.org:a/b.git"] and "no specification" in bad[f"{site}/none.json"]
    assert [r.url for r in docs.where("source_type = 'git'").orderBy("url").collect()] == ["https://github.com/o/r/blob/trunk/README.md", "https://github.com/o/r/blob/trunk/docs/é.md"]
    made = api.generate(docs, "2024-05-01")
    assert made.report().first().valid
    with pytest.raises(ValueError, match="no source gave"):
        api.ingest(spark, [f"{site}/none.json"], options=options)
