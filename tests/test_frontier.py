"""A crawl as a stream: stopped and started again, it gives the pages of the crawl over the whole link graph."""

from pyspark.sql import functions as F

from loomspark.operators import graph
from loomspark.streaming import frontier

N = 60


def targets(i):
    return [k for k in (2 * i + 1, 2 * i + 2, i // 3, i) if k < N]


def at(i):
    return f"https://{'ab'[i % 2]}.example/docs/{i}"


def test_a_crawl_that_is_stopped_goes_on(spark, tmp_path):
    html = lambda i: "<article>" + "".join(f"<h2>S{k % 3}</h2><a href='{at(k)}#x'>l</a>" for k in targets(i)) + "</article>"
    table = spark.createDataFrame([(at(i), html(i)) for i in range(N) if i % 9 != 8], "url string, html string")
    asked = []

    def fetch(addresses):
        asked.extend(r.url for r in addresses.collect())
        return addresses.join(table, "url", "left").withColumn("error", F.when(F.col("html").isNull(), "HTTP 404"))

    seeds = spark.createDataFrame([(at(0), 0), (at(7), 1)], "url string, ord long")
    first = frontier.crawl(spark, str(tmp_path / "c"), seeds, fetch, max_depth=3, rounds=2)
    assert 0 < first.count() < N and {r.depth for r in first.collect()} == {0, 1}
    pages = frontier.crawl(spark, str(tmp_path / "c"), seeds, fetch, max_depth=3)
    assert len(asked) == len(set(asked)) == pages.count()

    edges = spark.createDataFrame([(at(i), at(k), pos, f"S{k % 3}") for i in range(N) for pos, k in enumerate(targets(i))], "src string, dst string, pos int, section string")
    want = graph.crawl(edges, seeds.withColumn("section", F.lit("Overview")), table.select("url"), max_depth=3, visited=True)
    assert {(r.url, r.depth, r.section, r.fetched) for r in want.collect()} == {(r.url, r.depth, r.section, r.error is None) for r in pages.collect()}
    order = [r.url for r in pages.orderBy("depth", "path").collect()]
    assert order == [r.url for r in want.orderBy("ord").collect()]
    again = frontier.crawl(spark, str(tmp_path / "c"), seeds, fetch, max_depth=3)
    assert again.count() == pages.count() == len(asked)


def test_links_out_of_scope_and_bad_seeds(spark, tmp_path):
    def fetch(addresses):
        return addresses.withColumn("html", F.lit("<main><a href='/in'>i</a><a href='https://else.example/x'>e</a><a href='mailto:x@y'>m</a></main>")).withColumn("error", F.when(F.col("url") == "nonsense", "no http(s) address"))

    seeds = spark.createDataFrame([("https://a.example/", 0), ("https://a.example/", 3), ("nonsense", 1)], "url string, ord long")
    pages = frontier.crawl(spark, str(tmp_path / "c"), seeds, fetch, max_depth=5, scope=lambda c: c.startswith("https://a.example/"))
    assert sorted((r.url, r.depth, r.error) for r in pages.collect()) == [("https://a.example/", 0, None), ("https://a.example/in", 1, None), ("nonsense", 0, "no http(s) address")]
