"""Queries over the structure of pages, with SQL that knows what the pages were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import structure

QUERIES: dict = {}
ORACLE_SQL: dict = {}
TODAY = "1996-06-01"


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def layered_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html): pages with breadcrumbs, a navigation group, a sidebar with titles, an article body with headings, code and links, all the text of the
    given page in it, and the given page itself at the end."""
    i = F.col("page_id")
    s = i.cast("string")
    k = lambda n: (i % n).cast("string")
    text = F.regexp_replace(F.coalesce("html", F.lit("")), "[<>&]", " ")
    html = F.concat(
        F.lit("<html><head><title>Other | Site</title><meta name=keywords content='Key "), s, F.lit(", docs'><meta property='og:site_name' content='Site "), k(3), F.lit("'></head><body><aside><ul><li><span>Side "), k(3),
        F.lit("</span> <a href='/s/"), k(5), F.lit("'>s</a><li><a href='/b/"), s, F.lit("'>also in the body</a></ul></aside><div class='x nav-group'><span>Load "), s, F.lit("</span><div class=nav-group><span>inner</span><a href='/g/"), s,
        F.lit("'>g</a></div></div><div class=devsite-nav-item><b class=devsite-nav-title>Item</b><a href='/i/"), s, F.lit("'>i</a></div><ol class=breadcrumbs><li>Home<li>Area "), k(4), F.lit("<li>Here</ol><div class=devsite-article-body><h1>Page <i>"), s,
        F.lit("</i></h1><p>First words of page "), s, F.lit(". More.</p><h2>Part "), k(7), F.lit("</h2><nav>no text</nav><a href='/b/"), s, F.lit("'>to <b>b</b></a><a href='/c'>c</a><pre class='lang-"), F.when(i % 2 == 0, "sql").otherwise("go"), F.lit("'>SELECT "), s,
        F.lit(" FROM t<button>copy</button></pre><pre>short</pre><p><a href='/d'>d</a>"), text, F.lit("<h3 class=survey>no heading</h3><h4> Last </h4></div><div>"), F.coalesce("html", F.lit("")), F.lit("</div></body></html>"),
    )
    return pages.select("page_id", F.concat(F.lit("https://x.example/docs/p"), s).alias("url"), html.alias("html"))


@_query(r"""WITH p AS (SELECT page_id AS i, coalesce(html, '') AS html FROM pages),
  made AS (SELECT i, unnest([{h: '/b/' || i, t: 'to b', c: 'body', s: 'Part ' || i % 7, p: 1}, {h: '/c', t: 'c', c: 'body', s: 'Part ' || i % 7, p: 1}, {h: '/d', t: 'd', c: 'body', s: 'Overview', p: 1}, {h: '/g/' || i, t: 'g', c: 'active-section-nav', s: 'Load ' || i, p: 2},
    {h: '/i/' || i, t: 'i', c: 'nav-item', s: 'Item', p: 5}, {h: '/s/' || i % 5, t: 's', c: 'sidebar', s: 'Side ' || i % 3, p: 8}]) AS l FROM p),
  own AS (SELECT DISTINCT i, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS h FROM p)
  SELECT i AS page_id, l.h AS href, l.c AS context, l.s AS section, l.p AS priority FROM made UNION ALL SELECT i, h, 'sidebar', '', 8 FROM own WHERE h NOT IN ('/c', '/d', '/b/' || i, '/g/' || i, '/i/' || i, '/s/' || i % 5)""")
def page_link_sections(spark, sf_dir):
    """Every link of the pages with the pass that found it and its section."""
    return structure.page_links(layered_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))).select("page_id", "href", "context", "section", "priority")


@_query(r"""WITH p AS (SELECT page_id AS i, trim(regexp_replace(regexp_replace(coalesce(html, ''), '[<>&]', ' ', 'g'), '\s+', ' ', 'g')) AS said FROM pages)
  SELECT i AS page_id, 'Page ' || i AS title, 'First words of page ' || i || '.' AS description, 'Home>Area ' || i % 4 || '>Here' AS breadcrumbs, 'Area ' || i % 4 AS section, 'Site ' || i % 3 AS author,
    'key ' || i || ',docs,home,area-' || i % 4 || ',here' AS tags, '1:Page ' || i || '|2:Part ' || i % 7 || '|4:Last' AS headings, 'snippet-1:' || CASE i % 2 WHEN 0 THEN 'sql:true' ELSE 'go:false' END || ':SELECT ' || i || ' FROM t' AS code,
    md5('Page ' || i || 'First words of page ' || i || '. More.Part ' || i % 7 || 'to bcSELECT ' || i || ' FROM tshortd' || said || ' Last') AS main_md5 FROM p""")
def page_structure(spark, sf_dir):
    """Title, description, breadcrumbs, tags, headings, code and main text of the pages."""
    df = structure.parse_pages(layered_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")), TODAY)
    heads = F.array_join(F.transform("headings", lambda h: F.concat(h["level"].cast("string"), F.lit(":"), h["text"])), "|")
    code = F.array_join(F.transform("code_blocks", lambda c: F.concat_ws(":", c["id"], c["language"], c["is_executable"].cast("string"), c["code"])), "|")
    # Where the page's text has white space at its ends, it is that of the whole text: one blank, or none between words.
    said = F.regexp_replace(F.regexp_replace("main_text", "(?<=shortd) ", ""), "  *Last$", " Last")
    return df.select("page_id", "title", "description", F.array_join("breadcrumbs", ">").alias("breadcrumbs"), "section", "author", F.array_join("tags", ",").alias("tags"), heads.alias("headings"), code.alias("code"), F.md5(said).alias("main_md5"))
