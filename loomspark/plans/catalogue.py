"""Registry of the engine's queries and of the SQL that checks them.

Every query reads the given tables, or rows that Spark derives from them, whole. The SQL is written for DuckDB and
shares no code with the Spark side but for fixed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark import api
from loomspark.functions import classify, text, url
from loomspark.operators import attest, bundle, computations, documents, front, graph, openapi, sections, structure, trust, validate
from loomspark.parsing import markdown
from loomspark.sources import readers

QUERIES: dict = {}
ORACLE_SQL: dict = {}
TODAY = "1996-06-01"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over_cores(df: DataFrame) -> DataFrame:
    """Wide text rows of a single file over all cores; large tables have their own splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ---------------------------------------------------------------- SQL building blocks


def _slug(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(lower({x})), '[^A-Za-z0-9_ \\t\\n\\r\\f\\v-]', '', 'g'), '[ \\t\\n\\r\\f\\v_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item')"


def _cut(x: str) -> str:
    return f"CASE WHEN length({x}) <= 60 THEN {x} ELSE regexp_replace(CASE WHEN strpos(reverse(left({x}, 60)), '-') > 0 AND 60 - strpos(reverse(left({x}, 60)), '-') > 30 THEN left({x}, 60 - strpos(reverse(left({x}, 60)), '-')) ELSE left({x}, 60) END, '-+$', '') END"


def _decoded(x: str) -> str:
    for name, sign in text.ENTITIES:
        x = f"replace({x}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return x


_ORIGIN = "lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1))"
_PATH = "regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1)"
_HOST = f"regexp_replace(regexp_replace({_ORIGIN}, '^https?://', ''), ':[0-9]+$', '')"
_PARTS = f"list_filter(string_split({_PATH}, '/'), lambda p: p <> '')"
_TITLE = "trim(" + _decoded("regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')") + ")"
_SOURCE = _slug(f"CASE WHEN len({_PARTS}) > 0 THEN regexp_replace({_HOST}, '^www\\.', '') || '-' || ({_PARTS})[1] ELSE regexp_replace({_HOST}, '^www\\.', '') END")
_SECTION = f"coalesce(regexp_replace(CASE WHEN len({_PARTS}) >= 2 THEN ({_PARTS})[len({_PARTS}) - 1] END, '[-_]', ' ', 'g'), 'General')"
_FOLDER = f"""CASE WHEN lower(section) NOT IN ('', 'general', 'overview') THEN {_slug('section')} WHEN contains(slug, 'migrat') THEN 'migrate-data'
  WHEN contains(slug, 'load') OR contains(slug, 'transfer') OR contains(slug, 'storage') THEN 'load-data'
  WHEN contains(slug, 'dataform') OR contains(slug, 'pipeline') OR contains(slug, 'prep') THEN 'transform-data'
  WHEN contains(slug, 'reverse-etl') OR contains(slug, 'extract') THEN 'export-data' ELSE 'guides' END"""
_CONCEPTS = f"""c0 AS (SELECT page_id, url, {_TITLE} AS title, {_SECTION} AS section, {_SOURCE} AS source_id,
    CASE WHEN len({_PARTS}) > 0 THEN {_slug(f"regexp_replace(({_PARTS})[-1], '(?i)\\.(html?|mdx?|markdown)$', '')")} ELSE {_cut(_slug(_TITLE))} END AS slug FROM pages),
  c1 AS (SELECT *, {_FOLDER} AS folder FROM c0),
  c2 AS (SELECT *, row_number() OVER (PARTITION BY folder, slug ORDER BY page_id) + CASE WHEN slug IN ('index', 'log') THEN 1 ELSE 0 END AS n FROM c1),
  c3 AS (SELECT *, row_number() OVER (PARTITION BY folder, slug, source_id, n > 1 ORDER BY page_id) AS m FROM c2),
  concepts AS (SELECT page_id, url, title, section, source_id, slug, folder, CASE WHEN folder = '' THEN '' ELSE folder || '/' END ||
    CASE WHEN n = 1 THEN slug WHEN m = 1 THEN slug || '-' || source_id ELSE slug || '-' || source_id || '-' || m END || '.md' AS path FROM c3)"""


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _over_cores(_read(spark, sf_dir, "pages"))
    return graph.cut_lineage(documents.resolve_paths(documents.page_concepts(pages), "page_id"))


# ---------------------------------------------------------------- pages and URLs


@_query(f"SELECT page_id, {_TITLE} AS title, {_slug(_TITLE)} AS slug FROM pages")
def page_title_slug(spark, sf_dir):
    title = documents.page_title(F.col("html"))
    return _over_cores(_read(spark, sf_dir, "pages")).select("page_id", title.alias("title")).withColumn("slug", text.slug("title"))


@_query(f"""SELECT page_id, {_ORIGIN} || CASE WHEN {_PATH} IN ('', '/') THEN '/' ELSE regexp_replace({_PATH}, '/$', '') END ||
  CASE WHEN regexp_matches(q, '[?&]hl(=|&|$)') THEN CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END WHEN q = '?' THEN '' ELSE q END AS normalized
  FROM (SELECT *, regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS q, list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^hl(=|$)')) AS k FROM pages)""")
def page_normalized_url(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", url.normalize_url(F.col("url")).alias("normalized"))


@_query(f"SELECT page_id, {_SOURCE} AS source_id, {_SECTION} AS section FROM pages")
def page_source_id(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", url.source_id(F.col("url")).alias("source_id"), F.coalesce(url.url_section(F.col("url")), F.lit("General")).alias("section"))


def _links(spark, sf_dir):
    """(page_id, url, pos, href, target): all anchors of the pages, resolved."""
    pages = _over_cores(_read(spark, sf_dir, "pages"))
    hrefs = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return hrefs.withColumn("target", url.normalize_url(url.resolve_url(F.col("href"), F.col("url"))))


_LINKS = f"""l0 AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
  links AS (SELECT page_id, url, pos, href, {_ORIGIN} || CASE WHEN regexp_extract(href, '^([^?#]*)', 1) = '/' THEN '/' ELSE regexp_replace(regexp_extract(href, '^([^?#]*)', 1), '/$', '') END AS target FROM l0 WHERE href LIKE '/%')"""


@_query(f"WITH {_LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, href, target FROM links")
def page_links(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", "href", "target")


@_query(f"""WITH {_LINKS}, seeds AS (SELECT DISTINCT {_ORIGIN} AS origin FROM pages WHERE page_id % 3 = 0)
  SELECT page_id, CAST(pos AS INTEGER) AS pos, target FROM links WHERE regexp_extract(target, '^(https?://[^/?#]+)', 1) IN (SELECT origin FROM seeds)
  AND NOT regexp_matches(lower(regexp_extract(target, '^https?://[^/?#]+([^?#]*)', 1)), '({'|'.join(e.replace('.', chr(92) + '.') for e in url.ASSET_ENDINGS)})$')""")
def link_scope_semijoin(spark, sf_dir):
    # Every third page is a seed, in domain scope: an equality of origins, so the semi-join needs no broadcast.
    seeds = _read(spark, sf_dir, "pages").where("page_id % 3 = 0").select(url.origin(F.col("url")).alias("origin")).distinct()
    links = _links(spark, sf_dir).withColumn("origin", url.origin(F.col("target")))
    return links.where(url.in_scope(F.col("target"), F.col("target"), "domain")).join(seeds, "origin", "left_semi").select("page_id", "pos", "target")


@_query(f"""WITH {_LINKS}, r AS (SELECT *, CASE WHEN contains(lower(href), 'en') THEN 2 ELSE 5 END AS priority FROM links),
  d AS (SELECT *, row_number() OVER (PARTITION BY page_id, target ORDER BY priority, pos) AS n FROM r)
  SELECT page_id, target, CAST(priority AS INTEGER) AS priority, CAST(row_number() OVER (PARTITION BY page_id ORDER BY priority, pos) AS INTEGER) AS ord FROM d WHERE n = 1""")
def link_priority_dedupe(spark, sf_dir):
    # Navigation links: groups that hold the word go first, a link counts in the first pass that has it.
    df = _links(spark, sf_dir).withColumn("priority", F.when(F.contains(F.lower("href"), F.lit("en")), 2).otherwise(5))
    best = df.groupBy("page_id", "target").agg(F.min(F.struct("priority", "pos")).alias("at"))
    return best.select("page_id", "target", "at.priority", F.row_number().over(Window.partitionBy("page_id").orderBy("at")).alias("ord"))


_FIRST_P = "trim(regexp_replace(" + _decoded("regexp_replace(regexp_extract(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '(?s)<p>(.*?)(?:<p>|</p>|<h[1-6]|$)', 1), '<[^>]*>', '', 'g')") + ", '[ \\t\\n\\r]+', ' ', 'g'))"
_DESCRIPTION = f"CASE WHEN length({_FIRST_P}) > 20 THEN string_split({_FIRST_P}, '.')[1] || '.' ELSE '' END"


@_query(f"SELECT page_id, {_DESCRIPTION} AS description FROM pages")
def page_description(spark, sf_dir):
    return _over_cores(_read(spark, sf_dir, "pages")).select("page_id", documents.page_description(F.col("html")).alias("description"))


@_query(f"""SELECT page_id, array_to_string(list_concat([regexp_replace(lower(section), '[^a-z0-9]+', '-', 'g')], list_filter([{', '.join(repr(w) for w in documents.TAG_WORDS)}],
  lambda w: (list_contains(string_split_regex(lower(title), '[\\s,–—\\(\\):;]+'), w) OR contains(lower(description), w)) AND w <> regexp_replace(lower(section), '[^a-z0-9]+', '-', 'g'))), ',') AS tags
  FROM (SELECT page_id, {_TITLE} AS title, {_SECTION} AS section, {_DESCRIPTION} AS description FROM pages)""")
def page_tags(spark, sf_dir):
    df = _over_cores(_read(spark, sf_dir, "pages")).select("page_id", documents.page_title(F.col("html")).alias("title"), documents.page_description(F.col("html")).alias("description"), F.coalesce(url.url_section(F.col("url")), F.lit("General")).alias("section"))
    return df.select("page_id", F.array_join(documents.tags(F.col("title"), F.col("description"), F.col("section")), ",").alias("tags"))


@_query(f"""SELECT page_id, CASE WHEN regexp_matches(v, '(?i)\\.git$') THEN 'git' WHEN regexp_matches(p, '(?i)\\.(md|mdx|markdown)$') THEN 'markdown'
  WHEN regexp_matches(p, '(?i)\\.(json|ya?ml)$') OR regexp_matches(p, '(?i)(openapi|swagger|api-docs)') THEN 'openapi' ELSE 'webpage' END AS source_type
  FROM (SELECT page_id, v, regexp_extract(v, '(?i)^https?://[^/?#]+([^?#]*)', 1) AS p FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '^([^?#]*)', 1) || '.md' WHEN 1 THEN regexp_extract(url, '^([^?#]*)', 1) || '/openapi'
    WHEN 2 THEN regexp_extract(url, '^([^?#]*)', 1) || '.git' WHEN 3 THEN regexp_extract(url, '^([^?#]*)', 1) || '.yaml' ELSE url END AS v FROM pages))""")
def source_type_detect(spark, sf_dir):
    plain = F.regexp_extract("url", "^([^?#]*)", 1)
    kind = F.col("page_id") % 5
    v = F.when(kind == 0, F.concat(plain, F.lit(".md"))).when(kind == 1, F.concat(plain, F.lit("/openapi"))).when(kind == 2, F.concat(plain, F.lit(".git"))).when(kind == 3, F.concat(plain, F.lit(".yaml"))).otherwise(F.col("url"))
    return _read(spark, sf_dir, "pages").select("page_id", classify.source_type(v).alias("source_type"))


@_query(f"""SELECT page_id, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS source_id FROM (SELECT page_id, s, row_number() OVER (PARTITION BY s ORDER BY page_id) AS n FROM (SELECT page_id, {_SOURCE} AS s FROM pages))""")
def source_id_uniquify(spark, sf_dir):
    df = _read(spark, sf_dir, "pages").select("page_id", url.source_id(F.col("url")).alias("s"))
    n = F.row_number().over(Window.partitionBy("s").orderBy("page_id"))
    return df.withColumn("n", n).select("page_id", F.when(F.col("n") == 1, F.col("s")).otherwise(F.concat("s", F.lit("-"), F.col("n").cast("string"))).alias("source_id"))


_REPO = "(SELECT doc_id, source, CASE doc_id % 6 WHEN 0 THEN 'docs/guide/d' || doc_id || '.md' WHEN 1 THEN 'src/README.md' WHEN 2 THEN 'api/openapi-' || doc_id || '.yaml' WHEN 3 THEN 'node_modules/x/d' || doc_id || '.md' WHEN 4 THEN 'lib/code' || doc_id || '.py' ELSE 'notes/my_notes/d' || doc_id || '.mdx' END AS p FROM documents)"


@_query(f"""SELECT source, p AS path, CAST(rank AS INTEGER) AS rank, section, CAST(n AS INTEGER) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, p, doc_id) AS n FROM
  (SELECT doc_id, source, p, CASE WHEN regexp_matches(p, '(?i)^docs?/') THEN 1 WHEN regexp_matches(p, '(?i)(^|/)(openapi|swagger)[^/]*\\.(json|ya?ml)$') THEN 2 WHEN regexp_matches(p, '(?i)readme\\.mdx?$') THEN 3 ELSE 4 END AS rank,
   CASE WHEN regexp_matches(p, '(?i)^docs?/') THEN CASE WHEN len(string_split(p, '/')) > 2 THEN regexp_replace(string_split(p, '/')[2], '[-_]+', ' ', 'g') ELSE 'Documentation' END ELSE regexp_replace(string_split(p, '/')[-2], '[-_]+', ' ', 'g') END AS section
   FROM {_REPO} WHERE NOT regexp_matches(p, '(?i)(^|/)(node_modules|vendor|\\.git|dist|build)/') AND (regexp_matches(p, '(?i)\\.mdx?$') OR regexp_matches(p, '(?i)(^|/)(openapi|swagger)[^/]*\\.(json|ya?ml)$')))) WHERE n <= 100""")
def repo_path_topk(spark, sf_dir):
    """The first hundred files of each repository, here each source of documents: the connector's own limit."""
    d, k = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    p = F.when(k == 0, F.concat(F.lit("docs/guide/d"), d, F.lit(".md"))).when(k == 1, "src/README.md").when(k == 2, F.concat(F.lit("api/openapi-"), d, F.lit(".yaml"))).when(k == 3, F.concat(F.lit("node_modules/x/d"), d, F.lit(".md")))
    p = p.when(k == 4, F.concat(F.lit("lib/code"), d, F.lit(".py"))).otherwise(F.concat(F.lit("notes/my_notes/d"), d, F.lit(".mdx")))
    df = _read(spark, sf_dir, "documents").select("doc_id", "source", p.alias("path")).where(classify.is_ingestible(F.col("path")))
    df = df.withColumn("rank", classify.repo_rank(F.col("path"))).withColumn("section", classify.repo_section(F.col("path")))
    return df.withColumn("ord", F.row_number().over(Window.partitionBy("source").orderBy("rank", "path", "doc_id"))).where("ord <= 100").drop("doc_id")


# ---------------------------------------------------------------- text and markdown


@_query("""SELECT doc_id, l AS language, l IN ('sql', 'python', 'bash', 'sh') AS executable FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)SELECT|FROM|WHERE|JOIN|GROUP BY|INSERT|UPDATE|CREATE TABLE') THEN 'sql'
  WHEN regexp_matches(text, '(?i)def |import |print\\(|class ') THEN 'python' WHEN regexp_matches(text, '(?i)bq |gcloud |curl |npm |git ') THEN 'bash'
  WHEN starts_with(text, '{') AND regexp_matches(text, '(?s)\\{.*\\}|\\[.*\\]') THEN 'json' WHEN regexp_matches(text, '(?m)^[a-zA-Z0-9_-]+:\\s+') THEN 'yaml' ELSE 'text' END AS l FROM documents)""")
def code_language(spark, sf_dir):
    df = _read(spark, sf_dir, "documents").select("doc_id", classify.code_language(F.col("text")).alias("language"))
    return df.withColumn("executable", classify.is_executable(F.col("language")))


@_query("""SELECT p_partkey, CASE WHEN contains(t, 'introduction') OR contains(t, 'overview') OR contains(t, 'concept') THEN 'Overview' WHEN contains(t, 'reference') OR contains(t, 'syntax') OR contains(t, 'schema') OR contains(t, 'api') THEN 'Reference'
  WHEN contains(t, 'how to') OR contains(t, 'step') OR contains(t, 'playbook') OR contains(t, 'triage') OR contains(t, 'incident') THEN 'Playbook' WHEN contains(t, 'table') OR contains(t, 'dataset') THEN 'BigQuery Table' ELSE 'Guide' END AS concept_type
  FROM (SELECT p_partkey, lower(p_name || ' ' || CASE p_partkey % 7 WHEN 0 THEN 'Overview' WHEN 1 THEN 'API' WHEN 2 THEN 'How To' WHEN 3 THEN 'Tables' ELSE '' END) AS t FROM part)""")
def concept_type(spark, sf_dir):
    k = F.col("p_partkey") % 7
    title = F.concat("p_name", F.lit(" "), F.when(k == 0, "Overview").when(k == 1, "API").when(k == 2, "How To").when(k == 3, "Tables").otherwise(""))
    return _read(spark, sf_dir, "part").select("p_partkey", classify.concept_type(title).alias("concept_type"))


_CLEAN = "trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[\\s*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '[*_`~]', '', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '[ \\t\\n\\r\\f\\v ]+', ' ', 'g'))"


@_query(f"""WITH b AS (SELECT doc_id, list_filter(list_transform(list_filter(list_transform(string_split_regex(text, '\\r?\\n\\s*\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|>|[-*+]\\s|[0-9]+\\.\\s|\\||`{{3,}}|~{{3,}}|---|<)')),
    lambda x: {_CLEAN.format('x')}), lambda x: length(x) > 20)[1] AS p FROM documents),
  s AS (SELECT doc_id, coalesce(p, '') AS p, regexp_extract(coalesce(p, ''), '^(.*?[.!?])(\\s|$)', 1) AS f FROM b), t AS (SELECT doc_id, trim(CASE WHEN f <> '' THEN f ELSE p END) AS s FROM s)
  SELECT doc_id, CASE WHEN length(s) > 300 THEN rtrim(left(s, 299)) || '…' ELSE s END AS sentence FROM t""")
def doc_first_sentence(spark, sf_dir):
    return _over_cores(_read(spark, sf_dir, "documents")).select("doc_id", text.first_sentence("text").alias("sentence"))


_MD = "md AS (SELECT doc_id, '# Document ' || doc_id || chr(10) || chr(10) || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: '## Part ' || i || chr(10) || chr(10) || x), chr(10) || chr(10)) AS markdown, 'Document ' || doc_id AS title, 'https://corpus.example/' || coalesce(source, 'none') || '/doc-' || doc_id AS url FROM documents)"
_PROSE = "length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '<[^>]*>', ' ', 'g'), 'https?://\\S+', ' ', 'g'), '(?m)^ {{0,3}}#{{1,6}}\\s+', '', 'g'), '[*_`~>|-]', ' ', 'g'), '[ \\t\\n\\r\\f\\v ]+', ' ', 'g')))"


@_query(f"WITH {_MD} SELECT doc_id, CAST({_PROSE.format('markdown')} AS INTEGER) AS prose FROM md")
def doc_prose_len(spark, sf_dir):
    return documents.md_docs(_over_cores(_read(spark, sf_dir, "documents"))).select("doc_id", text.prose_length("markdown").alias("prose"))


_HEADS = f"""{_MD}, ln AS (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS line_no FROM md),
  hd AS (SELECT doc_id, line_no, line, length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})\\s+(.*?)\\s*#*\\s*$', 1)) AS level, {_CLEAN.format("regexp_extract(line, '^ {0,3}(#{1,6})\\s+(.*?)\\s*#*\\s*$', 2)")} AS heading FROM ln WHERE regexp_matches(line, '^ {{0,3}}(#{{1,6}})\\s+(.*?)\\s*#*\\s*$'))"""


@_query(f"WITH {_HEADS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(level AS INTEGER) AS level, heading FROM hd WHERE heading <> ''")
def md_headings(spark, sf_dir):
    return sections.headings(documents.md_docs(_over_cores(_read(spark, sf_dir, "documents"))), "doc_id", "markdown").drop("raw")


@_query(f"WITH {_HEADS} SELECT doc_id, CAST(min(level) AS INTEGER) AS split_level FROM (SELECT doc_id, level FROM hd WHERE heading <> '' GROUP BY doc_id, level HAVING count(*) >= 3) GROUP BY doc_id")
def split_level(spark, sf_dir):
    return sections.split_level(documents.md_docs(_over_cores(_read(spark, sf_dir, "documents"))), "doc_id", "markdown")


_SPLIT = f"""{_MD}, parts AS (SELECT doc_id, i, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS body FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents) WHERE n >= 3),
  k AS (SELECT *, {_PROSE.format('body')} >= 100 AS kept FROM parts), g AS (SELECT *, sum(CAST(kept AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM k),
  w AS (SELECT doc_id, grp, string_agg(CASE WHEN kept THEN body WHEN body = '' THEN '## Part ' || i ELSE '## Part ' || i || chr(10) || chr(10) || body END, chr(10) || chr(10) ORDER BY i) AS body, max(CASE WHEN kept THEN 'Part ' || i END) AS title, max(CASE WHEN kept THEN 2 END) AS level FROM g GROUP BY doc_id, grp),
  x AS (SELECT doc_id, 0 AS grp, '# Document ' || doc_id AS body FROM documents), y AS (SELECT doc_id, max(grp) AS n FROM w GROUP BY doc_id),
  sections AS (SELECT w.doc_id, w.grp, w.title, w.level, w.body FROM w JOIN y USING (doc_id) WHERE n BETWEEN 3 AND 50 AND w.grp > 0)"""


@_query(f"WITH {_SPLIT} SELECT doc_id, CAST(grp AS INTEGER) AS sec_ord, title, CAST(level AS INTEGER) AS level, md5(body) AS body_md5 FROM sections")
def split_sections(spark, sf_dir):
    df = sections.split_sections(documents.md_docs(_over_cores(_read(spark, sf_dir, "documents"))), "doc_id", "markdown")
    return df.where("sec_ord > 0").select("doc_id", "sec_ord", "title", "level", F.md5("body").alias("body_md5"))


@_query(f"WITH {_SPLIT} SELECT doc_id, CAST(grp AS INTEGER) AS sec_ord, url || '#' || {_slug('s.title')} AS url, {_cut(_slug('s.title'))} AS slug, {_slug('md.title')} AS folder FROM sections s JOIN md USING (doc_id)")
def section_concepts(spark, sf_dir):
    docs = documents.md_docs(_over_cores(_read(spark, sf_dir, "documents")))
    return sections.section_concepts(sections.split_sections(docs, "doc_id", "markdown"), docs, "doc_id").select("doc_id", "sec_ord", "url", "slug", "folder")


# ---------------------------------------------------------------- bundles


@_query(f"WITH {_CONCEPTS} SELECT page_id, path, folder, slug, title FROM concepts")
def concept_paths(spark, sf_dir):
    return _concepts(spark, sf_dir).select("page_id", "path", "folder", "slug", "title")


@_query(f"WITH {_CONCEPTS}, f AS (SELECT DISTINCT page_id, path, u FROM (SELECT page_id, path, url AS u FROM concepts UNION ALL SELECT page_id, path, regexp_replace(url, '/$', '') FROM concepts)) SELECT u AS url, min(page_id) AS key_ord, max_by(path, page_id) AS path FROM f GROUP BY u")
def url_path_dictionary(spark, sf_dir):
    return bundle.url_dictionary(_concepts(spark, sf_dir), "page_id")


@_query(f"""WITH {_CONCEPTS}, n AS (SELECT count(*) AS n FROM pages), t AS (SELECT DISTINCT u AS url, path, page_id FROM (SELECT page_id, path, url AS u FROM concepts UNION ALL SELECT page_id, path, regexp_replace(url, '/$', '') FROM concepts)),
  d AS (SELECT url, min(page_id) AS key_ord, max_by(path, page_id) AS path FROM t GROUP BY url), e AS (SELECT *, regexp_replace(url, '/$', '') AS norm, regexp_replace(regexp_replace(url, '/$', ''), '(?i)^https?://[^/]+', '') AS tail FROM d),
  l AS (SELECT c.page_id, p.url || '#part' AS href FROM concepts c JOIN n ON true JOIN pages p ON p.page_id = (c.page_id * 7 + 3) % n.n),
  h AS (SELECT l.page_id, l.href, min_by(e.path, e.key_ord) AS path FROM l JOIN e ON regexp_replace(string_split(href, '#')[1], '/$', '') = norm OR (tail LIKE '/%' AND suffix(href, tail)) GROUP BY ALL)
  SELECT l.page_id, l.href, '/' || h.path || CASE WHEN string_split(l.href, '#')[2] <> '' THEN '#' || string_split(l.href, '#')[2] ELSE '' END AS target FROM l LEFT JOIN h USING (page_id, href)""")
def rewrite_links(spark, sf_dir):
    """A link of each page to another one, seven places on, as the bundle has it."""
    concepts = _concepts(spark, sf_dir)
    n = concepts.agg(F.count("*").alias("n"))
    to = concepts.crossJoin(F.broadcast(n)).select("page_id", ((F.col("page_id") * 7 + 3) % F.col("n")).alias("to"))  # one row
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("to"), F.concat(F.lit("[x]("), "url", F.lit("#part)")).alias("body"))
    links = bundle.extract_links(to.join(pages, "to"), "page_id", "body")
    return bundle.rewrite_links(links, bundle.url_dictionary(concepts, "page_id"), "page_id").select("page_id", "href", "target")


@_query(f"WITH {_CONCEPTS} SELECT page_id, page_id = (SELECT min(page_id) FROM concepts WHERE folder = 'guides' OR page_id % 4 = 1) AS is_root FROM concepts")
def root_election(spark, sf_dir):
    df = _concepts(spark, sf_dir).withColumn("wants_root", (F.col("folder") == "guides") | (F.col("page_id") % 4 == 1))
    return bundle.elect_root(df, "page_id").select("page_id", "is_root")


@_query(f"WITH {_CONCEPTS} SELECT folder, count(*) AS n, string_agg('* [' || title || '](/' || path || ')', chr(10) ORDER BY page_id) AS body FROM concepts WHERE folder <> '' GROUP BY folder")
def folder_index(spark, sf_dir):
    return bundle.folder_index(_concepts(spark, sf_dir), "page_id")


@_query(f"""WITH {_CONCEPTS}, r AS (SELECT folder, title, path, row_number() OVER (PARTITION BY folder ORDER BY page_id) AS pos FROM concepts)
  SELECT folder, CAST(pos AS INTEGER) AS pos, '* [' || title || '](/' || path || ')' AS line FROM r WHERE pos <= 12
  UNION ALL SELECT folder, 13, '* …and ' || (count(*) - 12) || ' more' FROM r GROUP BY folder HAVING count(*) > 12""")
def root_index_topn(spark, sf_dir):
    return bundle.root_index(_concepts(spark, sf_dir), "page_id")


@_query(f"WITH {_CONCEPTS} SELECT count(*) AS concepts, count(DISTINCT nullif(folder, '')) AS folders, count(DISTINCT source_id) AS sources, array_to_string(list_sort(list(DISTINCT folder) FILTER (WHERE folder <> '')), ',') AS folder_list FROM concepts")
def bundle_summary(spark, sf_dir):
    return bundle.summary(_concepts(spark, sf_dir))


def _generated(spark, sf_dir):
    """The files of a bundle made of all pages, from html to front matter and indexes."""
    table = _over_cores(_read(spark, sf_dir, "pages"))
    return api.generate(readers.pages(table, "doc_ord"), TODAY).files


_MADE = f"""{_CONCEPTS.replace('c1 AS (SELECT *, ' + _FOLDER + ' AS folder FROM c0)', "c1 AS (SELECT * REPLACE (CASE WHEN page_id = (SELECT min(page_id) FROM pages) THEN 'overview' ELSE slug END AS slug), CASE WHEN page_id = (SELECT min(page_id) FROM pages) THEN '' ELSE " + _FOLDER + " END AS folder FROM c0)")},
  made AS (SELECT path, 'concept' AS role FROM concepts UNION ALL SELECT DISTINCT folder || '/index.md', 'index' FROM concepts WHERE folder <> '' UNION ALL VALUES ('index.md', 'root_index'), ('log.md', 'log'))"""


@_query(f"WITH {_MADE} SELECT path, role FROM made")
def generated_bundle(spark, sf_dir):
    return _generated(spark, sf_dir).select("path", classify.file_role(F.col("path")).alias("role"))


@_query(f"WITH {_MADE} SELECT true AS valid, 0 AS errors, 0 AS warnings, sum(CASE role WHEN 'concept' THEN 7 WHEN 'index' THEN 1 WHEN 'log' THEN 2 ELSE 3 END) AS n_checks FROM made")
def generated_checks(spark, sf_dir):
    """A generated bundle passes every check: seven of each concept, one of each folder's index, three of the root index, two of the log."""
    return validate.report(validate.checks(_generated(spark, sf_dir)))


@_query(f"""WITH {_MADE} SELECT path AS id, title AS label, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS folder FROM concepts
  UNION ALL SELECT DISTINCT folder || '/index.md', 'index', folder FROM concepts WHERE folder <> '' UNION ALL VALUES ('index.md', 'Root Index', 'root')""")
def generated_nodes(spark, sf_dir):
    """The graph's nodes of a generated bundle, labelled by what the front matter of its files says."""
    return graph.nodes(_generated(spark, sf_dir)).select("id", "label", "folder")


@_query(f"""WITH {_MADE} SELECT path, 'stable' AS status, 'machineConfirmed' AS tier, '{TODAY}' AS generated_at, '{TODAY}' AS verified_at, url AS sources FROM concepts""")
def generated_provenance(spark, sf_dir):
    """Where each concept of a generated bundle comes from, and how far it can be trusted."""
    files = graph.cut_lineage(front.parsed(_generated(spark, sf_dir).where(classify.file_role(F.col("path")) == "concept")))
    made = trust.provenance(files).withColumn("sources", F.array_join("sources", " "))
    return trust.lifecycle(files, TODAY).select("path", "status", "tier").join(made, "path")


# ---------------------------------------------------------------- files: validation, graph, trust


def _files(spark, sf_dir):
    """Files of a bundle derived from `pages` by arithmetic on page_id: some without type, closing dashes, runtime or a source's resource; links to pages that may not exist."""
    i = F.col("page_id")
    name = lambda c: F.concat(F.lit("g"), (c % 10).cast("string"), F.lit("/p"), c.cast("string"), F.lit(".md"))
    kind = F.when(i % 7 == 0, "").when(i % 7 == 1, "Attested Computation").when(i % 7 == 2, "Overview").otherwise("Guide")
    extra = F.when(i % 14 == 1, "runtime: spark\n").otherwise("")
    verified = F.when(i % 3 == 0, "verified:\n  - by: human:ana\n").when(i % 3 == 1, "verified:\n  by: process:ci\n").otherwise("")
    cited = F.when(i % 5 == 0, "sources:\n  - id: s0\n    resource: x\n  - id: s1\n").when(i % 5 == 1, "sources: s0\n").otherwise("")
    front = F.concat(F.lit("---\ntype: "), kind, F.lit("\ntitle: \"Page "), i.cast("string"), F.lit("\"\n"), extra, verified, cited, F.when(i % 11 == 5, "").otherwise("---\n"))
    body = F.concat(F.lit("\nSee [a](/"), name(2 * i + 1), F.lit(") [b](./p"), (i + 10).cast("string"), F.lit(".md) [c](https://x.example/y.md) claim[^s"), (i % 4).cast("string"), F.lit("]\n"))
    pages = _read(spark, sf_dir, "pages").select("page_id")
    files = pages.select(name(i).alias("path"), F.concat(F.when(i % 13 == 6, "").otherwise(front), body).alias("content"))
    index = pages.select((i % 10).alias("g")).distinct().select(F.concat(F.lit("g"), F.col("g").cast("string"), F.lit("/index.md")).alias("path"), F.when(F.col("g") == 3, "---\nx: 1\n---\n").otherwise("# Index\n").alias("content"))
    top = pages.agg(F.count("*").alias("n")).select(F.explode(F.array(F.struct(F.lit("index.md").alias("path"), F.lit('---\nokf_version: "0.2"\n---\n# All\n').alias("content")), F.struct(F.lit("log.md").alias("path"), F.concat(F.lit("# Log\n\n## 2024-01-02\n* two\n* "), F.col("n").cast("string"), F.lit("\n\n## 2023-12-31\n* one\n")).alias("content")))).alias("f")).select("f.*")
    return files.unionByName(index).unionByName(top)


_NAME = "'g' || ({0}) % 10 || '/p' || ({0}) || '.md'"
_FILES = f"""p0 AS (SELECT page_id AS i FROM pages), files AS (SELECT {_NAME.format('i')} AS path, CASE WHEN i % 13 = 6 THEN '' ELSE '---' || chr(10) || 'type: ' || CASE i % 7 WHEN 0 THEN '' WHEN 1 THEN 'Attested Computation' WHEN 2 THEN 'Overview' ELSE 'Guide' END || chr(10) || 'title: "Page ' || i || '"' || chr(10) ||
    CASE WHEN i % 14 = 1 THEN 'runtime: spark' || chr(10) ELSE '' END || CASE WHEN i % 11 = 5 THEN '' ELSE '---' || chr(10) END END AS content, i, CASE WHEN i % 13 <> 6 AND i % 11 <> 5 THEN 1 ELSE 0 END AS closed FROM p0),
  raw AS (SELECT {_NAME.format('i')} AS source, unnest([{_NAME.format('2 * i + 1')}, 'g' || i % 10 || '/p' || (i + 10) || '.md', 'https://x.example/y.md']) AS target FROM p0),
  idx AS (SELECT DISTINCT i % 10 AS g FROM p0), known AS (SELECT path FROM files UNION ALL SELECT 'g' || g || '/index.md' FROM idx UNION ALL VALUES ('index.md'), ('log.md'))"""
_CHECKS = f"""{_FILES}, checks AS (SELECT path, 'front_matter_present' AS "check", 'error' AS severity, i % 13 <> 6 AS passed FROM files UNION ALL SELECT path, 'front_matter_closed', 'error', closed = 1 FROM files WHERE i % 13 <> 6
  UNION ALL SELECT path, c, 'error', true FROM files, (VALUES ('front_matter_parses'), ('front_matter_mapping')) v(c) WHERE closed = 1 UNION ALL SELECT path, 'sources_list', 'warning', i % 5 = 0 FROM files WHERE closed = 1 AND i % 5 < 2
  UNION ALL SELECT path, 'source_resource', 'warning', b FROM files, (VALUES (true), (false)) v(b) WHERE closed = 1 AND i % 5 = 0 UNION ALL SELECT path, 'type_present', 'error', i % 7 <> 0 FROM files WHERE closed = 1 UNION ALL SELECT path, 'runtime_present', 'error', i % 14 = 1 FROM files WHERE closed = 1 AND i % 7 = 1
  UNION ALL SELECT 'g' || g || '/index.md', 'index_without_front_matter', 'warning', g <> 3 FROM idx UNION ALL SELECT 'index.md', 'version', 'warning', true UNION ALL SELECT 'index.md', 'root_index_parses', 'error', true UNION ALL SELECT 'log.md', 'dated_log', 'warning', true
  UNION ALL SELECT 'index.md', 'root_index_exists', 'error', true UNION ALL SELECT 'log.md', 'log_exists', 'error', true)"""


@_query(f'WITH {_CHECKS} SELECT path, "check", severity, passed FROM checks')
def validate_checks(spark, sf_dir):
    return validate.checks(_files(spark, sf_dir))


@_query(f"WITH {_CHECKS} SELECT NOT coalesce(bool_or(NOT passed AND severity = 'error'), false) AS valid, count(*) FILTER (WHERE NOT passed AND severity = 'error') AS errors, count(*) FILTER (WHERE NOT passed AND severity = 'warning') AS warnings, count(*) AS n_checks FROM checks")
def validate_report(spark, sf_dir):
    return validate.report(validate.checks(_files(spark, sf_dir)))


@_query(f"WITH {_FILES} SELECT type, count(*) AS n FROM (SELECT CASE i % 7 WHEN 1 THEN 'Attested Computation' WHEN 2 THEN 'Overview' ELSE 'Guide' END AS type FROM files WHERE closed = 1 AND i % 7 <> 0) GROUP BY type")
def type_histogram(spark, sf_dir):
    return validate.type_histogram(_files(spark, sf_dir))


@_query(f"WITH {_FILES} SELECT tier, count(*) AS n FROM (SELECT CASE WHEN closed = 0 OR i % 3 = 2 THEN 'unverified' WHEN i % 3 = 0 THEN 'humanReviewed' ELSE 'machineConfirmed' END AS tier FROM files) GROUP BY tier")
def trust_summary(spark, sf_dir):
    concepts = _files(spark, sf_dir).where(classify.file_role(F.col("path")) == "concept")
    return validate.trust_summary(front.parsed(concepts).select(validate.verified_by().alias("verified_by")))


@_query(f"""WITH {_FILES} SELECT path AS id, CASE WHEN closed = 1 THEN 'Page ' || i ELSE 'p' || i END AS label, CASE WHEN closed = 0 OR i % 7 = 0 THEN 'Concept' WHEN i % 7 = 1 THEN 'Attested Computation' WHEN i % 7 = 2 THEN 'Overview' ELSE 'Guide' END AS type, 'g' || i % 10 AS folder FROM files
  UNION ALL SELECT 'g' || g || '/index.md', 'index', 'Index', 'g' || g FROM idx UNION ALL SELECT 'index.md', 'Root Index', 'Index', 'root'""")
def graph_nodes(spark, sf_dir):
    return graph.nodes(_files(spark, sf_dir))


@_query(f"""WITH {_FILES} SELECT source, target, 'link' AS type FROM raw JOIN known ON path = target WHERE source <> target UNION ALL SELECT 'g' || i % 10 || '/index.md', path, 'contains' FROM files UNION ALL SELECT 'index.md', 'g' || g || '/index.md', 'hierarchy' FROM idx""")
def graph_edges(spark, sf_dir):
    files = _files(spark, sf_dir)
    return graph.cross_links(files).unionByName(graph.hierarchy(files))


@_query(f"WITH {_FILES} SELECT source, target FROM raw WHERE target NOT LIKE 'https:%' AND target NOT IN (SELECT path FROM known)")
def broken_links(spark, sf_dir):
    return graph.broken_links(_files(spark, sf_dir))


@_query(f"WITH {_FILES} SELECT path, 's' || i % 4 AS label, i % 4 <> 3 AS resolved FROM files")
def footnote_attribution(spark, sf_dir):
    files = _files(spark, sf_dir).where(classify.file_role(F.col("path")) == "concept")
    sources = files.select("path", F.explode(F.array(F.lit("s0"), F.lit("s1"), F.lit("s2"))).alias("id"))
    return trust.footnotes(files, sources)


@_query(f"WITH {_FILES} SELECT path FROM known WHERE contains(lower(path), '/p1')")
def path_search(spark, sf_dir):
    return bundle.listing(bundle.search(_files(spark, sf_dir), "/P1")).select("path")


@_query("SELECT 'b' || event_id // 10 || '/log.md' AS path, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(k AS INTEGER) AS entry_no, CASE k WHEN 0 THEN '**' || event_type || '**' ELSE 'event ' || event_id END AS entry FROM events, (VALUES (0), (1)) v(k)")
def log_entries(spark, sf_dir):
    """A log for every ten events, each with its own date."""
    part = F.concat(F.lit("## "), F.col("ts").cast("date").cast("string"), F.lit("\n\n* **"), "event_type", F.lit("**\n* event "), F.col("event_id").cast("string"), F.lit("\n"))
    parts = _read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("b"), "event_id", part.alias("part"))
    logs = parts.groupBy("b").agg(text.string_agg("part", "\n", "event_id").alias("body"))
    return trust.log_entries(logs.select(F.concat(F.lit("b"), F.col("b").cast("string"), F.lit("/log.md")).alias("path"), F.concat(F.lit("# Log\n\n"), "body").alias("content")))


@_query("SELECT tag, count(*) AS n, min(doc_id) AS first FROM (SELECT DISTINCT doc_id, unnest([lang, source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END]) AS tag FROM documents) GROUP BY tag")
def tag_view(spark, sf_dir):
    df = _read(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source", F.when(F.col("n_chars") > 2000, "long").otherwise("short")).alias("tags"))
    return trust.tag_view(df, "doc_id")


@_query(f"SELECT o_orderkey, coalesce(CASE o_orderstatus WHEN 'O' THEN NULL ELSE o_orderstatus END, 'stable') AS status, coalesce(DATE '{TODAY}' >= CAST(o_orderdate AS DATE), false) AS stale FROM orders")
def stale_concepts(spark, sf_dir):
    df = _read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").cast("date").alias("stale_after"))
    return trust.staleness(df, TODAY).drop("stale_after")


@_query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END, w) AS \"window\" FROM events LEFT JOIN (SELECT user_id, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS w FROM events WHERE user_id % 2 = 0 GROUP BY user_id) USING (user_id)")
def usage_window_effective(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    own = events.select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("date").cast("string")).alias("own_window"))
    shared = events.where("user_id % 2 = 0").groupBy("user_id").agg(F.min(F.col("ts").cast("date")).cast("string").alias("shared_window"))
    return trust.effective_windows(own, shared, "user_id").select("event_id", "window")


_EDGES = "edges AS (SELECT page_id AS src, unnest([2 * page_id + 1, 2 * page_id + 2]) AS dst, unnest([0, 1]) AS pos FROM pages)"


def _edges(spark, sf_dir):
    i = F.col("page_id")
    return _read(spark, sf_dir, "pages").select(i.alias("src"), F.posexplode(F.array(2 * i + 1, 2 * i + 2)).alias("pos", "dst"))


@_query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT page_id AS start, page_id AS node, 0 AS depth FROM pages UNION ALL SELECT r.start, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node) SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY start, node")
def lineage_closure(spark, sf_dir):
    """What each page's sources lead to; a page is a source of two others."""
    starts = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("start"))
    return graph.closure(_edges(spark, sf_dir), starts)


@_query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT CAST(0 AS BIGINT) AS url, 0 AS depth UNION ALL SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.url) SELECT url, CAST(depth AS INTEGER) AS depth, url AS ord FROM r WHERE url IN (SELECT page_id FROM pages)")
def crawl_bfs(spark, sf_dir):
    """Breadth-first order from the first page over derived links; in a binary tree the place equals the id.

    Down to the last level that there is.
    """
    pages = _read(spark, sf_dir, "pages")
    seeds = pages.agg(F.min("page_id").alias("url")).withColumn("ord", F.lit(0))
    return graph.crawl(_edges(spark, sf_dir), seeds, pages.select(F.col("page_id").alias("url")), max_depth=None)


# ---------------------------------------------------------------- parsing inside Arrow batches


def _replaced(x: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        x = f"replace({x}, '{old}', {new})"
    return x


#: The article of a page, or, where it holds a hundred characters at most, the body without what a reader does not want.
_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_BODY = _replaced("regexp_replace(regexp_extract(html, '(?s)<body>(.*?)(?:</body>|$)', 1), '(?s)<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->', '', 'g')", ('<div class="ad">', "'<p>'"), ("<article>", "'<p>'"), ("</div>", "''"), ("</article>", "''"))
_CONTENT = f"CASE WHEN length(trim(regexp_replace({_ARTICLE}, '<[^>]*>', '', 'g'))) > 100 THEN {_ARTICLE} ELSE {_BODY} END"
_REFERENCES = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&quot;?', '\"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')"
_BREAK = "chr(10) || chr(10)"
_MARKED = _replaced(f"regexp_replace(regexp_replace({_CONTENT}, '([\\\\`*_\\[\\]])', '\\\\\\1', 'g'), '\\s+', ' ', 'g')", ("<h1>", f"{_BREAK} || '# '"), ("</h1>", _BREAK), ("<p>", _BREAK), ("</p>", _BREAK), ("<b>", "'**'"), ("<br>", "'  ' || chr(10)"))


@_query(f"SELECT page_id, trim(regexp_replace(regexp_replace({_REFERENCES.format(_MARKED)}, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', {_BREAK}, 'g'), ' ' || chr(9) || chr(10)) AS markdown FROM pages")
def html_to_markdown(spark, sf_dir):
    return _over_cores(_read(spark, sf_dir, "pages")).select("page_id", markdown.markdown_of(F.col("html")).alias("markdown"))


@_query(f"SELECT page_id, {_TITLE} AS title, {_SECTION} AS section, 'Documentation Team' AS author, '{TODAY}' AS last_modified, 1 AS n_headings, 0 AS n_blocks FROM pages")
def parse_html_struct(spark, sf_dir):
    df = structure.parse_pages(_read(spark, sf_dir, "pages"), TODAY)
    return df.select("page_id", "title", "section", "author", "last_modified", F.size("headings").alias("n_headings"), F.size("code_blocks").alias("n_blocks"))


_SAID = "trim(regexp_replace(" + _REFERENCES.format(f"regexp_replace({_CONTENT}, '<[^>]*>', '', 'g')") + ", '\\s+', ' ', 'g'))"


@_query(f"SELECT page_id, {_SAID} AS main_text, CAST(length({_SAID}) AS INTEGER) AS n_chars FROM pages")
def page_main_text(spark, sf_dir):
    return structure.parse_pages(_read(spark, sf_dir, "pages"), TODAY).select("page_id", "main_text", F.length("main_text").alias("n_chars"))


@_query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) SELECT DISTINCT page_id, href, 'sidebar' AS context, 8 AS priority FROM l""")
def page_link_candidates(spark, sf_dir):
    return structure.page_links(_read(spark, sf_dir, "pages")).select("page_id", "href", "context", "priority")


def _fenced(spark, sf_dir):
    """Documents with front matter and two fenced blocks, around their first line and behind the other ones; null texts are empty."""
    whole = F.regexp_replace(F.coalesce("text", F.lit("")), "[`~]", "")
    line = F.substring_index(whole, "\n", 1)
    rest = F.substr(whole, F.length(line) + 2)
    md = F.concat(F.lit("---\ndoc: "), F.col("doc_id").cast("string"), F.lit("\n---\n# T\n\n```text\n"), line, F.lit("\n```\n\n"), rest, F.lit("\n\n~~~sql\nselect "), F.col("doc_id").cast("string"), F.lit(" as x\n~~~\n"))
    return _over_cores(_read(spark, sf_dir, "documents")).select("doc_id", md.alias("md"))


_FIRST_LINE = "trim(regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '[`~]', '', 'g'), ' ' || chr(9) || chr(13))"


@_query(f"SELECT doc_id, CASE WHEN length({_FIRST_LINE}) > 10 THEN 2 ELSE 1 END AS n_blocks, 'select ' || doc_id || ' as x' AS last_code FROM documents")
def md_code_blocks(spark, sf_dir):
    df = _fenced(spark, sf_dir).select("doc_id", markdown.code_blocks_of(F.col("md")).alias("b"))
    return df.select("doc_id", F.size("b").alias("n_blocks"), F.element_at("b", -1)["code"].alias("last_code"))


@_query("SELECT doc_id, '{\"doc\": ' || doc_id || '}' AS \"values\", '# T' AS first_line FROM documents")
def md_frontmatter(spark, sf_dir):
    df = _fenced(spark, sf_dir).select("doc_id", front.read(F.col("md")).alias("f"))
    return df.select("doc_id", F.col("f.values"), F.substring_index("f.body", "\n", 1).alias("first_line"))


@_query(f"SELECT doc_id, CAST(CASE WHEN length({_FIRST_LINE}) > 10 THEN 1 ELSE 0 END AS INTEGER) AS block_no, 'select ' || doc_id || ' as x' AS code FROM documents")
def first_sql_block(spark, sf_dir):
    blocks = _fenced(spark, sf_dir).select("doc_id", markdown.code_blocks_of(F.col("md")).alias("blocks"))
    return computations.first_sql_block(blocks, "doc_id")


@_query(f"""SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/openapi.json' AS url FROM pages WHERE page_id % 2 = 0 AND regexp_extract(url, '^(https?://[^/?#]+)', 1) IN (SELECT {_ORIGIN} FROM pages WHERE page_id % 5 = 0)""")
def spec_discovery(spark, sf_dir):
    """Every second page speaks of a specification, whatever it holds besides; sites of every fifth page have one."""
    table = _read(spark, sf_dir, "pages")
    speaks = table.select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), F.when(F.col("page_id") % 2 == 0, " see our openapi pages").otherwise("")).alias("html"))
    corpus = table.where("page_id % 5 = 0").select(F.concat(url.origin(F.col("url")), F.lit("/openapi.json")).alias("url"), F.lit("{}").alias("json")).distinct()
    return computations.discover_specs(speaks, corpus).select("page_id", "url")


@_query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'url' WHEN 1 THEN 'bundle' WHEN 2 THEN 'relative' ELSE 'scope' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'process' WHEN 2 THEN 'producer' ELSE 'unknown' END AS actor FROM documents")
def field_kinds(spark, sf_dir):
    k, d = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    value = F.when(k == 0, F.concat(F.lit("https://x.example/"), d)).when(k == 1, F.concat(F.lit("/a/"), d, F.lit(".md"))).when(k == 2, F.concat(F.lit("./"), d, F.lit(".md"))).otherwise(F.concat(F.lit("scope"), d))
    actor = F.when(k == 0, F.concat(F.lit("human:"), d)).when(k == 1, F.concat(F.lit("process:"), d)).when(k == 2, F.concat(F.lit("acme/"), d)).otherwise(d)
    return _read(spark, sf_dir, "documents").select("doc_id", classify.resource_kind(value).alias("kind"), classify.actor_kind(actor).alias("actor"))


@_query("SELECT user_id, max(ts) AS verified_at, arg_max(event_type, (ts, event_id)) AS verified_by FROM events GROUP BY user_id")
def latest_verification(spark, sf_dir):
    """The latest of a concept's verifications; here each user's events."""
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("by"), F.col("ts").alias("at"))
    return trust.latest_verification(events, "user_id", "event_id")


# ---------------------------------------------------------------- API specifications


_API = """parts AS (SELECT p_brand || '/' || p_partkey // 1000 AS spec_id, p_brand, p_partkey AS k, p_name, p_type, p_size, string_split(p_type, ' ')[1] AS tag, replace(p_type, ' ', '') AS m, '/parts/' || p_partkey || '/{id}' AS path FROM part),
  ops AS (SELECT *, 'get' AS method, 'getpart' || k AS slug, p_name AS summary, p_name AS about FROM parts UNION ALL SELECT *, 'put', 'put-parts-' || k || '-id', 'Replaces a part.', 'Replaces a part.' || chr(10) || 'All of it.' FROM parts WHERE p_size % 3 = 0),
  models AS (SELECT DISTINCT spec_id, p_brand, m, p_type AS about FROM parts UNION ALL SELECT DISTINCT spec_id, p_brand, 'Base', '' FROM parts),
  props AS (SELECT spec_id, m AS model, p AS property, t AS type, r AS required, p = 'seen' AS read_only, o FROM models, (VALUES ('id', '`integer (int64)`', true, 0), ('seen', '`string`', false, 1), ('size', '`integer` - one of `1`, `2`, `3`, `4`, `5`, `6`, …', false, 2), ('name', '`string`', true, 3), ('like', 'array of [Base](/schemas/base.md)', false, 4)) v(p, t, r, o) WHERE m <> 'Base' OR o < 2)"""
_API_TEXT = """'**' || summary || '**' || n || n || CASE WHEN about <> summary THEN about || n || n ELSE '' END || '## Request Details' || n || n || '* **HTTP Method**: `' || upper(method) || '`' || n || '* **Endpoint Path**: `' || path || '`' || n || '* **Full URL**: `https://api.example/v1' || path || '`' || n
  || '* **Consumes**: `application/json`' || n || '* **Produces**: `application/json`' || n || n || CASE WHEN method = 'put' THEN '## Request Body' || n || n || '* **part** (required): [' || m || '](/schemas/' || lower(m) || '.md)' || n || n ELSE '' END
  || '## Parameters' || n || n || '| Parameter | In | Type | Required | Description |' || n || '| --- | --- | --- | --- | --- |' || n || '| `size` | query | `integer` | ' || CASE WHEN p_size % 2 = 0 THEN '**Yes**' ELSE 'No' END || ' | How large |' || n || CASE WHEN method = 'get' THEN '| `id` | path | `integer (int64)` | **Yes** | - |' || n ELSE '' END || n
  || '## Responses' || n || n || CASE WHEN method = 'get' THEN '| HTTP Status | Returns | Description |' || n || '| --- | --- | --- |' || n || '| `200` | [' || m || '](/schemas/' || lower(m) || '.md) | A part |' || n || '| `404` | - | None |' ELSE '| HTTP Status | Description |' || n || '| --- | --- |' || n || '| `204` | Done |' END || n || n
  || '## Code Examples' || n || n || '### cURL' || n || n || '```bash' || n || 'curl -X ' || upper(method) || ' "https://api.example/v1' || path || '" \\' || n || '  -H "Accept: application/json"' || n || '```' || n || n || '### Python (requests)' || n || n || '```python' || n || 'import requests' || n || n || 'url = "https://api.example/v1' || path || '"' || n
  || 'headers = {"Accept": "application/json"}' || n || n || 'response = requests.' || method || '(url, headers=headers)' || n || 'print(response.status_code)' || n || 'print(response.json())' || n || '```'"""
_API_DOCS = f"""{_API}, docs AS (SELECT spec_id, 'https://api.example/v1' || path AS url, tag AS section, slug, upper(method) || ' ' || path || ' - ' || summary AS title, summary AS description, 'API Endpoint' AS type, 'api,endpoint,' || lower(tag) AS tags, {_API_TEXT} AS markdown FROM ops, (SELECT chr(10) AS n)
  UNION ALL SELECT spec_id, NULL, 'Schemas', lower(m), m || ' Schema Model', CASE WHEN m = 'Base' THEN 'Base data model reference.' ELSE about END, 'Reference', 'api,schema,model,' || lower(m), CASE WHEN m = 'Base' THEN '' ELSE about || n || n || '**Composed of**: [Base](/schemas/base.md), `object`' || n || n END || '## Schema Properties' || n || n || '| Property | Type | Required | Description |' || n || '| --- | --- | --- | --- |' || n || t
  FROM models JOIN (SELECT spec_id, model AS m, string_agg('| `' || property || '` | ' || type || ' | ' || CASE WHEN required THEN '**Yes**' WHEN read_only THEN 'read-only' ELSE 'No' END || ' | - |', chr(10) ORDER BY o) AS t FROM props GROUP BY ALL) USING (spec_id, m), (SELECT chr(10) AS n))"""


def _specs(spark, sf_dir):
    return openapi.specs_of_parts(_read(spark, sf_dir, "part"))


@_query(f"WITH {_API} SELECT spec_id, tag, path, method, slug, summary FROM ops")
def openapi_endpoints(spark, sf_dir):
    return openapi.endpoints(_specs(spark, sf_dir)).select("spec_id", "tag", "path", "method", "slug", "summary")


@_query(f"""WITH {_API} SELECT spec_id, path, method, 0 AS param_no, 'size' AS name, 'query' AS place, p_size % 2 = 0 AS required, '`integer`' AS type, 'How large' AS description FROM ops
  UNION ALL SELECT spec_id, path, method, 1, 'id', 'path', true, '`integer (int64)`', '' FROM ops WHERE method = 'get' UNION ALL SELECT spec_id, path, method, 1, 'part', 'body', true, '[' || m || '](/schemas/' || lower(m) || '.md)', '' FROM ops WHERE method = 'put'""")
def openapi_params(spark, sf_dir):
    return openapi.parameters(_specs(spark, sf_dir))


@_query(f"""WITH {_API} SELECT spec_id, path, method, status, description, CASE WHEN status = '200' THEN '[' || m || '](/schemas/' || lower(m) || '.md)' ELSE '' END AS type FROM ops JOIN (VALUES ('get', '200', 'A part'), ('get', '404', 'None'), ('put', '204', 'Done')) v(method, status, description) USING (method)""")
def openapi_responses(spark, sf_dir):
    return openapi.responses(_specs(spark, sf_dir)).drop("no")


@_query(f"WITH {_API} SELECT spec_id, model, property, type, required, read_only FROM props")
def openapi_schema_props(spark, sf_dir):
    return openapi.schema_properties(_specs(spark, sf_dir)).drop("prop_no", "description")


@_query(f"WITH {_API_DOCS} SELECT * FROM docs")
def openapi_docs(spark, sf_dir):
    return openapi.documents(_specs(spark, sf_dir)).drop("ord").withColumn("tags", F.array_join("tags", ","))


@_query(f"""WITH {_API_DOCS}, paths AS (SELECT DISTINCT spec_id, CASE WHEN type = 'Reference' THEN 'schemas' ELSE lower(section) END AS folder, slug FROM docs)
  SELECT spec_id, folder || '/' || slug || '.md' AS path FROM paths UNION ALL SELECT DISTINCT spec_id, folder || '/index.md' FROM paths UNION ALL SELECT DISTINCT spec_id, unnest(['index.md', 'log.md']) FROM paths""")
def openapi_bundle_paths(spark, sf_dir):
    """The files of each specification's own bundle; their contents are `openapi_docs` under front matter."""
    return openapi.bundle(_specs(spark, sf_dir), TODAY).select("spec_id", "path")


# ---------------------------------------------------------------- attested computations

_REVENUE = "SELECT sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem_view WHERE l_shipdate >= CAST(:since AS timestamp) AND l_returnflag = :flag"
_RUNS = (("R", "1994-01-01"), ("A", "1995-01-01"), ("N", "1996-01-01"))


def _revenue(spark, sf_dir):
    """(name, bound_sql, actual): the contract's statement, bound and executed for each run."""
    _read(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem_view")
    out = None
    for flag, since in _RUNS:
        args = attest.bind(_REVENUE, {"since": True, "flag": True}, {"flag": flag, "since": since})
        row = attest.execute(spark, _REVENUE, args).select(F.lit(f"revenue-{flag}").alias("name"), F.lit(attest.bound_text(_REVENUE, args)).alias("bound_sql"), F.col("value").alias("actual"))
        out = row if out is None else out.unionByName(row)
    return graph.cut_lineage(out)  # a row per run; each statement is executed once


@_query("SELECT 'revenue-' || f AS name, round(sum(l_extendedprice * (1 - l_discount)) FILTER (WHERE l_shipdate >= CAST(s AS TIMESTAMP) AND l_returnflag = f), 2) AS actual FROM lineitem, (VALUES ('R', '1994-01-01'), ('A', '1995-01-01'), ('N', '1996-01-01')) v(f, s) GROUP BY f")
def attested_revenue(spark, sf_dir):
    return _revenue(spark, sf_dir).select("name", F.round("actual", 2).alias("actual"))


@_query("SELECT * FROM (VALUES ('revenue-R', 1, 'pass'), ('revenue-R', 2, 'sql_mismatch'), ('revenue-A', 1, 'value_mismatch'), ('revenue-A', 2, 'sql_mismatch'), ('revenue-N', 1, 'stale'), ('revenue-N', 2, 'sql_mismatch')) v(name, run_id, verdict)")
def attestation_verdicts(spark, sf_dir):
    again = _revenue(spark, sf_dir)
    wrong = F.when(F.col("name") == "revenue-A", F.col("actual") * 1.5).otherwise(F.col("actual"))
    receipts = again.select("name", F.explode(F.array(F.lit(1), F.lit(2))).alias("run_id"), F.col("bound_sql"), wrong.alias("value"))
    receipts = receipts.select("name", "run_id", F.when(F.col("run_id") == 1, F.col("bound_sql")).otherwise(F.concat("bound_sql", F.lit(" "))).alias("executed_sql"), "value")
    contracts = again.select("name", F.when(F.col("name") == "revenue-N", F.lit("1996-01-01")).otherwise(F.lit("2030-01-01")).cast("date").alias("stale_after"))
    return attest.verdicts(receipts, again, contracts, TODAY)
