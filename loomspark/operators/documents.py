"""Pages and markdown documents as concepts: the row shapes that bundle assembly works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import classify, text, url
from loomspark.functions.classify import TAG_WORDS
from loomspark.operators import front, graph, structure
from loomspark.parsing import markdown as M



def page_title(html: Column) -> Column:
    """Text of the first h1, else the title element without its site part; entities decoded, trimmed."""
    heading = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    title = F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s*\|.*$", "")
    found = F.when(F.trim(F.regexp_replace(heading, "<[^>]*>", "")) != "", F.regexp_replace(heading, "<[^>]*>", "")).otherwise(title)
    return F.trim(text.decode_entities(found))


def page_description(html: Column) -> Column:
    """The meta description, else the first article paragraph of over 20 characters up to its first full stop."""
    meta = F.regexp_extract(html, r'(?is)<meta name="description" content="([^"]*)"', 1)
    article = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    first = F.regexp_extract(article, r"(?is)<p>(.*?)(?:<p>|</p>|<h[1-6]|$)", 1)
    first = F.trim(F.regexp_replace(text.decode_entities(F.regexp_replace(first, "<[^>]*>", "")), r"[ \t\n\r]+", " "))
    said = F.when(F.length(first) > 20, F.concat(F.substring_index(first, ".", 1), F.lit("."))).otherwise("")
    return F.when(meta != "", text.decode_entities(meta)).otherwise(said)


def page_concepts(table: DataFrame) -> DataFrame:
    """(page_id, url, title, section, source_id, slug, folder) of each page; a null html or url gives the defaults.

    Section and folder come from the URL; the slug is that of the path's last part without its ending, else of the title.
    """
    title = page_title(F.coalesce("html", F.lit("")))
    section = F.coalesce(url.url_section(F.col("url")), F.lit("General"))
    parts = url.path_parts(F.col("url"))
    last = F.when(F.size(parts) > 0, F.regexp_replace(F.element_at(F.when(F.size(parts) > 0, parts), -1), r"(?i)\.(html?|mdx?|markdown)$", ""))
    df = table.select("page_id", "url", title.alias("title"), section.alias("section"), url.source_id(F.col("url")).alias("source_id"), last.alias("last"))
    df = df.withColumn("slug", F.when(F.col("last").isNotNull(), text.slug("last")).otherwise(text.truncate_slug(text.slug("title")))).drop("last")
    return df.withColumn("folder", classify.folder(F.col("section"), F.col("slug")))


def tags(title: Column, description: Column, section: Column) -> Column:
    """The section's slug, then the fixed words that the title has as a word or the description anywhere; each once."""
    words = F.split(F.lower(title), r"[\s,–—\(\):;]+")
    # No loop over the words: the optimizer copies what it finds once, as in a loop's body, and title and description would be read from the page for each word.
    found = F.array_compact(F.array(*(F.when(F.array_contains(words, w) | F.contains(F.lower(description), F.lit(w)), F.lit(w)) for w in TAG_WORDS)))
    return F.array_distinct(F.concat(F.array(F.regexp_replace(F.lower(section), "[^a-z0-9]+", "-")), found))


def resolve_paths(concepts: DataFrame, key: str) -> DataFrame:
    """Adds `path`, free of collisions, as if the concepts chose one after the other, by `key`.

    A concept takes the first free one of: its plain name, the name with its source's, the same with 2, 3, ... at the end.
    `index` and `log` are reserved for the bundle's own files. concepts: key (unique), folder, slug, source_id.

    All choose at once, and of those that meet on a path all but the first move on, until none meet: as everyone prefers
    earlier names and every path earlier concepts, this ends where the choice in order does. The n-th concept of one folder,
    name and source cannot have an earlier than its n-th choice, so it begins there and keeps its distance from the ones
    before it. Only narrow rows take part.
    """
    group = ["folder", "slug", "source_id"]
    own = concepts.select(key, *(F.coalesce(c, F.lit("")).alias(c) for c in group))
    state = graph.grouped_ranks(own, group, key, "turn").withColumn("turn", F.col("turn") + F.col("slug").isin("index", "log").cast("int"))
    name = F.when(F.col("turn") == 0, F.col("slug")).when(F.col("turn") == 1, F.concat_ws("-", "slug", "source_id")).otherwise(F.concat_ws("-", "slug", "source_id", F.col("turn").cast("string")))
    path = F.concat(F.when(F.col("folder") == "", "").otherwise(F.concat("folder", F.lit("/"))), name, F.lit(".md"))
    while True:
        placed = state.withColumn("path", path)
        # One write a round: whether a concept lost its path to an earlier one.
        placed = graph.cut_lineage(placed.withColumn("lost", F.col(key) != F.min(key).over(Window.partitionBy("path"))))
        touched = placed.where("lost").select(*group).distinct()
        if touched.isEmpty():
            break
        moved = placed.withColumn("turn", F.col("turn") + F.col("lost").cast("int")).select(key, *group, "turn")
        inside = Window.partitionBy(*group).orderBy(key)
        again = moved.join(touched, group, "left_semi").withColumn("at", F.row_number().over(inside))
        again = again.withColumn("turn", F.max(F.col("turn") - F.col("at")).over(inside) + F.col("at")).drop("at")
        state = moved.join(touched, group, "left_anti").unionByName(again)
    return concepts.join(placed.select(key, "path"), key)


#: What a document may say about itself beside its text, and the types.
SAID = {"html": "string", "markdown": "string", "section": "string", "is_root": "boolean", "title": "string", "description": "string", "type": "string", "tags": "array<string>", "author": "string", "site": "string", "last_modified": "string", "slug_hint": "string", "source_type": "string", "splittable": "boolean", "link_root": "string", "absolute_links": "boolean"}
#: Characters of a description.
DESCRIPTION = 400


def parse_documents(docs: DataFrame, key: str, as_of: str) -> DataFrame:
    """(key, source_id, source_type, url, section, is_root, slug_hint, splittable, title, description, type, tags, author, site, last_modified, body, extra).

    docs: key, source_id, url, html or markdown and any of SAID. What the source says of a document counts before what its
    front matter says, this before what is found in its text. Relative links of markdown become absolute, unless
    `absolute_links` is false. Of a document without any date, `as_of` is the date. A first heading that repeats the title goes.
    `extra` has the lines of the front matter's keys that a bundle does not write itself.
    """
    for name, kind in SAID.items():
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    some = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    df = docs.withColumn("is_md", F.col("markdown").isNotNull()).withColumn("fm", front.read(F.col("markdown")))
    read = structure.parse_pages(docs.where("markdown is null").select(key, "url", "html"), as_of, key, content=False)
    df = df.join(read.select(key, F.struct(*(c for c in read.columns if c != key)).alias("p")), key, "left")
    df = df.withColumn("body", F.when(F.col("is_md"), M.absolute_links_of(F.col("fm.body"), F.when(F.coalesce("absolute_links", F.lit(True)), F.col("url")), F.col("link_root"))).otherwise(M.markdown_of(F.col("html"))))
    df = graph.cut_lineage(df.drop("html", "markdown"))
    values = F.col("fm.values")
    said = lambda *keys: F.when(F.col("is_md"), F.coalesce(*(some(F.get_json_object(values, f"$.{k}")) for k in keys)))
    page = lambda field: F.when(~F.col("is_md"), some(F.col(f"p.{field}")))
    heading = some(text.strip_markdown(F.regexp_extract("body", r"(?m)^ {0,3}#\s+(.*?)\s*#*\s*$", 1)))
    of_path = text.title_from_path("url")
    title = F.coalesce(some(F.col("title")), some(text.strip_markdown(said("title"))), page("title"), heading, of_path)
    listed = F.coalesce(F.get_json_object(values, "$.tags"), F.get_json_object(values, "$.keywords"))
    listed = F.when(F.startswith(listed, F.lit("[")), F.from_json(listed, "array<string>")).otherwise(F.split(listed, ","))
    none = F.array().cast("array<string>")
    df = df.withColumn("title", title).withColumn("section", F.coalesce(some(F.col("section")), said("section"), page("section"), F.lit("General")))
    tags = F.concat(F.when(F.col("is_md"), F.concat(F.coalesce(listed, none), F.array(F.regexp_replace(F.lower("section"), "[^a-z0-9]+", "-")))).otherwise(F.coalesce("p.tags", none)), F.coalesce("tags", none))
    tags = F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: F.coalesce(t, F.lit("")) != ""))
    about = F.coalesce(some(F.col("description")), some(F.left(text.strip_markdown(F.coalesce(said("description", "summary"), F.when(F.col("is_md"), text.first_paragraph("body")))), F.lit(DESCRIPTION))), page("description"), F.concat("title", F.lit(" documentation.")))
    body = F.trim(F.regexp_replace("body", r"^\s+|\s+$", ""))
    first = F.regexp_extract(body, r"^ {0,3}#\s+(.*?)\s*(?:\n|$)", 1)
    body = F.when(F.col("is_md") & (first != "") & (text.strip_markdown(first) == F.col("title")), F.regexp_replace(body, r"^[^\n]*\n*\s*", "")).otherwise(body)
    return df.select(
        key, "source_id", "source_type", "url", "section", "is_root", "slug_hint", F.coalesce("splittable", F.lit(True)).alias("splittable"), "title", about.alias("description"),
        F.coalesce(some(F.col("type")), said("type"), classify.concept_type(F.col("title"))).alias("type"), tags.alias("tags"), F.coalesce(some(F.col("author")), said("author"), page("author"), F.lit("Documentation Team")).alias("author"),
        F.coalesce(some(F.col("site")), said("site_name"), page("site")).alias("site"), F.substring_index(F.coalesce(some(F.col("last_modified")), said("last_modified", "date"), page("last_modified"), F.lit(as_of)), "T", 1).alias("last_modified"), body.alias("body"),
        F.when(F.col("is_md"), front.extensions(F.try_parse_json(values))).alias("extra"),
    )


def md_docs(documents: DataFrame) -> DataFrame:
    """(doc_id, url, title, markdown) derived from plain documents: each line becomes a section of its own."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.lit("## Part "), (i + 1).cast("string"), F.lit("\n\n"), x))
    body = F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.array_join(lines, "\n\n"))
    return documents.select("doc_id", F.concat(F.lit("https://corpus.example/"), F.coalesce("source", F.lit("none")), F.lit("/doc-"), F.col("doc_id").cast("string")).alias("url"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), body.alias("markdown"))
