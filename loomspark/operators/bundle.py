"""Bundle assembly: root election, URL dictionary, link rewrite, indexes, summary, and the files themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import text, url

#: Concepts of a folder that the root index lists.
ROOT_ENTRIES = 12
_LINK = r"\[([^\]]+)\]\(([^)]+)\)"


def url_dictionary(concepts: DataFrame, key: str) -> DataFrame:
    """(url, key_ord, path): both forms of each concept's URL, with and without a trailing slash; the last concept's path counts, the first one's place."""
    forms = concepts.where("url is not null and url != ''").select(key, "path", F.explode(F.array_distinct(F.array("url", F.regexp_replace("url", "/$", "")))).alias("url"))
    return forms.groupBy("url").agg(F.min(key).alias("key_ord"), F.max_by("path", key).alias("path"))


def extract_links(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, label, href) of each markdown link."""
    c = F.coalesce(column, F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(c, F.lit(_LINK), F.lit(1)).alias("label"), F.regexp_extract_all(c, F.lit(_LINK), F.lit(2)).alias("href"))
    return docs.select(key, F.posexplode(both).alias("pos", "l")).select(key, "pos", "l.label", "l.href")


def rewrite_links(links: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """(key, pos, href, target): the bundle path of each link, its fragment kept; null where no concept matches.

    Of the dictionary's entries, in order, the first counts whose URL is the link without fragment, or whose path ends the
    link. Ends are joined by equality: every end of the link that begins at a slash is a key. An entry without a path
    (a site's root) matches as a whole only. If none matches, a root-relative link is looked up by its path alone.
    """
    base = F.regexp_replace(F.substring_index("href", "#", 1), "/$", "")
    df = links.select(key, "pos", "href", base.alias("base"), F.when(F.contains("href", F.lit("#")), F.substring_index(F.substring_index("href", "#", 2), "#", -1)).alias("hash"))
    entries = dictionary.select(F.regexp_replace("url", "/$", "").alias("norm"), "key_ord", "path", F.col("url").alias("exact"))
    entries = entries.withColumn("tail", F.regexp_replace("norm", "(?i)^https?://[^/]+", "")).withColumn("where", url.path(F.col("exact")))
    whole = df.join(entries, F.col("base") == F.col("norm")).select(key, "pos", "key_ord", "path", F.lit(0).alias("turn"))
    parts = F.split("href", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/")))
    tails = df.where(F.contains("href", F.lit("/"))).select(key, "pos", F.explode(ends).alias("tail"))
    tails = tails.join(entries.where("tail like '/%'"), "tail").select(key, "pos", "key_ord", "path", F.lit(0).alias("turn"))
    rooted = df.where("href like '/%'").join(entries, (F.col("where") == F.substring_index("href", "#", 1))).select(key, "pos", "key_ord", "path", F.lit(1).alias("turn"))
    best = whole.unionByName(tails).unionByName(rooted).groupBy(key, "pos").agg(F.min_by("path", F.struct("turn", "key_ord")).alias("path"))
    out = df.join(best, [key, "pos"], "left")
    mark = F.when(F.coalesce("hash", F.lit("")) != "", F.concat(F.lit("#"), "hash")).otherwise("")
    return out.select(key, "pos", "href", F.concat(F.lit("/"), "path", mark).alias("target"))


def elect_root(concepts: DataFrame, key: str) -> DataFrame:
    """Adds `is_root`: the first concept, by `key`, that wants to be the root."""
    first = concepts.where("wants_root").agg(F.min(key).alias("root"))
    return concepts.join(F.broadcast(first)).withColumn("is_root", F.coalesce(F.col(key) == F.col("root"), F.lit(False))).drop("root")  # one row


def folder_index(concepts: DataFrame, key: str) -> DataFrame:
    """(folder, n, body): each folder's list of concepts, in order, as markdown."""
    line = F.concat(F.lit("* ["), F.col("title"), F.lit("](/"), F.col("path"), F.lit(")"))
    lines = concepts.where("folder != ''").withColumn("line", line)
    return lines.groupBy("folder").agg(F.count("*").alias("n"), text.string_agg("line", "\n", key).alias("body"))


def root_index(concepts: DataFrame, key: str, entries: int = ROOT_ENTRIES) -> DataFrame:
    """(folder, pos, line): the first `entries` concepts of each folder, then a line that says how many more there are."""
    inside = Window.partitionBy("folder").orderBy(key)
    df = concepts.select("folder", "title", "path", F.row_number().over(inside).alias("pos"))  # each task keeps `entries` a folder
    shown = df.where(F.col("pos") <= entries).select("folder", "pos", F.concat(F.lit("* ["), "title", F.lit("](/"), "path", F.lit(")")).alias("line"))
    more = concepts.groupBy("folder").agg(F.count("*").alias("n")).where(F.col("n") > entries)
    more = more.select("folder", F.lit(entries + 1).alias("pos"), F.concat(F.lit("* …and "), (F.col("n") - entries).cast("string"), F.lit(" more")).alias("line"))
    return shown.unionByName(more)


def summary(concepts: DataFrame) -> DataFrame:
    """(concepts, folders, sources, folder_list): one row about a bundle."""
    folders = F.array_join(F.sort_array(F.collect_set(F.when(F.col("folder") != "", F.col("folder")))), ",")
    return concepts.agg(F.count("*").alias("concepts"), F.count_distinct(F.when(F.col("folder") != "", F.col("folder"))).alias("folders"), F.count_distinct("source_id").alias("sources"), folders.alias("folder_list"))


def listing(files: DataFrame) -> DataFrame:
    """The files as a reader lists them: the root index, the log, then by path."""
    return files.orderBy(F.when(F.col("path") == "index.md", 0).when(F.col("path") == "log.md", 1).otherwise(2), "path")


def search(files: DataFrame, part: str) -> DataFrame:
    """The files whose path holds `part`, in any case."""
    return files.where(F.contains(F.lower("path"), F.lit(part.lower())))


def footnote_id(title: str) -> Column:
    """The id of a concept's source."""
    return F.concat(F.lit("src-"), F.left(text.slug(title), F.lit(20)))


#: Tags of a concept that has none (fixed values of the format's producer).
DEFAULT_TAGS = ("documentation", "cloud")
_OPTIONAL = {"tags": "array<string>", "author": "string", "last_modified": "string", "tip": "string", "extra": "string"}


def _quote(c: Column) -> Column:
    said = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")
    return F.concat(F.lit('"'), F.replace(F.replace(said, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def concept_files(concepts: DataFrame, as_of: str, actor: str) -> DataFrame:
    """(path, content) of concepts: front matter, heading, body, footnote of its source; a `tip` stands before the body, `extra` lines below the front matter's own."""
    for name, kind in _OPTIONAL.items():
        if name not in concepts.columns:
            concepts = concepts.withColumn(name, F.lit(None).cast(kind))
    sid = footnote_id("title")
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.col("tags")).otherwise(F.array(*map(F.lit, DEFAULT_TAGS)))
    author = F.coalesce("author", F.lit("Documentation Team"))
    about = F.coalesce(F.nullif("description", F.lit("")), F.concat("title", F.lit(" reference documentation.")))
    front = F.concat(
        F.lit("---\ntype: "), F.coalesce("type", F.lit("Guide")), F.lit("\ntitle: "), _quote(F.col("title")), F.lit("\ndescription: "), _quote(about), F.lit("\nresource: "), _quote(F.col("url")), F.lit("\ntags: ["), F.array_join(F.transform(tags, _quote), ", "),
        F.lit(f"]\nstatus: stable\ngenerated:\n  by: {actor}\n  at: {as_of}\nverified:\n  by: process:crawler\n  at: {as_of}\nsources:\n  - id: "), sid, F.lit("\n    resource: "), _quote(F.col("url")), F.lit("\n    title: "), _quote(F.col("title")), F.lit("\n    author: "), _quote(author),
        F.lit("\n    last_modified: "), _quote(F.coalesce("last_modified", F.lit(as_of))), F.lit("\n"), F.coalesce("extra", F.lit("")), F.lit("---\n\n# "), "title", F.lit("\n\n"),
    )
    note = F.concat(F.lit("\n\n---\n\n[^"), sid, F.lit("]: ["), "title", F.lit("]("), F.coalesce("url", F.lit("")), F.lit(") - "), author, F.lit("\n"))
    return concepts.select("path", F.concat(front, F.coalesce("tip", F.lit("")), F.coalesce("body", F.lit("")), note).alias("content"))


def headline(concepts: DataFrame, key: str) -> DataFrame:
    """(title, description): one row; what a bundle is called: its root concept, else the first one."""
    first = F.min_by(F.struct("title", F.coalesce("description", F.lit("")).alias("description")), F.struct(F.col("folder") != "", key)).alias("h")
    found = concepts.agg(first)
    return found.select(F.coalesce("h.title", F.lit("Open Knowledge Bundle")).alias("title"), F.coalesce(F.nullif("h.description", F.lit("")), F.lit("Curated knowledge bundle automatically generated from documentation.")).alias("description"))


def bundle_files(concepts: DataFrame, key: str, as_of: str, actor: str = "process:loomspark", overviews: DataFrame | None = None, computations: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(path, content) of a bundle: concepts with front matter and a footnote, folder indexes, the root index and the log.

    concepts: key, path, folder, title, url, description, type, body and any of tags, author, last_modified, tip, extra. overviews:
    folder, title, body, resource: what a folder's index says instead of the usual words. computations: key, path, title,
    content: files of the folder `computations`. sources: ord, name, url, label, n. `as_of` is the date of the log and of
    `generated`. The root index lists the first ROOT_ENTRIES concepts of a folder and says how many more there are.
    """
    spark = concepts.sparkSession
    if overviews is None:
        overviews = spark.createDataFrame([], "folder string, title string, body string, resource string")
    if computations is None:
        computations = spark.createDataFrame([], "key long, path string, title string, content string")
    if sources is None:
        sources = spark.createDataFrame([], "ord long, name string, url string, label string, n long")
    files = concept_files(concepts, as_of, actor).unionByName(computations.select("path", "content"))
    rows = concepts.select("folder", F.struct(F.lit(0).alias("late"), F.col(key).cast("long").alias("key")).alias("at"), "title", "path", F.coalesce(F.nullif("description", F.lit("")), "title").alias("about"))
    rows = rows.unionByName(computations.select(F.lit("computations").alias("folder"), F.struct(F.lit(1).alias("late"), F.col("key").cast("long").alias("key")).alias("at"), "title", "path", F.lit("Sanctioned executable computation.").alias("about")))
    line = F.concat(F.lit("* ["), "title", F.lit("](/"), "path", F.lit(") - "), F.regexp_replace("about", r"[\r\n]+", " "))
    rows = rows.withColumn("line", line)
    own = overviews.select("folder", F.col("title").alias("named"), F.col("body").alias("said"), "resource")
    named = F.coalesce("named", text.folder_title("folder"))
    head = F.concat(F.lit("# "), named, F.lit("\n\n"), F.when(F.col("named").isNull(), F.concat(F.lit("This directory contains curated knowledge documents related to **"), text.folder_title("folder"), F.lit("**.\n\n"))).otherwise(F.concat(F.when(F.coalesce("said", F.lit("")) != "", F.concat("said", F.lit("\n\n"))).otherwise(""), F.when(F.coalesce("resource", F.lit("")) != "", F.concat(F.lit("Source: ["), "named", F.lit("]("), "resource", F.lit(")\n\n"))).otherwise(""))))
    lists = rows.where("folder != ''").groupBy("folder").agg(text.string_agg("line", "\n", "at").alias("body"))
    index = lists.join(own, "folder", "left").select(F.concat("folder", F.lit("/index.md")).alias("path"), F.concat(head, F.lit("## Concepts\n\n"), "body", F.lit("\n")).alias("content"))
    shown = rows.withColumn("pos", F.row_number().over(Window.partitionBy("folder").orderBy("at"))).where((F.col("pos") <= ROOT_ENTRIES) | (F.col("folder") == ""))
    parts = shown.groupBy("folder").agg(text.string_agg("line", "\n", "at").alias("body")).join(rows.groupBy("folder").agg(F.count("*").alias("n")), "folder").join(own, "folder", "left")
    more = F.when(F.col("n") > ROOT_ENTRIES, F.concat(F.lit("\n* …and "), (F.col("n") - ROOT_ENTRIES).cast("string"), F.lit(" more in ["), named, F.lit("](/"), "folder", F.lit("/index.md)."))).otherwise("")
    part = F.when(F.col("folder") == "", F.concat(F.lit("## Overview\n\n"), "body", F.lit("\n\n"))).otherwise(F.concat(F.lit("## "), F.when(F.col("folder") == "computations", "Attested Computations").otherwise(named), F.lit("\n\n* ["), named, F.lit(" Directory](/"), "folder", F.lit("/index.md) - Section overview and index.\n"), "body", more, F.lit("\n\n")))
    whole = parts.withColumn("part", part).agg(text.string_agg("part", "", "folder").alias("parts"))  # a part per folder
    origin = F.concat(F.lit("* "), F.when(F.col("url").rlike("(?i)^https?://"), F.concat(F.lit("["), "name", F.lit("]("), "url", F.lit(")"))).otherwise(F.concat(F.lit("`"), "name", F.lit("`"))), F.lit(" - "), "label", F.lit(", "), F.col("n").cast("string"), F.lit(" concept document(s)."))
    merged = sources.withColumn("line", origin).agg(F.count("*").alias("sources"), text.string_agg("line", "\n", "ord").alias("origins"))  # one row
    one = whole.crossJoin(headline(concepts, key)).crossJoin(merged).crossJoin(concepts.agg(F.count("*").alias("concepts"), F.count_distinct(F.nullif("folder", F.lit(""))).alias("folders"))).crossJoin(computations.agg(F.count("*").alias("made")))  # one row each
    roll = F.when(F.col("sources") > 1, F.concat(F.lit("## Sources\n\nThis bundle merges knowledge from "), F.col("sources").cast("string"), F.lit(" sources.\n\n"), "origins", F.lit("\n\n"))).otherwise("")
    root = F.concat(F.lit('---\nokf_version: "0.2"\n---\n\n# '), "title", F.lit("\n\n"), "description", F.lit("\n\n"), F.coalesce("parts", F.lit("")), roll)
    log = F.concat(F.lit(f"# Directory Update Log\n\n## {as_of}\n* **Creation**: Ingested documentation and generated the bundle\n* **Structure**: "), (F.col("concepts") + F.col("made")).cast("string"), F.lit(" concept documents in "), F.col("folders").cast("string"), F.lit(" folders\n"), F.when(F.col("sources") > 1, F.concat(F.lit("* **Sources**: Merged "), F.col("sources").cast("string"), F.lit(" sources\n"))).otherwise(""), F.lit(f"* **Verification**: Confirmed by `{actor}`\n"))
    both = one.select(F.explode(F.array(F.struct(F.lit("index.md").alias("path"), root.alias("content")), F.struct(F.lit("log.md").alias("path"), log.alias("content")))).alias("f")).select("f.*")
    return files.unionByName(index).unionByName(both)
