"""Sources by type: what a user names is told apart by `classify.source_type`, and each type has a reader for all inputs of it.

A reader takes inputs (src_ord, value) and gives (documents, errors): documents have src_ord beside readers.DOCUMENT, errors
src_ord and error. Pages that prove to be specifications, or name one, leave the crawl and are read as such.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import classify, text
from loomspark.functions import url as U
from loomspark.operators import computations, graph, openapi
from loomspark.sources import http, readers


@dataclass(frozen=True)
class Options:
    """Limits of crawls and listings, how to ask, and where the APIs of repository hosts are (host kind -> address; {host} stands for the name)."""

    max_files: int = 100
    max_pages: int = 25
    max_depth: int = 3
    scope: str = "subtree"
    client: http.Client = http.Client()
    token: str | None = None
    apis: dict = field(default_factory=lambda: {"github": ("https://api.{host}", "https://raw.githubusercontent.com"), "gitlab": ("https://{host}/api/v4", "")})


def typed(spark: SparkSession, values: list[str]) -> DataFrame:
    """(src_ord, value, type) of addresses and texts."""
    rows = spark.createDataFrame(list(enumerate(values)), "src_ord int, value string")
    return rows.withColumn("type", classify.source_type(F.col("value")))


def _errors(df: DataFrame) -> DataFrame:
    return df.select("src_ord", "error")


def _no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], readers.DOCUMENT + ", src_ord int")


def _fetched(inputs: DataFrame, address, options: Options) -> DataFrame:
    """Inputs with what their addresses gave; texts that are no address are their own body."""
    asked = graph.cut_lineage(inputs.withColumn("url", F.when(F.col("value").rlike("(?i)^https?://"), address)))
    got = http.fetch(asked.where("url is not null"), options.client)
    return asked.join(got, "url", "left").withColumn("text", F.when(F.col("url").isNull(), F.col("value")).otherwise(F.decode("body", "UTF-8")))


def markdown(spark: SparkSession, inputs: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Markdown addresses, a repository's page of a file as its raw form, and markdown texts."""
    got = _fetched(inputs, U.to_raw_url(F.col("value")), options)
    name = F.when(F.col("url").isNull(), F.lit("text")).otherwise(text.slug(text.title_from_path("url")))
    docs = got.where("error is null").select(
        "src_ord", name.alias("source_id"), F.lit("markdown").alias("source_type"), F.coalesce("url", F.lit("text://input")).alias("url"), U.markdown_section(F.col("url")).alias("section"), F.lit(None).cast("boolean").alias("is_root"),
        F.col("text").alias("markdown"), U.link_root(F.col("value")).alias("link_root"),
    )
    return _no_documents(spark).unionByName(docs, allowMissingColumns=True), _errors(got.where("error is not null"))


def specifications(spark: SparkSession, inputs: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Specifications by address or as text; what is none is an error."""
    got = graph.cut_lineage(_fetched(inputs, U.to_raw_url(F.col("value")), options).select("src_ord", "value", "text", "error"))
    named = got.withColumn("spec_id", F.when(F.col("value").rlike("(?i)^https?://"), F.col("value")).otherwise(F.concat(F.lit("text://input-"), F.col("src_ord").cast("string"))))
    return _documents_of_specs(named.where("error is null"), named)


def _documents_of_specs(good: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    docs = readers._api_documents(good.select("spec_id", "text").distinct(), keep=True).join(named.select("spec_id", "src_ord"), "spec_id").drop("spec_id")
    docs = graph.cut_lineage(docs)
    lost = named.join(docs.select("src_ord").distinct(), "src_ord", "left_anti")
    return docs, _errors(lost.withColumn("error", F.coalesce("error", F.lit("no specification of version 2 or 3"))))


def uploads(spark: SparkSession, inputs: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Documents of the online editor, exported and converted."""
    got = _fetched(inputs, U.google_doc_export(F.col("value")), options)
    got = got.withColumn("c", readers.converted(F.lit("docx"), F.col("body"))).withColumn("error", F.coalesce("error", "c.error"))
    docs = got.where("error is null").select(
        "src_ord",
        text.slug(F.concat(F.lit("document-"), F.left(F.regexp_extract("value", "/d/([A-Za-z0-9_-]+)", 1), F.lit(8)))).alias("source_id"),
        F.lit("upload").alias("source_type"),
        F.col("value").alias("url"),
        F.lit("Guides").alias("section"),
        F.col("c.markdown").alias("markdown"),
    )
    return _no_documents(spark).unionByName(docs, allowMissingColumns=True), _errors(got.where("error is not null"))


def pages(spark: SparkSession, inputs: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Crawls, one an input; a start page that is a specification, names one or speaks of one gives that specification's documents instead."""
    start = graph.cut_lineage(inputs.withColumn("url", U.normalize_url(F.col("value"))))
    lost = start.where("url is null").withColumn("error", F.lit("no valid address to start from"))
    first = http.fetch(start.where("url is not null"), options.client).withColumn("html", F.decode("body", "UTF-8"))
    seeds = start.join(first, "url").select(F.col("src_ord").alias("page_id"), "url", "html")
    wanted = graph.cut_lineage(computations.spec_candidates(seeds.where("html is not null")))
    others = http.fetch(wanted.select(F.col("candidate").alias("url")).join(first, "url", "left_anti"), options.client)
    corpus = openapi.of_text(first.unionByName(others.withColumn("html", F.decode("body", "UTF-8"))).where("error is null").select(F.col("url").alias("spec_id"), F.col("html").alias("text")))
    named = graph.cut_lineage(
        computations.discover_specs(seeds, graph.cut_lineage(corpus.select(F.col("spec_id").alias("url"), "json"))).select(
            F.col("page_id").alias("src_ord"), F.col("url").alias("spec_id"), F.col("json").alias("text"), F.lit(None).cast("string").alias("error")
        )
    )
    docs, errors = _documents_of_specs(named, named)
    errors = errors.unionByName(_errors(lost))
    for row in seeds.join(named.select(F.col("src_ord").alias("page_id")), "page_id", "left_anti").orderBy("page_id").collect():  # what a user typed
        one = spark.createDataFrame([(row.url, 0)], "url string, ord long")
        got, bad = http.crawl(spark, one, options.max_pages, options.max_depth, options.scope, options.client)
        said = got.select(F.lit(row.page_id).alias("src_ord"), U.source_id(F.lit(row.url)).alias("source_id"), F.lit("webpage").alias("source_type"), "url", "section", (F.col("ord") == 0).alias("is_root"), "html")
        docs = docs.unionByName(_no_documents(spark).unionByName(said, allowMissingColumns=True))
        errors = errors.unionByName(bad.select(F.lit(row.page_id).alias("src_ord"), F.concat("url", F.lit(": "), "error").alias("error")))
    return docs, errors


def repositories(spark: SparkSession, inputs: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Repositories by their host's listing: the first `max_files` ingestible files by rank are fetched, no others."""
    docs, errors = _no_documents(spark), spark.createDataFrame([], "src_ord int, error string")
    for row in inputs.select("src_ord", U.parse_repo(F.col("value")).alias("r")).orderBy("src_ord").collect():  # what a user typed
        repo = row.r
        if repo is None or repo.host not in options.apis:
            errors = errors.unionByName(spark.createDataFrame([(row.src_ord, "no repository of a known host: check it out and name its folder")], "src_ord int, error string"))
            continue
        api, raw = (x.format(host=repo.hostname) for x in options.apis[repo.host])
        asked = {"ref": repo.ref, "token": options.token or "", "paged": str(repo.host == "gitlab").lower(), "timeout": str(options.client.timeout), "maxPages": str(max(1, -(-options.max_files // 10)))}
        listed = http.listing(spark, api, repo.full_name, **{k: v for k, v in asked.items() if v})
        errors = errors.unionByName(listed.where("error is not null").select(F.lit(row.src_ord).alias("src_ord"), "error"))
        names = listed.where("path is not null").select("ref", F.col("path").alias("name")).where(classify.is_ingestible(F.col("name")))
        inside = names.where(F.startswith("name", F.lit(repo.sub_path.strip("/") + "/"))) if repo.sub_path else names
        names = names if repo.sub_path and inside.isEmpty() else inside
        quoted = F.replace(F.replace(F.url_encode("name"), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
        whole = (
            F.concat(F.lit(f"{raw}/{repo.full_name}/"), "ref", F.lit("/"), quoted)
            if raw
            else F.concat(F.lit(f"{api}/projects/{repo.full_name.replace('/', '%2F')}/repository/files/"), F.replace(quoted, F.lit("/"), F.lit("%2F")), F.lit("/raw?ref="), "ref")
        )
        chosen = graph.cut_lineage(names.orderBy(classify.repo_rank(F.col("name")), "name").limit(options.max_files).withColumn("url", whole))
        header = (("PRIVATE-TOKEN", options.token) if repo.host == "gitlab" else ("Authorization", f"Bearer {options.token}"),) if options.token else ()
        got = graph.cut_lineage(http.fetch(chosen, options.client._replace(accept="text/plain, */*", headers=header)).join(chosen, "url"))
        errors = errors.unionByName(got.where("error is not null").select(F.lit(row.src_ord).alias("src_ord"), F.concat("name", F.lit(": "), "error").alias("error")))
        made = readers.repository_documents(
            got.where("error is null").select(F.concat(F.lit(f"{repo.web_url}/blob/"), "ref", F.lit("/"), "name").alias("path"), "name", F.col("body").alias("content")),
            readers.text_slug(repo.repo),
        )
        docs = docs.unionByName(made.withColumn("src_ord", F.lit(row.src_ord)))
    return docs, errors


#: A reader for each type of source.
READERS = {"webpage": pages, "markdown": markdown, "openapi": specifications, "upload": uploads, "git": repositories}


def read(spark: SparkSession, inputs: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of inputs (src_ord, value, type): each type's reader takes all inputs of the type."""
    inputs = graph.cut_lineage(inputs)
    docs, errors = _no_documents(spark), spark.createDataFrame([], "src_ord int, error string")
    for kind in sorted(r.type for r in inputs.select("type").distinct().collect()):  # at most as many as there are readers
        made, bad = READERS[kind](spark, inputs.where(F.col("type") == kind).select("src_ord", "value"), options)
        docs, errors = docs.unionByName(graph.cut_lineage(made.select(docs.columns))), errors.unionByName(graph.cut_lineage(bad))
    return docs, errors
