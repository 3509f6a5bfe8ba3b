"""The engine's verbs: ingest, generate, validate, graph, export."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import classify, text
from loomspark.operators import bundle, documents, front, graph, progress, sections, validate
from loomspark.operators import computations as computing
from loomspark.parsing import markdown as M
from loomspark.sources import readers, registry, sinks


@dataclass
class Bundle:
    """A bundle's concepts and files, and what was counted while they were made."""

    concepts: DataFrame
    files: DataFrame
    run: progress.Run = field(default_factory=progress.Run)

    @cached_property
    def parsed(self) -> DataFrame:
        """The files with their front matter, which is read once."""
        return graph.cut_lineage(front.parsed(self.files))

    def checks(self) -> DataFrame:
        """The findings, written; how many checks failed is in the run's events."""
        failed = lambda severity: F.count_if(~F.col("passed") & (F.col("severity") == severity))
        return self.run.written(validate.checks(self.parsed), "checked", errors=failed("error"), warnings=failed("warning"))

    def report(self) -> DataFrame:
        return validate.report(self.checks())

    def nodes(self) -> DataFrame:
        return graph.nodes(self.parsed)

    def edges(self) -> DataFrame:
        return graph.cross_links(self.files).unionByName(graph.hierarchy(self.files))

    def save(self, folder: str) -> DataFrame:
        """Writes the files below a shared folder, all of them or none; returns (path, bytes)."""
        return sinks.write_files(self.files, folder)

    def zip(self, target: str) -> int:
        """Writes the files as one archive in a shared folder; returns how many it holds."""
        return sinks.write_zip(self.files, target)


def ingest(spark: SparkSession, inputs: list[str], max_files: int = 100, options: registry.Options | None = None, run: progress.Run | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, errors) of what a user names, in that order: folders (checked-out repositories), files, tables of pages, addresses and texts.

    A folder of Parquet files is a table of page_id, url, html; addresses and texts go to the reader of their type (see
    sources.registry): web pages are crawled, repositories listed and read, specifications become a document per endpoint and
    model. What cannot be read is a row of errors (source, type, error). documents: doc_ord and the document shape; sources:
    ord, source_id, source_type, input, documents. Raises ValueError if nothing gave a document. `run` gets the counts.
    """
    options, run = options or registry.Options(max_files=max_files), run or progress.Run()
    kinds = [readers.local_kind(value) for value in inputs]
    parts, failed = [], []
    for n, (value, kind) in enumerate(zip(inputs, kinds)):
        if kind is None:
            continue
        try:
            got, bad = readers.local(spark, value, kind, options.max_files)
            parts.append(graph.cut_lineage(got.withColumn("src_ord", F.lit(n))))
        except (AnalysisException, ValueError) as e:  # a path that is not there, or a table without the columns of pages
            bad = spark.createDataFrame([(value, str(e).splitlines()[0][:300])], "source string, error string")
        failed.append(bad.select(F.lit(n).alias("src_ord"), "source", "error"))
    named = [(n, v) for n, (v, k) in enumerate(zip(inputs, kinds)) if k is None]
    if named:
        rows = registry.typed(spark, [v for _, v in named]).join(spark.createDataFrame([(i, n) for i, (n, _) in enumerate(named)], "src_ord int, at int"), "src_ord")
        got, bad = registry.read(spark, rows.select(F.col("at").alias("src_ord"), "value", "type"), options)
        parts.append(got)
        failed.append(bad.select("src_ord", F.lit(None).cast("string").alias("source"), "error"))
    asked = spark.createDataFrame(list(enumerate(inputs)), "src_ord int, input string").withColumn("type", F.coalesce(*(F.when(F.col("src_ord") == n, F.lit(k)) for n, k in enumerate(kinds) if k), classify.source_type(F.col("input"))))
    docs = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None
    errors = functools.reduce(DataFrame.unionByName, failed).join(asked, "src_ord").select("src_ord", F.coalesce("source", "input").alias("source"), "type", "error")
    if docs is not None:
        per_source = {f"source_{n}": F.count_if(F.col("src_ord") == n) for n in range(len(inputs))}  # what a user typed
        docs = run.written(docs.join(F.broadcast(asked.select("src_ord", "input")), "src_ord"), "documents_read", **per_source)
        said = errors.select("src_ord").unionByName(docs.select("src_ord")).distinct()
        none = asked.join(said, "src_ord", "left_anti").select("src_ord", F.col("input").alias("source"), "type", F.lit("no document found").alias("error"))
        errors = errors.unionByName(none)
    errors = run.written(errors.drop("src_ord"), "sources_failed")
    if docs is None or not run.count("documents_read"):
        raise ValueError(f"no source gave a document: {[tuple(r) for r in errors.limit(20).collect()]}")
    docs = graph.ranks(docs.withColumn("at", F.struct("src_ord", F.coalesce(~F.col("is_root"), F.lit(True)), "section", "url", "slug_hint")), "at").withColumnRenamed("rank", "doc_ord").drop("at")
    docs = graph.cut_lineage(docs)
    sources = docs.groupBy("src_ord").agg(F.min("source_id").alias("source_id"), F.min("source_type").alias("source_type"), F.min("input").alias("input"), F.count("*").alias("documents")).withColumnRenamed("src_ord", "ord")
    return docs, readers.unique_ids(sources, "ord"), errors


def generate(docs: DataFrame, as_of: str, split: bool = True, computations: bool = True, actor: str = "process:loomspark", run: progress.Run | None = None) -> Bundle:
    """A bundle of documents: doc_ord, source_id, url, html or markdown, and what else `documents.parse_documents` takes.

    Documents are parsed, catalogues are split into a concept per section under an overview, the first document that is or may
    be the root becomes the overview, paths are reserved in order, links between concepts are rewritten. A concept's first
    SQL block becomes a computation of its own. The root index lists the sources, where there are several.
    """
    run = run or progress.Run()
    df = run.written(documents.parse_documents(docs, "doc_ord", as_of), "documents_parsed", characters=F.sum(F.length("body")))
    whole = df.withColumn("sec_ord", F.lit(0)).withColumn("wants_root", F.coalesce("is_root", F.col("doc_ord") == 0)).withColumn("forced", F.lit(None).cast("string"))
    overviews = None
    if split:
        parts = graph.cut_lineage(sections.split_sections(df.where("splittable").select("doc_ord", "body"), "doc_ord", "body"))
        own = sections.section_concepts(parts, df, "doc_ord").join(parts.select("doc_ord", "sec_ord", "body"), ["doc_ord", "sec_ord"])
        own = own.join(df.select("doc_ord", "source_id", "source_type", "tags", "author", "site", "last_modified"), "doc_ord").withColumn("type", classify.concept_type(F.col("title")))
        own = own.withColumn("forced", F.col("folder")).withColumn("slug_hint", F.col("slug")).withColumn("wants_root", F.lit(False))
        split_docs = parts.where("sec_ord = 0").select("doc_ord", F.col("body").alias("preamble")).join(df, "doc_ord")
        said = F.regexp_replace("preamble", r"^ {0,3}#\s+[^\n]*\n*", "")
        overviews = split_docs.select(text.slug("title").alias("folder"), F.struct("title", F.coalesce(F.nullif(said, F.lit("")), "description").alias("body"), F.col("url").alias("resource")).alias("o"), "doc_ord")
        overviews = graph.cut_lineage(overviews.groupBy("folder").agg(F.max_by("o", "doc_ord").alias("o")).select("folder", "o.*"))
        whole = whole.join(split_docs.select("doc_ord"), "doc_ord", "left_anti").unionByName(own.drop("folder", "slug"), allowMissingColumns=True)
    whole = whole.drop("is_root", "splittable").withColumn("at", F.struct("doc_ord", "sec_ord"))
    ranked = bundle.elect_root(graph.ranks(whole, "at").withColumnRenamed("rank", "ord"), "ord").drop("at")
    last = F.regexp_replace(F.element_at(F.split(F.regexp_replace("url", r"[?#].*$|/$", ""), "/"), -1), r"(?i)\.(html?|mdx?|markdown)$", "")
    by_url = F.when(F.col("url").rlike("(?i)^https?://[^/]+/[^?#]"), text.slug(last))
    # Names are made once a concept and written: copies of their expressions grow beyond what can be compiled.
    ranked = sections.once(ranked, "_hint", F.when(F.coalesce("slug_hint", F.lit("")) != "", text.slug("slug_hint")))
    ranked = sections.once(ranked, "_title", text.slug("title"))
    ranked = sections.once(ranked, "_own", F.when(F.col("is_root"), "overview").otherwise(F.coalesce(text.truncate_slug(F.col("_hint")), F.lit(""))))
    ranked = sections.once(ranked, "slug", F.when(F.col("_own") != "", F.col("_own")).otherwise(F.coalesce(by_url, text.truncate_slug(F.col("_title")))))
    ranked = ranked.withColumn("folder", F.coalesce("forced", classify.folder(F.col("section"), F.col("slug"), F.col("is_root")))).drop("_hint", "_title", "_own")
    ranked = graph.cut_lineage(ranked)
    found = None
    keys = ranked.select("ord", "folder", "slug", "source_id")
    if computations:
        blocks = ranked.select("ord", "source_id", "title", "url", M.code_blocks_of(F.col("body")).alias("blocks"))
        first = computing.first_sql_block(blocks, "ord").join(ranked.select("ord", "source_id", "title", "url"), "ord")
        found = graph.cut_lineage(computing.computation_files(first, "ord", as_of).join(first.select("ord", "source_id"), "ord"))
        n = ranked.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("n"))  # computations choose their paths after all concepts
        keys = keys.unionByName(found.crossJoin(F.broadcast(n)).select((F.col("ord") + F.col("n")).alias("ord"), "folder", "slug", "source_id"))
    paths = graph.cut_lineage(documents.resolve_paths(keys, "ord").select("ord", "path"))
    concepts = ranked.join(paths, "ord")
    if computations:
        found = found.crossJoin(F.broadcast(n)).withColumn("late", F.col("ord") + F.col("n")).join(paths.withColumnRenamed("ord", "late"), "late").select(F.col("ord").alias("key"), "path", "title", "content")
        found = graph.cut_lineage(found)
        tip = F.concat(F.lit("> [!TIP]\n> This guide includes a sanctioned executable computation: ["), F.regexp_replace("title", "^Computation: ", ""), F.lit(" Computation](/"), "path", F.lit(")\n\n"))
        concepts = concepts.join(found.select(F.col("key").alias("ord"), tip.alias("tip")), "ord", "left")
    concepts = graph.cut_lineage(concepts)
    links = bundle.rewrite_links(bundle.extract_links(concepts, "ord", "body"), bundle.url_dictionary(concepts, "ord"), "ord").where("target is not null")
    swaps = links.groupBy("ord").agg(F.map_from_entries(F.collect_set(F.struct("href", "target"))).alias("to"))
    linked = concepts.join(swaps, "ord", "left")
    # A body is split where links begin, and each link looked up once.
    href = lambda p: F.substring_index(p, ")", 1)
    swap = lambda p: F.concat(F.coalesce(F.try_element_at("to", href(p)), href(p)), F.substr(p, F.length(href(p)) + 1))
    swapped = F.array_join(F.transform(F.split("body", r"\]\("), lambda p, i: F.when((i > 0) & F.contains(p, F.lit(")")), swap(p)).otherwise(p)), "](")
    made = linked.withColumn("n_links", F.coalesce(F.size("to"), F.lit(0))).withColumn("body", F.when(F.col("to").isNull(), F.col("body")).otherwise(swapped)).drop("to")
    linked = run.written(made, "concepts_made", targets_linked=F.sum("n_links")).drop("n_links")
    labels = F.create_map(*(F.lit(x) for pair in readers.LABELS.items() for x in pair))
    sources = df.groupBy("source_id").agg(F.min("doc_ord").alias("ord"), F.min_by("url", "doc_ord").alias("url"), F.coalesce(labels[F.min("source_type")], F.lit("Source")).alias("label"), F.count("*").alias("n")).withColumnRenamed("source_id", "name")
    files = run.written(bundle.bundle_files(linked, "ord", as_of, actor, overviews, found, sources), "files_made", characters=F.sum(F.length("content")))
    return Bundle(linked, files, run)
