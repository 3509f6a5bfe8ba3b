"""Computations that documents carry: the first executable block of each concept, as a file of its own; specification discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import classify, text, url

#: Where specifications usually are, in order (fixed values).
SPEC_PATHS = ("/openapi.json", "/swagger.json", "/openapi.yaml", "/v3/api-docs", "/api-docs", "/swagger/v1/swagger.json")


def first_sql_block(concepts: DataFrame, key: str) -> DataFrame:
    """(key, block_no, code): the first executable SQL block of each concept's array `blocks` of (language, code)."""
    numbered = F.transform("blocks", lambda b, i: F.struct(i.alias("block_no"), b["language"].alias("language"), b["code"].alias("code")))
    first = F.get(F.filter(numbered, lambda b: b["language"] == "sql"), F.lit(0))
    return concepts.select(key, first.alias("b")).where("b is not null").select(key, "b.block_no", "b.code")


def computation_files(concepts: DataFrame, key: str, as_of: str, runtime: str = "bigquery") -> DataFrame:
    """(key, folder, slug, title, content): an attested-computation file per (key, title, url, code)."""
    sid = F.concat(F.lit("src-"), F.left(text.slug("title"), F.lit(20)))
    front = F.concat(
        F.lit('---\ntype: Attested Computation\ntitle: "Computation for '), F.replace("title", F.lit('"'), F.lit('\\"')), F.lit(f'"\nstatus: stable\nruntime: {runtime}\nparameters:\n  - name: project_id\n    type: string\n    required: false\n  - name: dataset_id\n    type: string\n    required: false\nexecutor:\n  receipt: [job_id, executed_sql, result]\ngenerated:\n  at: {as_of}\nverified:\n  by: process:crawler\n  at: {as_of}\nsources:\n  - id: '), sid, F.lit('\n    resource: "'), F.coalesce("url", F.lit("")), F.lit('"\n---\n\n'),
    )
    body = F.concat(F.lit(f"# Computation\n\n```{runtime}\n"), "code", F.lit("\n```\n\nSanctioned logic of the source.[^"), sid, F.lit("]\n"))
    return concepts.select(key, F.lit("computations").alias("folder"), F.concat(F.lit("comp-"), F.left(text.slug("title"), F.lit(25))).alias("slug"), F.concat(F.lit("Computation: "), "title").alias("title"), F.concat(front, body).alias("content"))


def spec_candidates(pages: DataFrame) -> DataFrame:
    """(page_id, ord, candidate): where a page's specification may be: itself, the address that it names, the usual places if it speaks of one."""
    html = F.coalesce("html", F.lit(""))
    named = F.regexp_extract(html, r"""(?i)(?:url|spec-url)\s*[:=]\s*["']([^"']+)["']""", 1)
    site = url.origin(F.col("url"))
    usual = F.when(html.rlike("(?i)swagger-ui|swagger|openapi|redoc"), F.array(*(F.concat(site, F.lit(p)) for p in SPEC_PATHS))).otherwise(F.array().cast("array<string>"))
    listed = F.concat(F.array(F.when(classify.source_type(html) == "openapi", F.col("url"))), F.array(F.when(named != "", url.resolve_url(named, F.col("url")))), usual)
    return pages.select("page_id", F.posexplode(listed).alias("ord", "candidate")).where("candidate is not null")


def discover_specs(pages: DataFrame, corpus: DataFrame) -> DataFrame:
    """(page_id, url, json): the first candidate of each page that is in the corpus (url, json)."""
    met = spec_candidates(pages).join(corpus.withColumnRenamed("url", "candidate"), "candidate")
    return met.groupBy("page_id").agg(F.min_by(F.struct(F.col("candidate").alias("url"), "json"), "ord").alias("b")).select("page_id", "b.*")
