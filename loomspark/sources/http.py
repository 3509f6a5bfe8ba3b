"""Addresses over HTTP: pages and files fetched by tasks at a polite pace, listings of repositories as a data source, live crawls.

All rows of a host go to one task, as its pace is the bound and not the cluster: a host gets a request every `delay` seconds. What
cannot be had is a row with an error; no address ends a job.
"""

from __future__ import annotations

import itertools
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomspark.functions import url as U
from loomspark.operators import graph, structure


class Client(NamedTuple):
    """How to ask: seconds to wait, redirects to follow, seconds between two requests to a host, bytes to take, headers beside the usual ones."""

    timeout: float = 15.0
    redirects: int = 5
    delay: float = 0.2
    most: int = 25 * 1024 * 1024
    agent: str = "loomspark"
    accept: str = "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"
    headers: tuple[tuple[str, str], ...] = ()


class Answer(NamedTuple):
    """What an address gave."""

    final_url: str | None
    status: int | None
    content_type: str | None
    body: bytes | None
    error: str | None


#: What a user can do about a status.
ADVICE = {401: "a token is needed", 403: "no permission, or the rate limit is reached: give a token or wait", 404: "not found, or private: give a token", 429: "the rate limit is reached: give a token or wait"}


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self, most: int):
        self.max_redirections, self.max_repeats = most, most

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if urllib.parse.urlsplit(newurl).scheme not in ("http", "https"):
            raise urllib.error.URLError("redirect to another scheme")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def get(address: str | None, client: Client) -> tuple[Answer, dict]:
    """(answer, its headers) of one address."""
    try:
        if urllib.parse.urlsplit(address or "").scheme not in ("http", "https"):
            return Answer(None, None, None, None, "no http(s) address"), {}
        asked = urllib.request.Request(address, headers={"User-Agent": client.agent, "Accept": client.accept, "Accept-Language": "en-US,en;q=0.9", **dict(client.headers)})
        with urllib.request.build_opener(_Redirects(client.redirects)).open(asked, timeout=client.timeout) as got:
            body = got.read(client.most + 1)
            said = {k.lower(): v for k, v in got.headers.items()}
            if len(body) > client.most:
                return Answer(got.url, got.status, said.get("content-type"), None, "answer is too large"), said
            return Answer(got.url, got.status, said.get("content-type"), body, None), said
    except urllib.error.HTTPError as e:
        advice = f": {ADVICE[e.code]}" if e.code in ADVICE else ""
        return Answer(e.url, e.code, None, None, f"HTTP {e.code}{advice}"), {}
    except Exception as e:  # whatever an address does: it is a row with an error
        return Answer(None, None, None, None, str(getattr(e, "reason", e)) or type(e).__name__), {}


def fetch(addresses: DataFrame, client: Client = Client()) -> DataFrame:
    """(url, final_url, status, content_type, body, error) of addresses (url), each once, written when fetched.

    A task that runs again asks again; what follows reads what was written.
    """
    names = ["url", *Answer._fields]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: dict[str, float] = {}
        for batch in batches:
            for address in batch.column(0).to_pylist():
                host = urllib.parse.urlsplit(address).netloc if address else ""
                time.sleep(max(0.0, free.get(host, 0.0) - time.monotonic()))
                free[host] = time.monotonic() + client.delay
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((address, *get(address, client)[0]), types)], names)

    asked = addresses.select("url").distinct().repartition(F.coalesce(U.host(F.col("url")), F.lit("")))
    return graph.cut_lineage(asked.mapInArrow(rows, "url string, final_url string, status int, content_type string, body binary, error string"))


# ---------------------------------------------------------------- listings


class Page(InputPartition):
    """A page of a listing."""

    def __init__(self, address: str):
        self.address = address


class ListingReader(DataSourceReader):
    """Reads a repository's tree: in one answer, or page by page, a partition each."""

    def __init__(self, options: dict):
        self.api, self.name, self.paged = options["api"].rstrip("/"), options["repository"], options.get("paged", "false") == "true"
        self.ref, self.per_page, self.most = options.get("ref") or None, int(options.get("perPage", 100)), int(options.get("maxPages", 10))
        token = options.get("token")
        headers = ((("PRIVATE-TOKEN", token) if self.paged else ("Authorization", f"Bearer {token}")),) if token else ()
        self.client = Client(accept="application/json", headers=headers, timeout=float(options.get("timeout", 15)))
        quoted = urllib.parse.quote(self.name, safe="" if self.paged else "/")
        self.base = f"{self.api}/projects/{quoted}" if self.paged else f"{self.api}/repos/{quoted}"

    def _json(self, address: str) -> tuple[object, dict, str | None]:
        answer, said = get(address, self.client)
        if answer.error:
            return None, said, answer.error
        try:
            return json.loads(answer.body), said, None
        except ValueError:
            return None, said, "answer is no JSON"

    def partitions(self) -> list[Page]:
        ref = self.ref
        if ref is None:
            about, _, error = self._json(self.base)
            if error:
                return [Page(self.base)]  # read again by a task, which gives the error's row
            ref = (about or {}).get("default_branch") or "main"
        quoted = urllib.parse.quote(ref, safe="")
        if not self.paged:
            return [Page(f"{self.base}/git/trees/{quoted}?recursive=1")]
        page = lambda k: f"{self.base}/repository/tree?recursive=true&per_page={self.per_page}&page={k}&ref={quoted}"
        total = get(page(1), self.client)[1].get("x-total-pages", "")
        return [Page(page(k)) for k in range(1, min(int(total) if total.isdigit() else self.most, self.most) + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        found, _, error = self._json(partition.address)
        listed = found.get("tree") if isinstance(found, dict) else found
        if error or not isinstance(listed, list):
            yield partition.address, None, None, error or "answer is no listing"
            return
        ref = urllib.parse.unquote(partition.address.rsplit("ref=", 1)[-1] if self.paged else partition.address.rsplit("/", 1)[-1].split("?")[0])
        for node in listed:
            if isinstance(node, dict) and node.get("type") == "blob" and isinstance(node.get("path"), str):
                yield partition.address, ref, node["path"], None


class Listing(DataSource):
    """`repository_listing`: the files of a repository, told by its API. Options: api, repository, ref, paged, perPage, maxPages, token, timeout."""

    @classmethod
    def name(cls) -> str:
        return "repository_listing"

    def schema(self) -> str:
        return "page string, ref string, path string, error string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def listing(spark: SparkSession, api: str, repository: str, **options: str) -> DataFrame:
    """(page, ref, path, error): a row per file of a repository, and one per page of its listing that could not be had."""
    spark.dataSource.register(Listing)
    return graph.cut_lineage(spark.read.format("repository_listing").options(api=api, repository=repository, **options).load())


# ---------------------------------------------------------------- crawls


def crawl(spark: SparkSession, seeds: DataFrame, max_pages: int = 25, max_depth: int = 3, scope: str = "subtree", client: Client = Client()) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of a crawl from seeds (url, ord): breadth first, a level a round.

    pages: url, depth, ord, section, html, the first `max_pages` in order; errors: url, depth, error. Links are those of
    `structure.page_links`, by priority, inside the scope of a seed. Pages and what is queued are at most twice `max_pages`. A page's section is that of the
    link that led to it, else its parent's; seeds have Overview.
    """
    typed = [r.url for r in seeds.orderBy("ord").collect()]  # what a user typed
    inside = lambda c: F.greatest(F.lit(False), F.lit(False), *(F.coalesce(U.in_scope(c, F.lit(s), scope), F.lit(False)) for s in typed))
    level = graph.cut_lineage(seeds.groupBy("url").agg(F.min("ord").alias("ord")).select("url", F.array(F.col("ord").cast("long")).alias("path"), F.lit("Overview").alias("section")))
    queued, met, left = level, None, 2 * max_pages - level.count()
    for depth in itertools.count():
        got = fetch(level, client).join(level, "url").withColumn("depth", F.lit(depth)).withColumn("html", F.decode("body", "UTF-8")).drop("body")
        got = graph.cut_lineage(got)
        met = got if met is None else met.unionByName(got)
        if depth == max_depth or left <= 0:
            break
        pages = got.where("error is null")
        links = structure.page_links(pages.select(F.col("url").alias("page"), "url", "html"), "page").join(pages.select(F.col("url").alias("page"), "path", F.col("section").alias("above"), "final_url"), "page")
        links = links.withColumn("url", U.normalize_url(U.resolve_url(F.col("href"), F.coalesce("final_url", "page")))).where(F.col("url").isNotNull()).where(inside(F.col("url")))
        at = F.struct(F.concat("path", F.array(F.col("ord").cast("long"))).alias("path"), F.coalesce(F.nullif("section", F.lit("")), "above").alias("section"))
        found = links.groupBy("url").agg(F.min(at).alias("at")).join(queued, "url", "left_anti").select("url", "at.*")
        level = graph.cut_lineage(found.orderBy("path").limit(left))
        n = level.count()
        if not n:
            break
        queued, left = queued.unionByName(level), left - n
    ranked = graph.ranks(met.where("error is null").withColumn("at", F.struct("depth", "path")), "at").withColumnRenamed("rank", "ord")
    return ranked.where(F.col("ord") < max_pages).select("url", "depth", "ord", "section", "html"), met.where("error is not null").select("url", "depth", "error")
