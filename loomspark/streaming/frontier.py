"""A crawl as a stream: what was visited is state, keyed by host, and every level of links is a batch. A stopped crawl goes on where it was.

The frontier is a folder of files (url, depth, path, section). A batch admits the addresses that its host has not seen, has them
fetched, writes their pages and puts their links into the frontier for the next batch. Batches are named by their numbers, so a
batch that runs again writes the same files; addresses that come twice are met by the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomspark.functions import url as U
from loomspark.operators import graph, structure

FRONTIER = "url string, depth int, path array<long>, section string"
#: What a stream with state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"


class Admit(StatefulProcessor):
    """Lets an address of a host through once; of several links to it in a batch, the first by path."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "url string", "depth int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple] = {}
        for some in rows:
            for address, depth, path, section in zip(some["url"], some["depth"], some["path"], some["section"]):
                found = (int(depth), [int(x) for x in path], section)
                if (address not in best or found[:2] < best[address][:2]) and not (address not in best and self.seen.containsKey((address,))):
                    best[address] = found
        for address, found in best.items():
            self.seen.updateValue((address,), (found[0],))
        if best:
            yield pd.DataFrame({"url": list(best), "depth": [f[0] for f in best.values()], "path": [f[1] for f in best.values()], "section": [f[2] for f in best.values()]})

    def close(self) -> None:
        pass


def links_of(pages: DataFrame) -> DataFrame:
    """(page, ord, url, section): the links of pages (url, html), resolved and in order."""
    found = structure.page_links(pages.select(F.col("url").alias("page"), "url", "html"), "page")
    target = U.normalize_url(U.resolve_url(F.col("href"), F.col("page")))
    return found.select("page", "ord", target.alias("url"), F.nullif("section", F.lit("")).alias("section")).where("url is not null")


def crawl(
    spark: SparkSession, folder: str, seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_depth: int = 3, scope: Callable | None = None, links: Callable[[DataFrame], DataFrame] = links_of, rounds: int | None = None
) -> DataFrame:
    """Crawls from seeds (url, ord) below a shared `folder` until nothing new is met, or for so many `rounds`; returns all pages so far.

    fetch: addresses (url) to (url, html, error), as sources.http gives them; scope: which addresses (a column) count. Called again
    with the same folder it goes on: seeds that were seen are not asked again. Result: url, depth, path (the places of the links that
    led to it, the seed's first: its order within a depth), section, html, error.
    """
    given = [r.url for r in spark.read.schema(FRONTIER).option("recursiveFileLookup", "true").parquet(f"{folder}/frontier").limit(1).collect()] if _there(spark, f"{folder}/frontier") else []
    if not given:
        start = seeds.select("url", F.lit(0).alias("depth"), F.array(F.col("ord").cast("long")).alias("path"), F.lit("Overview").alias("section"))
        start.write.mode("overwrite").parquet(f"{folder}/frontier/seeds")

    def batch(admitted: DataFrame, number: int) -> None:
        admitted = graph.cut_lineage(admitted)
        if admitted.isEmpty():
            return
        got = graph.cut_lineage(fetch(admitted.select("url")).select("url", "html", "error").join(admitted, "url").select("url", "depth", "path", "section", "html", "error"))
        got.write.mode("overwrite").parquet(f"{folder}/pages/batch-{number}")
        above = got.where(F.col("error").isNull() & (F.col("depth") < max_depth))
        met = links(above).join(above.select(F.col("url").alias("page"), "depth", "path", F.col("section").alias("above")), "page")
        met = met.where(scope(F.col("url"))) if scope else met
        met = met.select("url", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array(F.col("ord").cast("long"))).alias("path"), F.coalesce("section", "above").alias("section"))
        met.write.mode("overwrite").parquet(f"{folder}/frontier/batch-{number}")

    before = spark.conf.get(_SETTING, None)
    spark.conf.set(_SETTING, PROVIDER)
    try:
        done = 0
        while rounds is None or done < rounds:
            frontier = spark.readStream.schema(FRONTIER).option("recursiveFileLookup", "true").parquet(f"{folder}/frontier")
            hosts = frontier.withColumn("host", F.coalesce(U.host(F.col("url")), F.lit(""))).groupBy("host")
            admitted = hosts.transformWithStateInPandas(statefulProcessor=Admit(), outputStructType=FRONTIER, outputMode="Append", timeMode="None")
            query = admitted.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
            done += 1
            if not sum(p.numInputRows for p in query.recentProgress):
                break
    finally:
        spark.conf.unset(_SETTING) if before is None else spark.conf.set(_SETTING, before)
    return spark.read.schema(f"{FRONTIER}, html string, error string").option("recursiveFileLookup", "true").parquet(f"{folder}/pages")


def _there(spark: SparkSession, folder: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
