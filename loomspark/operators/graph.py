"""The graph of a bundle: nodes, hierarchy and cross-link edges, broken links, lineage, crawl order."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import classify
from loomspark.operators import front


def scratch_dir(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir; where that is unset and Spark runs in one process, as in tests, below a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/loomspark-{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df`, written as Parquet to the application's shared folder and read again: what follows does not depend on any executor that made it."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what `cut_lineage` wrote for this application; for when its results have been stored or read."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def nodes(files: DataFrame) -> DataFrame:
    """(id, label, type, folder) of each file but root index and log, and the root node."""
    role = classify.file_role(F.col("path"))
    files = front.parsed(files)
    label = F.coalesce(F.nullif(front.value("title"), F.lit("")), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", ""))
    kind = F.when(role == "index", "Index").otherwise(F.coalesce(F.nullif(front.value("type"), F.lit("")), F.lit("Concept")))
    folder = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("root")
    out = files.where(~role.isin("root_index", "log")).select(F.col("path").alias("id"), label.alias("label"), kind.alias("type"), folder.alias("folder"))
    root = files.sparkSession.range(1).select(F.lit("index.md").alias("id"), F.lit("Root Index").alias("label"), F.lit("Index").alias("type"), F.lit("root").alias("folder"))
    return root.unionByName(out)


def hierarchy(files: DataFrame) -> DataFrame:
    """(source, target, type): the root leads to folder indexes, these to their concepts; concepts at the top hang on the root."""
    role = classify.file_role(F.col("path"))
    above = F.when((role == "concept") & F.contains("path", F.lit("/")), F.concat(F.substring_index("path", "/", 1), F.lit("/index.md"))).otherwise("index.md")
    return files.where(~role.isin("root_index", "log")).select(above.alias("source"), F.col("path").alias("target"), F.when(role == "index", "hierarchy").otherwise("contains").alias("type"))


def navigation(files: DataFrame) -> DataFrame:
    """(source, pos, target, found): where each link inside the bundle leads a reader: its fragment is left out; found tells whether the file exists."""
    inside = link_targets(files).where(~F.col("target").rlike("(?i)^[a-z][a-z0-9+.-]*:") & ~F.startswith("target", F.lit("#")))
    known = files.select(F.col("path").alias("target"), F.lit(True).alias("found"))
    return inside.withColumn("target", F.substring_index("target", "#", 1)).join(known, "target", "left").select("source", "pos", "target", F.coalesce("found", F.lit(False)).alias("found"))


def link_targets(files: DataFrame) -> DataFrame:
    """(source, pos, target): each link's target as a bundle path; ./ is the file's folder, fragments and ../ are kept as they are."""
    hrefs = files.select(F.col("path").alias("source"), F.posexplode(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1))).alias("pos", "href"))
    here = F.regexp_replace("source", "[^/]*$", "")
    to = F.when(F.startswith("href", F.lit("./")), F.concat(here, F.substring("href", 3, 1 << 20))).otherwise(F.regexp_replace("href", "^/", ""))
    return hrefs.select("source", "pos", to.alias("target"))


def cross_links(files: DataFrame) -> DataFrame:
    """(source, target, type): links between files of the bundle, repeated ones kept, none to itself."""
    known = files.select(F.col("path").alias("target"))
    return link_targets(files).join(known, "target").where("source != target").select("source", "target", F.lit("link").alias("type"))


def broken_links(files: DataFrame) -> DataFrame:
    """(source, target): links to markdown files that are not in the bundle; addresses and fragments are no such links."""
    inside = link_targets(files).where(~F.col("target").rlike("(?i)^[a-z][a-z0-9+.-]*:") & F.col("target").rlike(r"\.md$"))
    return inside.join(files.select(F.col("path").alias("target")), "target", "left_anti").select("source", "target")


def closure(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node, depth): what can be reached from each start over edges (src, dst), at its least depth; cycles end.

    starts: start. A level per step, down to `depth` or to the last; each is joined with the edges and anti-joined with what was reached before.
    """
    level = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()
    level = cut_lineage(level)
    reached = level
    for d in itertools.count(1) if depth is None else range(1, depth + 1):
        level = level.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        level = cut_lineage(level.join(reached, ["start", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached


def crawl(edges: DataFrame, seeds: DataFrame, known: DataFrame, max_depth: int | None = 3, max_pages: int | None = None, visited: bool = False) -> DataFrame:
    """(url, depth, ord): breadth-first order from seeds (url, ord) over edges (src, dst, pos); pages not in `known` are visited but not emitted.

    Each level is ordered by (its parent's place, the link's place); a page counts where it is met first. With `max_pages`,
    the crawl ends when so many pages are out, and no more than twice as many are queued; without `max_depth` it ends when
    nothing new is met. Where edges have a `section`, so has the result: a page's is that of the link that led to it, else
    its parent's (seeds may have one too). With `visited`, pages that could not be had are rows as well, told by `fetched`.
    """
    sections = ["section"] if "section" in edges.columns else []
    given = F.col("section") if "section" in seeds.columns else F.lit(None).cast("string")
    # A page's place among those of its depth is its path: the places of the links that led to it, the seed's first.
    first = F.min(F.struct(F.array(F.col("ord").cast("long")).alias("path"), given.alias("section"))).alias("at")
    level = cut_lineage(seeds.groupBy("url").agg(first).select("url", F.lit(0).alias("depth"), "at.path", *(F.col(f"at.{c}").alias(c) for c in sections)))
    queued, seen, there = level, level.count(), known.select("url").distinct()
    for d in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        fetched = level.join(there, "url", "left_semi")
        if sections:
            fetched = fetched.withColumnRenamed("section", "above")
        path = F.concat("path", F.array(F.col("pos").cast("long"))).alias("path")
        met = fetched.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("to"), F.struct(path, *(F.coalesce(c, "above").alias(c) for c in sections)).alias("at"))
        found = met.groupBy(F.col("to").alias("url")).agg(F.min("at").alias("at")).join(queued, "url", "left_anti")
        found = found.select("url", F.lit(d).alias("depth"), "at.path", *(F.col(f"at.{c}").alias(c) for c in sections))
        if max_pages is not None:
            found = found.orderBy("path").limit(max(0, 2 * max_pages - seen))
        level = cut_lineage(found)  # the one write of a level
        n = level.count()
        if not n:
            break
        queued, seen = queued.unionByName(level), seen + n
    queued = ranks(queued.withColumn("at", F.struct("depth", "path")).drop("path"), "at").drop("at").withColumnRenamed("rank", "ord").select("url", "depth", "ord", *sections)
    if visited:
        return queued.join(there.withColumn("fetched", F.lit(True)), "url", "left").withColumn("fetched", F.coalesce("fetched", F.lit(False)))
    emitted = queued.join(there, "url", "left_semi")
    if max_pages is not None:
        emitted = emitted.orderBy("ord").limit(max_pages)
    return emitted


def ranks(df: DataFrame, by: str, start: int = 0) -> DataFrame:
    """Adds `rank`, from `start`, in the order of `by`, by counts of sorted range partitions."""
    parts = df.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumn("part", F.spark_partition_id())
    parts = cut_lineage(parts)
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row per partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy(by))
    return parts.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("inside") - 1 + start).drop("part", "before", "inside")


def grouped_ranks(df: DataFrame, groups: list[str], by: str, name: str) -> DataFrame:
    """Adds `name`: the place (from 0) of each row in its group by `by`, groups of any size: a group that lies in several sorted
    range partitions is counted in each of them."""
    parts = df.repartitionByRange(*groups, by).withColumn("part", F.spark_partition_id())
    parts = cut_lineage(parts)
    counts = parts.groupBy("part", *groups).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition of a group
    before = counts.withColumn("before", before).where("before is not null").drop("n")
    inside = F.row_number().over(Window.partitionBy("part", *groups).orderBy(by))
    out = parts.withColumn("inside", inside).join(before, ["part", *groups], "left")
    return out.withColumn(name, (F.col("inside") - 1 + F.coalesce("before", F.lit(0))).cast("long")).drop("part", "inside", "before")
