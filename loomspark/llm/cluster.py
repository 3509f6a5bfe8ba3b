"""Connected components of documents that share buckets, with every link confirmed; no group's pairs are all made.

Buckets of any size are worked through in rounds: each member is first held against one leader of its bucket,
then what is still outside the bucket's largest component against other leaders. What is left after that is either
unlinked or linked in an unusual way; it is held against all of its buckets' members, by `rest`. Members that are
already connected are never compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm import common

#: Leaders of the second round, for each bucket.
LEADERS = 3


def components(links: DataFrame) -> DataFrame:
    """(id, component) of each end of `links` (a, b): component is the smallest id that can be reached.

    Large-star and small-star steps by joins, until nothing changes. No ends are collected.
    """
    links = common.materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        links = common.materialize(small)
        # Done when all are stars: every end hangs on one centre, and no centre hangs on another.
        ends = links.select("u", F.lit(1).alias("hangs")).unionByName(links.select(F.col("v").alias("u"), F.lit(0).alias("hangs")))
        if ends.groupBy("u").agg(F.sum("hangs").alias("n"), F.min("hangs").alias("centre")).where("n > 1 or (n = 1 and centre = 0)").isEmpty():
            break
    ends = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def blockwise(now: DataFrame, by: str, payload: DataFrame, weight: Column, block: int, links_of: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Links (a, b) of members outside their bucket's major component with any other of the same `by`, found inside tasks.

    now: key, id, component, major; by: one of its columns; payload: id and what links_of needs. The members of one `by` are
    dealt into blocks of about `block` of the summed weight, guests (members outside the major component) go to every block
    of it; small ones share a task, of about `block` of the summed weight as well. links_of takes the rows of one block (id, component,
    guest and the payload) and returns the links of its guests: only those leave the task, not the pairs.
    """
    region = now.groupBy(by, "id", "component").agg(F.max(F.col("component") != F.col("major")).alias("guest")).join(payload, "id")
    blocks = lambda n: F.greatest(F.ceil(F.coalesce(n, F.lit(0)) / block), F.lit(1)).cast("int")
    sizes = region.groupBy(by).agg(F.sum(weight).alias("weight"), blocks(F.sum(weight)).alias("nh"), blocks(F.sum(F.when(F.col("guest"), weight))).alias("ng"))
    sizes = common.materialize(sizes)  # a row per region
    groups = max(1, int((sizes.agg(F.sum("weight")).first()[0] or 0) // block))
    region = region.join(sizes.drop("weight"), by)
    share = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    held = region.withColumn("guest", F.lit(False)).withColumn("h", share("nh")).withColumn("g", every("ng"))
    guests = region.where("guest").withColumn("g", share("ng")).withColumn("h", every("nh"))
    rows = held.unionByName(guests).drop("nh", "ng").withColumnRenamed(by, "region").withColumn("at", F.pmod(F.xxhash64("region"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("region")
        keys = table.column("region").to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        found = [links_of(table.slice(x, y - x)) for x, y in zip(edges, edges[1:])]
        return pa.concat_tables(found)

    return rows.groupBy("at", "g", "h").applyInArrow(run, "a long, b long").distinct()


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    both = left.join(right, "key").where("cx != cy")
    return common.materialize(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def linked(members: DataFrame, verify: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, component) of the members that have links; all links between members of a common bucket count.

    members: key (any type) and id, each pair once. verify: takes pairs (a, b), a < b, each once, and returns those that
    are links. rest: takes (key, id, component, major) of the buckets that still hold several components, and returns
    the links (a, b) of members outside their bucket's major component with any member of another component. Ids
    without any link may be missing from the result.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lead")).where("n > 1")
    members = common.materialize(members.join(sizes, "key"))
    pairs = common.materialize(members.where("id > lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    links = common.materialize(verify(pairs))
    for last in (False, True):
        now = members.select("key", "id").join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
        now = common.materialize(now)
        counts = now.groupBy("key", "component").agg(F.count("*").alias("n"))
        major = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
        now = common.materialize(now.join(major, "key"))
        if now.isEmpty():
            break
        if last:
            found = rest(now)
        else:
            ranked = now.where("component = major")
            picks = F.array(*(F.min_by(F.struct(F.col("id").alias("y"), F.col("component").alias("cy")), F.xxhash64("id", F.lit(k))) for k in range(LEADERS)))
            lead = ranked.groupBy("key").agg(F.array_distinct(picks).alias("p")).select("key", F.explode("p").alias("p")).select("key", "p.*")
            found = verify(_pairs(now.where("component != major").select("key", F.col("id").alias("x"), F.col("component").alias("cx")), lead))
        links = common.materialize(links.select("a", "b").unionByName(found.select("a", "b")))
    return components(links)
