"""References inside JSON documents: a table of nodes, made level by level, and references followed to their ends by joins.

A node is told by its JSON pointer. Only nodes on the way to a wanted pointer are taken apart, so that a document of which a few places are
referred to costs its text once per level of these. References that lead to references are followed by doubling: after k rounds a
reference knows where 2 ** k steps lead. All nodes of a chain are in the table, so each round ends some, as long as any chain is
open; when a round ends none, those that are left run in circles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators import graph

#: Where a node is a reference, this member says to what.
REF = "$ref"


def token(key: Column) -> Column:
    """A key as a part of a pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_of(ref: Column) -> Column:
    """The pointer of a local reference (`#`, `#/a/b`): percent signs decoded, a `~` that escapes nothing stands for itself; null for other references."""
    decoded = F.coalesce(F.try_url_decode(F.replace(F.substring(ref, 2, 1 << 20), F.lit("+"), F.lit("%2B"))), F.substring(ref, 2, 1 << 20))
    return F.when(ref.rlike("^#(/|$)"), F.regexp_replace(decoded, "~(?![01])", "~0"))


def _value(df: DataFrame) -> DataFrame:
    return df.select("spec_id", F.lit("").alias("pointer"), F.lit(0).alias("depth"), F.try_parse_json("json").alias("value")).where("value is not null")


def _children(level: DataFrame) -> DataFrame:
    inside = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("pos", "key", "child"))
    at = F.concat("pointer", F.lit("/"), F.coalesce(token(F.col("key")), F.col("pos").cast("string")))
    return inside.select("spec_id", at.alias("pointer"), (F.col("depth") + 1).alias("depth"), F.col("child").alias("value"))


def nodes(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(spec_id, pointer, depth, value): the nodes of JSON documents (spec_id, json), or those that `wanted` (spec_id, pointer) names.

    The root's pointer is ''. A text that is no JSON has no nodes, a wanted pointer that leads nowhere has none. A level is a
    join and a write; the last is that of the deepest node, or of the longest wanted pointer.
    """
    level = graph.cut_lineage(_value(docs))
    if wanted is None:
        found, last = level, None
    else:
        cut = F.split("pointer", "/")
        ways = wanted.select("spec_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(cut)), lambda k: F.array_join(F.slice(cut, F.lit(1), k), "/"))).alias("pointer")).distinct()
        ways = graph.cut_lineage(ways.withColumn("depth", F.size(F.split("pointer", "/")) - 1))
        last = ways.agg(F.max("depth")).first()[0] or 0
        ends = wanted.select("spec_id", "pointer").distinct()
        found = level
    depth = 0
    while last is None or depth < last:
        depth += 1
        below = _children(level)
        if wanted is not None:
            below = below.join(ways.where(F.col("depth") == depth).drop("depth"), ["spec_id", "pointer"], "left_semi")
        level = graph.cut_lineage(below)
        if last is None and level.isEmpty():
            break
        found = found.unionByName(level)
    return found if wanted is None else found.join(ends, ["spec_id", "pointer"], "left_semi")


def kind(json: Column) -> Column:
    """object, array, string, boolean, null or number of a value's JSON."""
    first = F.left(json, F.lit(1))
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")


def references(docs: DataFrame) -> DataFrame:
    """(spec_id, ref, pointer): the distinct local references of each document, as they are written (escapes undone) and as pointers."""
    written = F.regexp_extract_all("json", F.lit(r'"\$ref"\s*:\s*"(#(?:[^"\\]|\\.)*)"'), F.lit(1))
    df = docs.select("spec_id", F.explode(F.array_distinct(written)).alias("ref"))
    plain = F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), "ref", F.lit('"'))), "$", "string")
    df = df.select("spec_id", F.when(F.contains("ref", F.lit("\\")), F.coalesce(plain, "ref")).otherwise(F.col("ref")).alias("ref"))
    return df.select("spec_id", "ref", pointer_of(F.col("ref")).alias("pointer")).where("pointer is not null").distinct()


def targets(docs: DataFrame) -> DataFrame:
    """(spec_id, ref, pointer, hops, state, json): where each local reference of JSON documents (spec_id, json) leads in the end.

    state is found, missing (it, or a reference that it leads to, names no node) or cycle; hops counts the references on the way
    after the first, pointer is the last one followed. json is null unless found. In a cycle pointer and hops are those of the first step. References to
    other documents are no local ones: a chain ends at them. spec_id must be unique. Documents without references have no row.
    """
    refs = graph.cut_lineage(references(docs))
    if refs.isEmpty():
        return refs.select("spec_id", "ref", "pointer", F.lit(0).alias("hops"), F.lit("found").alias("state"), F.lit(None).cast("string").alias("json"))
    there = nodes(docs, refs.select("spec_id", "pointer"))
    # The member is read where it is a string, as a schema may have a property of that name.
    onward = pointer_of(F.try_variant_get("value", f"$['{REF}']", "string"))
    there = graph.cut_lineage(there.select("spec_id", "pointer", F.to_json("value").alias("json"), onward.alias("next")))
    done = there.where("next is null").select("spec_id", F.col("pointer").alias("at"), F.col("pointer").alias("end"), F.lit(0).alias("hops"))
    # Open: a node leads to `to` after `hops` steps. Each round a node takes its target's own steps.
    steps = there.where("next is not null").select("spec_id", F.col("pointer").alias("at"), F.col("next").alias("to"), F.lit(1).alias("hops"))
    left, ended = steps.count(), done
    first = steps
    while left:
        ends = ended.select("spec_id", F.col("at").alias("to"), "end", F.col("hops").alias("more"))
        known = there.select("spec_id", F.col("pointer").alias("to"), F.lit(True).alias("known"))
        met = graph.cut_lineage(steps.join(ends, ["spec_id", "to"], "left").join(known, ["spec_id", "to"], "left"))
        over = met.where("end is not null or known is null").select("spec_id", "at", F.coalesce("end", "to").alias("end"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        ended = graph.cut_lineage(ended.unionByName(over))
        onwards = met.where("end is null and known").select("spec_id", "at", "to", "hops")
        own = onwards.select("spec_id", F.col("at").alias("to"), F.col("to").alias("then"), F.col("hops").alias("more"))
        steps = graph.cut_lineage(onwards.join(own, ["spec_id", "to"], "left").select("spec_id", "at", F.coalesce("then", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
        before, left = left, steps.count()
        if left == before:
            break
    circles = first.join(steps.select("spec_id", "at"), ["spec_id", "at"], "left_semi").select("spec_id", "at", F.col("to").alias("end"), "hops", F.lit(True).alias("circle")) if left else None
    ended = ended.withColumn("circle", F.lit(False))
    ended = ended.unionByName(circles) if circles is not None else ended
    out = refs.join(ended.withColumnRenamed("at", "pointer"), ["spec_id", "pointer"], "left")
    out = out.select("spec_id", "ref", F.coalesce("end", "pointer").alias("pointer"), F.coalesce("hops", F.lit(0)).alias("hops"), F.coalesce("circle", F.lit(False)).alias("circle"))
    out = out.join(there.select("spec_id", "pointer", "json", F.lit(True).alias("known")), ["spec_id", "pointer"], "left")
    state = F.when(F.col("circle"), "cycle").when(F.col("known"), "found").otherwise("missing")
    return out.select("spec_id", "ref", "pointer", "hops", state.alias("state"), F.when(state == "found", F.col("json")).alias("json"))
