"""Queries over references inside specifications and the nodes of these, with SQL that walks the same JSON by its own functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.operators import openapi, pointers

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def linked_specs(part: DataFrame) -> DataFrame:
    """(spec_id, json): specifications of `part`, one for each brand and openapi.PARTS keys, whose paths refer to one another.

    Of eight paths in a row the first holds a parameter, leads round to the eighth or to nothing; the others refer to the path
    before them. Some references have their tildes as percent signs, and some are read over two steps of components.
    """
    key = F.concat("p_brand", F.lit("/"), F.floor(F.col("p_partkey") / openapi.PARTS).cast("string"))
    order = Window.partitionBy("key").orderBy("p_partkey")  # at most PARTS rows
    df = part.withColumn("key", key).select("key", "p_partkey", "p_name", (F.row_number().over(order) - 1).alias("r"), F.lag("p_partkey").over(order).alias("before"), F.lead("p_partkey", 7).over(order).alias("eighth"))
    to = lambda k: F.concat(F.lit("#/paths/"), F.when(F.col("r") % 2 == 0, "~1").otherwise("%7E1"), F.lit("p"), F.when(F.col("r") % 2 == 0, "~1").otherwise("%7e1"), k.cast("string"), F.lit("/get/parameters/0"))
    ref = F.when(F.col("r") % 8 != 0, to(F.col("before"))).when(F.floor(F.col("r") / 8) % 4 == 1, F.coalesce(to(F.col("eighth")), F.lit("#/parameters/none"))).when(F.floor(F.col("r") / 8) % 4 == 2, "#/parameters/absent").when(F.floor(F.col("r") / 8) % 4 == 3, "#/parameters/second")
    value = F.to_json(F.when(ref.isNotNull(), F.struct(ref.alias("$ref"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("size"))).otherwise(F.struct(F.lit(None).cast("string").alias("$ref"), F.col("p_name").alias("name"), F.col("p_partkey").cast("int").alias("size"))))
    item = F.concat(F.lit('"/p/'), F.col("p_partkey").cast("string"), F.lit('":{"get":{"parameters":['), value, F.lit("]}}"))
    paths = df.groupBy(F.col("key").alias("spec_id")).agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("paths"))  # at most PARTS rows
    shared = F.lit('"parameters":{"first":{"name":"first","a/b~c":[1,null,true,"é\\n"]},"second":{"$ref":"#/parameters/first"},"loop":{"$ref":"#/parameters/loop"}}')
    return paths.select("spec_id", F.concat(F.lit('{"swagger":"2.0",'), shared, F.lit(',"paths":{'), "paths", F.lit("}}")).alias("json"))


#: The same specifications, made by SQL; references are followed through them by JSON pointers.
_LINKED = r"""items AS (SELECT p_brand || '/' || p_partkey // 1000 AS spec_id, p_partkey AS k, p_name, row_number() OVER w - 1 AS r, lag(p_partkey) OVER w AS before, lead(p_partkey, 7) OVER w AS eighth
    FROM part WINDOW w AS (PARTITION BY p_brand || '/' || p_partkey // 1000 ORDER BY p_partkey)),
  refs AS (SELECT *, CASE WHEN r % 8 <> 0 THEN '#/paths/' || t || 'p' || lower(t) || before || '/get/parameters/0' WHEN r // 8 % 4 = 1 THEN coalesce('#/paths/' || t || 'p' || lower(t) || eighth || '/get/parameters/0', '#/parameters/none')
    WHEN r // 8 % 4 = 2 THEN '#/parameters/absent' WHEN r // 8 % 4 = 3 THEN '#/parameters/second' END AS ref FROM (SELECT *, CASE r % 2 WHEN 0 THEN '~1' ELSE '%7E1' END AS t FROM items)),
  specs AS (SELECT spec_id, CAST('{"swagger":"2.0","parameters":{"first":{"name":"first","a/b~c":[1,null,true,"é\n"]},"second":{"$ref":"#/parameters/first"},"loop":{"$ref":"#/parameters/loop"}},"paths":{' ||
    string_agg('"/p/' || k || '":{"get":{"parameters":[' || CASE WHEN ref IS NULL THEN json_object('name', p_name, 'size', k)::VARCHAR ELSE json_object('$ref', ref)::VARCHAR END || ']}}', ',') || '}}' AS JSON) AS j FROM refs GROUP BY spec_id)"""


@_query(rf"""WITH RECURSIVE {_LINKED},
  given AS (SELECT DISTINCT spec_id, ref FROM refs WHERE ref IS NOT NULL UNION SELECT spec_id, unnest(['#/parameters/first', '#/parameters/loop']) FROM specs),
  walk AS (SELECT spec_id, ref, url_decode(ref[2:]) AS pointer, 0 AS hops FROM given
    UNION ALL SELECT w.spec_id, w.ref, url_decode(json_extract_string(j, w.pointer || '/$ref')[2:]), hops + 1 FROM walk AS w JOIN specs USING (spec_id) WHERE json_extract_string(j, w.pointer || '/$ref') IS NOT NULL AND hops < 30),
  last AS (SELECT spec_id, ref, max(hops) AS hops, arg_max(pointer, hops) AS pointer, max(pointer) FILTER (WHERE hops = 1) AS first FROM walk GROUP BY spec_id, ref)
  SELECT spec_id, ref, CASE WHEN hops = 30 THEN first ELSE pointer END AS pointer, CAST(CASE WHEN hops = 30 THEN 1 ELSE hops END AS INTEGER) AS hops,
    CASE WHEN hops = 30 THEN 'cycle' WHEN json_extract(j, pointer) IS NULL THEN 'missing' ELSE 'found' END AS state, CASE WHEN hops < 30 THEN json_extract_string(j, pointer || '/name') END AS name
  FROM last JOIN specs USING (spec_id)""")
def pointer_targets(spark, sf_dir):
    """Where each reference of the specifications leads in the end: over up to nine steps, in circles or nowhere."""
    found = pointers.targets(linked_specs(spark.read.parquet(f"{sf_dir}/part.parquet")))
    return found.select("spec_id", "ref", "pointer", "hops", "state", F.get_json_object("json", "$.name").alias("name"))


@_query(rf"""WITH RECURSIVE {_LINKED},
  n AS (SELECT spec_id, '' AS pointer, 0 AS depth, j FROM specs
    UNION ALL SELECT spec_id, pointer || '/' || replace(replace(e.key, '~', '~0'), '/', '~1'), depth + 1, e.value FROM n, json_each(n.j) AS e WHERE json_type(n.j) IN ('OBJECT', 'ARRAY'))
  SELECT spec_id, pointer, depth, CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
    CASE WHEN json_type(j) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN j->>'$' END AS said FROM n""")
def specification_nodes(spark, sf_dir):
    """Every node of the specifications; `said` is a scalar's text."""
    found = pointers.nodes(linked_specs(spark.read.parquet(f"{sf_dir}/part.parquet"))).withColumn("json", F.to_json("value"))
    kind = pointers.kind(F.col("json"))
    said = F.when(~kind.isin("object", "array", "null"), F.try_variant_get("value", "$", "string"))
    return found.select("spec_id", "pointer", "depth", kind.alias("kind"), said.alias("said"))
