"""Queries over front matter that says more than one plain line a key, with SQL that knows what the files were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import front, trust

QUERIES: dict = {}
ORACLE_SQL: dict = {}
TODAY = "2024-01-15"


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def annotated_files(pages: DataFrame) -> DataFrame:
    """(path, content) of pages: comments, quotes around colons, folded text, anchors, flow mappings, keys that are numbers, keys that
    nobody knows, and the page's whole html as the body. Every seventh file verifies by one mapping, every fifth has older keys."""
    i = F.col("page_id")
    s, day = i.cast("string"), F.lpad((1 + i % 28).cast("string"), 2, "0")
    front_lines = F.concat(
        F.lit('# made of a page\ntype: "Guide: part" # not the plain text\ntitle: \'It\'\'s '), s, F.lit("'\n"), s, F.lit(": number key\ndescription: >\n  first line\n  second "), s, F.lit("\n"),
        F.when(i % 5 == 0, F.concat(F.lit("timestamp: 2023-12-"), day, F.lit("\n"))).otherwise(F.concat(F.lit("generated: &who {by: process:ci, at: 2024-01-"), day, F.lit("}\nreviewed: *who\n"))),
        F.when(i % 7 == 0, F.concat(F.lit("verified: {by: process:ci, at: 2024-02-"), day, F.lit("}\n"))).when(i % 7 < 4, F.concat(F.lit("verified:\n- by: human:ana\n  at: 2024-02-01\n- {at: \"2024-02-"), day, F.lit('", by: process:ci}\n'))).otherwise(""),
        F.lit("stale_after: 2024-01-"), day, F.when(i % 3 == 0, "\nstatus: 'draft'").otherwise(""), F.lit('\nsources:\n- {id: s0, resource: "https://x.example/a: b#'), s, F.lit('"}\n- id: s1\nx-owner: {team: data, ids: [1, '), s, F.lit("], none: ~}\n"),
    )
    return pages.select(F.concat(F.lit("p"), s, F.lit(".md")).alias("path"), F.concat(F.lit("---\n"), front_lines, F.lit("---\n"), F.coalesce("html", F.lit(""))).alias("content"))


#: What such a file says, key by key; `extra` are the lines of unknown keys, `known` those of the others.
_SAID = r"""p AS (SELECT page_id AS i, 'p' || page_id || '.md' AS path, lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') AS d, coalesce(html, '') AS body FROM pages),
  x AS (SELECT *, '{"at":"2024-01-' || d || '","by":"process:ci"}' AS who, '{"at":"2024-02-' || d || '","by":"process:ci"}' AS ci FROM p),
  said AS (SELECT *, '"' || i || '": "number key"' || chr(10) || CASE WHEN i % 5 <> 0 THEN 'reviewed: ' || who || chr(10) ELSE '' END || 'stale_after: "2024-01-' || d || '"' || chr(10)
      || CASE WHEN i % 5 = 0 THEN 'timestamp: "2023-12-' || d || '"' || chr(10) ELSE '' END || 'x-owner: {"ids":[1,' || i || '],"none":null,"team":"data"}' || chr(10) AS extra,
    'type: "Guide: part"' || chr(10) || 'title: "It''s ' || i || '"' || chr(10) || 'description: "first line second ' || i || '\n"' || chr(10) || CASE WHEN i % 3 = 0 THEN 'status: "draft"' || chr(10) ELSE '' END
      || CASE WHEN i % 5 <> 0 THEN 'generated: ' || who || chr(10) ELSE '' END || CASE WHEN i % 7 = 0 THEN 'verified: ' || ci || chr(10) WHEN i % 7 < 4 THEN 'verified: [{"at":"2024-02-01","by":"human:ana"},' || ci || ']' || chr(10) ELSE '' END
      || 'sources: [{"id":"s0","resource":"https://x.example/a: b#' || i || '"},{"id":"s1"}]' || chr(10) AS known FROM x)"""


@_query(rf"WITH {_SAID} SELECT path, 'ok' AS state, 'Guide: part' AS type, 'It''s ' || i AS title, 'first line second ' || i AS description, extra, md5(body) AS body_md5 FROM said")
def front_values(spark, sf_dir):
    """What each file's front matter says, unknown keys as they will be written, and the digest of the body."""
    df = front.parsed(annotated_files(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return df.select("path", "front.state", *(front.value(k).alias(k) for k in ("type", "title", "description")), front.extensions(F.col("front.values")).alias("extra"), F.md5("front.body").alias("body_md5"))


@_query(rf"WITH {_SAID} SELECT path, md5('---' || chr(10) || known || extra || '---' || chr(10) || body) AS file_md5, true AS same FROM said")
def front_round_trip(spark, sf_dir):
    """Each file written from what was read: its digest, and whether reading it again gives the same values and body."""
    df = front.parsed(annotated_files(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    df = df.select("path", front.written(F.col("front.values"), F.col("front.body")).alias("content"), F.to_json("front.values").alias("before"), F.col("front.body").alias("body"))
    same = (F.to_json("front.values") == F.col("before")) & (F.col("front.body") == F.col("body")) & (F.col("front.state") == "ok")
    return front.parsed(df).select("path", F.md5("content").alias("file_md5"), same.alias("same"))


@_query(rf"""WITH {_SAID} SELECT path, CASE WHEN i % 3 = 0 THEN 'draft' ELSE 'stable' END AS status, '2024-01-' || d AS stale_after, '2024-01-' || d <= '{TODAY}' AS stale,
  CASE WHEN i % 7 = 0 THEN 'machineConfirmed' WHEN i % 7 < 4 THEN 'humanReviewed' ELSE 'unverified' END AS tier FROM said""")
def file_lifecycle(spark, sf_dir):
    """Status, staleness and trust of each file, from its front matter."""
    return trust.lifecycle(annotated_files(spark.read.parquet(f"{sf_dir}/pages.parquet")), TODAY)


@_query(rf"""WITH {_SAID} SELECT path, CASE WHEN i % 5 = 0 THEN '2023-12-' ELSE '2024-01-' END || d AS generated_at, CASE WHEN i % 7 < 4 THEN '2024-02-' || d END AS verified_at, 'https://x.example/a: b#' || i AS sources FROM said""")
def file_provenance(spark, sf_dir):
    """When each file was made and last verified, and what it was made of; older keys count where newer ones lack."""
    found = trust.provenance(annotated_files(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.withColumn("sources", F.array_join("sources", " "))
