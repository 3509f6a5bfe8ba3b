"""What a bundle's reader asks: staleness, usage windows, attribution, tags, log entries, actors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import classify
from loomspark.operators import front, validate


def staleness(concepts: DataFrame, today: str) -> DataFrame:
    """Adds `status` (stable if absent) and `stale`: whether `today` has reached stale_after; no date is never stale."""
    when = F.try_to_date("stale_after", "yyyy-MM-dd") if dict(concepts.dtypes)["stale_after"] == "string" else F.col("stale_after")
    return concepts.withColumn("status", F.coalesce("status", F.lit("stable"))).withColumn("stale", F.coalesce(F.lit(today).cast("date") >= when, F.lit(False)))


def effective_windows(entries: DataFrame, shared: DataFrame, key: str) -> DataFrame:
    """Adds `window` to entries (key, own_window): its own, else the one its document shares (key, shared_window)."""
    return entries.join(shared, key, "left").withColumn("window", F.coalesce("own_window", "shared_window")).drop("own_window", "shared_window")


def footnotes(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, label, resolved): each footnote reference of a file, and whether its sources (path, id) have that id."""
    refs = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"\[\^([^\]]+)\]"), F.lit(1)))).alias("label"))
    known = sources.select("path", F.col("id").alias("label"), F.lit(True).alias("known")).distinct()
    return refs.join(known, ["path", "label"], "left").select("path", "label", F.coalesce("known", F.lit(False)).alias("resolved"))


def tag_view(concepts: DataFrame, key: str) -> DataFrame:
    """(tag, n, first): how many concepts have each tag, and the first of them."""
    each = concepts.select(key, F.explode(F.array_distinct("tags")).alias("tag"))
    return each.groupBy("tag").agg(F.count("*").alias("n"), F.min(key).alias("first"))


def latest_verification(verified: DataFrame, key: str, order: str) -> DataFrame:
    """(key, verified_at, verified_by): the latest of each concept's verifications (key, at, by); of one time the last by `order`."""
    return verified.groupBy(key).agg(F.max("at").alias("verified_at"), F.max_by("by", F.struct("at", order)).alias("verified_by"))


def provenance(files: DataFrame) -> DataFrame:
    """(path, generated_at, verified_at, sources) of concept files (path, content), with what older versions of the format have instead.

    generated_at is `generated.at`, else the top-level `timestamp`; verified_at the latest `at` of `verified`, as a list or one
    mapping; sources the `resource` of each entry of `sources`, else the links in the list under the heading Citations.
    """
    cited = F.regexp_extract(F.coalesce("content", F.lit("")), r"(?m)^#{1,6} Citations[ \t]*\r?\n((?:(?!#).*(?:\r?\n|$))*)", 1)
    links = F.regexp_extract_all(cited, F.lit(r"(?m)^[ \t]*(?:[-*+]|\d+\.).*?(?:\]\(|<|(?=https?://))([^)>\s]+)"), F.lit(1))
    some = lambda key: F.nullif(front.value(key), F.lit(""))
    listed = front.fields("sources", "resource")
    return front.parsed(files).select(
        "path", F.coalesce(some("generated.at"), some("timestamp")).alias("generated_at"), F.array_max(front.fields("verified", "at")).alias("verified_at"),
        F.when(F.size(listed) > 0, listed).otherwise(links).alias("sources"),
    )


def lifecycle(files: DataFrame, today: str) -> DataFrame:
    """(path, status, stale_after, stale, tier) of concept files, as their front matter says: stable and never stale where it says nothing."""
    some = lambda key: F.nullif(front.value(key), F.lit(""))
    said = front.parsed(files).select("path", some("status").alias("status"), some("stale_after").alias("stale_after"), classify.trust_tier(validate.verified_by()).alias("tier"))
    return staleness(said, today).select("path", "status", "stale_after", "stale", "tier")


def log_entries(logs: DataFrame) -> DataFrame:
    """(path, date, entry_no, entry): the dated entries of log files (path, content); the newest dates first when sorted by date."""
    parts = F.split(F.coalesce("content", F.lit("")), r"(?m)^## ")
    groups = logs.select("path", F.explode(F.filter(parts, lambda p: p.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"))).alias("g"))
    entries = F.regexp_extract_all("g", F.lit(r"(?m)^\* (.*)$"), F.lit(1))
    return groups.select("path", F.substring("g", 1, 10).alias("date"), F.posexplode(entries).alias("entry_no", "entry"))
