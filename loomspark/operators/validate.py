"""Conformance checks of a bundle's files, as rows, and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import classify
from loomspark.operators import front

#: Fixed values of the bundle format: the root index's version key and the versions known.
VERSION_KEY, VERSIONS = "okf_version", ("0.2", "0.1")
_FOUND = "array<struct<check:string,severity:string,passed:boolean>>"


def verified_by(values: str = "front.values") -> Column:
    """Actors of the front matter's `verified`, given as a list or as a single mapping; '' for an entry that names none."""
    return F.transform(front.entries("verified", values), lambda e: F.coalesce(F.try_variant_get(e, "$.by", "string"), F.lit("")))


def _finding(when: Column, name: str, severity: str, passed: Column) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), passed.alias("passed")))


def checks(files: DataFrame) -> DataFrame:
    """(path, check, severity, passed): a row per finding about each file, and one each for the root index and the log.

    files: path and content, or these with `front` (see front.parsed). Concepts must have front matter that is closed and holds a
    `type`, which is text; sub-indexes should have none, logs should have a dated heading, the root index should name a known
    version, computations must have a runtime. Front matter must be YAML and a mapping, or nothing in it is checked; `sources`
    should be a list whose entries have a resource.
    """
    text, state = F.coalesce("content", F.lit("")), F.col("front.state")
    role, kind = F.col("role"), front.value("type")
    df = front.parsed(files).withColumn("role", classify.file_role(F.col("path")))
    opened, closed = state != "absent", ~state.isin("absent", "open")
    concept, top = role == "concept", role == "root_index"
    sound, listed = concept & (state == "ok"), front.is_list("sources")
    found = F.array(
        _finding(top, "version", "warning", front.value(VERSION_KEY).isin(*VERSIONS)),
        _finding(top & opened, "root_index_parses", "error", state != "unparseable"),
        _finding(role == "index", "index_without_front_matter", "warning", ~opened),
        _finding(role == "log", "dated_log", "warning", text.rlike(r"(?m)^## [0-9]{4}-[0-9]{2}-[0-9]{2}")),
        _finding(concept, "front_matter_present", "error", opened),
        _finding(concept & opened, "front_matter_closed", "error", closed),
        _finding(concept & closed, "front_matter_parses", "error", state != "unparseable"),
        _finding(concept & closed & (state != "unparseable"), "front_matter_mapping", "error", state != "no_mapping"),
        _finding(sound, "type_present", "error", front.is_text("type") & (kind != "")),
        _finding(sound & (kind == "Attested Computation"), "runtime_present", "error", front.value("runtime") != ""),
        _finding(sound & front.given("sources"), "sources_list", "warning", listed),
    )
    named = lambda e: F.coalesce(F.try_variant_get(e, "$.resource", "string"), F.lit("")) != ""
    cited = F.transform(front.entries("sources"), lambda e: F.struct(F.lit("source_resource").alias("check"), F.lit("warning").alias("severity"), named(e).alias("passed")))
    found = F.concat(F.array_compact(found), F.when(sound & listed, cited).otherwise(F.array().cast(_FOUND)))
    each = df.select("path", F.explode(found).alias("f")).select("path", "f.*")
    there = files.select("path").agg(F.coalesce(F.max(F.col("path") == "index.md"), F.lit(False)).alias("r"), F.coalesce(F.max(F.col("path") == "log.md"), F.lit(False)).alias("l"))
    exists = lambda path, name, passed: F.struct(F.lit(path).alias("path"), F.lit(name).alias("check"), F.lit("error").alias("severity"), F.col(passed).alias("passed"))
    must = there.select(F.explode(F.array(exists("index.md", "root_index_exists", "r"), exists("log.md", "log_exists", "l"))).alias("f"))
    return each.unionByName(must.select("f.*"))


def report(found: DataFrame) -> DataFrame:
    """(valid, errors, warnings, n_checks): one row; valid if no error-level check failed."""
    bad = ~F.col("passed")
    return found.agg(F.coalesce(~F.bool_or(bad & (F.col("severity") == "error")), F.lit(True)).alias("valid"), F.count_if(bad & (F.col("severity") == "error")).alias("errors"), F.count_if(bad & (F.col("severity") == "warning")).alias("warnings"), F.count("*").alias("n_checks"))


def type_histogram(files: DataFrame) -> DataFrame:
    """(type, n) of the concepts that have one."""
    df = front.parsed(files.where(classify.file_role(F.col("path")) == "concept")).select(front.value("type").alias("type"))
    return df.where("type != ''").groupBy("type").agg(F.count("*").alias("n"))


def trust_summary(concepts: DataFrame) -> DataFrame:
    """(tier, n): how many concepts (with an array `verified_by`) are of each trust tier."""
    return concepts.select(classify.trust_tier(F.col("verified_by")).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))
