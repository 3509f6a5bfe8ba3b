"""Markdown headings, code blocks and the split of a catalogue into one concept per section."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import batches, text

MIN_SECTIONS, MAX_SECTIONS, MIN_PROSE = 3, 50, 100
_HEADING = r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$"


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_MARK = re.compile(r" {0,3}#{1,6}\s+.")


def outline(markdown: str | None) -> list[int]:
    """The numbers (from 0) of the lines outside code fences that may be headings; a fence ends at one of the sign that opened it."""
    found, open_ = [], ""
    for k, line in enumerate(re.split(r"\r?\n", markdown or "")):
        if m := _FENCE.match(line):
            open_ = m[1][0] if not open_ else "" if open_ == m[1][0] else open_
        elif not open_ and _MARK.match(line):
            found.append(k)
    return found


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: a generator keeps the optimizer from copying its expression into each use, loops over arrays included."""
    return df.withColumn(name, F.explode_outer(F.array(value)))


def _outlined(docs: DataFrame, column: str) -> DataFrame:
    """Adds `lines` and `heads`: the ATX headings outside fences that have a text, as (line_no, level, heading, raw), all inside the row."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(outline, na_action=None)

    batches.small(docs.sparkSession)
    body = F.coalesce(column, F.lit(""))
    df = once(docs.withColumn("at", run(body)), "lines", F.split(body, "\r?\n"))
    raw = F.transform("at", lambda k: F.struct(k.alias("line_no"), F.get("lines", k).alias("raw")))
    rows = F.transform(F.filter(raw, lambda h: h["raw"].rlike(_HEADING)), lambda h: F.struct(h["line_no"].alias("line_no"), F.length(F.regexp_extract(h["raw"], _HEADING, 1)).alias("level"), text.strip_markdown(F.regexp_extract(h["raw"], _HEADING, 2)).alias("heading"), h["raw"].alias("raw")))
    return once(df, "heads", F.filter(rows, lambda h: h["heading"] != "")).drop("at")


def headings(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, line_no, level, heading, raw) of the ATX headings outside fences that have a text."""
    return _outlined(docs.select(key, column), column).select(key, F.explode("heads").alias("h")).select(key, "h.*")


def _split_level(heads: str, least: int) -> Column:
    often = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.when(F.size(F.filter(heads, lambda h: h["level"] == k)) >= least, k))
    return F.array_min(often)


def split_level(docs: DataFrame, key: str, column: str, least: int = MIN_SECTIONS) -> DataFrame:
    """(key, split_level): the shallowest level of which a document has `least` headings; no row without one."""
    return _outlined(docs.select(key, column), column).select(key, _split_level("heads", least).alias("split_level")).where("split_level is not null")


def split_sections(docs: DataFrame, key: str, column: str, min_prose: int = MIN_PROSE, least: int = MIN_SECTIONS, most: int = MAX_SECTIONS) -> DataFrame:
    """(key, sec_ord, title, level, body) of the documents that read as a catalogue of sections.

    A block runs from a heading of the split level or above to the next. Blocks of less prose than `min_prose` are
    folded, heading and all, into the kept block before them, or into the preamble (sec_ord 0, title null), which is there
    for every split document. Documents with fewer kept blocks than `least` or more than `most` are not split: no rows.
    A document is split inside its row: no text is shuffled, and documents of one key are split each for itself.
    """
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    df = _outlined(docs.select(key, trimmed(F.coalesce(column, F.lit(""))).alias(column)), column).drop(column)
    df = once(df, "top", _split_level("heads", least)).where("top is not null")
    starts = F.filter("heads", lambda h: h["level"] <= F.col("top"))
    # Each block ends where the next one begins; the first has no heading.
    df = once(df, "starts", F.concat(F.array(F.struct(F.lit(-1).alias("line_no"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("string").alias("raw"))), starts)).drop("heads")
    end = lambda i: F.coalesce(F.get("starts", i + 1)["line_no"], F.size("lines"))
    body = lambda s, i: trimmed(F.array_join(F.slice("lines", s["line_no"] + 2, end(i) - s["line_no"] - 1), "\n"))
    df = once(df, "blocks", F.transform("starts", lambda s, i: F.struct(s["level"].alias("level"), s["heading"].alias("title"), s["raw"].alias("raw"), body(s, i).alias("body")))).drop("lines", "starts")
    numbered = F.transform("blocks", lambda b, i: F.when((i > 0) & (text.prose_length(b["body"]) >= min_prose), i))
    df = once(df, "kept", F.concat(F.array(F.lit(0)), F.array_compact(numbered))).where(F.size("kept").between(least + 1, most + 1))
    flush = lambda b: F.regexp_replace(b["raw"], r"^ {1,3}(?=#)", "")
    folded = lambda b: F.when(b["body"] != "", F.concat_ws("\n\n", flush(b), b["body"])).otherwise(flush(b))
    until = lambda g: F.coalesce(F.get("kept", g + 1), F.size("blocks"))
    whole = lambda k, g: F.array_join(F.concat(F.array(F.nullif(F.get("blocks", k)["body"], F.lit(""))), F.transform(F.slice("blocks", k + 2, until(g) - k - 1), folded)), "\n\n")
    parts = F.transform("kept", lambda k, g: F.struct(g.alias("sec_ord"), F.get("blocks", k)["title"].alias("title"), F.get("blocks", k)["level"].alias("level"), whole(k, g).alias("body")))
    return df.select(key, F.explode(parts).alias("p")).select(key, "p.*")


def section_concepts(sections: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, sec_ord, url, title, description, slug, folder) of the kept sections; folder is the slug of the document's title."""
    parents = docs.select(key, F.col("url").alias("parent"), text.slug("title").alias("folder"))
    df = sections.where("sec_ord > 0").join(parents, key)
    said = text.first_sentence("body")
    return df.select(key, "sec_ord", F.concat("parent", F.lit("#"), text.slug("title")).alias("url"), "title", said.alias("description"), text.truncate_slug(text.slug("title")).alias("slug"), "folder")
