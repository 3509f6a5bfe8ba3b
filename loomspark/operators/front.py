"""Front matter as a VARIANT: parsed once a file, read by every check, view and graph, and written back with the keys nobody knows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import batches
from loomspark.parsing import front as reading

#: Keys that a bundle's producer writes itself, in the order of the file; all others are carried on as they are.
WRITTEN = ("type", "title", "description", "resource", "tags", "status", "generated", "verified", "sources")
#: reading.BLOCK, as Java has it.
_BLOCK = r"(?s)\A\x{FEFF}{0,2}---[ \t]*\r?\n(.*?)(?:(?<=\n)|\r?\n)---[ \t]*(?:\r?\n|\z)"
#: The parsed column: state (absent, open, unparseable, no_mapping, ok), values, body.
FRONT = "front"


def read(content: Column) -> Column:
    """struct<state, values: JSON text of an object, body> of texts; null counts as empty. Only the front matter itself goes to Python."""

    @F.pandas_udf("state string, values string, used int")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in series:
            found = [(reading.read(x), len(x)) for x in s]
            yield pd.DataFrame([(state, values, n - len(body)) for (state, values, body), n in found], columns=["state", "values", "used"], dtype=object)

    batches.small()
    text = F.coalesce(content, F.lit(""))
    # What has no closing line tells by its first signs whether it has an opening one.
    head = F.coalesce(F.nullif(F.regexp_extract(text, _BLOCK, 0), F.lit("")), F.left(text, F.lit(4)))
    found = run(F.when(F.startswith(text, F.lit("---")) | F.startswith(text, F.lit("\ufeff")), head).otherwise(""))
    return F.struct(found["state"].alias("state"), found["values"].alias("values"), F.substring(text, found["used"] + 1, F.lit(1 << 30)).alias("body"))


def parsed(files: DataFrame) -> DataFrame:
    """Adds `front` (state, values as VARIANT, body) to files (path, content), unless they have it already."""
    if FRONT in files.columns:
        return files
    # A generator keeps the optimizer from copying what makes a text into each of its uses.
    df = files.withColumn("_text", F.explode_outer(F.array("content")))
    df = df.withColumn("_read", read(F.col("_text"))).withColumn("_values", F.try_parse_json("_read.values"))
    # Values that are too large for a VARIANT count as none.
    state = F.when(F.col("_values").isNull(), F.lit(reading.UNPARSEABLE)).otherwise(F.col("_read.state"))
    made = F.struct(state.alias("state"), F.coalesce("_values", F.parse_json(F.lit("{}"))).alias("values"), F.col("_read.body").alias("body"))
    return df.withColumn(FRONT, made).drop("_text", "_read", "_values")


def _path(key: str) -> str:
    return "$" + "".join(f"['{k}']" for k in key.split("."))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def value(key: str, values: str = f"{FRONT}.values") -> Column:
    """A value as text; '' if it is absent, null or no scalar. A dot leads into a mapping."""
    return F.coalesce(_trimmed(F.try_variant_get(values, _path(key), "string")), F.lit(""))


def given(key: str, values: str = f"{FRONT}.values") -> Column:
    """Whether a key has a value other than null."""
    whole = F.try_variant_get(values, _path(key), "variant")
    return whole.isNotNull() & ~F.is_variant_null(whole)


def entries(key: str, values: str = f"{FRONT}.values") -> Column:
    """The entries of a list, or of one value as a list of it; none if it is absent or null."""
    listed = F.coalesce(F.try_variant_get(values, _path(key), "array<variant>"), F.array(F.try_variant_get(values, _path(key), "variant")))
    return F.when(given(key, values), listed).otherwise(F.array().cast("array<variant>"))


def fields(key: str, field: str, values: str = f"{FRONT}.values") -> Column:
    """A field of each entry of a list (or of one mapping), as text; entries without it give none."""
    said = F.transform(entries(key, values), lambda e: F.nullif(_trimmed(F.try_variant_get(e, _path(field), "string")), F.lit("")))
    return F.filter(said, lambda x: x.isNotNull())


def is_list(key: str, values: str = f"{FRONT}.values") -> Column:
    """Whether a value is a list."""
    return F.try_variant_get(values, _path(key), "array<variant>").isNotNull()


def is_text(key: str, values: str = f"{FRONT}.values") -> Column:
    """Whether a value is text."""
    return F.coalesce(F.startswith(F.to_json(F.try_variant_get(values, _path(key), "variant")), F.lit('"')), F.lit(False))


def extensions(values: Column, known: tuple[str, ...] = WRITTEN) -> Column:
    """The lines of the keys that are not `known`, by name: YAML whose keys and values are written as JSON; '' if there are none."""
    own = F.filter(F.map_entries(F.coalesce(F.try_variant_get(values, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))), lambda e: ~e["key"].isin(*known))
    lines = F.transform(own, lambda e: F.concat(_name(e["key"]), F.lit(": "), F.coalesce(F.to_json(e["value"]), F.lit("null")), F.lit("\n")))
    return F.array_join(lines, "")


def _name(key: Column) -> Column:
    """A key as YAML: bare where it is a plain word, else as JSON."""
    quoted = F.regexp_replace(F.to_json(F.array(key)), r"^\[|\]$", "")
    plain = key.rlike("^[A-Za-z_][A-Za-z0-9_-]*$") & ~F.lower(key).isin("true", "false", "null", "yes", "no", "on", "off", "y", "n")
    return F.when(plain, key).otherwise(quoted)


def written(values: Column, body: Column) -> Column:
    """A file of values and a body: the known keys in their order, then the others by name, all values as JSON."""
    whole = lambda k: F.try_variant_get(values, _path(k), "variant")
    known = F.concat(*(F.when(whole(k).isNotNull(), F.concat(F.lit(f"{k}: "), F.to_json(whole(k)), F.lit("\n"))).otherwise("") for k in WRITTEN))
    return F.concat(F.lit("---\n"), known, extensions(values), F.lit("---\n"), body)
