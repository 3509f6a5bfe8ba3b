"""Fill-in-middle transformation: documents are cut into prefix, middle and suffix and put into training order.

One fullmatch of (unit)* over a text retains every repetition of its group; the ends of the repetitions number the
units and hold both cuts, so no unit is looked at in Python. Where a unit is one code point, a long text is matched in
runs of SEGMENT code points, whose repetitions together are those of the whole text: the captures of one run bound the
memory of a task. Other units (words, lines, graphemes) are matched over the whole text at once.

Draws come from a hash of the document's id, so that a task that runs again gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm import common

#: The sentinels; a text that contains one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Out of a hundred documents: those that are transformed, and of these those with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = "1"
#: The unit of the cuts, and how many are matched at once where it is one code point.
CODE_POINT, SEGMENT = r"(?s:.)", 1 << 19


def unit_ends(text: str, pattern: regex.Pattern, segment: int | None) -> list[int] | None:
    """Where each unit of a text ends, in code points; none if the units do not cover it."""
    if segment is None or len(text) <= segment:
        found = pattern.fullmatch(text)
        return found.ends(1) if found else None
    runs = (pattern.fullmatch(text, at, min(at + segment, len(text))) for at in range(0, len(text), segment))
    return list(chain.from_iterable(run.ends(1) for run in runs))


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four unsigned 32-bit integers that an id and a seed give; a null id counts as the empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(text: str, doc_id: int | None, pattern: regex.Pattern, segment: int | None, seed: str, rate: int, suffix_first: int) -> tuple:
    """(units, form, prefix and middle in code points, output) of one text."""
    ends = unit_ends(text, pattern, segment)
    h1, h2, h3, h4 = draws(doc_id, seed)
    n = None if ends is None else len(ends)
    if not text or n is None or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    low, high = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < suffix_first:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Puts every whole text into one of three forms: plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle).

    docs: doc_id and text; other columns are ignored, so their names cannot clash. A null text is empty; an empty text, one that
    holds a sentinel and one that the units (a pattern without groups) do not cover stay plain, the last with n null. Rows that
    repeat a doc_id get the same draws, each over its own length; a null doc_id draws as the empty string. Result, a row for
    each row of docs: doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output.
    """
    docs = common.spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    segment = SEGMENT if unit == CODE_POINT else None
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(f"({unit})*")
        for batch in batches:
            made, held = [], 0
            for k in range(batch.num_rows):
                doc_id, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                made.append((doc_id, *transform(text, doc_id, pattern, segment, seed, rate, suffix_first)))
                held += len(text)
                if held >= common.CHUNK_BYTES or k == batch.num_rows - 1:
                    types = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)
                    made, held = [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from: no sentinel lies in the text, so each one's only place parts the output."""
    before = lambda mark: F.substring_index(output, mark, 1)
    part = lambda mark, end: F.substring_index(before(end), mark, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """All of `documents`, transformed by code points, with the digests of each output and of the text that is restored from it."""
    made = fill_in_middle(common.read(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: The same rows by plain SQL, which numbers code points by their lengths.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n,
             CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
             CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
