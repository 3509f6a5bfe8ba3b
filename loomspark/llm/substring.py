"""Substring dedup: difference-cover anchors find passages that repeat across documents.

A window is `window` consecutive words. Anchors are shorter windows that start only at positions whose
remainder modulo a period lies in a perfect difference cover. Two equal windows of two documents, at any
positions, hold an equal anchor at the same distance from their starts: for any two remainders the cover has
a shift that takes both into it. So the anchors which two documents share lead to every repeated window;
around them whole windows are hashed (128 bits) and held against the smallest document that has them.

Exact copies are folded first: of a text that many documents have, only the smallest id makes anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import common

#: Perfect difference covers: period -> remainders; each difference modulo the period occurs.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor width for windows of so many words: the longest period that leaves anchors of a third of the window."""
    fitting = [p for p in COVERS if window - p + 1 >= max(2, window // 3)]
    if not fitting:
        return 1, (0,), window
    return max(fitting), COVERS[max(fitting)], window - max(fitting) + 1


def _anchor_rows(window: int):
    period, cover, width = cover_for(window)
    chosen = np.zeros(period, dtype=bool)
    chosen[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for row, end, words in common.chunks(batch.column(2), False):
                hashes = common.rolled(words.hashes, width)
                of = np.repeat(np.arange(row, end), np.diff(words.first))[: len(hashes)]
                at = np.arange(len(hashes)) - words.first[of - row]
                n = words.first[of - row + 1] - words.first[of - row]
                keep = chosen[at % period] & (at + width <= n) & (n >= window)
                rows = of[keep]
                yield pa.RecordBatch.from_arrays([pa.array(common.signed(hashes[keep])), pa.array(ids[rows]), pa.array(texts[rows]), pa.array(at[keep].astype(np.int32))], ["h", "doc_id", "t", "pos"])

    return run


def _window_rows(window: int):
    period = cover_for(window)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ids, texts), anchors = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)), batch.column(3)
            for row, end, words in common.chunks(batch.column(2), False):
                one, two = common.rolled(words.hashes, window), common.rolled(common.mix(words.hashes, 7), window)
                for k in range(row, end):
                    low, high = words.first[k - row], words.first[k - row + 1]
                    starts = high - low - window + 1
                    if starts <= 0:
                        continue
                    at = np.asarray(anchors[k].values)
                    edges = np.zeros(starts + 1, dtype=np.int32)
                    np.add.at(edges, np.clip(at - period + 1, 0, starts), 1)
                    np.add.at(edges, np.clip(at + 1, 0, starts), -1)
                    pos = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(common.signed(one[low + pos])), pa.array(common.signed(two[low + pos])), pa.array(np.full(len(pos), ids[k])), pa.array(np.full(len(pos), texts[k])), pa.array(pos.astype(np.int32))], ["h1", "h2", "doc_id", "t", "pos"])

    return run


def _kept_rows(window: int, texts: bool):
    """Words that stay; a batch has the id, the text's hash, the text and, where windows repeat, their starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered = batch.column(3) if batch.num_columns > 3 else None
            offsets, data = common.buffers(batch.column(2))
            raw = data.tobytes()
            total, removed, digest, kept = [], [], [], []
            for k in range(batch.num_rows):
                words = raw[offsets[k] : offsets[k + 1]].split()
                n = len(words)
                if covered is not None:
                    at = np.asarray(covered[k].values)
                    edges = np.zeros(n + 1, dtype=np.int32)
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + window, -1)
                    words = [w for w, gone in zip(words, np.cumsum(edges[:-1]) > 0) if not gone]
                text = b" ".join(words)
                total.append(n)
                removed.append(n - len(words))
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode())
            out = [batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(kept, pa.string())] if texts else [])], ["doc_id", "t", "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else [])])

    return run


def substring_dedup(docs: DataFrame, window: int = 50, texts: bool = False) -> DataFrame:
    """Removes each word covered by a `window`-word run that also starts in a document with a smaller doc_id.

    docs: doc_id (one without id keeps all words) and text; other columns are ignored, so their names cannot clash. A
    null or empty text has no words. Rows that repeat a doc_id are told apart by a hash of their texts: each is a document of that id,
    judged by its own windows. Result, a row for each row of docs: doc_id, n_words, n_removed, kept_sha256 and, with
    texts, kept (the words that stay, joined by one space).
    """
    text = F.coalesce("text", F.lit(""))
    docs = common.spread(docs.select("doc_id", F.xxhash64(text).alias("t"), text.alias("text")))
    row = ["doc_id", "t"]
    keyed = docs.where("doc_id is not null")
    first = keyed.select(*row, F.xxhash64(F.lit(1), "text").alias("b"), F.length("text").alias("c"))
    first = common.materialize(first)
    rep = first.groupBy("t", "b", "c").agg(F.min("doc_id").alias("rep"))
    copies = common.materialize(first.join(rep, ["t", "b", "c"]).where("doc_id > rep").select(*row).distinct())
    single = common.by_ids(keyed, copies, row, "left_anti")

    anchors = single.mapInArrow(_anchor_rows(window), "h long, doc_id long, t long, pos int")
    # Hashes that documents share are written first: what is joined with them is then a plain shuffle, which is split where
    # a hash is very common, after an aggregation that combines within tasks.
    shared = anchors.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h")
    shared = common.materialize(shared)
    near = common.materialize(anchors.join(shared, "h", "left_semi").groupBy(*row).agg(F.collect_list("pos").alias("at")))
    windows = common.by_ids(keyed, near.select(*row), row).join(near, row).select(*row, "text", "at").mapInArrow(_window_rows(window), "h1 long, h2 long, doc_id long, t long, pos int")
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    least = common.materialize(least)
    hit = windows.join(least, ["h1", "h2"]).where("doc_id > low").groupBy(*row).agg(F.collect_set("pos").alias("at"))
    hit = common.materialize(hit)

    schema = "doc_id long, t long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    cut = common.by_ids(docs, hit.select(*row), row).join(hit, row).select(*row, "text", "at").mapInArrow(_kept_rows(window, texts), schema)
    rest = common.by_ids(docs, hit.select(*row), row, "left_anti").select(*row, "text").mapInArrow(_kept_rows(window, texts), schema)
    # A copy of a text that a smaller document has loses all words, if it has a window at all.
    gone = (F.col("copied").isNotNull() & (F.col("n_words") >= window)).alias("gone")
    marked = copies.select(*row, F.lit(True).alias("copied"))
    small = copies.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS
    whole = rest.join(F.broadcast(marked) if small else marked, row, "left").withColumn("gone", gone).drop("copied")
    whole = whole.withColumn("n_removed", F.when(F.col("gone"), F.col("n_words")).otherwise(F.col("n_removed"))).withColumn("kept_sha256", F.when(F.col("gone"), F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")))
    if texts:
        whole = whole.withColumn("kept", F.when(F.col("gone"), F.lit("")).otherwise(F.col("kept")))
    return cut.unionByName(whole.drop("gone")).drop("t")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of `documents` that no window of a smaller document covers."""
    return substring_dedup(common.read(spark, sf_dir, "documents"))


#: The same rows by plain SQL over all windows.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS k FROM p),
m AS (SELECT k, min(doc_id) AS low FROM g GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM g JOIN m USING (k) WHERE doc_id > low),
e AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT e.doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY e.i) FILTER (WHERE c.i IS NULL) AS kept
      FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.i = e.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
