"""Benchmark decontamination by winnowing, in DataFrame functions only.

A document's k-gram hashes run under a sliding window, and of each window the least hash is kept. With
GRAM + SLIDE - 1 = 10, any ten words that a document and an item share put the same hash into both sets of
kept fingerprints. Documents without a common fingerprint are done; in the others the hits are extended to
whole windows of ten words, and the words under any of them are counted.

Hash arrays come from pairwise steps over whole arrays (2-grams from words, 4-grams from 2-grams, ...), so a
document is never exploded into k-grams before it is winnowed. Arrays are exploded as `outer` and nulls dropped
after: an inner explode would have the optimizer push size(array) > 0, and with it the whole chain of steps, down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm import common

#: Words in a window, in a k-gram, and k-grams under the sliding minimum.
WINDOW, GRAM, SLIDE = 10, 6, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything but digits, letters and non-ASCII characters.
BETWEEN = r"[\x00-/:-`{-\x7F]+"


def words_of(text: Column, between: str = BETWEEN) -> Column:
    """The words of a text, A-Z lower-cased (other letters stay as they are); null has none."""
    text = F.coalesce(text, F.lit(""))
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(folded, between), "")


def _tail(column: str, skip: int) -> Column:
    return F.slice(column, skip + 1, F.greatest(F.size(column) - skip, F.lit(0)))


def _pairwise(one: str, other: str, skip: int, f) -> Column:
    """f(one[i], other[i + skip]) for all i that have both."""
    n = F.greatest(F.least(F.size(one), F.size(other) - skip), F.lit(0))
    return F.zip_with(F.slice(one, 1, n), F.slice(other, skip + 1, n), f)


def with_grams(df: DataFrame, size: int, name: str) -> DataFrame:
    """Adds `name`: a hash of each run of `size` words, from the column of word hashes g1 and pairwise steps."""
    step, have = 1, ["g1"]
    while step * 2 <= size:
        if f"g{step * 2}" not in df.columns:
            df = df.withColumn(f"g{step * 2}", _pairwise(f"g{step}", f"g{step}", step, lambda a, b: F.xxhash64(a, b)))
        step *= 2
    whole, done = f"g{step}", step
    while done < size:
        part = 1 << ((size - done).bit_length() - 1)
        df = df.withColumn(f"r{done + part}", _pairwise(whole, f"g{part}", done, lambda a, b: F.xxhash64(a, b)))
        whole, done = f"r{done + part}", done + part
    return df.withColumn(name, F.col(whole))


def with_minima(df: DataFrame, of: str, size: int, name: str) -> DataFrame:
    """Adds `name`: the least of each `size` neighbours, by doubling."""
    step, whole = 1, of
    while step * 2 <= size:
        df = df.withColumn(f"m{step * 2}", _pairwise(whole, whole, step, lambda a, b: F.least(a, b)))
        whole, step = f"m{step * 2}", step * 2
    if step < size:  # two overlapping runs cover the rest
        df = df.withColumn("m", _pairwise(whole, whole, size - step, lambda a, b: F.least(a, b)))
        whole = "m"
    return df.withColumn(name, F.col(whole))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("g1", F.transform("words", lambda w: F.xxhash64(w)))


def fingerprints(df: DataFrame, *key: str) -> DataFrame:
    """(key, f): the distinct winnowed fingerprints of the texts with a window of WINDOW words at least."""
    df = _hashed(df).select(*key, "g1")
    df = with_minima(with_grams(df, GRAM, "gram").select(*key, "gram"), "gram", SLIDE, "f")
    return df.select(*key, F.explode_outer(F.array_distinct("f")).alias("f")).where("f is not null")


def windows(df: DataFrame, *key: str, size: int, positions: bool) -> DataFrame:
    """(key, pos, size, w): a hash of each run of `size` words."""
    df = with_grams(_hashed(df).select(*key, "g1"), size, "w").select(*key, "w")
    if positions:
        return df.select(*key, F.posexplode_outer("w").alias("pos", "w")).withColumn("size", F.lit(size)).where("w is not null")
    return df.select(*key, F.explode_outer(F.array_distinct("w")).alias("w")).where("w is not null")


#: Short items whose windows are looked up inside the rows, at most; more are joined with all windows.
IN_PLACE = 10_000


def short_windows(split: DataFrame, sizes: list[int], short: DataFrame) -> DataFrame:
    """(doc_id, t, pos, size, w): the windows of all `sizes` of documents (doc_id, t, words), in one pass; where `short` (w, size) has few
    windows, those of the documents that it lacks are left out before anything is exploded."""
    df = _hashed(split).select("doc_id", "t", "g1")
    for n in sizes:
        df = with_grams(df, n, f"w{n}")
    known = [r.w for r in short.select("w").distinct().limit(IN_PLACE + 1).collect()]
    of = lambda n: F.transform(f"w{n}", lambda w, i: F.struct(i.alias("pos"), F.lit(n).alias("size"), w.alias("w")))
    kept = (lambda a: F.filter(a, lambda x: x["w"].isin(known))) if len(known) <= IN_PLACE else (lambda a: a)
    return df.select("doc_id", "t", F.explode_outer(F.concat(*(kept(of(n)) for n in sizes))).alias("x")).where("x is not null").select("doc_id", "t", "x.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Finds the windows of ten words of `benchmark` items in documents.

    docs: doc_id (one without id is never hit) and text; benchmark: item_id and text; other columns are ignored. Words are runs
    of digits, letters and non-ASCII characters, A-Z lower-cased. An item of fewer than ten words, but not none, is one
    window of that length; an item_id with several texts has the windows of all. Null and empty texts have no words. Rows that
    repeat a doc_id are told apart by a hash of their texts, each with its own hits. Result, a row per row of docs: doc_id, n_words,
    n_hit (words inside any occurrence of a window), n_items, items_sha256 (of the item ids, sorted as strings,
    comma-joined), contaminated. Either table may be empty.
    """
    docs = common.spread(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text"))
    row = ["doc_id", "t"]
    split = docs.select(*row, words_of(F.col("text")).alias("words"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    items = common.materialize(items.where(F.size("words") > 0))
    small = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0] <= common.BROADCAST_ROWS
    side = F.broadcast if small else lambda df: df

    marks = fingerprints(items, "item_id").select("f").distinct()
    found = common.materialize(fingerprints(split, *row).join(side(marks), "f", "left_semi").select(*row).distinct())
    near = common.by_ids(docs, found, row).select(*row, words_of(F.col("text")).alias("words"))
    # Windows are matched once, however many items share one; items are joined with what a document's hits have in common.
    known = windows(items, "item_id", size=WINDOW, positions=False).withColumn("size", F.lit(WINDOW))
    hits = windows(near, *row, size=WINDOW, positions=True).join(side(known.select("w").distinct()), "w", "left_semi")
    hits = hits.select(*row, "pos", "size", "w")
    sizes = sorted(r.n for r in items.where(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct().collect())  # at most nine
    if sizes:
        short = None
        for n in sizes:
            own = windows(items.where(F.size("words") == n), "item_id", size=n, positions=False).withColumn("size", F.lit(n))
            short = own if short is None else short.unionByName(own)
        short = common.materialize(short)
        found = short_windows(split, sizes, short).join(side(short.select("w", "size").distinct()), ["w", "size"], "left_semi")
        hits = hits.unionByName(found.select(*row, "pos", "size", "w"))
        known = known.unionByName(short)
    hits = common.materialize(hits)

    each = hits.groupBy(*row).agg(F.array_sort(F.collect_set(F.struct("pos", "size"))).alias("spans"))
    named = hits.select(*row, "w", "size").distinct().join(side(known), ["w", "size"]).groupBy(*row).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    # Spans in order of start: each adds the words beyond the furthest end so far.
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct(F.greatest(a["end"], s["pos"] + s["size"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["pos"] + s["size"] - F.greatest(a["end"], s["pos"]))).alias("n")), lambda a: a["n"])
    each = each.join(named, row).select(*row, covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = split.select(*row, F.size("words").cast("long").alias("n_words")).join(each, row, "left")
    none = F.sha2(F.lit(""), 256)
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Passages of `benchmark` in `documents`."""
    return decontaminate(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


#: The same rows by plain SQL over all windows.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS k
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS k
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN sizes ON len(ws) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
