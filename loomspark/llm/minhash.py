"""MinHash near-dedup: fast similarity sketches, banding, and links confirmed on full shingle sets.

A sketch has BINS coordinates. In round i every shingle of a document falls into one bin and offers it the
value i + v, v in [0, 1); a bin keeps its least value. Rounds end when every bin is filled, so sets with many
shingles take one or two rounds; from round BINS on, round i fills bin i - BINS, so that each coordinate is
filled after 2 * BINS rounds at the latest. The share of equal coordinates of two sketches is an unbiased
estimate of the similarity, concentrated as for independent hashes.

Bands of ROWS coordinates put documents of similarity s into a common bucket with probability
1 - (1 - s ** ROWS) ** BANDS: at 0.8, all but 5 of 100 million links. Links are confirmed on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import cluster, common

ROWS, BANDS = 4, 32
BINS = ROWS * BANDS
SIMILARITY = 0.8


def shingle_sets(words: common.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts (sorted in each), and where each text's begin; fewer words are one shingle as a whole."""
    first = words.first
    n = np.diff(first)
    rolled = common.rolled(words.hashes, width)
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(of)) - first[:-1][of]
    full = at + width <= n[of]
    place, owner = np.flatnonzero(full), of[full]
    values = rolled[place]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = np.array([common.mix(common.rolled(words.hashes[first[k] : first[k + 1]], int(n[k])), int(n[k]))[0] for k in short], dtype=np.uint64)
        values, owner = np.concatenate([values, whole]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(n) + 1))


def sketches(values: np.ndarray, first: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches of some sets, a row each: the round in the upper bits, the hash in the lower."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * bins, empty, dtype=np.uint64)
    for i in range(2 * bins):
        if not len(values):
            break
        h = common.mix(values, i + 1)
        to = (h % np.uint64(bins)).astype(np.int64) if i < bins else np.full(len(values), i - bins)
        np.minimum.at(out, owner * bins + to, (h >> np.uint64(9)) | np.uint64(i << 55))
        open_ = (out.reshape(n, bins) == empty).any(axis=1)
        keep = open_[owner]
        if not keep.all():
            values, owner = values[keep], owner[keep]
    return out.reshape(n, bins)


def _sketch_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, words in common.chunks(batch.column(1), True):
                values, first = shingle_sets(words, width)
                sketch = sketches(values, first)
                bands = np.zeros((end - row, BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    bands = common.mix(bands * np.uint64(31) + sketch[:, r::ROWS], r + 1)
                size = np.diff(first)
                total = np.zeros(len(values) + 1, dtype=np.uint64)
                sums = []
                for seed in (11, 12):
                    np.cumsum(common.mix(values, seed), out=total[1:])
                    sums.append(common.signed(total[first[1:]] - total[first[:-1]]))
                bands = pa.FixedSizeListArray.from_arrays(pa.array(common.signed(bands.ravel())), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(size.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), bands], ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return run


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, words in common.chunks(batch.column(1), True):
                values, first = shingle_sets(words, width)
                sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(common.signed(values)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), sets], ["id", "shingles"])

    return run


#: Shingles in a block of documents that are compared in one task.
BLOCK = 1 << 20


def _block_links(least: int, most: int):
    """Links between the guests of a block and its holders, by counting shared shingles over postings; only links leave the task."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp, role = (table.column(c).to_numpy() for c in ("id", "component", "guest"))
        lists = table.column("shingles").combine_chunks()
        first, values = lists.offsets.to_numpy(), lists.values.to_numpy()  # offsets are those of the slice
        size = np.diff(first)
        rows = np.flatnonzero(~role)
        owner = np.repeat(np.arange(len(rows)), size[rows])
        held = np.concatenate([values[first[k] : first[k + 1]] for k in rows]) if len(rows) else np.empty(0, dtype=np.int64)
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        a, b = [], []
        for k in np.flatnonzero(role):
            mine = values[first[k] : first[k + 1]]
            low, high = np.searchsorted(held, mine), np.searchsorted(held, mine, side="right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(rows))
            link = (shared * most >= (size[k] + size[rows] - shared) * least) & (comp[rows] != comp[k])
            other = ids[rows[link]]
            a.append(np.minimum(other, ids[k]))
            b.append(np.maximum(other, ids[k]))
        cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, dtype=np.int64), pa.int64())
        return pa.table({"a": cat(a), "b": cat(b)})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """Groups of documents whose sets of `width`-word shingles have a Jaccard similarity of `similarity` or more.

    docs: doc_id (unique; one without id is only compared as a whole set) and text; other columns are ignored. Words are runs of other than ASCII white space, A-Z
    lower-cased; a text of fewer than `width` words, but not none, is one shingle. A null, empty or blank text has no
    shingle and no link. Result, a row per document: doc_id, n_shingles, component_id (the smallest doc_id that links
    lead to), kept (whether it is that one). Equal sets are one class from the start; only its smallest id is compared.
    """
    docs = common.spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    made = common.materialize(docs.mapInArrow(_sketch_rows(width), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"))
    full = made.where("n_shingles > 0")
    same = common.materialize(full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    reps = same.where("rep is not null").select(F.col("rep").alias("doc_id"))
    bands = full.select("doc_id", "bands").join(reps, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "bucket"))
    members = bands.select(F.xxhash64("band", "bucket").alias("key"), "id")
    least, most = int(round(100 * similarity)), 100

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = common.materialize(ids.distinct())
        return common.materialize(common.by_ids(docs, ids, "doc_id").mapInArrow(_set_rows(width), "id long, shingles array<long>"))

    def verify(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        both = both.select("a", "b", shared.alias("n"), (F.size("sa") + F.size("sb") - shared).alias("m"))
        return both.where(F.col("n") * most >= F.col("m") * least).select("a", "b")

    def rest(now: DataFrame) -> DataFrame:
        # A region is a major component with what shares its buckets.
        sets = sets_of(now.select(F.col("id").alias("doc_id")))
        return cluster.blockwise(now, "major", sets, F.size("shingles"), BLOCK, _block_links(least, most))

    comps = cluster.linked(members, verify, rest).withColumnRenamed("id", "rep")
    classes = same.join(comps, "rep", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    # Equal sets are one class: with a hot one the join is split by its size, as any skewed join.
    out = made.drop("bands").join(common.materialize(classes), ["s1", "s2", "n_shingles"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    """Components of `documents` by 2-word shingles at a similarity of 0.8."""
    return near_duplicates(common.read(spark, sf_dir, "documents"), width=2)


#: The same rows by an exact join on shared shingles, for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 2 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
t AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, t.root AS component_id, d.doc_id = t.root AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN t ON t.id = d.doc_id
"""
