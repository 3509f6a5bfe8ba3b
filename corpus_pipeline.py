"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of `documents`. Null texts, extra columns and rows with a null doc_id follow the operators' own rules; what a
stage decides for a repeated doc_id holds for all its rows, but for the line stage, which tells them by their texts. An
empty table gives an empty result at every stage.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import common, lines, minhash, packing, quality, winnow

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from `labels` as op5 does."""
    scores = quality.score_quality(docs, common.read(spark, sf_dir, "labels"))
    rejected = common.materialize(scores.where("predicted = 0").select("doc_id").distinct())
    return common.by_ids(docs, rejected, "doc_id", "left_anti").select(*COLUMNS)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines whose class has an earlier line; n_chars is that of what is left.

    Rows that repeat a doc_id are told apart by their texts. Documents without id stay whole.
    """
    classes = lines.line_classes(docs)
    gone = common.materialize(classes.where("not kept and doc_id is not null").groupBy("doc_id", "doc_hash").agg(F.collect_set("line_no").alias("gone")))
    docs = docs.select(*COLUMNS)
    touched = common.by_ids(docs, gone.select("doc_id").distinct(), "doc_id").withColumn("doc_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    cut = touched.join(gone, ["doc_id", "doc_hash"]).select(*COLUMNS, "gone")
    rest = common.by_ids(docs, gone.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(touched.join(gone, ["doc_id", "doc_hash"], "left_anti").select(*COLUMNS))

    def rebuild(batches):
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                gone = set(gone)
                texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
            cols = {c: batch.column(c) for c in COLUMNS} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([cols[c] for c in COLUMNS], list(COLUMNS))

    return cut.mapInArrow(rebuild, docs.schema).unionByName(rest)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, by five-word shingles at a similarity of 0.8."""
    groups = minhash.near_duplicates(docs)
    copies = common.materialize(groups.where("not kept").select("doc_id").distinct())
    return common.by_ids(docs, copies, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of `benchmark`."""
    found = winnow.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))
    leaks = common.materialize(found.where("contaminated").select("doc_id").distinct())
    return common.by_ids(docs, leaks, "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents, packed into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("minhash near-dedup", near_duplicate_filter),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]
#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; between two stages the table is written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs)
    return docs
