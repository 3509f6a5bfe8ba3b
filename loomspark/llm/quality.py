"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted over every whole text, in numpy over the bytes of a batch. The trees are grown from
histograms of binned statistics on a bounded sample of labelled rows and flattened into arrays: scoring moves
all rows of a batch one level down at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm import common

#: Labelled rows that the trees are fitted on, at most: those whose ids hash lowest.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAF = 80, 4, 32, 0.15, 5.0, 10
#: Kinds of bytes that are counted, in this order; the last is any other byte.
_KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!?", b"|", b"*#$%&~^+=_", b"@/\\:;", b"()[]{}<>", b"'\"`-", bytes(range(128, 192)), bytes(range(192, 256)))
_CLASS = np.full(256, len(_KINDS), dtype=np.int64)
for _i, _kind in enumerate(_KINDS):
    _CLASS[list(_kind)] = _i
N_KINDS = len(_KINDS) + 1


def _line_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each line that is not empty."""
    if not len(data):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    stops = np.unique(np.concatenate([np.flatnonzero(data == 10), offsets[1:] - 1]))
    stops = stops[stops >= 0]
    starts = np.concatenate([[0], stops[:-1] + 1])
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * common.powers(common._BASE, n), out=total[1:])
    ends = stops + (data[stops] != 10)
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    hashes = common.mix((total[ends] - total[starts]) * common.powers(common._INVERSE, n)[starts])
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n owners: how many distinct values, and how often the most frequent one occurs."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(values)))
    most = np.zeros(n)
    np.maximum.at(most, owner[at], times)
    return np.bincount(owner[at], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text; an empty text has zeros."""
    offsets, data = common.buffers(texts)
    out, row = [], 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + common.CHUNK_BYTES, side="right")) - 1)
        end = min(end, len(texts))
        out.append(_chunk(offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]))
        row = end
    return np.concatenate(out) if out else np.zeros((0, N_FEATURES))


N_FEATURES = N_KINDS + 12


def _chunk(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    of = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(of * N_KINDS + _CLASS[data], minlength=n * N_KINDS).reshape(n, N_KINDS)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=np.asarray(b) > 0)
    words = common.Words(offsets, data, True)
    n_words = np.diff(words.first).astype(float)
    owner = np.repeat(np.arange(n), np.diff(words.first))
    kinds, top = _distinct(words.hashes, owner, n)
    pairs = common.rolled(words.hashes, 2)
    inner = owner[:-1] == owner[1:] if len(owner) else np.empty(0, dtype=bool)
    two, top_two = _distinct(pairs[inner], owner[:-1][inner], n)
    n_pairs = np.maximum(n_words - 1, 0)
    lines, of_line = _line_hashes(offsets, data)
    n_lines = np.bincount(of_line, minlength=n).astype(float)
    distinct_lines, top_line = _distinct(lines, of_line, n)
    letters = counts[:, 0] + counts[:, 1] + counts[:, 14]
    cols = [share(counts[:, k], size) for k in range(N_KINDS)]
    cols += [
        np.log1p(size), np.log1p(n_words), share(size, n_words), share(kinds, n_words), share(top, n_words), share(two, n_pairs), share(top_two, n_pairs), np.log1p(n_lines),
        share(n_words, n_lines), share(distinct_lines, n_lines), share(top_line, n_lines), share(counts[:, 1], letters),
    ]
    return np.stack(cols, axis=1)


class Trees:
    """Trees of one depth as arrays: node k's children are 2k + 1 and 2k + 2; the last level are leaves."""

    def __init__(self, base: float):
        self.base, self.feature, self.threshold, self.leaf = base, [], [], []

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts trees on the logistic loss. No rows give a score of 1/2, rows of one label one near that label."""
    positive = (y.sum() + 0.5) / (len(y) + 1)
    trees = Trees(float(np.log(positive / (1 - positive))))
    if len(y) < 2 * LEAF or y.min() == y.max():
        return trees
    n, m = x.shape
    edges = np.stack([np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) for k in range(m)])
    binned = np.stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(m)], axis=1)
    total = np.full(n, trees.base)
    place = binned + np.arange(m) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (m * BINS) + place).ravel()
            hist = [np.bincount(at, np.repeat(v, m), width * m * BINS).reshape(width, m, BINS).cumsum(axis=2) for v in (g, h, np.ones(n))]
            gl, hl, nl = hist
            gr, hr, nr = (v[:, :, -1:] - v for v in hist)
            gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (gl + gr) ** 2 / (hl + hr + RIDGE)
            gain[(nl < LEAF) | (nr < LEAF)] = 0
            gain = gain[:, :, :-1].reshape(width, -1)
            best = gain.argmax(axis=1)
            for k in range(width):
                if gain[k, best[k]] > 1e-9:
                    f, b = divmod(int(best[k]), BINS - 1)
                    feature[first + k], threshold[first + k] = f, edges[f, b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - (2**DEPTH - 1)
        gs, hs = np.bincount(leaf, g, 2**DEPTH), np.bincount(leaf, h, 2**DEPTH)
        value = -RATE * gs / (hs + RIDGE)
        total += value[leaf]
        trees.feature.append(feature)
        trees.threshold.append(threshold)
        trees.leaf.append(value)
    return trees


def held_out() -> Column:
    """Whether a row's label may not be learned: crc32 of its id as text, modulo 3, is 1. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _train(docs: DataFrame, labels: DataFrame, rows: int) -> Trees:
    known = labels.where("quality is not null").select("doc_id", "quality").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = common.materialize(known.where(~held_out()))
    # Only about as many rows as are wanted are ranked, by their hash, so that tasks send no more than that.
    least = int(min(1.0, 1.5 * rows / max(1, known.count())) * (1 << 40))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    known = common.materialize(known.where(order < least).orderBy(order, "doc_id").limit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    # At most `rows` rows, a documented bound.
    found = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(run, "doc_id long, quality int, x array<double>").toPandas()
    found = found.sort_values("doc_id", kind="stable")
    x = np.array(found["x"].tolist(), dtype=float).reshape(-1, N_FEATURES)
    return fit(x, found["quality"].to_numpy(dtype=float))


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Scores every whole text for quality, as `labels.quality` (0 or 1) marks it.

    docs: doc_id and text; labels: doc_id and quality; other columns are ignored. Labels of rows whose
    crc32(doc_id as text) modulo 3 is 1 are not learned, and neither id, language, source nor label is an input of a score.
    A null text is empty; null labels are not learned; of several labels of an id the larger counts. Result, a row for
    each row of docs: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on). Without labels all scores are 0.5.
    """
    docs = common.spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    trees = _train(docs, labels, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = trees.score(statistics(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of `documents`, learned from `labels`."""
    return score_quality(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
