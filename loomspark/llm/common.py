"""What the operators share: reading, cutting lineage, size-checked joins and vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import graph

#: A side of a join is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 1_000_000
#: Rows in a batch that goes to Python, and bytes of text that are hashed at once.
BATCH_ROWS, CHUNK_BYTES = 500, 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as there are cores, for inputs of one small file.

    Arrow batches are kept small, for long texts: Spark reads that setting when a plan runs, so it stays for the session,
    unless the session has chosen another than Spark's own.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it again: what follows does not depend on any executor that made it."""
    return graph.cut_lineage(df)


def by_ids(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi", limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` semi- or anti-joined with a table of ids: by broadcast if that was counted to be small, else by shuffle."""
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids, key, how)


# ---------------------------------------------------------------- hashes of words

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTERS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _LETTERS.copy()
_FOLDED[65:91] = _LETTERS[97:123]
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of `h`."""
    h = h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, 1 << 16)
        p = np.full(size, np.uint64(base), dtype=np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` consecutive values, by prefix sums."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(_INVERSE, n))


class Words:
    """The words of some texts: hashes in order; those of text k are hashes[first[k]:first[k + 1]]."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lower: bool):
        n = len(data)
        if not n:
            self.hashes, self.first = np.empty(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
            return
        inside = ~_SPACE[data]
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[0], before[1:], after[-1], after[:-1] = False, inside[:-1], False, inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges], after[edges - 1] = False, False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_FOLDED if lower else _LETTERS)[data] * powers(_BASE, n), out=total[1:])
        self.hashes = mix((total[end] - total[start]) * powers(_INVERSE, n)[start])
        self.first = np.searchsorted(start, offsets).astype(np.int64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and UTF-8 bytes of an Arrow array of strings; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None and len(texts) else np.empty(0, dtype=np.uint8)
    return offsets - offsets[0] if len(offsets) else np.zeros(1, dtype=np.int64), data


def chunks(texts: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of runs of rows of about CHUNK_BYTES; a long text is a run of its own."""
    offsets, data = buffers(texts)
    row, n = 0, len(texts)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        end = min(end, n)
        yield row, end, Words(offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]], lower)
        row = end


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return h.view(np.int64)
