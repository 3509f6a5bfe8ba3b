"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are hashed by floor((a . v + b) / w) in some directions a of normal (2-stable) components, TABLES
times. Every vector lies in one bucket of each table. A query visits its own bucket and the perturbed ones (some
directions a step down or up) in the order of their estimated success: least expected sum of squared distances from
the query's projections to the cells that are entered, over its own order of distances. What the tables find is
merged and ranked by exact cosine.

How many directions, how wide a step and how many probes is fitted, so that buckets get finer as the table grows: a
bounded sample of queries is held against all rows, and of the settings that find enough of its true neighbours the
one that compares the fewest rows is taken.

Equal vectors are one row with the few smallest of their ids. Buckets are gathered into cells by their first
directions, so that a query's probes fall into few of them; a cell's rows and its queries are dealt into blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspark.llm import common

TABLES = 8
#: Components of the vectors, and queries, in a block of a cell.
CELL, ASKED = 1_280_000, 1_000
#: What the settings are fitted on: so many queries, held against all rows, and about so many rows.
FIT_QUERIES, FIT_ROWS = 64, 2048
#: Share of the sample's true neighbours that a setting must find.
FOUND = 0.93
#: Directions that are tried with their steps (in standard deviations of the vectors), and numbers of probes.
WIDTHS = ((6, 1.5), (8, 1.5), (10, 2.0), (12, 2.0), (14, 2.5), (16, 3.0), (20, 3.0), (24, 3.0), (28, 3.0))
PROBES = (25, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 1000, 1200, 1400, 1600)


class Setting(NamedTuple):
    """Directions in a table, width of a step, probes of a query in a table, and directions that name a cell."""

    width: int
    step: float
    probes: int
    coarse: int = 1


@lru_cache(maxsize=256)
def _planes(dim: int, width: int, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, shares of a step that they are moved by, and odd multipliers that make one number of the cells."""
    rng = np.random.default_rng((dim, width, table))
    return rng.standard_normal((dim, width)), rng.uniform(0, 1, width), rng.integers(1, 1 << 61, width) * 2 + 1


@lru_cache(maxsize=16)
def _sequence(width: int, probes: int) -> np.ndarray:
    """Perturbations in order of expected success, a row each: which of the 2 * width steps, nearest first, are taken.

    The squared distance of the j-th nearest of width uniform places to its edge has a known mean, and so has that of the
    opposite edge; sets of steps come out of a heap by the sum of their means. No set takes both steps of a direction.
    """
    j = np.arange(1, width + 1)
    near = j * (j + 1) / (4 * (width + 1) * (width + 2))
    far = 1 - j / (width + 1) + near
    cost = np.concatenate([near, far[::-1]])
    sets: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(sets) < probes:
        total, steps = heapq.heappop(heap)
        if all(2 * width - 1 - s not in steps for s in steps):
            sets.append(steps)
        last = steps[-1]
        if last + 1 < 2 * width:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*steps[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*steps, last + 1)))
    out = np.zeros((len(sets), 2 * width), dtype=np.int64)
    for row, steps in zip(out, sets):
        row[list(steps)] = 1
    return out


def _hashed(unit: np.ndarray, s: Setting, table: int) -> np.ndarray:
    """Projections in units of the step, a row per vector."""
    a, b, _ = _planes(unit.shape[1], s.width, table)
    return unit @ a / s.step + b


def _codes(home: np.ndarray, dim: int, s: Setting, table: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each row of cells, and the code of its cell, by the first directions only."""
    by = _planes(dim, s.width, table)[2]
    return home @ by, home[:, : s.coarse] @ by[: s.coarse]


def _probed(unit: np.ndarray, s: Setting, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that each query visits, in order, a row per query, and the codes of their cells."""
    p = _hashed(unit, s, table)
    home = np.floor(p).astype(np.int64)
    down = p - home
    by = _planes(unit.shape[1], s.width, table)[2]
    coarse = np.where(np.arange(s.width) < s.coarse, by, 0)
    order = np.argsort(np.concatenate([down, 1 - down], axis=1), axis=1, kind="stable")
    taken = _sequence(s.width, s.probes)
    whole, cell = _codes(home, unit.shape[1], s, table)
    moved = lambda base, m: base[:, None] + np.concatenate([-m, m])[order] @ taken.T
    return moved(whole, by), moved(cell, coarse)


def _group(codes: np.ndarray, groups: int) -> np.ndarray:
    return (common.mix(codes.view(np.uint64)) % np.uint64(groups)).astype(np.int32)


def _vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, vectors in double precision) of a batch by dimension; the table holds whole finite vectors only."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat, first = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), rows, flat[first[rows][:, None] + np.arange(d)[None]].astype(np.float64)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _row_cells(s: Setting, groups: int):
    """A row for each vector and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, v in _vectors(batch.column(1)):
                unit, own = _unit(v), batch.take(pa.array(rows))
                for t in range(TABLES):
                    codes, cell = _codes(np.floor(_hashed(unit, s, t)).astype(np.int64), d, s, t)
                    heads = [pa.array(np.full(len(rows), d, np.int32)), pa.array(np.full(len(rows), t, np.int32)), pa.array(_group(cell, groups)), pa.array(codes)]
                    yield pa.RecordBatch.from_arrays([*heads, own.column(0), own.column(1)], ["dim", "tab", "grp", "code", "ids", "v"])

    return run


def _query_cells(s: Setting, groups: int):
    """A row for each query, table and cell that it visits, with the buckets that it probes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, v in _vectors(batch.column(2)):
                unit = _unit(v)
                for t in range(TABLES):
                    codes, cells = _probed(unit, s, t)
                    of, first, buckets, grp = [], [0], [], []
                    for k, g in enumerate(_group(cells, groups)):
                        order = np.argsort(g, kind="stable")
                        found, n = np.unique(g, return_counts=True)
                        of += [rows[k]] * len(found)
                        grp.append(found)
                        first += (first[-1] + np.cumsum(n)).tolist()
                        buckets.append(codes[k][order])
                    own, n = batch.take(pa.array(of)), len(of)
                    probes = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.concatenate(buckets)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(np.concatenate(grp)), *own.columns, probes], ["dim", "tab", "grp", "h1", "h2", "v", "probes"])

    return run


def _open_rows(buckets: np.ndarray, first: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Places of the rows in the probed buckets; buckets are sorted, rows lie by bucket, first is where each begins."""
    at = np.minimum(np.searchsorted(buckets, mine), len(buckets) - 1)
    at = at[buckets[at] == mine]
    low, n = first[at], first[at + 1] - first[at]
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def _ranked(keep: int):
    """The `keep` nearest vectors of each query among the rows of its buckets in a cell, by exact cosine; without probes, among all."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        h1, h2, ids, scores = [], [], [], []
        if queries.num_rows and rows.num_rows:
            rows = rows.combine_chunks().sort_by("code")
            buckets, first = np.unique(rows.column("code").to_numpy(), return_index=True)
            first = np.append(first, rows.num_rows)
            lists = rows.column("ids").combine_chunks()
            least = lists.values.to_numpy()[lists.offsets.to_numpy()[:-1]]
            _, _, r = next(_vectors(rows.column("v")))
            _, _, q = next(_vectors(queries.column("v")))
            r, q = r / np.abs(r).max(axis=1, keepdims=True), q / np.abs(q).max(axis=1, keepdims=True)
            rn, qn = np.sqrt((r * r).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            probes = queries.column("probes").combine_chunks()
            flat, edges = probes.values.to_numpy(), probes.offsets.to_numpy()
            names = queries.column("h1").to_numpy(), queries.column("h2").to_numpy()
            for k in range(len(q)):
                mine = flat[edges[k] : edges[k + 1]]
                near = _open_rows(buckets, first, mine) if len(mine) else np.arange(len(r))
                if not len(near):
                    continue
                score = r[near] @ q[k] / (rn[near] * qn[k])
                edge = np.partition(score, -keep)[-keep] if len(score) > keep else -np.inf
                best = near[score >= edge - 1e-9]
                exact = (q[k] * r[best]).sum(axis=1) / (qn[k] * rn[best])
                top = np.lexsort((least[best], -exact))[:keep]
                h1 += [names[0][k]] * len(top)
                h2 += [names[1][k]] * len(top)
                ids += best[top].tolist()
                scores += exact[top].tolist()
            ids = lists.take(pa.array(ids, pa.int64()))
        return pa.table({"h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "ids": ids if len(h1) else pa.array([], pa.list_(pa.int64())), "score": pa.array(scores, pa.float64())})

    return run


def _nearest_of_sample(asked: np.ndarray, k: int):
    """The k nearest vectors of each sampled query among a task's rows; equal ones, which every setting finds, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.empty(0), np.empty((0, asked.shape[1]))) for _ in asked]
        for batch in batches:
            for d, _, v in _vectors(batch.column(1)):
                if d != asked.shape[1]:
                    continue
                unit = _unit(v)
                for i, near in enumerate(asked @ unit.T):
                    score, vectors = np.append(kept[i][0], near), np.concatenate([kept[i][1], unit])
                    score = np.where(score > 1 - 1e-12, -np.inf, score)
                    top = np.argsort(-score, kind="stable")[:k]
                    kept[i] = score[top], vectors[top]
        of = np.repeat(np.arange(len(asked), dtype=np.int32), [len(x) for x, _ in kept])
        vectors = pa.array([x.tolist() for _, v in kept for x in v], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.concatenate([x for x, _ in kept])), vectors], ["query", "score", "v"])

    return run


def settings(asked: np.ndarray, neighbours: list[np.ndarray], rows: np.ndarray) -> tuple[Setting, float, float]:
    """(setting, share of the neighbours that it finds, share of the rows that it compares), by sampled unit vectors.

    The setting with the fewest rows compared of those that find FOUND of the neighbours of each query; the one that finds
    the most, if none does.
    """
    spread = math.sqrt(max(1e-12, 1 - float((rows.mean(axis=0) ** 2).sum()))) if len(rows) else 1.0
    true, owner = np.concatenate(neighbours), np.repeat(np.arange(len(asked)), [len(x) for x in neighbours])
    tried = []
    for width, factor in WIDTHS:
        s = Setting(width, factor * spread, max(PROBES))
        rank = np.full(len(true), max(PROBES))
        visited = np.full((len(asked), len(rows)), max(PROBES))
        for t in range(TABLES):
            codes = _probed(asked, s, t)[0]
            of_true, of_rows = (_codes(np.floor(_hashed(x, s, t)).astype(np.int64), x.shape[1], s, t)[0] for x in (true, rows))
            for k in range(len(asked)):
                order = np.argsort(codes[k], kind="stable")
                mine = codes[k][order]
                for codes_of, out in ((of_true[owner == k], None), (of_rows, visited[k])):
                    at = np.minimum(np.searchsorted(mine, codes_of), len(mine) - 1)
                    when = np.where(mine[at] == codes_of, order[at], max(PROBES))
                    if out is None:
                        rank[owner == k] = np.minimum(rank[owner == k], when)
                    else:
                        np.minimum(out, when, out=out)
        for probes in PROBES:
            tried.append((float((rank < probes).mean()), float((visited < probes).mean()), s._replace(probes=probes)))
    good = [x for x in tried if x[0] >= FOUND] or [max(tried, key=lambda x: (x[0], -x[1]))]
    found, compared, best = min(good, key=lambda x: (x[1], x[2].probes))
    return best, found, compared


def fit(rows: DataFrame, asked: DataFrame, k: int) -> tuple[Setting, float, float]:
    """`settings` by FIT_QUERIES of the queries, whose nearest k of all rows are taken, and about FIT_ROWS of the rows."""
    common_dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common_dim is None:
        return Setting(*WIDTHS[0], PROBES[0]), 1.0, 1.0
    of_dim = F.size("v") == common_dim["d"]
    every = max(1, common_dim["count"] // FIT_ROWS)
    names = asked.where(of_dim).select("h1", "h2").orderBy("h1", "h2").limit(FIT_QUERIES)
    sample = [r.v for r in asked.join(F.broadcast(names), ["h1", "h2"], "left_semi").select("v").collect()]
    if not sample:
        return Setting(*WIDTHS[0], PROBES[0]), 1.0, 1.0
    some = [r.v for r in rows.where(of_dim & (F.pmod("h2", F.lit(every)) == 0)).select("v").collect()]  # every-th by hash
    sample, some = _unit(np.array(sample, dtype=float)), _unit(np.array(some or sample, dtype=float))
    near = rows.select("ids", "v").mapInArrow(_nearest_of_sample(sample, k), "query int, score double, v array<double>")
    best = Window.partitionBy("query").orderBy(F.desc("score"))
    near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("query", "v", "score").collect()
    of = [np.array([r.v for r in near if r.query == i and r.score > -2], dtype=float).reshape(-1, sample.shape[1]) for i in range(len(sample))]
    if not sum(map(len, of)):
        return Setting(*WIDTHS[0], PROBES[0]), 1.0, 1.0
    return settings(sample, of, some)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The `k` rows of `vectors` of largest cosine found for each row of `queries`, both of vec_id (unique) and embedding.

    A row is no candidate of a query of its own id. Vectors that are null, empty or zero, or hold a null or non-finite
    component, take no part, as queries or rows, nor do rows without id; vectors of different lengths are not compared, and
    settings are fitted on the most common length. Other columns are ignored. Result: query_id, rank (from 1), vec_id,
    score (cosine in double precision), nearest first, ties to the smaller vec_id. A query that finds fewer than k in
    its buckets is held against all rows, so that it gets k if there are k.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind = "float" if isinstance(element, T.FloatType) and queries.schema["embedding"].dataType.elementType == element else "double"
    whole = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    taken = lambda df: df.where("vec_id is not null").where(whole).select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("v")).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    # Of equal vectors k + 1 ids can count: the smallest, one of which may be the query's own.
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    rows = taken(vectors).withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    rows = common.materialize(rows.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")))
    queried = common.materialize(taken(queries).select("vec_id", "h1", "h2"))
    asked = common.materialize(taken(queries).groupBy("h1", "h2").agg(F.first("v").alias("v")))
    s, _, _ = fit(rows, asked, k)
    groups = max(1, -(-(rows.agg(F.sum(F.size("v"))).first()[0] or 0) // CELL))
    s = s._replace(coarse=min(s.width, groups.bit_length() + 1))
    cells = ["dim", "tab", "grp"]
    placed = common.spread(rows).select("ids", "v").mapInArrow(_row_cells(s, groups), f"dim int, tab int, grp int, code long, ids array<long>, v array<{kind}>")
    held = common.materialize(placed.groupBy(*cells).agg(F.ceil(F.count("*") * F.first("dim") / CELL).cast("int").alias("parts")))  # a row per cell

    def search(probing: DataFrame) -> DataFrame:
        """The k + 1 nearest vectors found for each query, with their ids."""
        probing = common.materialize(probing)
        blocks = probing.groupBy(*cells).agg(F.ceil(F.count("*") / ASKED).cast("int").alias("turns")).join(held, cells)
        blocks = common.materialize(blocks)
        each = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
        share = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
        at = probing.join(blocks, cells).withColumn("turn", share("turns", "h1", "h2")).select(*cells, "turn", "h1", "h2", "v", "probes", each("parts", "part"))
        of = placed.join(blocks, cells).withColumn("part", share("parts", F.col("ids")[0])).select(*cells, "part", "code", "ids", "v", each("turns", "turn"))
        keys = [*cells, "part", "turn"]
        found = at.groupBy(*keys).cogroup(of.groupBy(*keys)).applyInArrow(_ranked(k + 1), "h1 long, h2 long, ids array<long>, score double")
        best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), F.col("ids")[0])
        merged = found.groupBy("h1", "h2", "ids").agg(F.max("score").alias("score"))
        return merged.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("h1", "h2", "score", F.explode("ids").alias("vec_id"))

    def answers(found: DataFrame) -> DataFrame:
        mine = queried.withColumnRenamed("vec_id", "query_id").join(found, ["h1", "h2"]).where("vec_id != query_id")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return mine.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    probing = "dim int, tab int, grp int, h1 long, h2 long, v array<{}>, probes array<long>".format(kind)
    found = common.materialize(search(common.spread(asked).select("h1", "h2", "v").mapInArrow(_query_cells(s, groups), probing)))
    first = common.materialize(answers(found))
    full = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = common.materialize(queried.join(full, "vec_id", "left_anti").select("h1", "h2").distinct())
    if not short.isEmpty():
        every = asked.join(short, ["h1", "h2"], "left_semi").select(F.size("v").alias("dim"), "h1", "h2", "v", F.array().cast("array<long>").alias("probes"))
        every = every.join(held.where("tab = 0").select(*cells), "dim").select(*cells, "h1", "h2", "v", "probes")
        first = first.join(short, ["h1", "h2"], "left_anti").unionByName(answers(search(every)))
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest of each row of `embeddings` whose vec_id is divisible by 50."""
    table = common.read(spark, sf_dir, "embeddings")
    return nearest(table, table.where("vec_id % 50 = 0"))
