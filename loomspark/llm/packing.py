"""Packing by cutting-stock column generation.

Each document is tokenised once and cut into full pieces of CAPACITY ids and one shorter rest; only lengths go
on. The lengths' histogram has at most CAPACITY bins, whatever the corpus. A linear program over patterns (how many
pieces of which lengths make one sequence) is solved by column generation: duals of the restricted program price
the lengths, a knapsack dynamic program finds the pattern that they make most worth, until none pays. Rounded-down
patterns and first-fit decreasing for the few pieces left give the plan. Pieces are ranked within their length,
in shares whose number follows from the length's count, and the plan says for each range of ranks which sequence and
offset it gets: ranks and ranges meet by blocks of ranks, in an equi-join, and arithmetic does the rest.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm import common

CAPACITY, END = 2048, 1
#: Pieces of a length that are ranked in one task, about.
SHARE = 200_000
#: The program's lengths are in units of CAPACITY / UNITS; it ends when the bound is this near, or after so many columns.
UNITS, GAP, COLUMNS = 128, 1e-4, 2000
#: White space in one run that the fast encoder is trusted with: its pattern steps back through a run, a stack frame a character.
_LONG_RUN = re.compile(r"\s{20000}")
_encoders: dict[str, tuple] = {}


def _encoder(path: str):
    """Encodes a text to ids. The ranks file beside the tokenizer holds the same vocabulary and is several times as fast.

    Texts with a special token or very long white space go through the tokenizer itself.
    """
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        special = [t.content for t in slow.get_added_tokens_decoder().values()]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            if any(s in text for s in special) or _LONG_RUN.search(text):
                return slow.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[path] = encode
    return _encoders[path]


def _piece_rows(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            ids, start, length, crc, total = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.array([*encode(text.as_py()), end], dtype="<u4")
                for at in range(0, len(tokens), capacity):
                    piece = tokens[at : at + capacity]
                    ids.append(doc)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(tokens))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, start, length, crc, total)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _fill(left: dict[int, int], active: list[int], pattern: dict[int, int], room: int) -> dict[int, int]:
    """`pattern`, with the longest lengths that still fit added."""
    top = len(active)
    while room and top:
        top = bisect.bisect_right(active, room, 0, top)
        if not top:
            break
        n = active[top - 1]
        if k := min(left[n] - pattern.get(n, 0), room // n):
            pattern[n] = pattern.get(n, 0) + k
            room -= n * k
        top -= 1
    return pattern


def _take(left: dict[int, int], active: list[int], pattern: dict[int, int], times: int) -> None:
    for n, k in pattern.items():
        left[n] -= k * times
        if not left[n]:
            del left[n]
            active.pop(bisect.bisect_left(active, n))


def _price(duals: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """The pattern of most worth: an unbounded knapsack by dynamic programming. duals[u] is what a length of u units is worth."""
    best, took = np.full(room + 1, -np.inf), np.zeros(room + 1, dtype=int)
    best[0] = 0
    for c in range(1, room + 1):
        worth = duals[1 : c + 1] + best[c - 1 :: -1][:c]
        took[c] = k = int(np.argmax(worth))
        best[c] = worth[k]
    c = int(np.argmax(best))
    gain, pattern = float(best[c]), Counter()
    while c > 0:
        pattern[int(took[c]) + 1] += 1
        c -= int(took[c]) + 1
    return gain, dict(pattern)


def solve(counts: dict[int, int], room: int) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often each, of the linear program: fewest sequences of `room` units that hold all lengths (in units).

    Column generation: the basis begins with each length alone; the duals price a knapsack; the pattern found enters
    by a simplex step. Ends when no pattern pays, or the bound by the duals is within GAP.
    """
    units = sorted(counts)
    m, place = len(units), {u: i for i, u in enumerate(units)}
    patterns = [{u: room // u} for u in units]
    inverse = np.diag([1.0 / (room // u) for u in units])
    x = inverse @ np.array([counts[u] for u in units], dtype=float)
    bound = 0.0
    for _ in range(COLUMNS):
        duals = np.full(room + 1, -np.inf)
        duals[units] = inverse.sum(axis=0)
        gain, pattern = _price(duals, room)
        value = float(x.sum())
        bound = max(bound, value / max(gain, 1.0))
        if gain <= 1 + 1e-9 or value - bound <= GAP * value:
            break
        column = np.zeros(m)
        for u, k in pattern.items():
            column[place[u]] = k
        step = inverse @ column
        up = np.flatnonzero(step > 1e-12)
        out = int(up[np.argmin(x[up] / step[up])])
        ratio = x[out] / step[out]
        x = np.maximum(x - ratio * step, 0)
        x[out] = ratio
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        patterns[out] = pattern
    return [(p, float(v)) for p, v in zip(patterns, x) if v > 1e-9]


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pattern, times): sequences that use up a histogram of lengths (1 to capacity) with little padding.

    The program runs over lengths in units of capacity / UNITS, rounded up. A pattern of units is then made of real
    lengths, the longest of each unit first but for one of the shortest: in its place, and in what rounding leaves free, go
the longest that fit.
    """
    plan = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    left = {k: v for k, v in histogram.items() if v and k < capacity}
    active, unit = sorted(left), max(1, capacity // UNITS)
    counts: Counter = Counter()
    for n, k in left.items():
        counts[-(-n // unit)] += k
    for pattern, often in sorted(solve(counts, capacity // unit), key=lambda p: -p[1]) if counts else []:
        often = int(often + 1e-6)
        while often > 0:
            real: dict[int, int] = {}
            # One of the shortest is left out: what fits best into its place and into what rounding left free follows.
            last = min(pattern)
            for u, k in ((u, k - (u == last)) for u, k in pattern.items()):
                high = bisect.bisect_right(active, u * unit)
                while k and high and active[high - 1] > (u - 1) * unit:
                    n = active[high - 1]
                    real[n] = min(k, left[n])
                    k -= real[n]
                    high -= 1
                if k:
                    break
            if k or not real and len(pattern) > 1:
                break  # what rounding left free took some of these lengths
            real = _fill(left, active, real, capacity - sum(n * k for n, k in real.items()))
            if not real:
                break
            times = min(often, *(left[n] // k for n, k in real.items()))
            plan.append((real, times))
            _take(left, active, real, times)
            often -= times
    while left:  # first-fit decreasing for what rounding down has left
        real = _fill(left, active, {}, capacity)
        times = min(left[n] // k for n, k in real.items())
        plan.append((real, times))
        _take(left, active, real, times)
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces in a sequence, first sequence, offset of the first): where ranks go."""
    rows, rank, sequence = [], Counter(), 0
    for pattern, times in plan:
        offset = 0
        for n in sorted(pattern, reverse=True):
            k = pattern[n]
            rows.append((n, rank[n], rank[n] + k * times, k, sequence, offset))
            rank[n] += k * times
            offset += n * k
        sequence += times
    return rows


def _blocks(slots: list[tuple[int, int, int, int, int, int]], width: dict[int, int]) -> list[tuple[int, ...]]:
    """The slots, each once for every block of ranks that it touches; a length's blocks are of about the mean size of its slots."""
    return [(n, block, *rest) for n, low, high, *rest in ((s[0], s[1], s[2], *s[1:]) for s in slots) for block in range(low // width[n], (high - 1) // width[n] + 1)]


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Packs the tokens of all documents into sequences of at most `capacity`.

    docs: doc_id and text; other columns are ignored. tokenizer: path of a tokenizer file. A null text counts
    as empty: its document is the `end` id alone. Rows that repeat a doc_id, or have none, are documents of their own, with
    pieces of that id each. Result, a row per piece: doc_id, start (the document's ids before it), length, ids_crc32 (of
    the ids as little-endian unsigned 32-bit), doc_tokens (with the `end` id), sequence_id, offset (there, without gaps
    from 0). No documents give no pieces.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("byte_bpe_50k.json"))
    docs = common.spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    spark = docs.sparkSession
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = common.materialize(docs.mapInArrow(_piece_rows(tokenizer, capacity, end), schema))
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = _slots(plan_patterns(histogram, capacity))
    often = Counter(s[0] for s in slots)
    width = {n: -(-k // often[n]) for n, k in histogram.items()}
    lengths = spark.createDataFrame([(n, -(-k // SHARE), width[n]) for n, k in histogram.items()], "length long, shares long, width long")
    table = spark.createDataFrame(_blocks(slots, width), "length long, block long, low long, high long, k long, sequence long, first long")
    pieces = pieces.join(F.broadcast(lengths), "length").withColumn("share", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("shares")))
    counts = common.materialize(pieces.groupBy("length", "share").agg(F.count("*").alias("n")))  # a row for each SHARE pieces, and each length
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("r", F.row_number().over(inside)).join(F.broadcast(counts), ["length", "share"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("r") - 1).withColumn("block", F.floor(F.col("rank") / F.col("width")))
    placed = ranked.join(F.broadcast(table), ["length", "block"]).where("rank >= low and rank < high")
    n = F.col("rank") - F.col("low")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.floor(n / F.col("k")).cast("long")).alias("sequence_id"), (F.col("first") + (n % F.col("k")) * F.col("length")).alias("offset"))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All `documents`, packed into sequences of 2048 tokens."""
    return pack(common.read(spark, sf_dir, "documents"))
