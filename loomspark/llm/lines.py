"""Line dedup: a segment-partition edit join over the distinct lines of all documents.

A line is split into EDITS + 1 segments. Of two lines within EDITS edits, one segment of the shorter occurs
unchanged in the longer, at a place that its number, the lengths and the edits left of and right of it allow:
those substrings, for each length from EDITS shorter to its own, are the probes of a line. Keys of length, segment
number and substring bring lines together; a banded bit-parallel edit distance over code points decides. Its cost is
that of the band: 2 * EDITS + 1 places for each character between the lines' common beginning and end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import cluster, common

#: Edits between near-equal lines; shorter lines than CHARS are only matched as a whole.
EDITS, CHARS = 2, 32
_BLANK = np.array([32, *range(9, 14)])
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance of a and b is at most k.

    reach[e] holds, in 2k + 1 bits, which prefixes of a are within e edits of the prefix of b read so far: bit t is the
    prefix that is t - k longer than it. A match and a substitution keep the bit, a character of b alone moves it
    down, one of a alone up.
    """
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    a, b = _differing(a, b)
    m, n = len(a), len(b)
    full = (1 << 2 * k + 1) - 1
    reach = [((1 << e + 1) - 1) << k & full for e in range(k + 1)]
    for j, c in enumerate(b):
        low = j - k
        same = 0
        for i in range(max(0, low), min(m, j + k + 1)):  # the band alone
            if a[i] == c:
                same |= 1 << i - low
        new = [reach[0] & same]
        for e in range(1, k + 1):
            new.append((reach[e] & same | reach[e - 1] | reach[e - 1] >> 1 | new[e - 1] << 1) & full)
        reach = new
        if not reach[k]:
            return False
    return bool(reach[k] >> m - n + k & 1)


def _differing(a: str, b: str) -> tuple[str, str]:
    """a and b without their common beginning and end, which no cheapest edit touches; found by halving, not by character."""

    def shared(same, most: int) -> int:
        low, high = 0, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if same(low, middle) else (low, middle - 1)
        return low

    most = min(len(a), len(b))
    front = shared(lambda x, y: a[x:y] == b[x:y], most)
    m, n = len(a), len(b)
    back = shared(lambda x, y: a[m - y : m - x] == b[n - y : n - x], most - front)
    return a[front : m - back], b[front : n - back]


class _Lines:
    """All lines of some texts: hashes, lengths and where they begin in one array of code points."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        stops = np.append(np.flatnonzero(self.codes == 10), len(self.codes))
        self.start = np.concatenate([[0], stops[:-1] + 1]).astype(np.int64)
        self.length = stops - self.start
        counts = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(texts)), counts)
        self.number = np.arange(len(self.owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        n = len(self.codes)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(common.mix(self.codes.astype(np.uint64), 3) * common.powers(common._BASE, n), out=self.total[1:])
        self.inverse = common.powers(common._INVERSE, n + 1)
        marks = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(~np.isin(self.codes, _BLANK), out=marks[1:])
        self.blank = marks[self.start + self.length] == marks[self.start]
        self.ids = self.hashes(self.start, self.length)

    def hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return common.mix((self.total[start + size] - self.total[start]) * self.inverse[start])

    def second(self) -> np.ndarray:
        """Another hash of the lines, of other characters and powers: equal lines are told by both."""
        n = len(self.codes)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(common.mix(self.codes.astype(np.uint64), 4) * common.powers(_BASE, n), out=total[1:])
        return common.mix((total[self.start + self.length] - total[self.start]) * common.powers(_INVERSE, n + 1)[self.start], 6)

    def text(self, k: int) -> str:
        return self.codes[self.start[k] : self.start[k] + self.length[k]].tobytes().decode("utf-32-le", "surrogatepass")


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[list[pa.Array], _Lines]]:
    """(the columns beside the text, lines) of runs of rows of about CHUNK_BYTES characters; the text is the first column."""
    texts, low, size = batch.column(0).to_pylist(), 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= common.CHUNK_BYTES or k == len(texts) - 1:
            yield [c.slice(low, k + 1 - low) for c in batch.columns[1:]], _Lines(texts[low : k + 1])
            low, size = k + 1, 0


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, lines in _batches(batch):
            cols = [lines.number.astype(np.int32), common.signed(lines.ids), common.signed(lines.second()), lines.length.astype(np.int32), lines.blank]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(lines.owner)) for c in ids), *(pa.array(c) for c in cols)], ["doc_id", "doc_hash", "line_no", "id", "id2", "n_chars", "blank"])


def segments(length: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of each of `parts` segments of lines of some lengths; the last ones are a character longer."""
    size, longer = length // parts, length % parts
    out, start = [], np.zeros_like(length)
    for i in range(parts):
        mine = size + (i >= parts - longer)
        out.append((start, mine))
        start = start + mine
    return out


def _key_rows(edits: int, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, lines in _batches(batch):
                _, one = np.unique(lines.ids, return_index=True)
                one = one[(lines.length[one] >= chars) & ~lines.blank[one]]
                start, length, ids = lines.start[one], lines.length[one], lines.ids[one]
                keys, of, index = [], [], []

                def add(at, size, target, number, which, indexed):
                    salt = common.mix(target[which].astype(np.uint64) * np.uint64(edits + 1) + np.uint64(number), 9)
                    keys.append(common.mix(lines.hashes(start[which] + at[which], size[which]) ^ salt))
                    of.append(ids[which])
                    index.append(np.full(len(which), indexed))

                for less in range(edits + 1):
                    target = length - less
                    fits = np.flatnonzero(target >= chars)
                    for i, (at, size) in enumerate(segments(target, edits + 1)):
                        low, high = max(-i, less - (edits - i)), min(i, less + edits - i)
                        for move in range(low, high + 1):
                            here = at + move
                            which = fits[(here[fits] >= 0) & (here[fits] + size[fits] <= length[fits])]
                            add(here, size, target, i, which, less == 0 and move == 0)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(common.signed(np.concatenate(keys))), pa.array(common.signed(np.concatenate(of))), pa.array(np.concatenate(index))], ["key", "id", "indexed"])

    return run


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chosen lines of each text; a batch has the text and (line number, id) of the lines."""
    for batch in batches:
        ids, out = [], []
        for text, chosen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parts = text.split("\n")
            for at in chosen:
                # Another text of the same doc_id may have another line there, or none.
                if at["line_no"] < len(parts) and common.signed(_Lines([parts[at["line_no"]]]).ids)[0] == at["id"]:
                    ids.append(at["id"])
                    out.append(parts[at["line_no"]])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["id", "line"])


def _near_rows(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([within(x, y, edits) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


#: Bins that characters are counted in: an edit changes two counts by one at most.
_BINS = 64


def _histograms(texts: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(owner * _BINS + codes % _BINS, minlength=len(texts) * _BINS).reshape(-1, _BINS).astype(np.int16)


def _block_links(edits: int):
    """Links between the guests of a block and its other lines.

    Lines whose lengths differ by more than the edits, or whose counts of characters by more than twice the edits, cannot be
    linked; numpy rules those out, a row of the block at a time. The others are decided exactly.
    """

    def run(table: pa.Table) -> pa.Table:
        guest, ids, comps = (table.column(c).to_numpy() for c in ("guest", "id", "component"))
        texts = table.column("line").to_pylist()
        guests, held = np.flatnonzero(guest), np.flatnonzero(~guest)
        a, b = [], []
        if len(guests) and len(held):
            length, counts = np.array([len(t) for t in texts]), _histograms(texts)
            mine = counts[held]
            for k in guests.tolist():
                near = (np.abs(length[held] - length[k]) <= edits) & (comps[held] != comps[k])
                near = np.flatnonzero(near)
                near = near[np.abs(mine[near] - counts[k]).sum(axis=1) <= 2 * edits]
                for x in held[near].tolist():
                    if within(texts[k], texts[x], edits):
                        a.append(min(ids[k], ids[x]))
                        b.append(max(ids[k], ids[x]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


#: Lines of a bucket that are compared in one task.
BLOCK = 2048


def line_classes(docs: DataFrame, edits: int = EDITS, chars: int = CHARS) -> DataFrame:
    """Classes of equal and near-equal lines.

    docs: doc_id (a null one comes first) and text; other columns are ignored. Lines end at a line feed. Lines of at least `chars` code
    points within `edits` edits of each other are linked; shorter ones only if equal. Blank lines and null texts (one
    empty line) are in no class but their own, and stay. Rows that repeat a doc_id are told apart by their texts; equal
    rows are judged alike. Result, a row per line: doc_id, line_no (from 0), n_chars, class_doc_id and class_line_no (the
    first line, by doc_id, line_no and hash of the text, that links lead to), kept (whether it is that), doc_hash (of the
    text). Lines are told by 128 bits; of those that share the first 64 with another line, and of those that only
    documents without id have, only equal ones are linked.
    """
    docs = common.spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    hashed = docs.select("text", "doc_id", F.xxhash64("text").alias("doc_hash"))
    lines = common.materialize(hashed.mapInArrow(_line_rows, "doc_id long, doc_hash long, line_no int, id long, id2 long, n_chars int, blank boolean"))
    whole, place = lines.where("not blank"), F.struct("doc_id", "line_no", "doc_hash")
    # Lines are counted together before they are dealt by their hashes: a very common one is a row of each task.
    first = whole.groupBy("id").agg(F.min(place).alias("at"), F.min(F.when(F.col("doc_id").isNotNull(), place)).alias("known"), F.min("id2").alias("low"), F.max("id2").alias("high"))
    first = common.materialize(first)
    keys = docs.where("doc_id is not null").select("text").mapInArrow(_key_rows(edits, chars), "key long, id long, indexed boolean")
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("indexed").alias("indexed"))
    shared = common.materialize(shared.where("low < high and indexed").select("key"))
    members = common.by_ids(keys, shared, "key").select("key", "id").distinct()
    clashing = common.materialize(first.where("low < high").select("id"))
    members = common.materialize(common.by_ids(members, clashing, "id", "left_anti"))

    wanted = first.where("known is not null").join(members.select("id").distinct(), "id", "left_semi").select("id", F.col("known").alias("at"))
    wanted = common.materialize(wanted.groupBy("at.doc_id").agg(F.collect_list(F.struct("at.line_no", "id")).alias("chosen")))
    texts = common.by_ids(docs, wanted.select("doc_id"), "doc_id").join(wanted, "doc_id").select("text", "chosen").mapInArrow(_text_rows, "id long, line string")
    texts = common.materialize(texts.dropDuplicates(["id"]))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
        both = both.where(F.abs(F.length("x") - F.length("y")) <= edits)
        return both.select("a", "b", "x", "y").mapInArrow(_near_rows(edits), "a long, b long")

    def rest(now: DataFrame) -> DataFrame:
        return cluster.blockwise(now, "key", texts, F.lit(1), BLOCK, _block_links(edits))

    comps = cluster.linked(members, verify, rest)
    near = common.materialize(comps.where("component != id").select("component").distinct())
    small = first.where("low = high").select("id", "at").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # Only the classes of several texts need their members' least place.
    grouped = common.by_ids(small, near, "component").groupBy("component").agg(F.min("at").alias("least"))
    classes = small.join(grouped, "component", "left").select("id", F.coalesce("least", "at").alias("at"))
    columns = ["doc_id", "line_no", "n_chars", "doc_hash", "at"]
    out = whole.join(classes, "id").select(*columns)
    odd = common.by_ids(whole, clashing, "id")
    out = out.unionByName(odd.join(odd.groupBy("id", "id2").agg(F.min(place).alias("at")), ["id", "id2"]).select(*columns))
    out = out.unionByName(lines.where("blank").withColumn("at", place).select(*columns))
    return out.select("doc_id", "line_no", "n_chars", F.col("at.doc_id").alias("class_doc_id"), F.col("at.line_no").alias("class_line_no"), F.col("at").eqNullSafe(place).alias("kept"), "doc_hash")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Classes of the lines of `documents`."""
    return line_classes(common.read(spark, sf_dir, "documents"))
