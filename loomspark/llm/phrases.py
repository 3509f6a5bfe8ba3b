"""Phrase collocation mining: broadcast double-array tries count candidates at all positions of a text at once.

Words that are frequent enough get codes; texts are written once as arrays of codes, with 0 for a rare word, the end of a
piece and the end of a document, so that a phrase of frequent words is a run without 0. Then, for lengths 2, 3, 4:

* candidates are phrases of which both parts that lack one end word are frequent, and whose occurrences, counted within
  tasks and summed, reach the least count: the Apriori rule lets no frequent phrase go;
* the candidates are put into double-array tries, which are broadcast; numpy moves the states of all positions at once,
  one level at a time, drops those without a next state, and bincounts the accepting ones; the sums over all tasks
  are the phrases' numbers. The same walk tells at which positions a longer candidate may begin.

A word's code is two symbols, high and low, so that no row of a trie spans more than LOW places. Tries hold SHARD phrases at
most and GROUP of them are broadcast at a time; more phrases, or more than VOCABULARY words, mean more passes over the codes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import common
from loomspark.operators import graph

#: Words per broadcast vocabulary, phrases per trie, tries per pass, and the span of a code's low symbol.
VOCABULARY, SHARD, GROUP, LOW = 1 << 21, 1 << 18, 4, 1 << 11
#: Distinct words and positions that a task gathers before it sends on what it counted.
HELD_WORDS, HELD_KEYS = 1 << 18, 1 << 21
#: Codes in a row of the encoded texts, at least, codes whose states move at once, and rows that a task sends on at once.
STRETCH, STATES, SENT = 1 << 11, 1 << 19, 1 << 16
#: Bytes between words of a piece, and bytes between pieces.
BLANKS, STOPS = b" \t", b".,;:!?\n\x0b\x0c\r"

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(BLANKS)], _KIND[list(STOPS)] = 1, 2
_CODE_BITS = 31


def _letters(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte, the same for a letter in either case."""
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    values[65:91] = values[97:123]
    return values


_HASHES = (_letters(20250117), _letters(20250118))


def _salts(lang: str) -> tuple[int, int]:
    digest = hashlib.sha256(lang.encode()).digest()
    return int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:16], "little")


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell the folded words data[start:end] of a language from others."""
    up, down = common.powers(common._BASE, max(len(data), 1)), common.powers(common._INVERSE, max(len(data), 1))
    out = []
    for letters, salt in zip(_HASHES, _salts(lang)):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(letters[data] * up[: len(data)], out=total[1:])
        out.append(common.mix(((total[end] - total[start]) * down[start]) ^ np.uint64(salt)))
    return out[0], out[1]


def _spans(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, start, end, piece) of the words of some texts, in stretches of about CHUNK_BYTES that end between words.

    `piece` numbers the pieces of all the texts; two neighbouring words belong together if they have the same number.
    """
    offsets, data = common.buffers(texts)
    kinds = _KIND[data]
    at, stops = 0, 0
    while at < len(data):
        end = min(at + common.CHUNK_BYTES, len(data))
        while end < len(data) and not kinds[end - 1]:  # on to the next byte between words, or the next text
            following = np.flatnonzero(kinds[end : end + common.CHUNK_BYTES])
            edge = int(offsets[np.searchsorted(offsets, end)])
            end = min(edge, end + int(following[0]) + 1 if len(following) else end + common.CHUNK_BYTES, len(data))
            if end == edge:
                break
        kind = kinds[at:end]
        inside = kind == 0
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[0], before[1:], after[-1], after[:-1] = False, inside[:-1], False, inside[1:]
        edges = offsets[(offsets > at) & (offsets < end)] - at
        before[edges], after[edges - 1] = False, False
        start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        ended = np.cumsum(kind == 2)
        piece = stops + ended[start] + np.searchsorted(offsets, at + start, side="right")
        stops += int(ended[-1])
        yield data[at:end], start, stop, piece
        at = end


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(language, its texts) of a batch of (lang, text)."""
    coded = batch.column(0).dictionary_encode()
    for k, lang in enumerate(coded.dictionary.to_pylist()):
        yield lang, batch.column(1).filter(pc.equal(coded.indices, k))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n): counts of a task's words; under a null word, of all words."""
    held: Counter = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        keys = list(held)
        for k in range(0, len(keys), SENT):
            part = keys[k : k + SENT]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.string()), pa.array([held[x] for x in part], pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for lang, texts in _by_language(batch):
            for data, start, end, _ in _spans(texts):
                one, two = _word_hashes(data, start, end, lang)
                _, first, which, n = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
                raw = data.tobytes()
                word = lambda i: raw[start[i] : end[i]].lower().decode()
                if (two[first][which] == two).all():
                    for i, k in zip(first.tolist(), n.tolist()):
                        held[lang, word(i)] += k
                else:  # two words of one hash
                    held.update((lang, word(i)) for i in range(len(start)))
                held[lang, None] += len(start)
                if len(held) > HELD_WORDS:
                    yield from rows()
                    held.clear()
    yield from rows()


def vocabulary(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n, code, h1, h2) of the words that occur `least` times in a language, codes from 1, and (lang, n) of all words."""
    counts = docs.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = common.materialize(counts.where(F.col("word").isNull() | (F.col("n") >= least)))
    words = counts.where("word is not null").withColumn("at", F.struct("lang", -F.col("n"), "word"))
    words = graph.ranks(words, "at", 1).select("lang", "word", "n", F.col("rank").cast("int").alias("code"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order, ones, twos = [], [], []
            places = pa.array(np.arange(batch.num_rows))
            for lang, mine in _by_language(pa.RecordBatch.from_arrays([batch.column(0), places], ["lang", "at"])):
                mine = mine.to_numpy()
                offsets, data = common.buffers(batch.column(1).take(pa.array(mine)))
                one, two = _word_hashes(data, offsets[:-1], offsets[1:], lang)
                order.append(mine)
                ones.append(one)
                twos.append(two)
            back = np.argsort(np.concatenate(order))
            hashes = [pa.array(common.signed(np.concatenate(h)[back])) for h in (ones, twos)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *hashes], ["lang", "word", "n", "code", "h1", "h2"])

    words = words.mapInArrow(hashed, "lang string, word string, n long, code int, h1 long, h2 long")
    return common.materialize(words), counts.where("word is null").select("lang", "n")


def _stretches(codes: np.ndarray) -> Iterator[slice]:
    """Parts of an array of codes, STRETCH or more each, that end with a 0."""
    ends = np.flatnonzero(codes == 0) + 1
    cuts = np.unique(ends[np.searchsorted(ends, np.arange(STRETCH, len(codes), STRETCH))])
    edges = np.unique([0, *cuts.tolist(), len(codes)]).tolist()
    yield from (slice(x, y) for x, y in zip(edges, edges[1:]))


def _word_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, codes): the hashes of words in order, 0 before and after each piece, and as many codes of 0."""
    for batch in batches:
        for lang, texts in _by_language(batch):
            last, ones, twos = -1, [], []
            for data, start, end, piece in _spans(texts):
                if len(start):
                    one, two = _word_hashes(data, start, end, lang)
                    new = np.flatnonzero(np.diff(piece, prepend=last))
                    ones.append(np.insert(one, new, 0))
                    twos.append(np.insert(two, new, 0))
                    last = piece[-1]
            one, two = (np.concatenate([*x, np.zeros(1, dtype=np.uint64)]) for x in (ones, twos))
            parts = list(_stretches(one))
            columns = [[x[part].tobytes() for part in parts] for x in (one, two, np.zeros(len(one), dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["h1", "h2", "codes"])


def encode(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(codes): runs of documents as int32 codes, 0 for rare words and around pieces.

    Words are looked up by their hashes in a broadcast part of the vocabulary, VOCABULARY words at most; where it is larger,
    further passes look up what is still 0.
    """
    size = words.agg(F.max("code")).first()[0] or 0
    rows = docs
    for low in range(0, max(size, 1), VOCABULARY):
        part = words.where((F.col("code") > low) & (F.col("code") <= low + VOCABULARY)).select("h1", "h2", "code").toArrow()
        h1, h2, code = (part.column(c).to_numpy() for c in ("h1", "h2", "code"))
        order = np.argsort(h1.view(np.uint64), kind="stable")
        known = docs.sparkSession.sparkContext.broadcast((h1.view(np.uint64)[order], h2.view(np.uint64)[order], code.astype(np.int32)[order]))
        last = low + VOCABULARY >= size
        rows = common.materialize(rows.mapInArrow(_look_up(known, not low, last), "codes binary" if last else "h1 binary, h2 binary, codes binary"))
    return rows


def _look_up(known, first: bool, last: bool):
    """Codes of a part of the vocabulary, put into runs; the first pass makes the runs of the texts, in the same worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, code = known.value
        for batch in _word_runs(batches) if first else batches:
            out = []
            for h1, h2, codes in zip(*(batch.column(k) for k in range(3))):
                a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (h1, h2))
                codes = np.frombuffer(codes.as_buffer(), dtype=np.int32)
                if len(one):
                    at = np.minimum(np.searchsorted(one, a), len(one) - 1)
                    codes = np.where((one[at] == a) & (two[at] == b) & (a | b != 0), code[at], codes)
                out.append(codes.tobytes())
            coded = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([coded] if last else [batch.column(0), batch.column(1), coded], ["codes"] if last else ["h1", "h2", "codes"])

    return run


# ---------------------------------------------------------------- double-array tries


def symbols(codes: np.ndarray) -> np.ndarray:
    """The symbols of a matrix of codes, a phrase a row: high and low of each word."""
    return np.stack([codes // LOW, codes % LOW], axis=2).reshape(len(codes), -1)


def build_trie(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, phrase) of the distinct phrases codes[i], sorted, all of one length.

    From a state s the symbol x leads to base[s] + x if check[base[s] + x] = s. State 1 is the root; phrase is the row of an
    accepting state, else -1. The first and the last place are never taken. Rows with more than one child are placed largest first, where
    they fit into holes, else behind all others; those with one child fill the holes that are left.
    """
    signs = symbols(codes)
    n, depth = signs.shape
    new = np.ones((depth, n), dtype=bool)  # where a node of each level begins
    differs = np.zeros(n - 1, dtype=bool)
    for j in range(depth):
        differs = differs | (signs[1:, j] != signs[:-1, j])
        new[j, 1:] = differs
    rng, size = np.random.default_rng(0), 2
    used = np.zeros(1 << 16, dtype=bool)
    used[:2] = True
    base, check = np.zeros(len(used), dtype=np.int64), np.full(len(used), -1, dtype=np.int64)

    def room(to: int) -> None:
        nonlocal used, base, check
        if to >= len(used):
            more = max(to + 1 - len(used), len(used))
            used, base, check = np.append(used, np.zeros(more, dtype=bool)), np.append(base, np.zeros(more, dtype=np.int64)), np.append(check, np.full(more, -1, dtype=np.int64))

    state = np.ones(1, dtype=np.int64)  # of each node of the level above
    parent = np.zeros(n, dtype=np.int64)  # that node's number, for each phrase
    for j in range(depth):
        first = np.flatnonzero(new[j])
        of, sign = parent[first], signs[first, j]
        count = np.bincount(of, minlength=len(state))
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        places = np.empty(len(first), dtype=np.int64)
        holes = np.flatnonzero(~used[:size])
        many = np.flatnonzero(count > 1)
        for turn, node in enumerate(many[np.argsort(-count[many], kind="stable")].tolist()):
            own = slice(begin[node], begin[node] + count[node])
            row = sign[own]
            if turn % 1024 == 1023:
                holes = np.flatnonzero(~used[:size])
            at = size - row[0]
            if len(holes):
                tried = rng.choice(holes, 32) - row[0]
                room(int(tried.max() + row[-1]))
                fits = np.flatnonzero((tried + row[0] > 1) & ~used[tried[:, None] + row].any(axis=1))
                at = tried[fits[0]] if len(fits) else at
            room(int(at + row[-1]))
            base[state[node]] = at
            places[own] = at + row
            used[places[own]] = True
            size = max(size, int(places[own][-1]) + 1)
        single = np.flatnonzero(count == 1)
        if len(single):
            holes = np.flatnonzero(~used[:size])[: len(single)]
            holes = np.concatenate([holes, size + np.arange(len(single) - len(holes))])
            room(int(holes[-1]) if len(holes) else size)
            places[begin[single]] = holes
            used[holes] = True
            base[state[single]] = holes - sign[begin[single]]
            size = max(size, int(holes.max()) + 1)
        check[places] = state[of]
        state, parent = places, np.cumsum(new[j]) - 1
    room(size)
    phrase = np.full(size + 1, -1, dtype=np.int32)
    phrase[state[parent]] = np.arange(n)
    return base[: size + 1].astype(np.int32), np.append(check[:size], -1).astype(np.int32), phrase


def walk(codes: np.ndarray, length: int, trie: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, accepting states) of the phrases of a trie in an array of codes: all positions move on together, a level at a time."""
    base, check, _ = trie
    whole = codes != 0
    for k in range(1, length):
        whole = whole[:-1] & (codes[k:] != 0) if len(whole) > 1 else whole[:0]
    at = np.flatnonzero(whole)
    states = np.ones(len(at), dtype=np.int32)
    for k in range(2 * length):
        word = codes[at + k // 2]
        following = base[states] + (word % LOW if k % 2 else word // LOW)
        on = check.take(following, mode="clip") == states
        at, states = at[on], following[on]
    return at, states


def _passes(length: int, tries, whole: bool, extend: bool):
    """Rows (rank, code, n) of a task: with code 0 how often the phrase of a rank occurs, else how often that code follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tries.value if tries is not None else []
        sums = [np.zeros(len(t[1]), dtype=np.int64) for _, t in known]
        held, size = [], 0

        def keys() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            yield from _rows(key >> _CODE_BITS, (key & ((1 << _CODE_BITS) - 1)).astype(np.int32), n)

        for codes in _joined(batches):
            ranks = np.where(codes > 0, codes, -1).astype(np.int64) if tries is None else np.full(len(codes), -1, dtype=np.int64)  # of the phrase at each position
            for (low, trie), total in zip(known, sums):
                at, states = walk(codes, length, trie)
                total += np.bincount(states, minlength=len(total))
                ranks[at] = trie[2][states].astype(np.int64) + low
            if not extend:
                continue
            at = np.flatnonzero(ranks[: max(len(codes) - length, 0)] >= 0)
            at = at[(codes[at + length] > 0) & ((ranks[at + 1] >= 0) if whole else True)]
            held.append(ranks[at] << _CODE_BITS | codes[at + length])
            size += len(at)
            if size >= HELD_KEYS:
                yield from keys()
                held, size = [], 0
        if size:
            yield from keys()
        for (low, trie), total in zip(known, sums):
            at = np.flatnonzero(total)
            yield from _rows(trie[2][at].astype(np.int64) + low, np.zeros(len(at), dtype=np.int32), total[at])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Codes of rows in a row, about STATES at a time; each row ends with a 0, so that no phrase is made or lost."""
    held, size = [], 0
    for batch in batches:
        for value in batch.column(0):
            held.append(value.as_py())
            size += len(held[-1]) // 4
            if size >= STATES:
                yield np.frombuffer(b"".join(held), dtype=np.int32)
                held, size = [], 0
    if size:
        yield np.frombuffer(b"".join(held), dtype=np.int32)


def _rows(rank: np.ndarray, code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rank), SENT):
        part = slice(k, k + SENT)
        yield pa.RecordBatch.from_arrays([pa.array(rank[part].astype(np.int64)), pa.array(code[part]), pa.array(n[part].astype(np.int64))], ["rank", "code", "n"])


def _tries_of(level: DataFrame, length: int, low: int) -> list:
    """(first rank, trie) of the phrases (rank, p) from rank `low` on, GROUP tries of SHARD phrases at most, each built in a task."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        base, check, phrase = build_trie(rows[[f"c{k}" for k in range(length)]].to_numpy(dtype=np.int64))
        return pd.DataFrame({"low": [int(rows["rank"].iloc[0])], "base": [base.tobytes()], "check": [check.tobytes()], "phrase": [phrase.tobytes()]})

    mine = level.where((F.col("rank") >= low) & (F.col("rank") < low + GROUP * SHARD))
    mine = mine.select((F.col("rank") / SHARD).cast("long").alias("shard"), "rank", *(F.col("p")[k].alias(f"c{k}") for k in range(length)))
    made = mine.groupBy("shard").applyInPandas(build, "low long, base binary, check binary, phrase binary").collect()
    return [(r.low, tuple(np.frombuffer(x, dtype=np.int32) for x in (r.base, r.check, r.phrase))) for r in made]


def count_phrases(encoded: DataFrame, words: DataFrame, longest: int, least: int) -> DataFrame:
    """(p, f): the phrases of 1 to `longest` codes that occur `least` times or more, and how often."""
    spark = encoded.sparkSession
    schema = "rank long, code int, n long"
    known = words.select(F.array("code").alias("p"), F.col("n").alias("f"))
    level, prefix = None, words.select(F.col("code").cast("long").alias("rank"), F.array("code").alias("p"))
    for length in range(1, longest + 1):
        size = 0 if level is None else level.count()
        if level is not None and not size:
            break
        counted = None
        for low in range(0, max(size, 1), GROUP * SHARD):
            tries = None if level is None else spark.sparkContext.broadcast(_tries_of(level, length, low))
            made = encoded.mapInArrow(_passes(length, tries, size <= GROUP * SHARD, length < longest), schema)
            made = common.materialize(made.groupBy("rank", "code").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
            counted = made if counted is None else counted.unionByName(made)
        if level is not None:
            known = known.unionByName(level.join(counted.where("code = 0"), "rank").select("p", F.col("n").alias("f")))
            prefix = level
        if length < longest:
            longer = counted.where("code > 0").join(prefix, "rank").select(F.concat("p", F.array("code")).alias("p"))
            level = common.materialize(graph.ranks(longer, "p"))
    return known


def mine_phrases(docs: DataFrame, longest: int = 4, least: int = 30, covered: int = 80, top: int | None = 2000) -> DataFrame:
    """The phrases of each language that hold together best.

    docs: lang and text; other columns are ignored, so their names cannot clash. A null text is empty, a null lang is `und`; a language
    without a candidate has no row, and an empty table gives none. Candidates, of 2 to `longest` words with a = f(phrase) >= least,
    are scored by floor(2000000 a / (l + r)) at their lowest-scoring cut (ties to the earliest), and dropped where a longer candidate
    that holds them has 100 f(longer) >= covered * a. Repeated documents count each time. Result: lang, rank (from 1), phrase, a, l, r, n, score,
    the first `top` of each language, or all, by score and a (descending) and phrase (in UTF-8 order).
    """
    docs = common.spread(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    words, totals = vocabulary(docs, least)
    known = common.materialize(count_phrases(encode(docs, words), words, longest, least))
    candidates = known.where(F.size("p") > 1)

    # All cuts of a candidate; both parts are frequent, so `known` has them.
    part = lambda name, f: known.select(F.col("p").alias(name), F.col("f").alias(f))
    cuts = candidates.select("p", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.slice("p", F.lit(1), F.col("k"))).withColumn("rest", F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")))
    cuts = cuts.join(part("first", "l"), "first").join(part("rest", "r"), "rest")
    exact = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = cuts.groupBy("p", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))

    # The most frequent longer candidate around each phrase: all inner runs of 2 words or more of each.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("p") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("p") - m + 1), lambda i: F.slice("p", i, m))))
    around = candidates.where(F.size("p") > 2).select(F.explode(inner).alias("p"), "f").groupBy("p").agg(F.max("f").alias("longer"))
    left = best.join(around, "p", "left").where(F.expr(f"longer is null or cast(100 as decimal(3, 0)) * longer < cast({covered} as decimal(10, 0)) * a"))

    small = words.count() <= common.BROADCAST_ROWS
    names = words.select("code", "lang", "word")
    named = left.select("p", "a", "cut", F.posexplode("p").alias("pos", "code")).join(F.broadcast(names) if small else names, "code")
    named = named.groupBy("p", "a", "cut", "lang").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("words"))
    named = named.select("lang", F.array_join("words.word", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    ranked = graph.grouped_ranks(named.withColumn("at", F.struct(-F.col("score"), -F.col("a"), "phrase")), ["lang"], "at", "rank")
    ranked = ranked.withColumn("rank", F.col("rank") + 1)
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(spark, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of each language of `documents` that hold together best."""
    return mine_phrases(common.read(spark, sf_dir, "documents"))


#: The same rows by plain SQL over all runs of words.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
w AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, m, ws[i : i + m - 1] AS p FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, p, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, p, f AS a FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT c.*, k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f)::HUGEINT AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, m)) AS k FROM c) AS c
      JOIN f AS x ON x.lang = c.lang AND x.p = c.p[1 : k] JOIN f AS y ON y.lang = c.lang AND y.p = c.p[k + 1 :]),
b AS (SELECT lang, p, a, l, r, score FROM k QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
i AS (SELECT lang, p[i : i + s - 1] AS p, max(a) AS longer
      FROM (SELECT lang, p, a, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM c)) GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.p = b.p
      WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o JOIN n USING (lang) QUALIFY rank <= 2000
"""
