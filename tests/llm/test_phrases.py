"""Phrase mining: the trie against a dictionary, small tables against counting by hand, limits made small, SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np

from loomspark.llm import phrases


def by_hand(rows, least=30, longest=4, covered=80, top=2000):
    """All phrases of (lang, text) rows, counted in Python."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, p), a in cands.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(inside[lang, p[i : i + m]], a)
    out = {}
    for (lang, p), a in cands.items():
        if 100 * inside[lang, p] >= covered * a:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def texts(seed, count):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "größe", "ÄB", "x" * 300, "a b", "🙂", "in", "on", "at"] + [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(len(words))]
    marks = [" ", " ", " ", " ", " ", "\t", "  ", ", ", ". ", "\n", "; ", " ? ", "\x0b", "!"]
    out = []
    for k in range(count):
        text = "".join(rng.choices(words, weights)[0] + rng.choice(marks) for _ in range(rng.randrange(60)))
        out.append((rng.choice(["en", "en", "de", None, "und"]), text + (" in the new york of it" if k % 3 == 0 else "")))
    return out


def test_trie_against_a_dictionary():
    rng = np.random.default_rng(3)
    for length, spread, n in ((1, 50, 20), (2, 30, 400), (2, 9000, 5000), (3, 12, 900), (4, 5000, 3000), (4, 4, 200)):
        codes = np.unique(rng.zipf(1.3, (n, length)).clip(1, spread), axis=0)
        trie = phrases.build_trie(codes.astype(np.int64))
        known = {tuple(c): i for i, c in enumerate(codes.tolist())}
        text = rng.zipf(1.2, 20000).clip(0, spread + 3).astype(np.int32)
        text[rng.random(len(text)) < 0.05] = 0
        at, states = phrases.walk(text, length, trie)
        want = {i: known[w] for i in range(len(text) - length + 1) if (w := tuple(text[i : i + length].tolist())) in known}
        assert dict(zip(at.tolist(), trie[2][states].tolist())) == want
    one = phrases.build_trie(np.array([[5, 4999]]))
    assert phrases.walk(np.array([5, 4999, 0, 5, 4999], dtype=np.int32), 2, one)[0].tolist() == [0, 3]
    assert phrases.walk(np.array([5], dtype=np.int32), 2, one)[0].tolist() == [] == phrases.walk(np.array([], dtype=np.int32), 2, one)[0].tolist()


def test_small_tables_by_hand(spark):
    rows = texts(1, 400) + [("en", None), ("en", ""), (None, "..."), ("xx", "only once"), ("rep", "same again " * 40)] + [("copy", "one two three four five")] * 30
    df = spark.createDataFrame([(i, lang, text, 0, 0) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n int, score int")
    assert got(phrases.mine_phrases(df)) == by_hand(rows)
    assert got(phrases.mine_phrases(df, longest=3, least=4, covered=60, top=5)) == by_hand(rows, 4, 3, 60, 5)


def test_limits_made_small_change_nothing(spark, monkeypatch):
    rows = texts(2, 300)
    df = spark.createDataFrame(rows, "lang string, text string")
    want = by_hand(rows, 5)
    for name, value in (("VOCABULARY", 7), ("SHARD", 9), ("GROUP", 2)):  # those that the driver reads
        monkeypatch.setattr(phrases, name, value)
    assert got(phrases.mine_phrases(df, longest=3, least=40)) == by_hand(rows, 40, 3)
    monkeypatch.undo()
    assert got(phrases.mine_phrases(df, least=5)) == want


def test_empty_and_wordless_tables(spark):
    for rows in ([], [("en", None), (None, " ,. ")], [("en", "rare words only")]):
        made = phrases.mine_phrases(spark.createDataFrame(rows, "lang string, text string"))
        assert made.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and made.count() == 0


def test_a_piece_without_end(spark):
    text = "alpha beta gamma " * 100_000 + "z" * 3_000_000
    made = got(phrases.mine_phrases(spark.createDataFrame([("en", text)], "lang string, text string")))
    assert made == by_hand([("en", text)])


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    made, want = phrases.op12_phrase_mining(spark, sf), con.sql(phrases.ORACLE)
    assert made.columns == want.columns
    assert got(made) == sorted(want.fetchall())


def test_stretches_of_a_text_do_not_matter(monkeypatch):
    import pyarrow as pa

    rows = texts(4, 60) + [("en", "é" * 500 + " end, " + "y" * 400), ("en", None)]
    batch = pa.RecordBatch.from_arrays([pa.array([lang or "und" for lang, _ in rows]), pa.array([t for _, t in rows])], ["lang", "text"])
    whole = {k: n for b in phrases._word_counts(iter([batch])) for k, n in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2).to_pylist())}
    runs = [np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.uint64) for b in phrases._word_runs(iter([batch]))]
    for name, value in (("STRETCH", 16), ("HELD_WORDS", 5), ("SENT", 3), ("STATES", 20)):
        monkeypatch.setattr(phrases, name, value)
    monkeypatch.setattr(phrases.common, "CHUNK_BYTES", 50)
    parts = Counter()
    for b in phrases._word_counts(iter([batch])):
        for lang, word, n in zip(*(b.column(k).to_pylist() for k in range(3))):
            parts[lang, word] += n
    assert parts == whole
    again = list(phrases._word_runs(iter([batch])))
    assert sum(b.num_rows for b in again) > 50
    assert all((np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.uint64) == x).all() for b, x in zip(again, runs, strict=True))
    monkeypatch.setattr(phrases, "HELD_KEYS", 10)
    codes = pa.RecordBatch.from_arrays([pa.array([np.array([0, 3, 4, 3, 4, 0, 4, 3, 0], dtype=np.int32).tobytes()] * 9)], ["codes"])
    pairs = Counter()
    for b in phrases._passes(1, None, True, True)(iter([codes, codes])):
        for rank, code, n in zip(*(b.column(k).to_pylist() for k in range(3))):
            pairs[rank, code] += n
    assert pairs == {(3, 4): 36, (4, 3): 36}
