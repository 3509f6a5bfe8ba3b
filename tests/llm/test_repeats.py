"""Rows that repeat a doc_id with other texts: substring dedup and decontamination, against brute force."""

import hashlib
import random
import re
from collections import Counter

from loomspark.llm import substring, winnow


def kept_by_hand(rows, window):
    """(doc_id, n_words, n_removed, digest) of each row, from all windows."""
    split = [(i, (t or "").split()) for i, t in rows]
    least = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if i is not None:
                least[w] = min(i, least.get(w, i))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and least[tuple(words[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def texts():
    rng = random.Random(3)
    long, other, third = (" ".join(f"{p}{rng.randrange(10**6)}" for _ in range(200)) for p in "abc")
    rows = [(1, long), (2, other + " " + long), (2, "only five words are here"), (2, third), (3, long), (3, third), (3, third), (4, None), (4, ""), (4, other), (None, long), (None, third), (5, third + " " + third), (5, " ".join(third.split()[50:130]))]
    return rows, long, other, third


def test_substring_dedup_of_repeated_ids(spark):
    rows, *_ = texts()
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == kept_by_hand(rows, 50)


def hits_by_hand(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    known = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in known} if i is not None else ():
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in known:
                    hit |= set(range(k, k + n))
                    found |= known[key]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontamination_of_repeated_ids(spark):
    rows, long, other, third = texts()
    rows += [(6, "tiny item"), (6, "a tiny item there"), (6, "nothing")]
    part = lambda t, a, b: " ".join(t.split()[a:b])
    items = [(1, part(long, 20, 60)), (2, part(long, 30, 50)), (3, "Tiny item"), (4, part(third, 0, 10)), (5, part(third, 0, 9)), (6, None), (7, part(long, 20, 60)), (7, part(other, 5, 25)), (8, "tiny item")]
    items += [(i, part(long, 25, 40)) for i in range(100, 140)]
    got = winnow.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == hits_by_hand(rows, items)
