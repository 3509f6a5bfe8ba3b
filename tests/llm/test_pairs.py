"""Near duplicates, lines, passages and packing against brute force on small, awkward fixtures."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from loomspark.llm import lines, minhash, packing, substring, winnow

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, empty, blank, null, very long and non-ASCII texts."""
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ñandú", "THE", "of"]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    base, passage = make(200), make(70)
    out = [" ".join(base), " ".join(base), " ".join(base).upper()]
    for k in (1, 3, 6, 12, 40):
        near = list(base)
        for _ in range(k):
            near[r.randrange(len(near))] = r.choice(vocabulary)
        out.append(" ".join(near))
    for k in range(4):
        out.append(" ".join(make(30 + k) + passage + make(20)))
    out.append(" ".join(passage + passage))
    out += ["", " \t\n", None, "one", "one", "One", "one two", " x y z", "a  b\x0bc", " ".join(make(5000)), "x" * 20000]
    out.append(" ".join(passage[:50]))
    out.append(" ".join(passage[:49]))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", 0, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, pos int").repartition(3)


def jaccard_components(texts, width, least):
    sets = []
    for t in texts:
        w = SPACED.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= least * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, texts, width):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, width).collect()}
    assert got == jaccard_components(texts, width, 80)


def test_near_duplicates_of_a_large_group(spark):
    """One group of near copies, with outliers that link to some members only; more than a leader can settle."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(120):
        t = list(base)
        for _ in range(r.choice([1, 2, 4, 7, 9])):
            t[r.randrange(len(t))] = f"x{r.randrange(400)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(df, 2).collect()}
    assert got == jaccard_components(texts, 2, 80)


def test_substring(docs, texts):
    words = [SPACED.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    want = {}
    for i, w in enumerate(words):
        gone = set()
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring.substring_dedup(docs, texts=True).collect()}
    assert got == want


@pytest.mark.parametrize("window", [3, 12, 50])
def test_covers(window):
    period, cover, width = substring.cover_for(window)
    for i, j in itertools.product(range(period), repeat=2):
        assert any((i + d) % period in cover and (j + d) % period in cover and d + width <= window for d in range(period))


def test_lines(spark):
    r = random.Random(5)
    long = ["".join(r.choice("abcdeé ") for _ in range(n)) for n in (40, 60, 90)]
    edit = lambda s, k: "".join(c for i, c in enumerate(s) if i not in r.sample(range(len(s)), k))
    pool = [*long, *(edit(s, 1) for s in long), *(edit(edit(s, 1), 1) for s in long), *(s[:20] + "X" + s[20:] for s in long), *(s[:10] + "YZQ" + s[13:] for s in long), "short", "shorts", "", "  "]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randrange(1, 9))) for _ in range(25)] + [None, "", "\n\n", "short"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {(x.doc_id, x.line_no): ((x.class_doc_id, x.class_line_no), x.kept) for x in lines.line_classes(spark.createDataFrame(rows, "doc_id long, text string, line string")).collect()}
    at = [(i, n, s) for i, t in enumerate(texts) for n, s in enumerate((t or "").split("\n"))]
    first = {}
    for i, n, s in at:
        first.setdefault(s, (i, n))
    root = {s: s for s in first}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            e = [i + 1]
            for j, y in enumerate(b):
                e.append(min(d[j] + (x != y), d[j + 1] + 1, e[j] + 1))
            d = e
        return d[-1]

    for a, b in itertools.combinations([s for s in first if len(s) >= lines.CHARS], 2):
        assert lines.within(a, b, 2) == (edits(a, b) <= 2)
        if edits(a, b) <= 2 and find(a) != find(b):
            x, y = sorted((find(a), find(b)), key=first.get)
            root[y] = x
    want = {(i, n): (first[find(s)] if s.strip() else (i, n), (first[find(s)] if s.strip() else (i, n)) == (i, n)) for i, n, s in at}
    assert got == want


def test_edit_distance_of_long_lines():
    import time

    r = random.Random(8)
    a = "".join(r.choice("abcdef") for _ in range(1_000_000))
    began = time.time()
    assert lines.within(a, a[:500_000] + a[500_001:] + "x", 2) and not lines.within(a, a[:300] + "zz" + a[300:900_000] + "z" + a[900_002:], 2)
    assert not lines.within(a, a[1:] + "".join(reversed(a[:1])), 0) and lines.within("x" * 100_000, "x" * 100_002, 2)
    assert time.time() - began < 20


def test_lines_of_repeated_ids(spark):
    """Rows of one doc_id with other texts are told apart; equal rows are judged alike."""
    long = "a line of some forty characters, no less"
    rows = [(1, f"{long}\none"), (1, f"two\n{long}\nthree"), (1, f"two\n{long}\nthree"), (2, f"{long}!\none"), (2, "x"), (None, "y\none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.line_classes(docs)
    want = [(None, 0, True), (None, 1, True), (1, 0, True), (1, 0, True), (1, 0, True), (1, 1, False), (1, 1, False), (1, 1, False), (1, 2, True), (1, 2, True), (2, 0, False), (2, 0, True), (2, 1, False)]
    order = lambda x: (x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.line_no, r.kept) for r in got.collect()), key=order) == sorted(want, key=order)


def test_long_texts_and_short_items(spark, monkeypatch):
    """A passage far inside a long text; items of one to nine words, looked up in place or joined."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    long = [r.choice(words) for _ in range(60_000)]
    items = {n: " ".join(long[30_000 + 50 * n : 30_000 + 51 * n]) for n in range(1, 10)} | {20: " ".join(long[-12:])}
    docs = spark.createDataFrame([(1, " ".join(long)), (2, "nothing of it"), (3, items[9])], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {}
    for d, text in ((1, long), (2, ["nothing", "of", "it"]), (3, items[9].split())):
        hit, found = set(), set()
        for i, item in items.items():
            own = item.split()
            windows = {tuple(own[k : k + 10]) for k in range(max(1, len(own) - 9))}
            n = min(10, len(own))
            for at in range(len(text) - n + 1):
                if text[at] in item and tuple(text[at : at + n]) in windows:
                    hit.update(range(at, at + n))
                    found.add(i)
        want[d] = (len(text), len(hit), len(found))
    for most in (winnow.IN_PLACE, 2):
        monkeypatch.setattr(winnow, "IN_PLACE", most)
        assert {x.doc_id: (x.n_words, x.n_hit, x.n_items) for x in winnow.decontaminate(docs, bench).collect()} == want


def test_decontamination(spark, docs, texts):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    items = {7: " ".join((texts[8] or "").split()[35:60]), 10: "one", 2: None, 3: "", 4: "..!", 5: "W1 w2", 11: (texts[0] or "")[:200]}
    split = lambda t: word.findall((t or "").translate(LOWER))
    windows = {i: {tuple(w[p : p + min(10, len(w))]) for p in range(max(1, len(w) - 9))} if (w := split(t)) else set() for i, t in items.items()}
    want = {}
    for d, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for i, mine in windows.items():
            for n in {len(x) for x in mine}:
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) in mine:
                        hit.update(range(p, p + n))
                        found.add(i)
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items.items()], "item_id long, text string, doc_id string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in winnow.decontaminate(docs, bench).collect()}
    assert got == want


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = {i: [*slow.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    pieces = packing.pack(docs).collect()
    for i, mine in ids.items():
        own, at = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start), 0
        for p in own:
            assert (p.start, p.doc_tokens) == (at, len(mine))
            assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in mine[at : at + p.length]))
            at += p.length
        assert at == len(mine)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for own in by.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


def test_special_token_text_is_what_the_tokenizer_makes_of_it():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    slow, fast = Tokenizer.from_file(path), packing._encoder(path)
    for t in ("a<|endoftext|>b", "naïve 你好 \U0001f600‍ x́", "  two  spaces\n\n\ttab'll don't 12345", "\x00\x7f"):
        assert fast(t) == slow.encode(t, add_special_tokens=False).ids


def test_packing_of_very_long_runs(spark):
    """A million of one sign: the fast encoder's pattern cannot step back through that much white space."""
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(4)
    texts = [" " * 1_000_000, "a" * 1_000_000, "".join(r.choice(" \n\t") for _ in range(1_000_000)), "x" + " " * 30_000 + "y", " \u2003" * 15_000]
    slow = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        ids = [*slow.encode(t, add_special_tokens=False).ids, 1]
        own = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == i)
        assert own == [(at, len(x), zlib.crc32(b"".join(k.to_bytes(4, "little") for k in x))) for at in range(0, len(ids), 2048) for x in [ids[at : at + 2048]]]


def test_padding_is_little(spark, monkeypatch):
    """Within 0.3 percent of best-fit decreasing over single pieces; shares and blocks of ranks are many here."""
    monkeypatch.setattr(packing, "SHARE", 10)
    r = random.Random(11)

    def best_fit(histogram):
        free, sequences = [0] * 2049, 0
        for n in sorted((n for n, k in histogram.items() for _ in range(k)), reverse=True):
            room = next((x for x in range(n, 2049) if free[x]), None)
            if room is None:
                sequences, room = sequences + 1, 2048
            else:
                free[room] -= 1
            free[room - n] += 1
        return sequences

    for histogram in ({n: r.randrange(1, 60) for n in range(1, 2048)}, {r.randrange(1, 1500): r.randrange(1, 90) for _ in range(300)}, {k: 200 for k in (700, 683, 1365, 30)}):
        assert sum(times for _, times in packing.plan_patterns(histogram)) <= 1.003 * best_fit(histogram) + 1
    texts = ["a " * r.randrange(1, 400) for _ in range(600)]
    pieces = packing.pack(spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    places = [(p.sequence_id, p.offset, p.length) for p in pieces]
    assert len(pieces) == 600 and len(set(places)) == 600
    at: dict[int, int] = {}
    for sequence, offset, length in sorted(places):
        assert offset == at.get(sequence, 0)
        at[sequence] = offset + length
    assert max(at.values()) <= 2048 and len(at) <= -(-sum(at.values()) // 2048) + 2


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece(seed):
    r = random.Random(seed)
    histogram = {r.randrange(1, 2049): r.randrange(1, 50) for _ in range(r.choice([1, 5, 300]))}
    used = {}
    for pattern, times in packing.plan_patterns(histogram):
        assert sum(n * k for n, k in pattern.items()) <= 2048 and times > 0
        for n, k in pattern.items():
            used[n] = used.get(n, 0) + k * times
    assert used == histogram
    assert packing.plan_patterns({}) == []


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).count() == substring.substring_dedup(none).count() == lines.line_classes(none).count() == packing.pack(none).count() == 0
    assert winnow.decontaminate(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(None, text), (1, text), (2, text + " end"), (2, text + " end"), (None, None)], "doc_id long, text string")
    near = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert near == {(None, 1, False), (1, 1, True), (2, 1, False), (None, None, True)}
    cut = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.substring_dedup(df).collect())
    assert cut == [(0, 0, 0), (0, 80, 0), (1, 80, 0), (2, 81, 80), (2, 81, 80)]
    assert lines.line_classes(df).count() == 5 and packing.pack(df).count() == 5
    bench = spark.createDataFrame([(5, text)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.n_hit) for r in winnow.decontaminate(df, bench).collect()) == [(0, 0), (0, 0), (1, 80), (2, 80), (2, 80)]
