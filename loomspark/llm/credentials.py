"""Secret scans: patterns for the plain cases, guess cost for what stands where a credential belongs.

Three patterns give base spans. Beyond them, each value after a credential word is split into the pieces that a
guesser would use (words, ranked by the documents that hold them, also reversed or with signs for letters, dates,
repeats, keyboard walks, runs of a sequence, else brute force), and dynamic programming finds the segmentation with
the fewest guesses. Values that would take too many are secrets, whatever their shape; words are not, nor are
references to a value that stands elsewhere (`${NAME}`, `<name>`, `os.environ`).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import common

KINDS = ("assign", "access", "hex", "guess")
_WORDS = r"(?:password|passwd|secret|token|api_?key)"
ASSIGN = re.compile(rf"""({_WORDS[3:-1]})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
#: A credential word, a sign of assignment and a value up to white space or a closing quote.
CONTEXT = re.compile(r"""(?:password|passwd|passphrase|pwd|secret|token|api_?key|credential|private_?key)["']?\x20*(?::=|=>|[:=])\x20*(?:"([^"\r\n]+)"|'([^'\r\n]+)'|([^\s"',;]+))""", re.I | re.A)
_HINTS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "credential", "privatekey", "private_key")
#: log10 of the guesses from which a value counts as a secret, and its least length.
GUESSES, LEAST = 10.0, 8
#: Longest piece of a segmentation; longer runs are several pieces.
PIECE, _TWICE = 64, math.log10(2)
#: Words that guessers try after the COMMON ones: those of so many documents at least, and the most frequent so many of
#: them, which bounds what goes to every task to a few MB.
LEAST_DOCS, MOST_WORDS = 5, 100_000
#: Letters in a word, and what no word stands beside: those are parts of codes, paths and keys.
WORD = r"(?<![\p{L}\p{N}+/=_.-])\p{L}{3,24}(?![\p{L}\p{N}+/=_]|[.-][\p{L}\p{N}])"
#: Values that guessers try first, most frequent first; a word's rank is its cost.
COMMON = (
    "password 123456 qwerty admin letmein welcome login secret test example changeme default dragon monkey master "
    "hello user root pass guest love abc iloveyou sunshine princess football baseball shadow superman batman "
    "trustno summer winter spring autumn flower freedom whatever token key value string none null true false "
    "your my the this that here placeholder sample demo dummy foo bar xxx todo undefined empty redacted hidden"
).split()
_RANK = {w: i + 1 for i, w in enumerate(COMMON)}
#: Rows of a keyboard, a key's upper and lower sign, each row half a key to the right of the one above.
_ROWS = ("1!2@3#4$5%6^7&8*9(0)-_=+", "qQwWeErRtTyYuUiIoOpP[{]}", "aAsSdDfFgGhHjJkKlL;:'\"", "zZxXcCvVbBnNmM,<.>/?")
_KEYS = {sign: (r, i // 2) for r, row in enumerate(_ROWS) for i, sign in enumerate(row)}
#: Steps to a neighbouring key: along the row, to the row below and to the row above.
_STEPS = {(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)}
#: Signs that stand for letters; 1 stands for two of them.
_SIGNS = [str.maketrans("@4831!0$57+", f"aabe{one}iosstt") for one in "il"]
#: A value that is no value but says where one comes from, or that one is to be put in.
REFERENCE = re.compile(r"""\$\{|\$\(|\$[A-Za-z_]\w*$|\{\{|\{%|<[^<>]*>?$|%\w+%$|\[[^\[\]]*\]$|[*.xX#_-]+$|(?:os\.(?:environ|getenv)|(?:process|import\.meta)\.env|System\.getenv|getenv|env|secrets|config|settings|vault)\b[.\[(:]""", re.A)
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")


def _alphabet(value: str) -> int:
    kinds = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10))
    size = sum(n for f, n in kinds if any(f(c) for c in value))
    return max(2, size + (33 if any(not c.isalnum() for c in value) else 0))


def pieces(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 of the guesses) of all pieces that are no brute force, by start; none is longer than PIECE."""
    n, low = len(value), value.lower()
    brute = math.log10(_alphabet(value)) if n else 0.0
    plain = [low, *{low.translate(t) for t in _SIGNS if low.translate(t) != low}]
    lowered = [c == d for c, d in zip(value, low)]
    for i in range(n):
        end = min(n, i + PIECE)
        for size in range(3, min(24, n - i) + 1):
            odd = not all(lowered[i : i + size])
            for text in plain:
                swaps = sum(a != b for a, b in zip(low[i : i + size], text[i : i + size]))
                if text is not low and not swaps:
                    continue
                word = text[i : i + size]
                if rank := ranks.get(word):
                    yield i, i + size, math.log10(rank + 1) + (odd + swaps) * _TWICE
                if (rank := ranks.get(word[::-1])) and word != word[::-1]:
                    yield i, i + size, math.log10(rank + 1) + (1 + odd + swaps) * _TWICE
        if m := _DATE.match(value, i):
            yield i, m.end(), math.log10(366 * 100)
        j = i + 1
        while j < end and low[j] == low[i]:
            j += 1
        if j - i >= 3:
            yield i, j, brute + math.log10(j - i)
        for size in range(2, 9):
            j = i + size
            while j + size <= end and low[j : j + size] == low[i : i + size]:
                j += size
            if j - i >= 2 * size:
                yield i, j, size * brute + math.log10((j - i) / size)
        j, turns, before = i + 1, 0, None
        while j < end and (step := _step(value[j - 1], value[j])) in _STEPS:
            turns += step != before
            j, before = j + 1, step
        if j - i >= 3:  # where it begins, how long it is, and each turn
            yield i, j, math.log10(47 * (j - i)) + turns * math.log10(len(_STEPS))
        j = i + 1
        step = ord(low[j]) - ord(low[i]) if j < n else 0
        while step in (1, -1) and j < end and ord(low[j]) - ord(low[j - 1]) == step:
            j += 1
        if j - i >= 3:
            yield i, j, math.log10(36 * (j - i))


def _step(a: str, b: str) -> tuple[int, int] | None:
    x, y = _KEYS.get(a), _KEYS.get(b)
    return (y[0] - x[0], y[1] - x[1]) if x and y else None


def guess_cost(value: str, enough: float = math.inf, ranks: dict[str, int] = _RANK) -> float:
    """log10 of the guesses of the cheapest segmentation of `value`, or a bound of at least `enough` below it; 0 for an empty one.

    best[j] = min over pieces i..j of best[i] + cost(piece), each piece beyond the first costing a factor of 2 for where
    it is cut. Characters between pieces cost a guess of the value's alphabet each.
    """
    n = len(value)
    brute = math.log10(_alphabet(value)) if n else 0.0
    best, done = [0.0] + [math.inf] * n, 0
    if len(value.lower()) != n:  # letters whose lower case is two: places would not match
        return n * brute
    for i, j, cost in pieces(value, ranks):
        while done < i:  # best[i] is final once all pieces that begin before it have been offered
            best[done + 1] = min(best[done + 1], best[done] + brute)
            done += 1
            if done >= PIECE and (least := min(best[done - PIECE + 1 : done + 1])) >= enough:
                return least  # every segmentation has a cut in this span
        best[j] = min(best[j], best[i] + cost + (_TWICE if i else 0.0))
    while done < n:
        best[done + 1] = min(best[done + 1], best[done] + brute)
        done += 1
    return best[n]


def find(text: str, ranks: dict[str, int] = _RANK) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans of a text, by start, then kind."""
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        taken = [(s, e) for _, s, e in found]
        for m in CONTEXT.finditer(text):
            k = next(k for k in (1, 2, 3) if m[k] is not None)
            s, e = m.span(k)
            if e - s >= LEAST and not REFERENCE.match(m[k]) and guess_cost(m[k], GUESSES, ranks) >= GUESSES and not any(a < e and s < b for a, b in taken):
                found.append(("guess", s, e))
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def frequent_words(docs: DataFrame) -> DataFrame:
    """(word, n): lower-cased words of at least LEAST_DOCS documents, the most frequent, MOST_WORDS at most; n documents hold each.

    Words of one n are taken together or not at all, so that no task and no driver sees more than is kept.
    What stands where a credential belongs counts for no word, so that a secret in many copies is not taken for one.
    """
    prose = F.regexp_replace("text", "(?i)" + CONTEXT.pattern, " ")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(prose), F.lit(WORD), F.lit(0)))).alias("word"))
    counts = common.materialize(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS))
    least, taken = None, 0
    for n, size in sorted(counts.groupBy("n").count().collect(), reverse=True):
        if (taken := taken + size) > MOST_WORDS:
            break
        least = n
    return counts.where(F.col("n") >= least if least is not None else F.lit(False))


def ranked(words: list[str]) -> dict[str, int]:
    """Ranks of the COMMON words, then of `words`, most frequent first."""
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *words]))}


def _span_rows(batches: Iterator[pa.RecordBatch], ranks: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [find(x.as_py(), ranks) for x in batch.column(1)]
        base = [[x for x in s if x[0] != "guess"] for s in spans]
        counts = [pa.array([sum(x[0] == kind for x in s) for s in spans], pa.int64()) for kind in KINDS]
        digest = pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base])
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts[:3], digest, pa.array([_joined(s) for s in spans], pa.string()), counts[3]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text.

    docs: doc_id and text; other columns are ignored. A null text is empty and has none. Result, a row for each row of
    docs: doc_id, n_assign, n_access, n_hex, base_sha256 (of the spans of those three kinds), spans (all spans,
    kind:start:end in code points, end exclusive, by start and kind, comma-joined), n_guess. Spans of different kinds may
    overlap, but a guessed value never overlaps an assignment. The words of guessed values are those of docs itself.
    """
    docs = common.spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    known = docs.sparkSession.sparkContext.broadcast(ranked([r.word for r in sorted(frequent_words(docs).collect(), key=lambda r: (-r.n, r.word))]))
    return docs.mapInArrow(lambda batches: _span_rows(batches, known.value), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Secrets in `documents`."""
    return scan_secrets(common.read(spark, sf_dir, "documents"))
