"""Secret scans: fixed patterns, and the guess cost of values in a credential context.

The guess cost is the least log10 of guesses over all segmentations of a value into words, dates, repeats, keyboard
walks and brute-force spans, found by dynamic programming over positions. A value that follows a credential's name and
costs at least ``COST`` is a secret of kind ``guess``; spans of the fixed patterns are kept beside it.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import struct_of, table
from tallyloom.llm.packing import vocabulary

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value counts as a secret, and the lengths of values that are judged.
COST, SHORTEST = 9.0, 8
#: Fixed patterns. Runs of the last two are maximal, so asking for the length in the pattern drops the same matches.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credentials?|bearer|private[_-]?key)["']?\x20*(?:[:=]|\x20is\x20)\x20*["']?([^\s"'`,;<>]{8,})""",
    re.ASCII,
)
#: Words that passwords are made of, frequent ones first; a word's rank is its guesses.
WORDS = (
    "password admin user login welcome secret token letmein monkey dragon master hello test guest root default changeme "
    "qwerty summer winter spring autumn football baseball princess sunshine shadow love money pass word key example "
    "sample demo null none true false your here value string placeholder server client data base public private access "
    "the and for you this that with from house home blue red green black white orange happy star super angel flower"
).split()
#: Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("@4013$5!7", "aaoiessit")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")


@functools.lru_cache(1)
def _ranks() -> tuple[dict[str, int], int]:
    """Rank of each word, and the longest word: ``WORDS``, then the whole words of the public vocabulary in its order."""
    with open(vocabulary(), "rb") as f:
        tokens = (base64.b64decode(x.split()[0]).decode("utf-8", "ignore") for x in f if x.strip())
        words = [t[1:] for t in tokens if len(t) > 3 and t[0] == " " and t[1:].isalpha() and t.islower()]
    out: dict[str, int] = {}
    for w in (*WORDS, *words):
        out.setdefault(w, len(out) + 1)
    return out, max(map(len, out))


@functools.lru_cache(1)
def _neighbours() -> set[tuple[str, str]]:
    """Pairs of keys side by side in a row or one above the other."""
    out = set()
    for r, row in enumerate(ROWS):
        for c, k in enumerate(row):
            for rr, cc in ((r, c + 1), (r + 1, c), (r + 1, c - 1)):
                if rr < len(ROWS) and 0 <= cc < len(ROWS[rr]):
                    out |= {(k, ROWS[rr][cc]), (ROWS[rr][cc], k)}
    return out


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


def segments(value: str) -> list[tuple[int, int, str, float]]:
    """Every candidate (start, end, kind, log10 of its guesses) but single characters."""
    out: list[tuple[int, int, str, float]] = []
    low, n = value.lower(), len(value)
    ranks, longest = _ranks()
    plain = low.translate(_LEET)
    # From each place, how many characters more repeat or walk on: counted backwards, so time is linear.
    same = {p: [0] * (n + 1) for p in (1, 2, 3, 4)}
    steps = [0] * (n + 1)
    for i in range(n - 2, -1, -1):
        for p, more in same.items():
            if i + p < n and value[i + p] == value[i]:
                more[i] = more[i + 1] + 1
        if (low[i], low[i + 1]) in _neighbours():
            steps[i] = steps[i + 1] + 1
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            rank = ranks.get(low[i:j]) or ranks.get(plain[i:j])
            if rank:
                turns = sum(a != b for a, b in zip(value[i:j], low[i:j])) and 1
                leet = ranks.get(low[i:j]) is None
                out.append((i, j, "word", math.log10(rank * (1 + turns) * (1 + 3 * leet) + 1)))
        m = _DATE.match(value, i)
        if m:
            out.append((i, m.end(), "date", math.log10(119 * (12 if m.end() - i > 4 else 1) * (31 if m.end() - i > 7 else 1) + 1)))
        for period in (1, 2, 3, 4):
            j = min(n, i + period) + same[period][i]
            if j - i >= 2 * period + (period == 1):
                out.append((i, j, "repeat", sum(math.log10(_alphabet(c)) for c in value[i : i + period]) + math.log10((j - i) / period)))
        j = i + 1 + steps[i]
        if j - i >= 3:
            out.append((i, j, "walk", math.log10(47 * (j - i) * 4)))
    return out


def guess_cost(value: str) -> tuple[float, list[tuple[int, int, str]]]:
    """The least log10 of guesses of a value, and the segmentation that has it.

    Guesses of segments multiply; each segment more costs a factor of two for where it ends. Brute-force spans cost
    the size of each character's alphabet. Ties take the segmentation found first.
    """
    n = len(value)
    at: list[list[tuple[int, int, str, float]]] = [[] for _ in range(n + 1)]
    for s in segments(value):
        at[s[1]].append(s)
    best = [0.0] + [math.inf] * n
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    turn = math.log10(2)
    for j in range(1, n + 1):
        step = best[j - 1] + math.log10(_alphabet(value[j - 1])) + (0 if back[j - 1][1] == "brute" else turn)
        best[j], back[j] = step, (j - 1, "brute")
        for i, _, kind, cost in at[j]:
            if best[i] + cost + turn < best[j]:
                best[j], back[j] = best[i] + cost + turn, (i, kind)
    path, j = [], n
    while j:
        i, kind = back[j]
        if path and kind == "brute" == path[-1][2]:
            path[-1] = (i, path[-1][1], kind)
        else:
            path.append((i, j, kind))
        j = i
    return best[n], path[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of the fixed patterns; an assign's span is its whole match."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]


def guess_spans(text: str, base: list[tuple[int, int, int]], cost: float = COST) -> list[tuple[int, int, int]]:
    """Values in a credential context, outside the base spans, whose guess cost reaches ``cost``."""
    out = []
    spans = sorted((a, b) for a, b, _ in base)
    begins = [a for a, _ in spans]
    reach = list(itertools.accumulate((b for _, b in spans), max))
    for m in CONTEXT.finditer(text):
        a, b = m.start(1), m.end(1)
        value = text[a:b].rstrip(".)]}")
        b = a + len(value)
        before = bisect.bisect_left(begins, b)
        if len(value) < SHORTEST or before and reach[before - 1] > a:
            continue
        if guess_cost(value)[0] >= cost:
            out.append((a, b, 3))
    return out


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each by start, then kind; places are code points, ends exclusive."""
    text = text or ""
    base = sorted(base_spans(text), key=lambda s: (s[0], s[2]))
    return base, sorted(base + guess_spans(text, base), key=lambda s: (s[0], s[2]))


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


SPANS = T.ArrayType(struct_of("kind string, start int, end int"))


def find(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with an array of secrets (kind, start, end) of the whole text; null and empty texts have none.

    Rows are scanned one by one: repeated rows repeat their spans, an empty table gives an empty result.
    """

    @F.pandas_udf(SPANS)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in parts:
            yield pd.Series([[(KINDS[k], a, b) for a, b, k in scan(t)[1]] for t in text], dtype=object)

    return docs.withColumn(out, found.asNondeterministic()(text_col))


def masked(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with each secret replaced; overlapping ones together."""
    spans = scan(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def _masked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in parts:
        yield pd.Series([masked(t) for t in text], dtype=object)


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret of the text replaced by a mark; all rows stay, null texts stay null."""
    return docs.withColumn(text_col, _masked.asNondeterministic()(text_col))


@F.pandas_udf(struct_of("n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))
def _digests(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for text in parts:
        rows = []
        for t in text:
            base, every = scan(t)
            n = [sum(s[2] == k for s in base) for k in range(3)]
            rows.append((*n, hashlib.sha256(digest(base).encode()).hexdigest(), digest(every)))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def query(spark, sf_dir: str) -> DataFrame:
    """op7: secrets in every whole text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("s", _digests.asNondeterministic()("text")).select("doc_id", "s.*")
