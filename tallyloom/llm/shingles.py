"""Hashes of word shingles for many texts at once, in numpy.

Words are runs of bytes outside the six white-space bytes, with A-Z lower-cased. A word's hash is a polynomial of
its bytes, taken from one running sum over the whole chunk, then mixed; a shingle's hash combines the hashes of five
consecutive words. Hashes have 64 bits, so two different shingles of one pair of documents are taken for equal with a
probability below 2**-30 even at 100,000 words.
"""

from __future__ import annotations

import functools

import numpy as np

WIDTH = 5
CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


@functools.lru_cache(1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256)
    lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    return mix(lower.astype(_U) + _U(0x1234567)), space


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least; kept for chunks of the usual size."""
    if not _powers:
        _powers.extend(_make_powers(CHUNK_BYTES + (1 << 17)))
    return (_powers[0], _powers[1]) if n < len(_powers[0]) else _make_powers(n + 1)


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INV):
        x = np.full(n, base, _U)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def chunks(texts: list[str | None]) -> list[tuple[list[int], list[bytes]]]:
    """Texts as bytes, in runs of about CHUNK_BYTES; a longer text is a run by itself."""
    out, at, run, size = [], [], [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if run and size + len(b) > CHUNK_BYTES:
            out.append((at, run))
            at, run, size = [], [], 0
        at.append(i)
        run.append(b)
        size += len(b) + 1
    if run:
        out.append((at, run))
    return out


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A text with fewer words than ``width`` has one shingle, all its words; without words, or null, it has none.
    """
    out: list[np.ndarray] = [np.empty(0, _U)] * len(texts)
    value, space = _byte_tables()
    for at, run in chunks(texts):
        joined = b" ".join(run) + b" "
        raw = np.frombuffer(joined, np.uint8)
        blank = space[raw]
        ends = np.flatnonzero(blank & ~np.concatenate(([True], blank[:-1])))
        starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        up, down = _power_tables(len(raw) + 1)
        total = np.empty(len(raw) + 1, _U)
        total[0] = 0
        np.cumsum(value[raw] * up[: len(raw)], out=total[1:])
        w = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _MIX2)
        n = len(w)
        sh = np.zeros(max(0, n - width + 1), _U)
        for j in range(width):
            sh = sh * _BASE + mix(w[j : n - width + 1 + j] + _U(j + 1)) if n >= width else sh
        sh = mix(sh)
        bounds = np.cumsum([0] + [len(b) + 1 for b in run])
        first = np.searchsorted(starts, bounds)
        for k, i in enumerate(at):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= width:
                out[i] = np.unique(sh[a : b - width + 1])
            elif b > a:
                h = _U(b - a)
                with np.errstate(over="ignore"):
                    for x in w[a:b]:
                        h = mix(np.asarray(h * _BASE + x))[()]
                out[i] = np.array([h], _U)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if not len(a) or not len(b):
        return 0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())
