"""Hash randomness: draws are functions of their keys, the same in every engine, at any partitioning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(parts) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def order_key(*parts) -> Column:
    """A text to order by: a permutation of whatever the keys tell apart."""
    return F.md5(_text(parts))


def u32(*parts) -> Column:
    """A whole number below 2**32."""
    return F.conv(F.substring(order_key(*parts), 1, 8), 16, 10).cast("long")


def letter(*parts, options: int = 4) -> Column:
    """A letter A, B, ... drawn from ``options``; null if it falls beyond D."""
    i = (u32(*parts) % options).cast("int")
    return F.when(i < 4, F.substring(F.lit("ABCD"), i + 1, F.lit(1)))


_TURNS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _part_words(texts: list[bytes], at: int) -> dict[int, np.ndarray]:
    """The message words to which texts of one length that begin at byte ``at`` contribute, an array over the texts each."""
    out: dict[int, np.ndarray] = {}
    for k, column in enumerate(np.array([list(t) for t in texts], np.uint32).reshape(len(texts), -1).T, at):
        out[k // 4] = out.get(k // 4, np.uint32(0)) + (column << np.uint32(k % 4 * 8))
    return out


def u32_grid(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """The number of ``u32`` for each head followed by each tail: one row a head. Heads have one length, and so have tails;
    both together at most 55 bytes, one block of md5. Each step works on all pairs at once."""
    long = len(heads[0]) + len(tails[0])
    if long > 55:
        raise ValueError("more than one block")
    mask, words = 0xFFFFFFFF, [0] * 16
    rows, columns = _part_words(heads, 0), _part_words(tails, len(heads[0]))
    end = _part_words([b"\x80"], long)
    for j in {*rows, *columns}:
        words[j] = rows.get(j, np.zeros(1, np.uint32))[:, None] + columns.get(j, np.zeros(1, np.uint32))[None, :]
    for j, v in end.items():
        words[j] = words[j] + v[0] if j in rows or j in columns else int(v[0])
    words[14] = long * 8
    shape = (len(heads), len(tails))
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f = np.empty(shape, np.uint32)
    for i in range(61):  # the last three steps do not touch the first word of the digest
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        w = words[_WORD[i]]
        if isinstance(w, int):
            f += np.uint32((_SINES[i] + w) & mask)
        else:
            f += np.uint32(_SINES[i])
            f += w
        f += a
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=a)
        f <<= np.uint32(_TURNS[i])
        f |= a
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(_START[0])).byteswap()
