"""Best-two-fit packing of tokenised documents into sequences.

A document's ids are cut into pieces of the sequence length, the remainder first. Whole pieces fill a sequence each;
the others are packed in groups of about ``GROUP`` pieces: a bin is filled greedily with the longest piece that still
fits, then its smallest piece is replaced by the two unpacked pieces that fit the gap so widened more tightly. The
pieces of bins left with a gap of over ``LOOSE`` tokens go into one more round over larger groups, so that grouping
costs few bins. Groups are dealt by a hash of a stored row number, so neither a hot source nor many copies or repeated
rows land in one task.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import staged, struct_of, table

LENGTH = 2048
GROUP = 2500
LOOSE = 4
SEPARATOR = 0
TOKENIZER = "byte_bpe_50k.json"


def vocabulary() -> str:
    """The public vocabulary's ranks file: the ids are those of ``TOKENIZER`` under the tokenizers library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(2)
def encoder(path: str):
    """Byte-level BPE over ``path``; the added tokens of ``TOKENIZER`` are found in texts as the tokenizers library does."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def pieces_of(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: a shorter piece, if any, comes first."""
    head = n % length
    cuts = [0] * (head > 0) + list(range(head, n, length))
    return [(a, b - a) for a, b in zip(cuts, [*cuts[1:], n])]


def tokenised(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """``doc_id`` and an array of pieces (piece, start, length, ids_crc32); a null text is empty, so one id long."""
    path = path or vocabulary()

    @F.pandas_udf(T.ArrayType(struct_of("piece int, start long, length long, ids_crc32 long")))
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for text in parts:
            out = []
            for t in text:
                ids = np.append(enc.encode_to_numpy(t or "", allowed_special="all"), SEPARATOR).astype("<u4")
                out.append([(k, a, n, zlib.crc32(ids[a : a + n])) for k, (a, n) in enumerate(pieces_of(len(ids), length))])
            yield pd.Series(out)

    return docs.select("doc_id", F.explode(cut.asNondeterministic()("text")).alias("p")).select("doc_id", "p.*")


def best_two_fit(sizes: np.ndarray, capacity: int = LENGTH) -> list[list[int]]:
    """Positions of ``sizes`` in bins of ``capacity``; sizes lie between 1 and ``capacity``.

    Equal sizes are taken in the order given, so the result is a function of the sequence of sizes.
    """
    if not len(sizes):
        return []
    order = np.argsort(sizes, kind="stable")
    left = np.bincount(sizes, minlength=capacity + 1)
    stock = {int(s): list(x[::-1]) for s, x in zip(np.unique(sizes), np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1))}
    ladder = np.arange(capacity + 1)
    # fits[s]: the largest size up to s that is still unpacked, 0 if none
    fits = np.maximum.accumulate(np.where(left > 0, ladder, 0))

    def take(s: int) -> None:
        left[s] -= 1
        if not left[s]:
            end = s + int(np.searchsorted(fits[s:], s, side="right"))
            fits[s:end] = fits[s - 1]

    def give(s: int) -> None:
        left[s] += 1
        if left[s] == 1:
            low, end = fits[s - 1], s + int(np.searchsorted(fits[s:], s, side="left"))
            fits[s:end] = np.where(fits[s:end] == low, s, fits[s:end])

    bins: list[list[int]] = []
    todo = len(sizes)
    while todo:
        gap, mine = capacity, []
        while gap and (s := int(fits[gap])):
            take(s)
            mine.append(s)
            gap -= s
        if gap and len(mine) > 1 and (pair := _tighter_pair(left, fits, gap + mine[-1], mine[-1])):
            give(mine.pop())
            for s in pair:
                take(s)
                mine.append(s)
        todo -= len(mine)
        bins.append(mine)
    return [[int(stock[s].pop()) for s in mine] for mine in bins]


def _tighter_pair(left: np.ndarray, fits: np.ndarray, room: int, smallest: int) -> tuple[int, int] | None:
    """Two unpacked sizes with the largest sum up to ``room`` that is over ``smallest``."""
    a = np.flatnonzero(left[: room // 2 + 1])
    if not len(a):
        return None
    b = fits[room - a].copy()
    alone = (b == a) & (left[a] < 2)
    b[alone] = fits[a[alone] - 1]
    total = np.where(b > 0, a + b, 0)
    k = int(total.argmax())
    return (int(a[k]), int(b[k])) if total[k] > smallest else None


_COLUMNS = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, r bigint, sequence_id bigint, offset bigint"


def _pack(part: pd.DataFrame, level: int, length: int) -> pd.DataFrame:
    """Pack one group; sequence ids carry the level and the group."""
    part = part.sort_values(["length", "doc_id", "piece", "ids_crc32", "r"], kind="stable", ignore_index=True)
    sizes = part["length"].to_numpy(np.int64)
    seq, off = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    head = (int(part["g"].iloc[0]) << 24) + (level << 62)
    for k, mine in enumerate(best_two_fit(sizes, length)):
        seq[mine] = head + k
        off[mine] = np.concatenate(([0], np.cumsum(sizes[mine])[:-1]))
    return part.assign(sequence_id=seq, offset=off)[[x.split()[0] for x in _COLUMNS.split(", ")]]


def _packed(pieces: DataFrame, level: int, length: int, group: int) -> DataFrame:
    n = pieces.count()
    groups = max(1, round(n / group))
    key = F.pmod(F.xxhash64("r", F.lit(level)), F.lit(groups))
    return pieces.withColumn("g", key).groupBy("g").applyInPandas(lambda x: _pack(x, level, length), _COLUMNS)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Every piece of every row of ``docs`` with its sequence and its place there.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are packed each by itself;
    a null id is packed like any other. An empty table gives an empty result.
    """
    pieces = staged(tokenised(docs, path, length).withColumn("r", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") == length).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    first = staged(_packed(pieces.where(F.col("length") < length), 0, length, group), "packed")
    loose = first.groupBy("sequence_id").agg(F.sum("length").alias("full")).where(F.col("full") < length - LOOSE).select("sequence_id")
    loose = staged(loose, "loose")
    again = _packed(first.join(loose, "sequence_id", "left_semi").select(pieces.columns), 1, length, group)
    return whole.unionByName(first.join(loose, "sequence_id", "left_anti")).unionByName(again).drop("r")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all documents packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
