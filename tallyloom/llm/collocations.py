"""Phrase collocations by hierarchical pair naming.

Texts are cut into pieces and words inside tasks; a task's texts become chunks of word codes over a dictionary of the
chunk. Level by level, adjacent names of a chunk are counted as pairs inside the chunk, and only the distinct pairs are
shuffled. Those whose count over all chunks reaches the minimum are named: a name is the smallest (chunk, index) that
holds the pair, so that one window both adds up a pair and names it for every chunk. A named phrase of k words is the
pair of its first and last k - 1 words. The pair serves as parent pointers: frequencies of all first and last parts, and
so every cut, come from the two parents, and a phrase lies in a longer one exactly if it is the parent of a candidate
one word longer that is as frequent at least. Words and pairs below the minimum have no name and end a run of names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import staged, struct_of, table

#: What ends a piece, what separates words, the name of an unknown language.
PIECE_END = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_END = b"\x20\x09"
UNKNOWN = "und"

MAX_WORDS = 3
MIN_COUNT = 10
COVERED = 50
TOP = 2000
SCALE = 1_000_000
#: Bytes of text in a chunk; a longer text is a chunk by itself.
CHUNK_BYTES = 16 << 20
SALTS = 64
#: Rows of an Arrow batch that goes back to Spark.
BATCH = 1 << 16
#: A name has the task in its highest 21 bits, the chunk of the task in 14, the index in the chunk in 28.
_CHUNK_BITS, _INDEX_BITS = 14, 28

_BYTES = bytearray(range(256))
_BYTES[65:91] = range(97, 123)
for _c in PIECE_END:
    _BYTES[_c] = 10
for _c in WORD_END:
    _BYTES[_c] = 32
_BYTES = bytes(_BYTES)


def encode(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words of all texts, -1 between pieces; the words by code; how often each occurs."""
    b = np.frombuffer(b"\n".join(texts).translate(_BYTES), np.uint8)
    texts.clear()
    word = (b != 32) & (b != 10)
    wide = np.int64 if len(b) > 1 << 30 else np.int32
    edge = np.flatnonzero(word[1:] != word[:-1]).astype(wide) + 1 if len(b) else np.empty(0, wide)
    edge = np.concatenate([[0] * bool(len(b) and word[0]), edge, [len(b)] * bool(len(b) and word[-1])]).astype(wide)
    start, size = edge[::2], np.diff(edge)[::2]
    if not len(start):
        return np.empty(0, np.int32), pa.array([], pa.string()), np.empty(0, np.int64)
    piece = np.searchsorted(np.flatnonzero(b == 10).astype(wide), start).astype(np.int32)
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    flat = b[word]
    del b, word, edge, start, size
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
    codes = coded.indices.to_numpy()
    return np.insert(codes, np.flatnonzero(np.diff(piece)) + 1, -1), coded.dictionary.cast(pa.string()), np.bincount(codes)


def pair_up(codes: np.ndarray, names: np.ndarray, index: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent codes that both have names, as pairs: codes of the pairs by position (-1: none), and by code of the
    pair its left and right name and its count. ``names`` holds a name per code, -1 for none."""
    named = np.append(names, -1)[codes] >= 0
    at = np.flatnonzero(named[:-1] & named[1:])
    keys = codes[at].astype(np.int64) * len(names) + codes[at + 1]
    if not index:
        pairs, n = np.unique(keys, return_counts=True)
        return None, names[pairs // max(len(names), 1)], names[pairs % max(len(names), 1)], n
    pairs, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    out = np.full(max(len(codes) - 1, 0), -1, np.int32)
    out[at] = inverse
    return out, names[pairs // max(len(names), 1)], names[pairs % max(len(names), 1)], n


def chunks(docs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` (text, lang) as stored chunks: ``chunk``, ``codes`` (32-bit), and per code ``lang``, ``word`` and ``n``.

    Languages have codes of their own, so a pair never mixes two. A null or empty text has no words.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held = TaskContext.get().partitionId(), 0, 0
        by_lang: dict[str, list[bytes]] = {}

        def flush() -> pa.RecordBatch:
            nonlocal made
            if task >> 63 - _CHUNK_BITS - _INDEX_BITS or made >> _CHUNK_BITS:
                raise OverflowError("more tasks or chunks of a task than names have room for")
            parts, langs, words, counts, base = [], [], [], [], 0
            for lang in sorted(by_lang):
                codes, own, n = encode(by_lang.pop(lang))
                codes[codes >= 0] += base
                parts += [codes, np.array([-1], np.int32)]
                langs.append(pa.DictionaryArray.from_arrays(np.zeros(len(own), np.int32), [lang]).dictionary_decode())
                words.append(own)
                counts.append(n)
                base += len(own)
            made += 1
            del codes, own, n
            pa.default_memory_pool().release_unused()
            each = lambda arrays: pa.ListArray.from_arrays(pa.array([0, base], pa.int32()), pa.concat_arrays(arrays))
            return pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([(task << _CHUNK_BITS) + made - 1], pa.int64()),
                    "codes": pa.array([np.concatenate(parts).astype("<i4").tobytes()], pa.binary()),
                    "lang": each(langs),
                    "word": each(words),
                    "n": each([pa.array(n, pa.int64()) for n in counts]),
                }
            )

        for batch in batches:
            for text, lang in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
                held += len(text)
                if held >= size:
                    yield flush()
                    held = 0
        if by_lang:
            yield flush()

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    return staged(rows.mapInArrow(make, struct_of("chunk long, codes binary, lang string[], word string[], n long[]")), "chunks")


def _named(counted: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Of rows (chunk, idx, n, *keys), those whose keys reach ``least`` over all chunks, with ``a`` and ``name``; stored.

    A key has one row a chunk at most, summed there before, so the commonest word is no hot key.
    """
    ref = F.shiftleft(F.col("chunk"), _INDEX_BITS) + F.col("idx")
    same = Window.partitionBy(*keys)
    rows = counted.withColumn("ref", ref).withColumns({"a": F.sum("n").over(same), "name": F.min("ref").over(same)})
    return staged(rows.filter(F.col("a") >= least).drop("n"), "named")


def _pairs(coded: DataFrame, replies: list[DataFrame]) -> DataFrame:
    """Distinct pairs of adjacent names of the last level in each chunk: chunk, idx, left, right, n.

    ``replies`` holds, level by level, the named codes of each chunk. The codes of higher levels are not stored: they
    follow from the words' codes and the replies.
    """
    told = replies[0].select("chunk", "idx", "name", F.lit(0).alias("level"))
    for k, r in enumerate(replies[1:], 1):
        told = told.unionByName(r.select("chunk", "idx", "name", F.lit(k).alias("level")))
    levels = len(replies)

    def pair(chunk: pa.Table, named: pa.Table) -> pa.Table:
        if not len(chunk) or not len(named):
            return shape.empty_table()
        codes, known = np.frombuffer(chunk["codes"][0].as_buffer(), "<i4"), chunk["known"][0].as_py()
        level, idx, name = (named[c].to_numpy() for c in ("level", "idx", "name"))
        for k in range(levels):
            names = np.full(known, -1, np.int64)
            names[idx[level == k]] = name[level == k]
            codes, left, right, n = pair_up(codes, names, index=k + 1 < levels)
            known = len(n)
        pa.default_memory_pool().release_unused()
        columns = [np.full(known, chunk["chunk"][0].as_py()), np.arange(known), left, right, n]
        whole = pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=shape)
        return pa.Table.from_batches(whole.to_batches(max_chunksize=BATCH), shape)

    shape = pa.schema([(c, pa.int64()) for c in ("chunk", "idx", "left", "right", "n")])
    own = coded.select("chunk", "codes", F.size("word").alias("known"))
    return own.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(pair, struct_of("chunk long, idx long, left long, right long, n long"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)) in exact integers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(SCALE).cast("decimal(7,0)"), wide(left) * wide(right))


def phrases(docs: DataFrame, max_words: int = MAX_WORDS, least: int = MIN_COUNT, covered: int = COVERED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All candidates of ``docs``: lang, phrase, words, a, l, r, n, score, and ``inside`` (a longer candidate covers it).

    A candidate is a phrase of 2 to ``max_words`` words that occurs ``least`` times or more in its language. Repeated
    rows count each time. An empty table, or one without a frequent pair, gives no rows.
    """
    coded = chunks(docs, chunk_bytes)
    each = coded.select("chunk", F.posexplode(F.arrays_zip("lang", "word", "n")).alias("idx", "x")).select("chunk", F.col("idx").cast("long").alias("idx"), "x.*")
    totals = coded.select(F.explode(F.arrays_zip("lang", "n")).alias("x")).select("x.*").groupBy("lang").agg(F.sum("n").alias("total"))
    level = _named(each, ["lang", "word"], least)
    replies, grams, out = [level], _first(level), []
    for k in range(2, max_words + 1):
        level = _named(_pairs(coded, replies), ["left", "right"], least)
        replies.append(level)
        longer = staged(_joined(level, grams), "grams")
        out.append(_covered(grams, longer, covered) if k > 2 else None)
        grams = longer
    out.append(grams.withColumn("inside", F.lit(False)))
    every = None
    for g in filter(None, out):
        every = g if every is None else every.unionByName(g)
    k = F.size("firsts")
    cut = lambda i: F.struct(
        _score(F.col("a"), F.element_at("firsts", i), F.element_at("lasts", k - i)).alias("score"), i.alias("k"), F.element_at("firsts", i).alias("l"), F.element_at("lasts", k - i).alias("r")
    )
    best = every.withColumn("cut", F.array_min(F.transform(F.sequence(F.lit(1), k - 1), cut)))
    return best.join(totals, "lang").select("lang", "phrase", k.alias("words"), "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score", "inside")


def _first(words: DataFrame) -> DataFrame:
    """Frequent words as phrases of one word; ``firsts`` and ``lasts`` hold the counts of first and last parts by length."""
    own = words.filter(F.col("ref") == F.col("name"))
    return own.select("name", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", F.array("a").alias("firsts"), F.array("a").alias("lasts"), F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"))


def _joined(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """Named pairs as phrases one word longer than ``shorter``, which holds both parents of each."""
    own = pairs.filter(F.col("ref") == F.col("name")).select("name", "left", "right", "a")
    head = shorter.select(F.col("name").alias("left"), "lang", "phrase", "firsts")
    tail = shorter.select(F.col("name").alias("right"), "last", "lasts")
    return own.join(head, "left").join(tail, "right").select(
        "name", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a", F.array_append("firsts", F.col("a")).alias("firsts"), F.array_append("lasts", F.col("a")).alias("lasts"), "left", "right"
    )


def _covered(grams: DataFrame, longer: DataFrame, share: int) -> DataFrame:
    """``grams`` with ``inside``. A phrase two words longer lies in one that is one longer and as frequent at least, so
    the children decide."""
    children = longer.select(F.explode(F.array_distinct(F.array("left", "right"))).alias("name"), "a").groupBy("name").agg(F.max("a").alias("most"))
    return grams.join(children, "name", "left").withColumn("inside", F.coalesce(100 * F.col("most") >= share * F.col("a"), F.lit(False))).drop("most")


def top_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` of the candidates not inside a longer one, with ``rank``. Ties go by a, then phrase.

    Ranks are taken in shares of a language first, so that a hot language is not sorted in one task.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = found.filter(~F.col("inside")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: each language's first 2000 phrases of 2 and 3 words over all documents."""
    return top_phrases(phrases(table(spark, sf_dir, "documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
w1 AS (SELECT lang, unnest(ws) AS phrase FROM w),
w2 AS (SELECT lang, unnest(list_transform(list_zip(ws[:-2], ws[2:]), lambda x: x[1] || ' ' || x[2])) AS phrase FROM w WHERE len(ws) > 1),
w3 AS (SELECT lang, unnest(list_transform(list_zip(ws[:-3], ws[2:-2], ws[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3])) AS phrase FROM w WHERE len(ws) > 2),
g AS MATERIALIZED (SELECT lang, phrase, count(*) AS f FROM (FROM w1 UNION ALL FROM w2 UNION ALL FROM w3) GROUP BY ALL),
t AS (SELECT lang, count(*) AS n FROM w1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE f >= 10 AND contains(phrase, ' ')),
j AS (SELECT lang, phrase, a, unnest(range(1, len(ws))) AS j, ws FROM c),
h AS MATERIALIZED (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM j),
x AS MATERIALIZED (SELECT h.*, g.f AS l FROM h JOIN g ON g.lang = h.lang AND g.phrase = h.head),
y AS (SELECT x.*, g.f AS r FROM x JOIN g ON g.lang = x.lang AND g.phrase = x.tail),
s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM y),
b AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
k AS MATERIALIZED (SELECT lang, part, max(a) AS f FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS part FROM c WHERE len(ws) = 3) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN k ON k.lang = b.lang AND k.part = b.phrase WHERE k.f IS NULL OR 100 * k.f < 50 * b.a),
q AS (SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN t ON t.lang = o.lang)
SELECT * FROM q WHERE rank <= 2000"""
