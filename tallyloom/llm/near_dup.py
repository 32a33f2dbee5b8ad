"""Near-duplicate detection: one-permutation MinHash, optimal densification, banded buckets and star edges.

Every distinct shingle set becomes a node, named by a 128-bit digest of the set; exact copies end there. A node's
hashes fall into ``BINS`` bins by their high bits and each bin keeps its least hash. An empty bin takes the value of
the first filled bin in an order of all bins drawn for it, so bins agree with a probability of the Jaccard similarity.
``ROWS`` bins make a band and equal bands a bucket. Sets of up to ``SHORT`` shingles take minima of ``BINS``
independent hashes instead, as two of few shingles in one bin shift many; sizes that meet both kinds have both buckets.

In a bucket only edges to hubs are candidates: first one hub, the member that meets most others in all its buckets,
linked to every other member, so a bucket of m members has m - 1 candidates. Links are confirmed on full sets,
components follow, and buckets whose members lie in one component are done. In the others the hub, which has met
everyone, leaves, and new hubs, taken outside the bucket's largest component, ``SLOTS`` at first and eight times as
many each round, meet the members of other components and leave. Once all members outside the largest component fit
into the slots, all become hubs and the bucket is done. So every pair of a bucket's
members in different components is checked, but those whose sizes or sketches prove them too far apart, and no group
is expanded into all its pairs. A sketch holds the parity of the number of shingles in each of ``SKETCH`` classes: a
shingle that only one of two sets has changes one bit, so sets differ in at least as many shingles as their sketches in
bits, and no pair that meets the similarity is ruled out.

A pair at similarity 0.75 exactly shares no bucket with probability (1 - 0.75**5)**48, about 2e-6; at 0.8 it is 4e-9.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import struct_of, table, type_of
from tallyloom.llm.shingles import mix, overlap, shingle_sets
from tallyloom.operators.graph import components
from tallyloom.sources.staging import scratch, staged

BANDS, ROWS = 48, 5
BINS = BANDS * ROWS
SHORT = 32
SLOTS = 32
#: Bits of a sketch.
SKETCH = 2048
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75


@functools.lru_cache(2)
def _tables(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """First hash of each bin; for each bin an order of all bins."""
    edge = [(i << 64) // bins for i in range(bins)]
    rank = mix(np.arange(bins * bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(bins, bins)
    return np.array(edge, np.uint64), np.argsort(rank, axis=1, kind="stable")


def bin_minima(sorted_set: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The least hash of each bin, empty bins densified, of a non-empty sorted set."""
    edge, order = _tables(bins)
    first = np.searchsorted(sorted_set, edge)
    value = sorted_set[np.minimum(first, len(sorted_set) - 1)]
    filled = np.append(first[1:], len(sorted_set)) > first
    empty = np.flatnonzero(~filled)
    if len(empty):
        near = order[empty, :16]
        hit = filled[near]
        donor = near[np.arange(len(empty)), hit.argmax(1)]
        late = np.flatnonzero(~hit.any(1))
        if len(late):
            rows = order[empty[late]]
            donor[late] = rows[np.arange(len(late)), filled[rows].argmax(1)]
        value[empty] = value[donor]
    return value


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band."""
    x = minima.reshape(BANDS, ROWS)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, j])
    return key


def short_minima(sorted_set: np.ndarray) -> np.ndarray:
    """The least of each of ``BINS`` independent hashes of a short non-empty set."""
    salt = mix(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return mix(sorted_set[None, :] ^ salt[:, None]).min(1)


def bucket_keys(sorted_set: np.ndarray) -> np.ndarray:
    """The keys of a set's buckets: sets of sizes that can be similar have keys of one kind in common."""
    n, keys = len(sorted_set), []
    if n <= SHORT:
        keys.append(band_keys(short_minima(sorted_set)))
    if 100 * n >= PERCENT * (SHORT + 1):
        keys.append(band_keys(bin_minima(sorted_set)))
    return np.concatenate(keys)


def sketch(sorted_set: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls into each class, 64 classes to a number."""
    counts = np.bincount((mix(sorted_set) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _signature(text):
    out = []
    for s in shingle_sets(list(text)):
        if len(s):
            out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), bucket_keys(s).view(np.int64), sketch(s)))
        else:
            out.append((0, None, None, None))
    return pd.DataFrame(out, columns=["n", "node", "bands", "sketch"])


@F.pandas_udf(struct_of("n long, node binary, bands long[], sketch long[]"))
def signature(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for text in parts:
        yield _signature(text)


@F.pandas_udf(type_of("boolean"))
def linked(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether two texts' full sets meet the similarity; rows that come with the same hub hash it once."""
    for a, b in parts:
        hubs = {t: i for i, t in enumerate(dict.fromkeys(b))}
        hub, own = shingle_sets(list(hubs)), shingle_sets(list(a))
        out = []
        for x, t in zip(own, b):
            y = hub[hubs[t]]
            both = overlap(x, y)
            out.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pd.Series(out, dtype=bool)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are similar; ``texts`` has node and text."""
    mine = texts.select(F.col("node").alias("u"), F.col("text").alias("__a"))
    hubs = texts.select(F.col("node").alias("v"), F.col("text").alias("__b"))
    both = pairs.join(mine, "u").join(hubs, "v").withColumn("__ok", linked.asNondeterministic()("__a", "__b"))
    return both.where("__ok").select("u", "v")


def _near_in_size():
    return F.lit(100) * F.least("n", "m") >= F.lit(PERCENT) * F.greatest("n", "m")


def _near_in_sketch():
    """False only for sets that differ in too many shingles: 100 * both >= PERCENT * (n + m - both) bounds n + m - 2 * both."""
    # Functions on arrays: one expression of all numbers would be a method too large for the JIT compiler.
    counts = F.zip_with("sketch", "other", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return F.lit(100 + PERCENT) * apart <= F.lit(100 - PERCENT) * (F.col("n") + F.col("m"))


def links(members: DataFrame, nodes: DataFrame, texts: DataFrame, held: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``(node, label)`` for the nodes of ``members(key, node, n)`` that are linked with another.

    A bucket's hub is the member of lowest rank. ``nodes`` has node, n, rank and sketch, ``texts`` node and text; both
    have one row a node. The result is a table of the ``scratch`` that ``held`` belongs to.
    """
    hub = members.join(nodes.select("node", "rank"), "node").groupBy("key").agg(F.min(F.struct("rank", "node", "n")).alias("h"))
    hub = held(hub.select("key", F.col("h.node").alias("v"), F.col("h.n").alias("m")), "hubs")
    met = members.withColumnRenamed("node", "u").join(hub, "key").where("u <> v")
    pairs = held(met.where(_near_in_size()).select("u", "v").distinct(), "met")
    pairs = pairs.join(nodes.select(F.col("node").alias("u"), "n", "sketch"), "u")
    pairs = pairs.join(nodes.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("sketch").alias("other")), "v").where(_near_in_sketch()).select("u", "v")
    pairs = held(pairs, "pairs")
    label = components(_confirmed(pairs, texts), held, unique=True)
    checked = [pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))]
    left = met.select("key", F.col("u").alias("node"), "n")
    slots = SLOTS
    while True:
        known = held(left.join(label, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("c")), "known")
        shares = known.groupBy("key", "c").agg(F.count(F.lit(1)).alias("size"))
        torn = shares.groupBy("key").agg(F.max_by("c", F.struct("size", "c")).alias("most"), (F.sum("size") - F.max("size")).alias("others"))
        torn = held(torn.where("others > 0"), "torn")
        if torn.isEmpty():
            return label
        drawn = held(known.join(torn, "key").join(nodes.select("node", "rank", "sketch"), "node"), "drawn")
        # Where all members outside the largest component have slots, each has its own and the bucket is done.
        all_in = F.col("others") <= slots
        slot = F.when(all_in, F.col("node")).otherwise(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(slots)).cast("string").cast("binary"))
        hub = drawn.where("c <> most").groupBy("key", slot.alias("slot")).agg(F.min(F.struct("rank", F.col("node").alias("v"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("sketch").alias("other"))).alias("h"))
        hub = held(hub.select("key", "h.v", "h.m", "h.d", "h.other"), "hubs")
        met = drawn.join(hub, "key").where((F.col("c") != F.col("d")) & _near_in_size() & _near_in_sketch())
        pairs = met.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()
        pairs = pairs.join(functools.reduce(DataFrame.unionByName, checked), ["u", "v"], "left_anti")
        checked.append(held(pairs, "pairs"))
        new = held(_confirmed(checked[-1], texts), "links")
        if not new.isEmpty():
            chain = label.select(F.col("node").alias("u"), F.col("label").alias("v"))
            label = components(chain.unionByName(new), held, unique=True)
        wide = drawn.where(~all_in).select("key", "node", "n")
        if wide.isEmpty():
            return label
        left = wide.join(hub.select("key", F.col("v").alias("node")), ["key", "node"], "left_anti")
        slots *= 8


def labelled(docs: DataFrame) -> DataFrame:
    """``(doc_id, t, n, node, label, component_id)`` a row of ``docs(doc_id, text)``: ``t`` tells the texts of a repeated
    id apart, ``node`` and ``label`` name its shingle set and its component, null without shingles or id."""
    signed = docs.withColumn("s", signature.asNondeterministic()("text")).select("doc_id", F.xxhash64("text").alias("t"), "s.*")
    signed = staged(signed.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node"))), "signatures")
    with scratch(docs.sparkSession) as held:
        # One row of all that have a node's set stands for it, however often ids or rows repeat.
        ours = signed.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "t")).alias("f"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch")])
        ours = held(ours.select("node", "f.doc_id", "f.t", "n", "bands", "sketch"), "nodes")
        rows = ours.select("node", "n", F.explode("bands").alias("key"))
        full = held(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
        members = held(rows.join(full, "key"), "members")
        # The more others a node meets in its buckets, the likelier it is what they were copied from: the best hub.
        wanted = members.groupBy("node").agg((-F.sum("size")).alias("rank"))
        wanted = held(wanted.join(ours.select("node", "n", "sketch", "doc_id", "t"), "node"), "wanted")
        texts = docs.withColumn("t", F.xxhash64("text")).join(wanted.select("node", "doc_id", "t"), ["doc_id", "t"])
        texts = held(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")
        label = links(members.select("key", "node", "n"), wanted.select("node", "n", "rank", "sketch"), texts, held)
        named = ours.select("node", "doc_id").join(label, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
        least = held(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
        named = staged(named.select("node", "label").join(least, "label"), "named")
    return signed.select("doc_id", "t", "n", "node").join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept. Ids may be of any type with an order.

    Null texts and texts without words have no shingles and stand alone. A null id takes no part: its component is
    null and it is kept. Repeated rows share their component; one of them stands for all in every join. Different
    texts under one id are judged each by itself. An empty table gives an empty result.
    """
    out = labelled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with one row of each group, one of its smallest doc_id; columns unchanged.

    Rows with a null id, a null text or no words are in no group and all stay. Repeated rows of the smallest id are
    one; if it has several texts in the group, one of these stays.
    """
    named = staged(labelled(docs.select("doc_id", "text")).select("doc_id", "t", "label", "component_id").where("label IS NOT NULL"), "named")
    best = staged(named.where("doc_id = component_id").groupBy("label").agg(F.min("doc_id").alias("__nd_id"), F.min("t").alias("__nd_t"), F.count(F.lit(1)).alias("__nd_n")), "best")
    once, often = best.where("__nd_n = 1"), best.where("__nd_n > 1").select("__nd_id", "__nd_t")
    rows = docs.withColumn("__nd_h", F.xxhash64("text"))
    here = (F.col("doc_id") == F.col("__nd_id")) & (F.col("__nd_h") == F.col("__nd_t"))
    grouped = named.select(F.col("doc_id").alias("__nd_id"), F.col("t").alias("__nd_t")).join(once.select("__nd_id", "__nd_t"), ["__nd_id", "__nd_t"], "left_anti").distinct()
    out = rows.join(grouped, here, "left_anti").unionByName(rows.join(often, here, "left_semi").dropDuplicates(["doc_id", "__nd_h"]))
    return out.select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: groups of near-duplicates among all documents."""
    return find(table(spark, sf_dir, "documents"))


_SHINGLES = r"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n, s FROM g),
u AS MATERIALIZED (SELECT s, min(doc_id) AS node, min(n) AS n FROM (SELECT doc_id, n, list_sort(s) AS s FROM n WHERE n > 0) GROUP BY s),
f AS MATERIALIZED (SELECT node, n, unnest(s) AS g FROM u),
df AS (SELECT g, count(*) AS df FROM f GROUP BY g HAVING count(*) > 1),
p AS MATERIALIZED (SELECT node, n, f.g, row_number() OVER (PARTITION BY node ORDER BY df, f.g) AS pos, count(*) OVER (PARTITION BY node) AS shared FROM f JOIN df ON f.g = df.g),
q AS MATERIALIZED (SELECT * FROM p WHERE 100 * shared >= 75 * n AND pos <= shared - ceil(0.75 * n) + 1),
c AS (SELECT DISTINCT a.node AS a, b.node AS b, a.n AS an, b.n AS bn FROM q a JOIN q b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
i AS (SELECT c.a, c.b, c.an, c.bn, count(*) AS i FROM c JOIN f x ON x.node = c.a JOIN f y ON y.node = c.b AND y.g = x.g GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM i WHERE 100 * i >= 75 * (an + bn - i) UNION ALL SELECT b, a FROM i WHERE 100 * i >= 75 * (an + bn - i)),
r AS (SELECT node AS a, node AS b FROM u UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
k AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a)"""
ORACLE = f"""WITH RECURSIVE {_SHINGLES.format(docs="documents")}
SELECT n.doc_id, n.n AS n_shingles, coalesce(k.component, n.doc_id) AS component_id, n.doc_id = coalesce(k.component, n.doc_id) AS kept
FROM n LEFT JOIN u ON u.s = list_sort(n.s) LEFT JOIN k ON k.node = u.node"""
