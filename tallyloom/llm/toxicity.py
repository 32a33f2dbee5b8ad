"""Toxicity by a classifier chain.

Categories are predicted in turn. Each has a linear model over the words and word beginnings that tell toxic texts
from others, and over the probabilities of the categories before it. The later models are trained on out-of-fold
probabilities, so that they meet the earlier ones as they are on unseen texts; a fold's vocabulary is counted without
that fold. The last category is ``toxic``, as the labels mark it. The labels name no kinds of toxicity, so the earlier
categories are found in them: two clusters of the toxic texts by their entries.

Vocabulary and models are fitted on at most ``SAMPLE`` labelled rows per class, in hash order. The vocabulary is
counted on the executors and its ``VOCABULARY`` best entries, for each fold and for all, come back.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import hash_sample, staged, struct_of, table, type_of

SAMPLE = 2500
VOCABULARY = 4096
FOLDS = 5
THRESHOLD = 0.5
PREFIXES = (4, 5, 6)
KINDS = ("kind_1", "kind_2")
CHAIN = (*KINDS, "toxic")
_WORD = re.compile(r"[^\W\d_]+")


def entries(text: str | None) -> set[str]:
    """Words of a text and their beginnings, the latter with a star."""
    out = set(_WORD.findall((text or "").lower()))
    return out | {w[:n] + "*" for w in out for n in PREFIXES if len(w) > n}


@dataclass
class Chain:
    """Entry numbers, and per category a weight for each entry, for the count of entries and for each probability
    before it. At most VOCABULARY entries."""

    number: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)

    def hits(self, text: str | None) -> list[int]:
        get, out = self.number.get, []
        for w in set(_WORD.findall((text or "").lower())):
            if (k := get(w)) is not None:
                out.append(k)
            for n in PREFIXES:
                if len(w) > n and (k := get(w[:n] + "*")) is not None:
                    out.append(k)
        return sorted(set(out))

    def predict(self, hits: list[list[int]]) -> np.ndarray:
        """A row per text and a column per category."""
        out = np.empty((len(hits), len(CHAIN)))
        for j in range(len(CHAIN)):
            out[:, j] = _probability(hits, out[:, :j], self.weights[j], self.bias[j], len(self.number)) if self.weights else 0.0
        return out


def _flat(hits: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    return row, np.fromiter((k for h in hits for k in h), np.int64, len(row))


def _dense(hits: list[list[int]], before: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p([len(h) for h in hits]), before]) if hits else np.zeros((0, 1 + before.shape[1]))


def _probability(hits, before, w, b, size) -> np.ndarray:
    row, col = _flat(hits)
    z = b + np.bincount(row, w[col], len(hits)) + _dense(hits, before) @ w[size:]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(hits: list[list[int]], before: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by Adam over all rows; with one class only, a constant."""
    n_dense = 1 + before.shape[1]
    rate = min(max(float((weight * y).sum() / weight.sum()), 1e-3), 1 - 1e-3)
    w, b = np.zeros(size + n_dense), float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return w, b
    row, col = _flat(hits)
    dense, weight = _dense(hits, before), weight / weight.sum()
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[col], len(y)) + dense @ w[size:]
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.concatenate((np.bincount(col, e[row], size), e @ dense, [e.sum()]))
        g[:-1] += 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - d[:-1], b - float(d[-1])
    return w, b


def kinds(hits: list[list[int]], toxic: np.ndarray, size: int, rounds: int = 25) -> list[np.ndarray]:
    """Two categories: clusters of the toxic texts by the cosine of their entries, rare entries weighing more.

    The first centres are the toxic text least like the mean and the one least like that; ties take the first.
    """
    rows = np.flatnonzero(toxic == 1)
    x = np.zeros((len(rows), size), np.float32)
    for i, k in enumerate(rows):
        x[i, hits[k]] = 1
    x *= np.log1p(len(rows) / np.maximum(1, x.sum(0)))
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    out = [np.zeros(len(toxic)) for _ in KINDS]
    if not len(rows):
        return out
    first = int((x @ x.mean(0)).argmin())
    centres = x[[first, int((x @ x[first]).argmin())]]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = np.stack([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(KINDS))])
        centres /= np.maximum(1e-9, np.linalg.norm(centres, axis=1, keepdims=True))
    for c, y in enumerate(out):
        y[rows[own == c]] = 1
    return out


def out_of_fold(views: list[list[list[int]]], before: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray, size: int) -> np.ndarray:
    """For each text the probability from a model, and a vocabulary (a view of the texts), that has not seen its fold."""
    out = np.full(len(y), float((weight * y).sum() / weight.sum()))
    for f, view in enumerate(views):
        a, o = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(a) and len(o):
            w, b = _fit([view[k] for k in a], before[a], y[a], weight[a], size)
            out[o] = _probability([view[k] for k in o], before[o], w, b, size)
    return out


def fit_chain(texts: list[str | None], toxic: np.ndarray, fold: np.ndarray, number: dict[str, int], chosen: np.ndarray, weight: np.ndarray) -> Chain:
    """Fit the categories in turn, each on out-of-fold probabilities of those before it.

    ``chosen`` has a row for each fold, and one for all folds at the end: the entries of ``number`` in its vocabulary.
    """
    if not len(texts):
        return Chain()
    size = len(number)
    hits = [Chain(number).hits(t) for t in texts]
    *views, view = [[[k for k in h if c[k]] for h in hits] for c in chosen]
    chain = Chain({w: i for i, w in enumerate(w for w, k in sorted(number.items(), key=lambda x: x[1]) if chosen[-1][k])})
    before = np.zeros((len(texts), 0))
    for y in (*kinds(view, toxic, size), toxic):
        w, b = _fit(view, before, y, weight, size)
        chain.weights.append(np.concatenate((w[:size][chosen[-1]], w[size:])))
        chain.bias.append(b)
        before = np.column_stack([before, out_of_fold(views, before, y, weight, fold, size)])
    return chain


@F.pandas_udf(type_of("string[]"))
def _entries(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in parts:
        yield pd.Series([sorted(entries(t)) for t in text], dtype=object)


def _best(counted: DataFrame, f: int | None, totals: dict[tuple[int, int], int]) -> DataFrame:
    """The vocabulary without fold ``f``, or of all folds, as (split, e)."""
    kept = [k for k in range(FOLDS) if k != f]
    n0, n1 = (max(1, sum(totals.get((k, t), 0) for k in kept)) for t in (0, 1))
    a, b = (sum((F.col(f"{x}{k}") for k in kept), F.lit(0)) for x in "ab")
    gain = a * F.log(F.greatest(a, F.lit(1)) / n1 / ((b + 0.5) / n0))
    best = counted.where((a >= 3) & (a / n1 > 10 * (b / n0))).orderBy(F.desc(gain), "e").limit(VOCABULARY)
    return best.select(F.lit(FOLDS if f is None else f).alias("split"), "e")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """A chain for ``labels.toxic``. Null ids, labels and texts are left out; without toxic rows nothing is toxic.

    Of an id's repeated rows the least text and label counts, once. An entry is kept if at least three sampled toxic
    texts have it and their share of it exceeds the others' tenfold; of these the VOCABULARY ones with the largest
    log-likelihood gain.
    """
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    chosen = hash_sample(known.where("toxic = 0"), "doc_id", sample).unionByName(hash_sample(known.where("toxic = 1"), "doc_id", sample))
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen.groupBy("doc_id").agg(F.min("toxic").alias("toxic"))), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = staged(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")), "labelled")
    totals = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    n0, n1 = (sum(n for (_, t), n in totals.items() if t == x) for x in (0, 1))
    if not n1:
        return Chain()
    sums = [F.sum(F.when((F.col("fold") == k) & (F.col("toxic") == t), 1).otherwise(0)).alias(f"{x}{k}") for x, t in (("a", 1), ("b", 0)) for k in range(FOLDS)]
    counted = rows.select("toxic", "fold", F.explode(_entries.asNondeterministic()("text")).alias("e")).groupBy("e").agg(*sums)
    counted = staged(counted.where(" + ".join(f"a{k}" for k in range(FOLDS)) + " >= 3"), "counted")
    got = functools.reduce(DataFrame.unionByName, [_best(counted, f, totals) for f in (*range(FOLDS), None)]).collect()
    number = {e: k for k, e in enumerate(sorted({r["e"] for r in got}))}
    in_split = np.zeros((FOLDS + 1, len(number)), bool)
    for r in got:
        in_split[r["split"], number[r["e"]]] = True
    seen = Chain(number)

    # Only the entries of the sampled texts come back, as a short text each.
    @F.pandas_udf(T.StringType())
    def evidence(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in parts:
            yield pd.Series([" ".join(sorted({w for w in set(_WORD.findall(t.lower())) if w in seen.number or any(w[:n] + "*" in seen.number for n in PREFIXES if len(w) > n)})) for t in text], dtype=object)

    got = rows.select("doc_id", "toxic", "fold", evidence.asNondeterministic()("text").alias("text")).toPandas().sort_values("doc_id", kind="stable")
    y = got["toxic"].to_numpy(float)
    weight = np.where(y == 1, 0.5 / max(1, n1), 0.5 / max(1, n0)) * len(y)  # the classes weigh the same
    return fit_chain(got["text"].tolist(), y, got["fold"].to_numpy(), number, in_split, weight)


def score(docs: DataFrame, model: Chain, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct of probabilities, one per category; null and empty texts are scored as without words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(struct_of(", ".join(f"{c} double" for c in CHAIN)))
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in parts:
            yield pd.DataFrame(sent.value.predict([sent.value.hits(t) for t in text]), columns=list(CHAIN))

    return docs.withColumn(out, scored.asNondeterministic()(text_col))


def reject(docs: DataFrame, model: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose last probability reaches ``threshold``; columns unchanged."""
    return score(docs, model, out="__tx").where(F.col("__tx.toxic") < threshold).drop("__tx")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all documents with each category's probability and the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    p = [F.col(f"toxicity.{c}").alias(f"p_{c}") for c in CHAIN]
    return out.select("doc_id", *p, (F.col("toxicity.toxic") >= THRESHOLD).alias("rejected"))
