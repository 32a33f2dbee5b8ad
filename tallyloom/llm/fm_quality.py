"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + <w, x> + 1/2 sum_f((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions in time
linear in the features present. Words are hashed into ``BUCKETS``; statistics and the length column are cut into
intervals, one indicator each, so that their interactions with words and with each other are learned.
The model is fitted on the driver from at most ``SAMPLE`` labelled rows per class, chosen by a hash of the id.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import fold, hash_sample, table, type_of

BUCKETS = 1 << 14
RANK = 6
SAMPLE = 2500
EPOCHS = 8
THRESHOLD = 0.7
#: Ends of the intervals of each statistic.
CUTS = {
    "words": (1, 5, 10, 20, 50, 100, 200, 500, 1000, 3000, 10000),
    "word_length": (2, 3, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15),
    "symbols": (0.0001, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "capitals": (0.005, 0.01, 0.03, 0.06, 0.1, 0.2, 0.5, 0.8),
    "digits": (0.0001, 0.01, 0.03, 0.1, 0.3),
    "stops": (0.0001, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.5),
    "punctuation": (0.0001, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3),
    "distinct": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "top_word": (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5, 0.9),
    "repeated_lines": (0.0001, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8),
    "length_column": (20, 100, 300, 1000, 3000, 10000, 30000),
}
_OFFSET = dict(zip(CUTS, np.cumsum([BUCKETS, *(len(c) + 1 for c in CUTS.values())]).tolist()))
SIZE = BUCKETS + sum(len(c) + 1 for c in CUTS.values())
_STOPS = frozenset("the of and to in is that it for on with la le les de des un une et que en der die das und ist ein zu el los las y con por".split())
_CLASS = np.zeros(256, np.int64)
_CLASS[list(b"#*$%&|<>@^~_=+{}[]\\")] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[list(b".,;:!?")] = 4


def statistics(text: str, n_chars: float | None) -> tuple[dict[str, float], Counter]:
    """Structure statistics of a text and the counts of its words."""
    raw = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=5)
    words = text.split()
    count = Counter(words)
    n, size = max(1, len(words)), max(1, int(raw.sum()))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return {
        "words": len(words),
        "word_length": len(text) / n,
        "symbols": raw[1] / size,
        "capitals": raw[2] / size,
        "digits": raw[3] / size,
        "stops": sum(c for w, c in count.items() if w in _STOPS) / n,
        "punctuation": raw[4] / size,
        "distinct": len(count) / n,
        "top_word": max(count.values(), default=0) / n,
        "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "length_column": len(text) if n_chars is None or n_chars != n_chars else float(n_chars),
    }, count


def features(text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: words share a norm of 1, each statistic has one indicator."""
    stats, count = statistics(text or "", n_chars)
    own = [_OFFSET[k] + int(np.searchsorted(CUTS[k], v, side="right")) for k, v in stats.items()]
    words = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for w in count), np.int64, len(count))
    i = np.concatenate((own, words)).astype(np.int64)
    return i, _values(len(i))


def _values(n: int) -> np.ndarray:
    """Values of n features: ones for the statistics, which come first, then words of equal weight and norm 1."""
    return np.concatenate((np.ones(len(CUTS)), np.full(n - len(CUTS), 1 / np.sqrt(max(1, n - len(CUTS))))))


@dataclass
class Machine:
    """Weights of a fitted machine; a few hundred kilobytes whatever the input."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, i: np.ndarray, x: np.ndarray) -> float:
        xv = self.v[i] * x[:, None]
        s = xv.sum(0)
        return float(self.bias + self.w[i] @ x + 0.5 * (s @ s - (xv * xv).sum()))

    def score(self, text: str | None, n_chars: float | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text, n_chars)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Adagrad on the weighted log loss with weight decay. Without rows, or with one class only, a constant."""
    rate = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    m = Machine(float(np.log(rate / (1 - rate))), np.zeros(SIZE), np.zeros((SIZE, RANK)))
    if not len(y) or y.min() == y.max():
        return m
    rng = np.random.default_rng(seed)
    m.v = rng.normal(0, 0.02, (SIZE, RANK))
    gw, gv = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(order) // 50)):
            i = np.concatenate([rows[k][0] for k in batch])
            x = np.concatenate([rows[k][1] for k in batch])
            start = np.cumsum([0, *(len(rows[k][0]) for k in batch)])[:-1]
            size = np.diff([*start, len(i)])
            xv = m.v[i] * x[:, None]
            s = np.add.reduceat(xv, start)
            z = m.bias + np.add.reduceat(m.w[i] * x, start) + 0.5 * ((s * s).sum(1) - np.add.reduceat((xv * xv).sum(1), start))
            e = weight[batch] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            m.bias -= 0.2 * float(e.sum())
            g = np.repeat(e, size) * x
            at, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, g, len(at)) + 1e-4 * m.w[at]
            dv = g[:, None] * (np.repeat(s, size, axis=0) - xv)
            dv = np.stack([np.bincount(inv, dv[:, f], len(at)) for f in range(RANK)], 1) + 1e-4 * m.v[at]
            gw[at] += dw * dw
            gv[at] += dv * dv
            m.w[at] -= 0.15 * dw / np.sqrt(gw[at])
            m.v[at] -= 0.03 * dv / np.sqrt(gv[at])
    return m


@F.pandas_udf(type_of("int[]"))
def _indices(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, n in parts:
        yield pd.Series([features(t, c)[0].astype(np.int32) for t, c in zip(text, n)])


def train(docs: DataFrame, labels: DataFrame, learn: object, sample: int = SAMPLE) -> Machine:
    """A machine for ``labels.quality`` from the rows whose id meets the condition ``learn``.

    At most ``sample`` labels of each class are read, in hash order; each class weighs what it has among all labels.
    Rows with a null id or label are left out; of an id's repeated rows the least text and label counts, once. Texts
    are joined to the chosen ids, a table of bounded size.
    """
    known = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(learn)
    share = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = hash_sample(known.where("quality = 0"), "doc_id", sample).unionByName(hash_sample(known.where("quality = 1"), "doc_id", sample))
    rows = docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen.groupBy("doc_id").agg(F.min("quality").alias("quality"))), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("text", "n_chars")).alias("d")).select("doc_id", "quality", "d.*")
    rows = rows.withColumn("i", _indices.asNondeterministic()("text", F.col("n_chars").cast("double"))).select("doc_id", "quality", "i").toPandas()
    rows = rows.assign(n=rows["i"].map(len)).sort_values(["doc_id", "quality", "n"], kind="stable")
    y = rows["quality"].to_numpy(float)
    got = Counter(y.tolist())
    weight = np.array([share[int(q)] / got[q] for q in y]) if len(y) else np.empty(0)
    # Classes at a ratio of at most 3 : 1, so that the rarer one is learned.
    if len(got) == 2:
        total = {q: weight[y == q].sum() for q in got}
        most = 3 * min(total.values())
        weight = weight * np.array([min(1.0, most / total[q]) for q in y])
        weight = weight / weight.mean()
    return fit([(np.asarray(i), _values(len(i))) for i in rows["i"]], y, weight)


def score(docs: DataFrame, model: Machine, text_col: str = "text", length_col: str | None = "n_chars", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``: the probability of label 1, for null and empty texts too.

    A null length counts as the text's own. Rows are scored one by one; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(type_of("double"))
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, n in parts:
            yield pd.Series([sent.value.score(t, c) for t, c in zip(text, n)], dtype=float)

    length = F.col(length_col).cast("double") if length_col else F.lit(None).cast("double")
    return docs.withColumn(out, scored.asNondeterministic()(text_col, length))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all documents; labels of rows in fold 2 of 4 are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = train(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    out = score(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
