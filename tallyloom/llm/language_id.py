"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A word's score for a language is the sum of log probabilities of its byte n-grams (one to four, with the word's ends),
hashed into ``BUCKETS``. A language is a candidate for a word only if the learned texts use the word's script in that
language; with no such language all stay. Viterbi over the words of the whole text, with one penalty for each switch,
labels spans of one language, and the language with the most letters is the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import fold, struct_of, table

BUCKETS = 1 << 15
ORDERS = 4
SWITCH = 12.0
#: Documents per language that the model is fitted on. A language takes 128 KB of the model.
SAMPLE = 1000
#: A script belongs to a language if it has at least this share of its letters.
SCRIPT_SHARE = 0.001
#: First code point of each range, and its script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
_STARTS = np.array([a for a, _ in SCRIPTS])
_NAMES = list(dict.fromkeys(s for _, s in SCRIPTS))
_OF_RANGE = np.array([_NAMES.index(s) for _, s in SCRIPTS])
CHUNK_WORDS = 400_000
#: Scores, one a word and language, that are held at a time.
CELLS = 1 << 22


def script_of(word: str) -> int:
    """Number of the script of a word's first letter; -1 without letters."""
    if word.isascii():
        return 0 if any(c.isalpha() for c in word) else -1
    for c in word:
        if c.isalpha():
            return int(_OF_RANGE[np.searchsorted(_STARTS, ord(c), side="right") - 1])
    return -1


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, and for each the number of its word."""
    joined = b"".join(b"\x01" + w.encode("utf-8", "surrogatepass") + b"\x02" for w in words)
    raw = np.frombuffer(joined, np.uint8).astype(np.uint32)
    word = np.cumsum(raw == 1) - 1
    out, of = [], []
    h = np.zeros(len(raw), np.uint32)
    for n in range(ORDERS):
        m = len(raw) - n
        if m <= 0:
            break
        h = (h[:m] * np.uint32(0x01000193)) ^ (raw[n:] + np.uint32(n << 9)) * np.uint32(0x9E3779B1)
        same = word[:m] == word[n:]
        if n == 0:
            same = raw > 2
        x = h[same]
        out.append(((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(17)).astype(np.int32))
        of.append(word[:m][same])
    return np.concatenate(out), np.concatenate(of)


@dataclass
class Languages:
    """``log_p`` is BUCKETS x languages; ``allowed`` scripts x languages."""

    names: list[str]
    log_p: np.ndarray
    allowed: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row per word; words without letters score 0 for every language."""
        out = np.zeros((len(words), len(self.names)), np.float32)
        scripts = np.fromiter(map(script_of, words), np.int64, len(words))
        keep = np.flatnonzero(scripts >= 0)
        if not len(keep):
            return out
        bucket, of = _grams([words[i].replace("\x01", "").replace("\x02", "") for i in keep])
        for k in range(len(self.names)):
            out[keep, k] = np.bincount(of, self.log_p[bucket, k], len(keep))
        ok = self.allowed[scripts[keep]]
        ok = ok | ~ok.any(1, keepdims=True)
        out[keep] = np.where(ok, out[keep], out[keep].min(1, keepdims=True) - 50)
        return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best state of every word of many texts, whose words follow each other in ``scores``."""
    return _paths(lengths, scores.shape[1], lambda positions: (scores[at] for at in positions), switch)


def _paths(lengths: np.ndarray, states: int, scored, switch: float) -> np.ndarray:
    """Best paths. ``scored`` takes the positions of the words of each step and gives their scores, step by step.

    Texts advance together, one word a step, longest first. Ties keep the language, then take the first. A state that
    is worth less than a switch from the best one is entered anew; each state keeps the step at which it was entered,
    and each word the best state before it with that state's step. So the way back goes from span to span, and memory
    is a few numbers a word and a text's states, not words times states.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    start = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    size = lengths[order]
    live = np.searchsorted(-size, -np.arange(1, (int(size[0]) if n else 0) + 1), side="right").tolist()
    best, since = np.zeros(int(lengths.sum()), np.int32), np.zeros(int(lengths.sum()), np.int32)
    v, entered = np.zeros((n, states), np.float32), np.zeros((n, states), np.int32)
    rows = np.arange(n)
    positions = [start[:a] + t for t, a in enumerate(live)]
    for t, (at, found) in enumerate(zip(positions, scored(positions))):
        a = len(at)
        if t:
            top = v[:a].argmax(1)
            best[at], since[at] = top, entered[rows[:a], top]
            jump = v[rows[:a], top][:, None] - switch
            held = v[:a] >= jump
            v[:a] = np.where(held, v[:a], jump)
            entered[:a] = np.where(held, entered[:a], t)
        v[:a] += found
    path = np.zeros(len(best), np.int32)
    for i in np.flatnonzero(size):
        state = int(v[i].argmax())
        first, end = int(entered[i, state]), int(size[i])
        while True:
            path[start[i] + first : start[i] + end] = state
            if not first:
                break
            at = start[i] + first
            state, end, first = int(best[at]), first, int(since[at])
    return path


def _scored(model: Languages, unique: list[str], number: np.ndarray, positions: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Scores of the words at each step: different words are scored once for as many steps as ``CELLS`` has room for."""
    room, t = max(1, CELLS // len(model.names)), 0
    while t < len(positions):
        end, words = t + 1, len(positions[t])
        while end < len(positions) and words + len(positions[end]) <= room:
            words += len(positions[end])
            end += 1
        wanted, place = np.unique(number[np.concatenate(positions[t:end])], return_inverse=True)
        table, k = model.word_scores([unique[i] for i in wanted]), 0
        for at in positions[t:end]:
            yield table[place[k : k + len(at)]]
            k += len(at)
        t = end


def _labelled(texts: list[str | None], model: Languages, switch: float, spans: bool) -> list[tuple]:
    """(language, score, spans) for each text; a span is (first word, words, language)."""
    if not model.names:
        return [("und", 0.0, [])] * len(texts)
    out: list[tuple] = []
    at = 0
    while at < len(texts):
        words: list[str] = []
        lengths: list[int] = []
        while at < len(texts) and (not lengths or len(words) < CHUNK_WORDS and len(lengths) * len(model.names) < CELLS):
            w = (texts[at] or "").lower().split()
            words += w
            lengths.append(len(w))
            at += 1
        seen: dict[str, int] = {}
        number = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        unique = list(seen)
        letters = np.fromiter((sum(map(str.isalpha, w)) if not w.isalpha() else len(w) for w in unique), np.int64, len(unique))[number]
        path = _paths(np.array(lengths), len(model.names), lambda positions: _scored(model, unique, number, positions), switch)
        begin = 0
        for n in lengths:
            p, x = path[begin : begin + n], letters[begin : begin + n]
            share = np.bincount(p, x, len(model.names))
            total = share.sum()
            if not total:
                out.append(("und", 0.0, []))
            else:
                k = int(share.argmax())
                cuts = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), n] if spans else []
                out.append((model.names[k], float(share[k] / total), [(a, b - a, model.names[p[a]]) for a, b in zip(cuts, cuts[1:])]))
            begin += n
    return out


@F.pandas_udf(struct_of("grams long[], scripts long[]"))
def _counted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Word types of a text as n-gram buckets, and its letters by script."""
    for text in parts:
        rows = []
        for t in text:
            words = list(dict.fromkeys(x.replace("\x01", "").replace("\x02", "") for x in (t or "").lower().split()))
            kinds = [script_of(w) for w in words]
            words = [w for w, k in zip(words, kinds) if k >= 0]
            b = _grams(words)[0] if words else np.empty(0, np.int32)
            rows.append((b.astype(np.int64), np.bincount([k for k in kinds if k >= 0], minlength=len(_NAMES)).astype(np.int64)))
        yield pd.DataFrame(rows, columns=["grams", "scripts"])


def train(docs: DataFrame, learn: object, sample: int = SAMPLE) -> Languages:
    """A model from text and non-null lang of the rows that meet the condition ``learn``.

    About ``sample`` documents per language, those with the lowest hashes of the id. Their counts are added up per
    language and bucket on the executors; only this table comes back. Every value of lang is learned, however many.
    """
    known = docs.where(learn).where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    found = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    names = sorted(found)
    log_p = np.zeros((BUCKETS, len(names)), np.float32)
    allowed = np.ones((len(_NAMES), len(names)), bool)
    if not names:
        return Languages(names, log_p, allowed)
    # A row a language, far smaller than the model: broadcast, so that texts are not shuffled by a hot language.
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, sample / n)) for k, n in found.items()], "lang string, share double")
    share = F.col("share")
    chosen = known.select("doc_id", "text", "lang").join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    counted = chosen.select("lang", "text").withColumn("c", _counted.asNondeterministic()("text"))
    both = counted.select("lang", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("c.grams").alias("x")), F.struct(F.lit(1).alias("kind"), F.col("c.scripts").alias("x")))).alias("e"))
    cells = both.select("lang", "e.kind", F.posexplode("e.x").alias("pos", "value"))
    summed = cells.groupBy("lang", "kind", F.when(F.col("kind") == 0, F.col("value")).otherwise(F.col("pos")).alias("cell")).agg(F.sum(F.when(F.col("kind") == 0, 1).otherwise(F.col("value"))).alias("n")).toPandas()
    by_lang = dict(list(summed.groupby("lang")))
    for k, lang in enumerate(names):
        mine = by_lang.get(lang, summed.iloc[:0])
        g, s = mine[mine["kind"] == 0], mine[mine["kind"] == 1]
        n = np.zeros(BUCKETS)
        n[g["cell"].to_numpy(np.int64)] = g["n"].to_numpy(float)
        log_p[:, k] = np.log((n + 0.5) / (n.sum() + 0.5 * BUCKETS))
        seen = np.zeros(len(_NAMES))
        seen[s["cell"].to_numpy(np.int64)] = s["n"].to_numpy(float)
        allowed[:, k] = seen >= SCRIPT_SHARE * max(1.0, seen.sum())
    return Languages(names, log_p, allowed)


SPAN = T.ArrayType(struct_of("word int, words int, lang string"))


def label(docs: DataFrame, model: Languages, text_col: str = "text", switch: float = SWITCH, spans: bool = True, out: str = "language") -> DataFrame:
    """``docs`` with the struct ``out``: lang, score and spans (first word, number of words, language).

    Null texts, texts without a letter and a model without languages give ``und`` with score 0 and no spans. The score
    is the share of the letters in spans of the language; ties go to the language first by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPAN)])

    @F.pandas_udf(kind)
    def labelled(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in parts:
            yield pd.DataFrame(_labelled(list(text), sent.value, switch, spans), columns=["lang", "score", "spans"])

    return docs.withColumn(out, labelled.asNondeterministic()(text_col))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the language of all documents; rows in fold 0 of 5 are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, fold(5) != 0)
    out = label(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.size("language.spans").alias("n_spans"))
