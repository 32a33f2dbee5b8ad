"""Quality rules: a threshold table compiled into one Spark projection.

The measures (lengths, symbols, stop words, lines, repeated word windows) and the rules over them are built-in
column expressions; no user function runs. Every rule is a row of ``RULES``: a name, a measure and the range a
kept text's measure lies in. ``compile_rules`` turns the table into one boolean per rule and their conjunction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import words

WINDOW = 8
#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages in use.
STOP_WORDS = (
    "the of and to in is that it for on with as was are be this by from at or an not a "
    "de la le les des un une et que qui dans pour est sur pas avec du au en par "
    "der die das und ist nicht ein eine zu den von mit sich auf für als dem im "
    "el los las del y con por una se al lo es su para como no"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= measure <= high; a bound of None is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", "mean_word_chars", 2.5, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.06, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
)


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def measure(df: DataFrame, text_col: str = "text", out: str = "measures") -> DataFrame:
    """Add the struct column ``out`` with every measure of the text.

    Null and empty texts measure 0 throughout. Repeated words are found by sorting 64-bit window hashes within the
    row, and only where a row has equal hashes, so a text of n words costs n log n. Columns of ``df`` are kept; one
    named like ``out`` is replaced. Helper columns carry a ``__qr_`` prefix and are dropped.
    """
    text, w, h, s, p, lines = (F.col(f"__qr_{x}") for x in ("text", "words", "hash", "sorted", "at", "lines"))
    n = F.size(w)
    df = df.withColumn("__qr_text", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("__qr_words", words(text)).withColumn(
        "__qr_lines", F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    )
    df = df.withColumn(
        "__qr_hash",
        F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    df = df.withColumn(
        "__qr_sorted",
        F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    twin = lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
    df = df.withColumn("__qr_at", F.when(s.isNotNull(), F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"]))))
    covered = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
    stop = F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))
    return df.withColumn(
        out,
        F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(stop).cast("long").alias("n_stop"),
        ),
    ).drop("__qr_text", "__qr_words", "__qr_lines", "__qr_hash", "__qr_sorted", "__qr_at")


def ratios(measures: str = "measures") -> dict[str, Column]:
    """The ratios a rule may name, over the struct that :func:`measure` adds; 0 over an empty denominator."""
    f = lambda x: f"{measures}.{x}"
    return {
        "n_words": F.col(f("n_words")).cast("double"),
        "mean_word_chars": _ratio(f("word_chars"), f("n_words")),
        "symbol_ratio": _ratio(f("n_symbols"), f("word_chars")),
        "stop_ratio": _ratio(f("n_stop"), f("n_words")),
        "dup_line_ratio": _ratio(f("n_dup_lines"), f("n_lines")),
        "repeat_ratio": _ratio(f("n_repeat_words"), f("n_words")),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES, measures: str = "measures") -> dict[str, Column]:
    """One boolean column per rule, true where the text passes it."""
    known, out = ratios(measures), {}
    for r in rules:
        x = known[r.measure]
        tests = [x >= r.low] * (r.low is not None) + [x <= r.high] * (r.high is not None)
        out[r.name] = tests[0] if len(tests) == 1 else tests[0] & tests[1]
    return out


def base_failed(measures: str = "measures") -> Column:
    n, again = F.col(f"{measures}.n_words"), F.col(f"{measures}.n_repeat_words")
    return (n < 20) | (100 * again > 30 * n)


def judge(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, measures: str = "measures") -> DataFrame:
    """``df`` with the measures, ``base_failed``, the failed rules' names and ``kept``.

    Null, empty and short texts fail the base rule. Rows are judged one by one: repeated rows repeat their verdict,
    an empty table gives an empty result.
    """
    passed = compile_rules(rules, measures)
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in passed.items()]), lambda x: x.isNotNull())
    df = measure(df, text_col, measures).withColumn("base_failed", base_failed(measures)).withColumn("failed_rules", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every whole text of documents under the production table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    m = [F.col(f"measures.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop")]
    return judge(docs).select("doc_id", *m, "base_failed", "kept")


_W = r"[^\x20\x09-\x0D]+"
#: The same rows in DuckDB; its lower() folds like Spark's over these texts.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_W}') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS l FROM d),
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i+7], ' '))) AS gram,
        unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM w WHERE len(w) >= 8),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM
        (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(l)::BIGINT AS n_lines,
        len(list_filter(w, lambda x: list_contains({STOP_WORDS!r}, lower(x))))::BIGINT AS n_stop
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop, base_failed,
  NOT base_failed AND n_words > 0 AND word_chars / n_words >= 2.5 AND word_chars / n_words <= 12.0
  AND (word_chars = 0 OR n_symbols / word_chars <= 0.1) AND n_stop / n_words >= 0.06
  AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AS kept
FROM b
"""
