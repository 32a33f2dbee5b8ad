"""Registry of named queries, and the stand-ins for evaluation data that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.rng import letter
from tallyloom.operators.spine import last_wins
from tallyloom.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CONDITIONS = ["click", "error", "purchase", "signup", "view"]
STATUSES = ["ok", "input_error", "pending_transport", "extraction_truncated", "extraction_invalid", "answer_truncated", "answer_parse_error"]


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as records: item, condition, category, gold, prediction, status, latency and tokens."""
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(F.col("value") < 4, "extraction_invalid").when(F.col("value") > 150, "answer_truncated").otherwise("ok")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("id"), F.col("event_type").alias("condition"), F.concat(F.lit("cat"), F.col("user_id") % 7).alias("category"),
        letter("gold", F.col("user_id")).alias("gold"), letter("pred", F.col("event_id"), options=5).alias("pred"), status.alias("status"),
        F.col("value").alias("latency"), F.when(k % 7 != 0, k).alias("tokens"), k.alias("k"),
    )


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each item and condition."""
    return last_wins(events(spark, sf_dir), ["id", "condition"], "event_id")


def U(text: str) -> str:
    """SQL of the hash number of a text."""
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def L(text: str, options: int = 4) -> str:
    return f"CASE WHEN {U(text)} % {options} < 4 THEN substr('ABCD', ({U(text)} % {options} + 1)::INT, 1) END"


EV = f"""ev AS (SELECT event_id, ts, user_id AS id, event_type AS condition, 'cat' || (user_id % 7)::VARCHAR AS category,
  {L("'gold|' || user_id")} AS gold, {L("'pred|' || event_id", 5)} AS pred,
  CASE WHEN value < 4 THEN 'extraction_invalid' WHEN value > 150 THEN 'answer_truncated' ELSE 'ok' END AS status,
  value AS latency, CASE WHEN (props->>'k')::BIGINT % 7 <> 0 THEN (props->>'k')::BIGINT END AS tokens, (props->>'k')::BIGINT AS k FROM events)"""
J = EV + """,
j AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id, condition ORDER BY event_id DESC) AS rn FROM ev) WHERE rn = 1)"""
OK = "coalesce(status = 'ok' AND pred = gold, false)"
#: The spine: every item with every condition, records where there are any.
S = J + f""",
it AS (SELECT DISTINCT id, category FROM ev),
s AS (SELECT it.id, it.category, c.condition, j.status, j.pred, j.gold, j.latency, j.tokens, {OK} AS correct
  FROM it CROSS JOIN (SELECT unnest({CONDITIONS!r}) AS condition) c LEFT JOIN j ON j.id = it.id AND j.condition = c.condition AND j.latency > 20)"""
