"""Ranks, last-wins, ordered neighbours and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions.rng import order_key
from tallyloom.operators.ranks import global_rank
from tallyloom.plans.registry import EV, events, query, r6
from tallyloom.sources.readers import table


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS rank, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) <= 100 AS in_first100 FROM documents")
def rank_in_category(spark, sf):
    w = Window.partitionBy("lang").orderBy(order_key(7, F.col("doc_id")), "doc_id")
    return table(spark, sf, "documents").select("doc_id", "lang", F.row_number().over(w).cast("long").alias("rank")).withColumn("in_first100", F.col("rank") <= 100)


@query(f"WITH {EV} SELECT event_id, id, row_number() OVER (PARTITION BY id, condition ORDER BY ts, event_id) AS attempt FROM ev")
def attempt_ordinal(spark, sf):
    return events(spark, sf).select("event_id", "id", F.row_number().over(Window.partitionBy("id", "condition").orderBy("ts", "event_id")).cast("long").alias("attempt"))


@query(f"WITH {EV} SELECT id, condition, k % 4 AS shift, max_by(pred, event_id) AS pred, max(event_id) AS event_id FROM (SELECT * REPLACE (coalesce(pred, '-') AS pred) FROM ev) GROUP BY 1, 2, 3")
def dedupe_last(spark, sf):
    e = events(spark, sf).withColumn("pred", F.coalesce("pred", F.lit("-")))
    return e.groupBy("id", "condition", (F.col("k") % 4).alias("shift")).agg(F.max_by("pred", "event_id").alias("pred"), F.max("event_id").alias("event_id"))


@query(f"""WITH {EV} SELECT event_id, last_value(CASE WHEN status = 'ok' THEN event_id END IGNORE NULLS) OVER (PARTITION BY id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_completed,
  min(CASE WHEN status <> 'ok' THEN event_id END) OVER (PARTITION BY id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_pending FROM ev""")
def next_and_previous(spark, sf):
    w = Window.partitionBy("id").orderBy("event_id")
    done, todo = F.when(F.col("status") == "ok", F.col("event_id")), F.when(F.col("status") != "ok", F.col("event_id"))
    return events(spark, sf).select(
        "event_id",
        F.last(done, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("previous_completed"),
        F.min(todo).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next_pending"),
    )


@query(r"""WITH h AS (SELECT lang, regexp_extract(lower(text), '^([a-z]+)', 1) AS head FROM documents), c AS (SELECT lang, head, count(*) AS n FROM h WHERE head <> '' GROUP BY 1, 2)
SELECT lang, head, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, head) AS r FROM c) WHERE r <= 5""")
def topk_heads(spark, sf):
    h = table(spark, sf, "documents").select("lang", F.regexp_extract(F.lower("text"), "^([a-z]+)", 1).alias("head")).where("head <> ''")
    c = h.groupBy("lang", "head").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "head")
    return c.withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")


_SCORE = "CASE WHEN n_chars < 200 THEN -1 WHEN lang = 'en' THEN n_chars % 97 ELSE n_chars % 31 END"


@query(f"SELECT doc_id, score FROM (SELECT doc_id, ({_SCORE})::BIGINT AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def scored_examples_topk(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(_SCORE).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"WITH {EV} SELECT condition, event_id FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY event_id) AS r FROM ev) WHERE r <= 12")
def head_n_per_variant(spark, sf):
    w = Window.partitionBy("condition").orderBy("event_id")
    return events(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 12").select("condition", "event_id")


_IDS = "CASE WHEN doc_id % 3 = 0 THEN 'x' || doc_id ELSE doc_id::VARCHAR END"


@query(f"SELECT natural_id, row_number() OVER (ORDER BY NOT regexp_matches(natural_id, '^[0-9]+$'), TRY_CAST(natural_id AS BIGINT), natural_id) AS position FROM (SELECT {_IDS} AS natural_id FROM documents)")
def natural_id_sort(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), "doc_id")).otherwise(F.col("doc_id").cast("string")).alias("natural_id"))
    # Numbers and texts are ranked apart, each range by range, and the texts begin after the numbers.
    keyed = d.withColumn("text", ~F.col("natural_id").rlike(r"\A[0-9]+\z")).withColumn("num", F.when(~F.col("text"), F.expr("try_cast(natural_id AS bigint)")))
    return global_rank(keyed, ["text", "num", "natural_id"], "position").select("natural_id", "position")


@query("SELECT doc_id, n_chars, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS avg_rank FROM documents")
def average_rank(spark, sf):
    from tallyloom.operators.stats import average_ranks

    return average_ranks(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "avg_rank").select("doc_id", "n_chars", "avg_rank")


@query("SELECT source, lang, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY n DESC, source, lang")
def multi_key_sort(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("n_chars")).alias("mean")).where("n >= 3").orderBy(F.desc("n"), "source", "lang")
