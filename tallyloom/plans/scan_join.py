"""Scans, projections, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.functions.rng import letter
from tallyloom.operators import state
from tallyloom.operators.scoring import is_correct
from tallyloom.operators.similarity import threshold_pairs
from tallyloom.operators.spine import completed, spine, strict_sum
from tallyloom.plans.registry import CONDITIONS, EV, J, L, S, STATUSES, events, judgments, query, r6
from tallyloom.sources import readers, sinks
from tallyloom.sources.readers import table

PREFIX = ["en", "fr", "de", "es"]
_LANG = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}


def joined_grid(spark, sf):
    """Every item with every condition and the record it has, if that took over 20 seconds."""
    items = events(spark, sf).select("id", "category").distinct()
    grid = spine(items, spark.createDataFrame([(c,) for c in CONDITIONS], "condition string"))
    got = judgments(spark, sf).where("latency > 20").drop("category")
    return grid.join(got, ["id", "condition"], "left").withColumn("correct", is_correct())


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 2000 AND lang = 'en'")
def pruned_scan(spark, sf):
    return readers.pruned(table(spark, sf, "documents"), ["doc_id", "lang", "absent", "n_chars"]).where("n_chars > 2000 AND lang = 'en'")


@query("SELECT doc_id, text FROM documents")
def whitelist_scan(spark, sf):
    return readers.whitelisted(table(spark, sf, "documents"), ["doc_id", "text"])


@query("SELECT vec_id, label FROM embeddings WHERE vec_id = 170")
def point_read(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id = 170").select("vec_id", "label")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' END AS language FROM documents")
def enum_translate(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in _LANG.items() for x in kv])
    out = table(spark, sf, "documents").select("doc_id", names[F.col("lang")].alias("language"), "lang")
    return out.select("doc_id", F.when(F.col("language").isNull() & F.col("lang").isNotNull(), F.raise_error(F.concat(F.lit("unmapped value: "), "lang"))).otherwise(F.col("language")).alias("language"))


@query(r"""SELECT a.doc_id, trim(regexp_replace(a.text, '[ \t\n\r]+', ' ', 'g')) = trim(regexp_replace(b.text, '[ \t\n\r]+', ' ', 'g')) AS same_text
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def ws_normalised_equality(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")).alias("t"))
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u")), "doc_id").select("doc_id", (F.col("t") == F.col("u")).alias("same_text"))


@query(r"SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS safe_id FROM pages")
def slug(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.slug(F.col("url")).alias("safe_id"))


@query(f"WITH {EV} SELECT event_id, k, tokens FROM ev")
def json_props_extract(spark, sf):
    return events(spark, sf).select("event_id", "k", "tokens")


@query(f"WITH {EV} SELECT id, condition, event_id, pred FROM (SELECT *, row_number() OVER (PARTITION BY id, condition ORDER BY event_id DESC) AS rn FROM ev WHERE status = 'ok') WHERE rn = 1")
def usable_outputs_last_wins(spark, sf):
    from tallyloom.operators.spine import last_wins

    return last_wins(events(spark, sf).where("status = 'ok'").select("id", "condition", "event_id", "pred"), ["id", "condition"], "event_id")


@query("SELECT doc_id, text, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}' AS canonical FROM documents")
def canonical_json(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", sinks.canonical_json(["n_chars", "doc_id", "lang"]).alias("canonical"))


@query("SELECT doc_id::VARCHAR AS doc_id, CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END AS toxic FROM labels")
def csv_cells(spark, sf):
    return sinks.csv_cells(table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic")))


@query("""SELECT doc_id, sha256(text) AS digest, sha256('[' || doc_id || ', ' || n_chars || ']') AS list_digest FROM documents""")
def content_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.sha2(F.concat(F.lit("["), F.concat_ws(", ", "doc_id", "n_chars"), F.lit("]")), 256).alias("list_digest"))


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def left_join_labels_gap(spark, sf):
    labels = table(spark, sf, "labels").withColumn("labelled", F.lit(True))
    return table(spark, sf, "documents").select("doc_id", "lang").join(labels, "doc_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_unscheduled(spark, sf):
    return state.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT doc_id FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE lang = 'en')")
def semi_join_novel_template(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("t"))
    return d.join(d.where("lang = 'en'").select("t"), "t", "left_semi").select("doc_id")


@query(f"""WITH {S}, st AS (SELECT unnest({STATUSES + ["missing"]!r}) AS status),
c AS (SELECT condition, coalesce(status, 'missing') AS status, count(*) AS n FROM s GROUP BY 1, 2)
SELECT k.condition, st.status, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT unnest({CONDITIONS!r}) AS condition) k CROSS JOIN st LEFT JOIN c ON c.condition = k.condition AND c.status = st.status""")
def spine_status_counts(spark, sf):
    counts = joined_grid(spark, sf).groupBy("condition", F.coalesce("status", F.lit("missing")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    grid = spine(spark.createDataFrame([(c,) for c in CONDITIONS], "condition string"), spark.createDataFrame([(s,) for s in [*STATUSES, "missing"]], "status string"))
    return completed(grid, counts, ["condition", "status"], {"n": 0})


@query(f"""WITH {S}, x AS (SELECT id, max(CASE WHEN condition = 'click' THEN correct::INT END) AS a, max(CASE WHEN condition = 'view' THEN correct::INT END) AS b FROM s GROUP BY id)
SELECT 'view-click' AS comparison, count(*) FILTER (WHERE a = 0 AND b = 1) AS corrected, count(*) FILTER (WHERE a = 1 AND b = 0) AS introduced FROM x""")
def self_join_corrected_introduced(spark, sf):
    g = joined_grid(spark, sf)
    x = g.groupBy("id").agg(F.max(F.when(F.col("condition") == "click", F.col("correct"))).alias("a"), F.max(F.when(F.col("condition") == "view", F.col("correct"))).alias("b"))
    return x.agg(F.count_if(~F.col("a") & F.col("b")).alias("corrected"), F.count_if(F.col("a") & ~F.col("b")).alias("introduced")).select(F.lit("view-click").alias("comparison"), "corrected", "introduced")


@query(f"""WITH {J}, m AS (SELECT id, condition, unnest([{{'kind': 'extract', 'key': md5('x|' || id)}}, {{'kind': 'answer', 'key': md5(event_id::VARCHAR)}}]) AS c FROM j),
c AS (SELECT md5(event_id::VARCHAR) AS key, latency, tokens FROM ev UNION ALL SELECT md5('x|' || id) AS key, min(latency), min(tokens) FROM ev GROUP BY id)
SELECT m.condition, m.c.kind AS kind, count(*) AS calls, round(sum(c.latency), 6) AS latency FROM m JOIN c ON c.key = m.c.key GROUP BY 1, 2""")
def map_explode_cost_join(spark, sf):
    calls = judgments(spark, sf).withColumn("call_keys", F.create_map(F.lit("extract"), F.md5(F.concat(F.lit("x|"), "id")), F.lit("answer"), F.md5(F.col("event_id").cast("string"))))
    calls = calls.select("id", "condition", F.explode("call_keys").alias("kind", "key"))
    ev = events(spark, sf)
    cache = ev.select(F.md5(F.col("event_id").cast("string")).alias("key"), "latency").unionByName(ev.groupBy(F.md5(F.concat(F.lit("x|"), "id")).alias("key")).agg(F.min("latency").alias("latency")))
    return calls.join(cache, "key").groupBy("condition", "kind").agg(F.count(F.lit(1)).alias("calls"), r6(F.sum("latency")).alias("latency"))


SIM = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({SIM}, 6) AS cosine, a.label = b.label AS same_label FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {SIM} >= 0.4")
def theta_similarity_pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    pairs = threshold_pairs(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 0.4)
    la, lb = e.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), e.select(F.col("vec_id").alias("b"), F.col("label").alias("lb"))
    return pairs.join(la, "a").join(lb, "b").select("a", "b", r6("sim").alias("cosine"), (F.col("la") == F.col("lb")).alias("same_label"))


VOCAB = [("the thing", "tool"), ("ening", "furniture"), ("ourea", "animal"), ("bleness", "vehicle"), ("the", "word"), ("and", "word")]
_M = r"(SELECT conv_id, turn, coalesce(nullif(regexp_extract(lower(text), '^([a-z]+ [a-z]+)', 1), ''), '') AS phrase, coalesce(nullif(regexp_extract(lower(text), '^([a-z]+)', 1), ''), '') AS head, coalesce(nullif(regexp_extract(lower(text), '([a-z]+)[^a-z]*$', 1), ''), '') AS last FROM conversations)"


@query(f"""WITH v(name, kind) AS (VALUES {", ".join(map(str, VOCAB))}), m AS {_M}
SELECT conv_id, turn, EXISTS (SELECT 1 FROM v WHERE name IN (m.phrase, m.head, m.last)) AS in_vocabulary FROM m""")
def vocab_three_way_match(spark, sf):
    low = F.lower("text")
    m = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(F.array(F.regexp_extract(low, "^([a-z]+ [a-z]+)", 1), F.regexp_extract(low, "^([a-z]+)", 1), F.regexp_extract(low, r"([a-z]+)[^a-z]*\z", 1)))).alias("name"))
    v = spark.createDataFrame(VOCAB, "name string, kind string")
    return m.join(F.broadcast(v), "name", "left").groupBy("conv_id", "turn").agg(F.max(F.col("kind").isNotNull()).alias("in_vocabulary"))


@query(f"""WITH rv AS (SELECT doc_id, {L("'r1|' || doc_id")} AS a, {L("'r2|' || doc_id")} AS b, {L("'gold|' || doc_id")} AS gold, {L("'model|' || doc_id", 5)} AS model FROM documents)
SELECT d.doc_id, d.lang, rv.gold, (rv.a = rv.gold)::INT + (rv.b = rv.gold)::INT AS human_correct_n, rv.a = rv.b AS agree, coalesce(rv.model = rv.gold, false) AS model_correct, l.quality
FROM documents d JOIN rv ON rv.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def star_report(spark, sf):
    d = table(spark, sf, "documents")
    answers = d.select("doc_id", F.explode(F.array(F.struct(F.lit("r1").alias("reviewer"), letter("r1", F.col("doc_id")).alias("answer")), F.struct(F.lit("r2").alias("reviewer"), letter("r2", F.col("doc_id")).alias("answer")))).alias("x")).select("doc_id", "x.*")
    keys = d.select("doc_id", letter("gold", F.col("doc_id")).alias("gold"))
    people = answers.join(keys, "doc_id").groupBy("doc_id", "gold").agg(F.count_if(F.col("answer") == F.col("gold")).cast("int").alias("human_correct_n"), ((F.count(F.lit(1)) == 2) & (F.min("answer") == F.max("answer"))).alias("agree"))
    model = d.select("doc_id", letter("model", F.col("doc_id"), options=5).alias("m"))
    out = d.select("doc_id", "lang").join(people, "doc_id").join(model, "doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return out.select("doc_id", "lang", "gold", "human_correct_n", "agree", F.coalesce(F.col("m") == F.col("gold"), F.lit(False)).alias("model_correct"), "quality")


@query(f"""WITH {J}, raw AS (SELECT id, condition, pred FROM j WHERE condition = 'click'), other AS (SELECT id, condition, {L("'other|' || id")} AS pred FROM j WHERE condition = 'click')
SELECT id, condition, pred FROM j WHERE condition <> 'click' UNION ALL SELECT o.id, o.condition, o.pred FROM other o JOIN raw r ON r.id = o.id""")
def replace_side_union(spark, sf):
    j = judgments(spark, sf).select("id", "condition", "pred")
    other = j.where("condition = 'click'").select("id", "condition", letter("other", F.col("id")).alias("pred"))
    kept = other.join(j.where("condition = 'click'").select("id"), "id", "left_semi")
    return j.where("condition <> 'click'").unionByName(kept.select("id", "condition", "pred"))


@query("""SELECT doc_id, 'only_documents' AS side FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'only_labels' AS side FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)""")
def except_both_ways(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return d.exceptAll(l).withColumn("side", F.lit("only_documents")).unionByName(l.exceptAll(d).withColumn("side", F.lit("only_labels")))


@query("SELECT count(*) AS shared FROM (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT DISTINCT doc_id FROM labels WHERE quality = 1)")
def split_overlap(spark, sf):
    a, b = table(spark, sf, "documents").where("lang = 'en'").select("doc_id"), table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return a.intersect(b).agg(F.count(F.lit(1)).alias("shared"))


@query(f"WITH {J} SELECT id, category, count(*) AS n, CASE WHEN count(*) = count(tokens) THEN sum(tokens)::BIGINT END AS tokens FROM j GROUP BY 1, 2")
def strict_token_sum(spark, sf):
    return judgments(spark, sf).groupBy("id", "category").agg(F.count(F.lit(1)).alias("n"), strict_sum("tokens").alias("tokens"))


@query("""SELECT q.conv_id, q.turn, length(q.text) AS question_chars, length(a.text) AS trace_chars FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'""")
def question_trace_join(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("trace_chars"))
    return c.where("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("question_chars")).join(a, ["conv_id", "turn"])


@query("""WITH o AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE p IS NOT NULL AND turn <> p + 1) AS gaps FROM o GROUP BY conv_id""")
def turn_gaps(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    o = table(spark, sf, "conversations").withColumn("p", F.lag("turn").over(w))
    return o.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("turn") != F.col("p") + 1).alias("gaps"))
