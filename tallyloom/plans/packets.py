"""Review packets, exports, prompts, groups of shared content and guards, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import options as op, text as tx
from tallyloom.functions.rng import letter, u32
from tallyloom.operators import graph, review
from tallyloom.plans.graphs import _CC, _links
from tallyloom.plans.questions import _MENT, _P, _Q, CELLS, MENTIONS, _drawn, _pick, asked, good
from tallyloom.plans.registry import CONDITIONS, EV, J, L, U, events, judgments, query, r6
from tallyloom.plans.texts import variants
from tallyloom.operators.ranks import global_rank
from tallyloom.sources.readers import table


@query(f"""WITH {_Q}, v AS (SELECT *, unnest(['mirror', 'reorder']) AS variant FROM q),
o AS (SELECT id, variant, gold, question, CASE WHEN variant = 'mirror' THEN range(1, n_images + 1) WHEN {U("'saved|' || id")} % 2 = 0 THEN list_append(range(2, n_images + 1), 1) ELSE list_reverse(range(1, n_images + 1)) END AS ord FROM v)
SELECT id, variant, gold, md5(question) AS question_md5, unnest(ord)::INT AS image, generate_subscripts(ord, 1)::INT AS shown FROM o""")
def review_packet(spark, sf):
    """Images of the mirrored and reordered questions, in saved order or else reversed, beside the dataset's question."""
    a = asked(spark, sf)
    saved = F.when((F.col("variant") == "reorder") & (u32("saved", F.col("id")) % 2 == 0), F.concat(F.sequence(F.lit(2), F.col("n_images")), F.array(F.lit(1))))
    records = a.select("id", "n_images", F.explode(F.array(F.lit("mirror"), F.lit("reorder"))).alias("variant")).select("id", "variant", saved.alias("image_order"))
    return review.review_packet(records, a).select("id", "variant", "gold", F.md5("question").alias("question_md5"), "image", "shown")


@query(f"""WITH c AS (SELECT lower(trim(coalesce({_pick(CELLS, 'cell')}, ''))) AS c FROM documents), a AS (SELECT count(*) FILTER (WHERE c <> '') AS reviewed, count(*) AS total, count(*) FILTER (WHERE c IN ('y', 'yes', 'true', '1')) AS passed FROM c)
SELECT *, round(CASE WHEN reviewed > 0 THEN 100.0::DOUBLE * passed / reviewed END, 6) AS pass_rate FROM a""")
def review_completion(spark, sf):
    return review.review_completion(table(spark, sf, "documents").select(_drawn(CELLS, "cell").alias("c")), "c").withColumn("pass_rate", r6("pass_rate"))


#: The wording of a prompt.
ASK = "Select the best answer. Respond with exactly one capital letter: A, B, C, or D."
HIDDEN = "The question and images are intentionally hidden. Use only the answer choices."


def prompt(stem, opts, options_only: bool = False):
    """The text sent for a question with its options in the order shown, or for its options alone."""
    head = [F.lit(ASK), F.lit(HIDDEN)] if options_only else [F.lit(ASK), F.lit("Question:"), stem]
    lines = [F.concat(F.lit(f"{c}. "), F.get(opts, F.lit(i))) for i, c in enumerate("ABCD")]
    return F.concat_ws("\n", *head, F.lit("Options:"), *lines, F.lit("Answer:"))


_LINES = "'Options:' || chr(10) || 'A. ' || opts[s % 4 + 1] || chr(10) || 'B. ' || opts[(s + 1) % 4 + 1] || chr(10) || 'C. ' || opts[(s + 2) % 4 + 1] || chr(10) || 'D. ' || opts[(s + 3) % 4 + 1] || chr(10) || 'Answer:'"


@query(f"""WITH {_P}, t AS (SELECT id, gold, stem, opts, unnest(['original', 'options_only', 'circular', 'circular', 'circular']) AS condition, unnest([0, 0, 1, 2, 3]) AS s FROM g)
SELECT id, gold AS gold_original, condition, s AS shift, '{ASK}' || chr(10) || CASE WHEN condition = 'options_only' THEN '{HIDDEN}' ELSE 'Question:' || chr(10) || stem END || chr(10) || {_LINES} AS prompt FROM t""")
def blind_prompts(spark, sf):
    """Five prompts a question: as it is, its options alone, and three rotations; the first doubles as shift 0."""
    g = good(spark, sf).select("id", F.col("gold").alias("gold_original"), "stem", "opts", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    shift = F.greatest(F.col("k") - 1, F.lit(0))
    hidden = F.col("k") == 1
    shown = op.rotated(F.col("opts"), shift)
    condition = F.when(F.col("k") == 0, "original").when(hidden, "options_only").otherwise("circular")
    return g.select("id", "gold_original", condition.alias("condition"), shift.alias("shift"), F.when(hidden, prompt(F.col("stem"), shown, True)).otherwise(prompt(F.col("stem"), shown)).alias("prompt"))


@query(f"""WITH x AS (SELECT DISTINCT user_id AS id FROM events), v AS (SELECT id, unnest(['orig','mirror','reorder','shuffle']) AS variant FROM x), k AS (SELECT id, count(*) AS k FROM v WHERE variant = 'orig' OR {U("'made|' || variant || '|' || id")} % 3 > 0 GROUP BY 1)
SELECT k, count(*) AS n_questions, sum(k)::BIGINT AS n_calls FROM k GROUP BY 1""")
def self_consistency_calls(spark, sf):
    """Questions by how often they are sampled: as often as they have variants."""
    v = variants(spark, sf).where((F.col("variant") == "orig") | (u32("made", F.col("variant"), F.col("id")) % 3 > 0))
    k = v.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    return k.groupBy("k").agg(F.count(F.lit(1)).alias("n_questions"), F.sum("k").alias("n_calls"))


_RANK = "list_position(" + repr(CONDITIONS) + ", condition)"


@query(f"""WITH {J}, p AS (SELECT *, sha256(id || '|' || condition) AS request_key FROM j)
SELECT id, condition, {_RANK}::INT AS condition_rank, category, pred, status, request_key, CASE WHEN ('0x' || substr(request_key, 1, 4))::BIGINT % 3 > 0 THEN 'mock-' || substr(request_key, 1, 2) END AS served_model, tokens AS input_tokens, round(latency, 6) AS latency_seconds FROM p""")
def prediction_export(spark, sf):
    """Judgments with the model that served them, from the cache where it has the request, by item and condition."""
    key = F.sha2(F.concat_ws("|", "id", "condition"), 256)
    j = judgments(spark, sf).withColumn("request_key", key)
    seen = events(spark, sf).select("id", "condition").distinct().select(key.alias("request_key"))
    cache = seen.where(F.conv(F.substring("request_key", 1, 4), 16, 10).cast("long") % 3 > 0).withColumn("served_model", F.concat(F.lit("mock-"), F.substring("request_key", 1, 2)))
    rank = F.array_position(F.array(*map(F.lit, CONDITIONS)), F.col("condition")).cast("int")
    out = j.join(cache, "request_key", "left").withColumn("condition_rank", rank)
    return out.orderBy("id", "condition_rank").select("id", "condition", "condition_rank", "category", "pred", "status", "request_key", "served_model", F.col("tokens").alias("input_tokens"), r6("latency").alias("latency_seconds"))


@query("""WITH l AS (SELECT doc_id, count(*) AS l FROM documents GROUP BY 1), r AS (SELECT doc_id, count(*) AS r FROM labels GROUP BY 1), a AS (SELECT coalesce(sum(l), 0)::BIGINT AS n_left, coalesce(sum(r), 0)::BIGINT AS n_right, count(*) FILTER (WHERE r IS NULL) AS only_left, count(*) FILTER (WHERE l IS NULL) AS only_right, count(*) FILTER (WHERE l > 1 OR r > 1) AS repeated FROM l FULL JOIN r USING (doc_id))
SELECT *, only_left = 0 AND only_right = 0 AND repeated = 0 AS aligned FROM a""")
def key_alignment(spark, sf):
    """Whether documents and labels could be joined row by row: never by position, but by a key that both have once."""
    return review.key_alignment(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")


_FLAG = f"CASE {U("'cell|' || event_id")} % 10 WHEN 0 THEN 'maybe' WHEN 1 THEN ' TRUE' WHEN 2 THEN '0' ELSE CASE WHEN e THEN '1' ELSE 'False' END END"


@query(f"""WITH {EV}, x AS (SELECT event_id, condition, coalesce(status = 'ok' AND pred = gold, false) AS e FROM ev), f AS (SELECT *, lower(trim({_FLAG})) AS f FROM x), v AS (SELECT condition, e, CASE WHEN f IN ('1', 'true') THEN true WHEN f IN ('0', 'false') THEN false END AS v FROM f)
SELECT condition, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS unreadable, count(*) FILTER (WHERE v <> e) AS disagrees FROM v GROUP BY 1""")
def correctness_crosscheck(spark, sf):
    """Exported truth cells held against status, prediction and gold."""
    e = F.coalesce((F.col("status") == "ok") & (F.col("pred") == F.col("gold")), F.lit(False))
    k = u32("cell", F.col("event_id")) % 10
    cell = F.when(k == 0, "maybe").when(k == 1, " TRUE").when(k == 2, "0").when(e, "1").otherwise("False")
    problem = events(spark, sf).select("condition", review.flag_problem(cell, e).alias("p"))
    return problem.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") == "unreadable").alias("unreadable"), F.count_if(F.col("p") == "disagrees").alias("disagrees"))


@query("""WITH RECURSIVE h AS (SELECT DISTINCT doc_id AS id, unnest([md5(text), 'pic|' || (doc_id // 2)]) AS h FROM documents), hh AS (SELECT * FROM h WHERE h IS NOT NULL), m AS (SELECT h, min(id) AS u FROM hh GROUP BY 1),
e AS (SELECT u, id AS v FROM m JOIN hh USING (h) WHERE u <> id UNION SELECT id, u FROM m JOIN hh USING (h) WHERE u <> id), r AS (SELECT id AS node, id AS seen FROM hh UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen)
SELECT node AS id, min(seen) AS "group" FROM r GROUP BY 1""")
def shared_image_groups(spark, sf):
    """Documents read as items with two images each, one of them the text: those that share one, through others too."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array(F.md5("text"), F.concat(F.lit("pic|"), F.floor(F.col("doc_id") / 2).cast("string"))).alias("images"))
    return review.shared_groups(d, "id", "images")


FLAGS = ["spatial", "viewpoint", "comparison"]
_RATES = ", ".join(f"avg(({U(f"'{n}|' || e.vec_id")} % 3 = 0)::INT) AS {n}" for n in FLAGS)
_HITS = " + ".join(f"({n} = top)::INT" for n in FLAGS)


@query(f"""{_CC}, t AS (SELECT c.label AS first_id, count(*) AS n, count(DISTINCT e.label) AS n_categories, string_agg(DISTINCT e.label::VARCHAR, ' | ' ORDER BY e.label::VARCHAR) AS categories, count(*) FILTER (WHERE {U("'half|' || e.vec_id")} % 2 = 0) AS n_explore, {_RATES} FROM c JOIN embeddings e ON e.vec_id = c.node GROUP BY 1),
u AS (SELECT *, greatest({", ".join(FLAGS)}) AS top FROM t)
SELECT row_number() OVER (ORDER BY n DESC, first_id) - 1 AS component_id, first_id, n, n_categories, categories, n_explore, n - n_explore AS n_confirm, {", ".join(f"round({n}, 6) AS {n}" for n in FLAGS)},
CASE WHEN top = 0 THEN 'none' WHEN {_HITS} > 1 THEN 'tie' {" ".join(f"WHEN {n} = top THEN '{n}'" for n in FLAGS)} END AS dominant, round(top, 6) AS purity FROM u""")
def component_group_table(spark, sf):
    """Groups of near vectors, largest first: categories, halves, rates of flags, and the flag that leads."""
    v = F.col("vec_id")
    e = table(spark, sf, "embeddings").select(v.alias("node"), F.col("label").cast("string").alias("category"), (u32("half", v) % 2 == 0).alias("explore"), *[(u32(n, v) % 3 == 0).cast("int").alias(n) for n in FLAGS])
    t = graph.components(_links(spark, sf)).join(e, "node").groupBy(F.col("label").alias("first_id")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("category").alias("n_categories"), F.array_join(F.sort_array(F.collect_set("category")), " | ").alias("categories"), F.count_if("explore").alias("n_explore"), *[F.avg(n).alias(n) for n in FLAGS]
    )
    name, top = review.dominant({n: F.col(n) for n in FLAGS})
    t = t.withColumn("dominant", name).withColumn("purity", r6(top)).withColumn("n_confirm", F.col("n") - F.col("n_explore")).withColumn("__down", -F.col("n"))
    out = global_rank(t, ["__down", "first_id"], "__r")
    return out.select((F.col("__r") - 1).alias("component_id"), "first_id", "n", "n_categories", "categories", "n_explore", "n_confirm", *[r6(n).alias(n) for n in FLAGS], "dominant", "purity")


_HEADS = "list_distinct(list_transform({0}, lambda x: split_part(x, '/', 1)))"


@query(f"""WITH t AS (SELECT doc_id, {_pick(MENTIONS, 'ment')} AS m1, {_pick(MENTIONS, 'auto')} AS m2 FROM documents), a AS (SELECT doc_id, {_MENT} AS x FROM (SELECT doc_id, m1 AS m FROM t)), b AS (SELECT doc_id, {_MENT} AS y FROM (SELECT doc_id, m2 AS m FROM t)),
h AS (SELECT a.doc_id, {_HEADS.format('x')} AS x, {_HEADS.format('y')} AS y FROM a JOIN b ON b.doc_id = a.doc_id) SELECT doc_id, len(x) AS human_heads, len(y) AS auto_heads, len(list_intersect(x, y)) AS overlap FROM h""")
def audit_set_overlap(spark, sf):
    """Heads that a person named, those the tagger found, and those both have."""
    heads = lambda c: F.array_distinct(F.transform(tx.mentions(F.col(c)), lambda x: F.split_part(x, F.lit("/"), F.lit(1))))
    d = table(spark, sf, "documents").select("doc_id", _drawn(MENTIONS, "ment").alias("a"), _drawn(MENTIONS, "auto").alias("b")).select("doc_id", heads("a").alias("a"), heads("b").alias("b"))
    n = lambda c: F.size(c).cast("long")
    return d.select("doc_id", n("a").alias("human_heads"), n("b").alias("auto_heads"), n(F.array_intersect("a", "b")).alias("overlap"))


@query(f"""WITH {EV}, a AS (SELECT category, condition, count(DISTINCT id) AS n_items, sum(latency) AS sequential, max(epoch(ts)) - min(epoch(ts)) AS wall, count(*) FILTER (WHERE status = 'extraction_invalid') AS failures FROM ev GROUP BY 1, 2),
b AS (SELECT category, condition, n_items, failures, sequential, wall / 100 AS wall FROM a), d AS (SELECT *, CASE WHEN failures > 0 THEN 'failures' WHEN coalesce(sequential <= 0 OR wall <= 0, true) THEN 'undefined' WHEN sequential / wall + 1e-9 < 1.15 THEN 'too slow' ELSE 'selected' END AS decision FROM b)
SELECT category, condition, n_items, failures, decision, round(CASE WHEN decision = 'selected' THEN sequential / wall END, 6) AS speedup FROM d""")
def concurrency_decision(spark, sf):
    """Whether concurrent calls pay, per category and condition; wall time is a hundredth of the span of the events."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    a = events(spark, sf).groupBy("category", "condition").agg(F.countDistinct("id").alias("n_items"), F.sum("latency").alias("sequential"), ((F.max(t) - F.min(t)) / 100).alias("wall"), F.count_if(F.col("status") == "extraction_invalid").alias("failures"))
    return review.concurrency_decision(a).select("category", "condition", "n_items", "failures", "decision", r6("speedup").alias("speedup"))


@query("SELECT event_type AS backend, (props->>'k')::BIGINT AS manifest, count(*) AS n, min(event_id) AS event_id, strftime(arg_min(ts, event_id), '%Y-%m-%dT%H:%M:%SZ') AS recorded_at FROM events GROUP BY 1, 2")
def session_history(spark, sf):
    """Sessions told apart by backend and manifest, each as first recorded."""
    e = events(spark, sf).select(F.col("condition").alias("backend"), F.col("k").alias("manifest"), "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("recorded_at"))
    n = e.groupBy("backend", "manifest").agg(F.count(F.lit(1)).alias("n"))
    return review.new_sessions(e, ["backend", "manifest"], "event_id").join(n, ["backend", "manifest"])
