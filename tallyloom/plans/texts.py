"""Text functions, votes, rotations and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import options as op, text as tx
from tallyloom.functions.rng import letter, u32
from tallyloom.operators import scoring
from tallyloom.plans.registry import EV, L, U, events, query, r6
from tallyloom.sources.readers import table

_T = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+(?:''[a-z]+)?')"


_ROT = f"""WITH d AS (SELECT doc_id AS id, {L("'gold|' || doc_id")} AS gold FROM documents), r AS (SELECT id, gold, unnest([0,1,2,3]) AS s FROM d), q AS (SELECT * FROM r WHERE ('0x' || substr(md5('lost|' || id || '|' || s), 1, 8))::BIGINT % 19 > 0),
x AS (SELECT id, gold, s, list_transform([0,1,2,3], lambda i: ('0x' || substr(md5('logit|' || id || '|' || s || '|' || i), 1, 8))::BIGINT % 1000 / 100.0) AS lg FROM q),
y AS (SELECT id, gold, s, list_transform([0,1,2,3], lambda j: lg[(j - s + 4) % 4 + 1]) AS o FROM x),
z AS (SELECT id, gold, s, list_position(o, list_max(o)) AS k, o FROM y)"""


@query(f"""{_ROT} SELECT id, round(avg((substr('ABCD', k, 1) = gold)::INT), 6) AS rotation_accuracy, count(DISTINCT k) = 1 AS consistent, bool_and(substr('ABCD', k, 1) = gold) AS all_correct,
substr('ABCD', list_position([round(avg(o[1]), 9), round(avg(o[2]), 9), round(avg(o[3]), 9), round(avg(o[4]), 9)], list_max([round(avg(o[1]), 9), round(avg(o[2]), 9), round(avg(o[3]), 9), round(avg(o[4]), 9)])), 1) = min(gold) AS consensus_correct FROM z GROUP BY id HAVING count(DISTINCT s) = 4""")
def circular_consensus(spark, sf):
    """Questions of which all four rotations have an answer."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), letter("gold", F.col("doc_id")).alias("gold"))
    r = d.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(3)))).where(u32("lost", F.col("id"), F.col("s")) % 19 > 0)
    logits = F.array(*[(u32("logit", F.col("id"), F.col("s"), i) % 1000) / 100.0 for i in range(4)])
    z = r.withColumn("o", op.unrotated(logits, F.col("s"))).withColumn("k", op.argmax(F.col("o")))
    hit = F.substring(F.lit("ABCD"), F.col("k") + 1, F.lit(1)) == F.col("gold")
    mean = F.array(*[F.round(F.avg(F.get("o", F.lit(j))), 9) for j in range(4)])
    a = z.groupBy("id").agg(r6(F.avg(hit.cast("int"))).alias("rotation_accuracy"), (F.countDistinct("k") == 1).alias("consistent"), F.every(hit).alias("all_correct"), mean.alias("m"), F.min("gold").alias("gold"), F.countDistinct("s").alias("shifts")).where("shifts = 4")
    return a.select("id", "rotation_accuracy", "consistent", "all_correct", (F.substring(F.lit("ABCD"), op.argmax(F.col("m")) + 1, F.lit(1)) == F.col("gold")).alias("consensus_correct"))


_VAR = f"""v AS (SELECT id, gold, variant, {L("variant || '|' || id", 5)} AS pred, pos FROM (SELECT user_id AS id, {L("'gold|' || user_id")} AS gold, unnest(['orig','mirror','reorder','shuffle']) AS variant, unnest([0,1,2,3]) AS pos FROM (SELECT DISTINCT user_id FROM events)))"""


def variants(spark, sf):
    ids = table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    v = ids.select("id", letter("gold", F.col("id")).alias("gold"), F.posexplode(F.array(*map(F.lit, ["orig", "mirror", "reorder", "shuffle"]))).alias("position", "variant"))
    return v.withColumn("pred", letter(F.col("variant"), F.col("id"), options=5))


@query(f"WITH {_VAR} SELECT v.variant, count(*) AS n, round(avg((v.pred IS DISTINCT FROM o.pred)::INT), 6) AS flip_rate FROM v JOIN v o ON o.id = v.id AND o.variant = 'orig' WHERE v.variant <> 'orig' GROUP BY 1")
def flip_rates(spark, sf):
    return scoring.flips(variants(spark, sf)).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("flipped").cast("int"))).alias("flip_rate"))


@query(f"""WITH {_VAR}, c AS (SELECT id, count(*) AS n_variants, count(DISTINCT coalesce(pred, '<none>')) = 1 AS consistent, max(CASE WHEN variant = 'orig' THEN coalesce(pred, '<none>') END) AS b FROM v GROUP BY id)
SELECT c.id, n_variants, consistent, round(count(*) FILTER (WHERE coalesce(v.pred, '<none>') <> b) / greatest(1, n_variants - 1), 6) AS disagreement FROM c JOIN v ON v.id = c.id GROUP BY 1, 2, 3""")
def consistency_rate(spark, sf):
    return scoring.consistency(variants(spark, sf)).withColumn("disagreement", r6("disagreement"))


@query(f"""WITH {_VAR}, n AS (SELECT id, pred, count(*) AS n, min(pos) AS at FROM v WHERE pred IS NOT NULL GROUP BY 1, 2), t AS (SELECT id, max(CASE WHEN variant = 'orig' THEN pred END) AS tie FROM v GROUP BY id)
SELECT t.id, coalesce(arg_max(n.pred, (n.n, (n.pred IS NOT DISTINCT FROM t.tie)::INT, -n.at)), t.tie) AS vote FROM t LEFT JOIN n ON n.id = t.id GROUP BY t.id, t.tie""")
def vote_with_tiebreak(spark, sf):
    v = variants(spark, sf)
    tie = v.where("variant = 'orig'").select("id", F.col("pred").alias("tie"))
    return scoring.plurality(v.join(tie, "id"), ["id"], tiebreak="tie")


@query(f"WITH d AS (SELECT doc_id, [({U("'p1|' || doc_id")} % 4), ({U("'p2|' || doc_id")} % 6), 3, 0] AS perm, {L("'pred|' || doc_id", 5)} AS pred FROM documents) SELECT doc_id, CASE WHEN perm[position(pred IN 'ABCD')] < 4 THEN substr('ABCD', perm[position(pred IN 'ABCD')]::INT + 1, 1) END AS mapped FROM d")
def permutation_map_back(spark, sf):
    d = table(spark, sf, "documents")
    perm = F.array(u32("p1", F.col("doc_id")) % 4, u32("p2", F.col("doc_id")) % 6, F.lit(3).cast("long"), F.lit(0).cast("long"))
    return d.select("doc_id", op.mapped_back(letter("pred", F.col("doc_id"), options=5), perm).alias("mapped"))


@query(rf"""WITH t AS (SELECT doc_id, {_T('text')} AS w FROM documents) SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, CASE WHEN len(w) > 1 THEN w[1] || '_' || w[2] END AS first_pair, len(w) + greatest(len(w) - 1, 0) AS n_grams FROM t""")
def ngrams_uni_bi(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", tx.tokens(F.col("text")).alias("w")).withColumn("g", tx.grams(F.col("w")))
    return t.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.get("g", F.size("w")).alias("first_pair"), F.size("g").cast("long").alias("n_grams"))


_QT = "(SELECT q.conv_id, q.turn, {0} AS q, {1} AS a FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')".format(_T("q.text"), _T("a.text"))


def turns(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), tx.tokens(F.col("text")).alias("a"), F.col("text").alias("trace"))
    return c.where("role = 'user'").select("conv_id", "turn", tx.tokens(F.col("text")).alias("q"), F.col("text").alias("question")).join(a, ["conv_id", "turn"])


@query(f"SELECT conv_id, turn, len(list_distinct(list_filter(a, lambda x: NOT list_contains(q, x)))) AS n_bridging FROM {_QT}")
def set_difference_bridging(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.size(F.array_except("a", "q")).cast("long").alias("n_bridging"))


@query(f"SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(a, q))) = 0 THEN 0 ELSE len(list_distinct(list_intersect(a, q))) / len(list_distinct(list_concat(a, q))) END, 6) AS jaccard FROM {_QT}")
def jaccard_overlap(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", r6(tx.jaccard(F.array_distinct("a"), F.array_distinct("q"))).alias("jaccard"))


_ADDED = "list_filter({words!r}, lambda w: regexp_matches({x}, '(?i)\\b' || w || '\\b'))"


@query(f"SELECT conv_id, turn, len(list_filter({_ADDED.format(words=tx.COMPARATIVES, x='trace')}, lambda w: NOT regexp_matches(question, '(?i)\\b' || w || '\\b'))) AS n_added FROM (SELECT q.conv_id, q.turn, q.text AS question, a.text || ' ' || {U("'cmp|' || q.conv_id")} % 9 || ' ' || {tx.COMPARATIVES!r}[({U("'cmp|' || q.conv_id")} % 14 + 1)::INT] AS trace FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')")
def comparatives_added(spark, sf):
    """Comparatives of an answer, to which a drawn one is added, that its question has not."""
    k = u32("cmp", F.col("conv_id"))
    trace = F.concat_ws(" ", "trace", (k % 9).cast("string"), F.element_at(F.array(*map(F.lit, tx.COMPARATIVES)), (k % 14 + 1).cast("int")))
    return turns(spark, sf).select("conv_id", "turn", F.size(F.array_except(tx.comparatives(trace), tx.comparatives(F.col("question")))).cast("long").alias("n_added"))


@query("SELECT doc_id, length(text) AS chars, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n_words, regexp_replace(lower(text), '^(the|a|an|this|that) ', '') AS head FROM documents")
def text_measures(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")).cast("long").alias("n_words"), tx.strip_article(F.col("text")).alias("head"))


@query(f"WITH {EV} SELECT id, condition, substr('ABCD', (('0x' || substr(sha256('mock|' || id || '|' || condition), 1, 2))::INT % 4) + 1, 1) AS mock_answer FROM (SELECT DISTINCT id, condition FROM ev)")
def mock_model(spark, sf):
    """A letter from a SHA-256 of the request, modulo 4."""
    k = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit("mock"), F.col("id"), "condition"), 256), 1, 2), 16, 10).cast("int") % 4
    return events(spark, sf).select("id", "condition").distinct().withColumn("mock_answer", F.substring(F.lit("ABCD"), k + 1, F.lit(1)))
