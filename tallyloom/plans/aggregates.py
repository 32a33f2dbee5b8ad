"""Aggregations: accuracy, cross tables, signatures, costs, coverage and priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.functions.rng import letter
from tallyloom.operators import scoring
from tallyloom.operators.spine import completed, spine, strict_sum
from tallyloom.plans.registry import EV, J, L, S, events, judgments, query, r6
from tallyloom.plans.scan_join import joined_grid
from tallyloom.sources.readers import table

LANGS = ["de", "en", "es", "fr"]
TYPES = ["click", "error", "purchase", "signup", "view"]


@query(f"""WITH {S}, c AS (SELECT condition, category, count(*) AS n, sum(correct::INT) AS c FROM s GROUP BY 1, 2)
SELECT condition, sum(n)::BIGINT AS n, sum(c)::BIGINT AS n_correct, round(sum(c) / sum(n), 6) AS micro, round(avg(c / n), 6) AS macro FROM c GROUP BY 1""")
def accuracy_micro_macro(spark, sf):
    return scoring.micro_macro(joined_grid(spark, sf)).withColumn("micro", r6("micro")).withColumn("macro", r6("macro"))


@query(f"""WITH {S} SELECT condition, count(*) AS n, round(avg((correct AND coalesce(tokens, 0) >= 30)::INT), 6) AS strict FROM s GROUP BY 1""")
def strict_accuracy(spark, sf):
    strict = F.col("correct") & (F.coalesce("tokens", F.lit(0)) >= 30)
    return joined_grid(spark, sf).groupBy("condition").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(strict.cast("int"))).alias("strict"))


@query("SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(n_chars), 6) AS mean_chars, median(n_chars)::DOUBLE AS median_chars FROM documents GROUP BY lang")
def value_shares(spark, sf):
    d = table(spark, sf, "documents")
    total = d.count()
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), r6(F.count(F.lit(1)) / total).alias("share"), r6(F.avg("n_chars")).alias("mean_chars"), F.median("n_chars").alias("median_chars"))


@query("""SELECT d.lang, round(avg((l.quality = 1)::INT), 6) AS quality_rate, round(avg((l.toxic = 1)::INT), 6) AS toxic_rate, count(l.doc_id) AS labelled, count(*) AS n
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang""")
def category_rates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(r6(F.avg((F.col("quality") == 1).cast("int"))).alias("quality_rate"), r6(F.avg((F.col("toxic") == 1).cast("int"))).alias("toxic_rate"), F.count("quality").alias("labelled"), F.count(F.lit(1)).alias("n"))


_PIV = ", ".join(f"round(count(*) FILTER (WHERE condition = '{t}') / count(*), 6) AS {t}" for t in TYPES)


@query(f"WITH {EV} SELECT category, {_PIV} FROM ev GROUP BY category")
def crosstab_normalised(spark, sf):
    p = events(spark, sf).groupBy("category").pivot("condition", TYPES).count().fillna(0)
    total = sum(F.col(t) for t in TYPES)
    return p.select("category", *[r6(F.col(t) / total).alias(t) for t in TYPES])


@query(f"""WITH {EV} SELECT coalesce(category, 'All') AS category, coalesce(condition, 'All') AS condition, count(*) AS n FROM ev GROUP BY CUBE (category, condition)""")
def crosstab_margins(spark, sf):
    return events(spark, sf).cube("category", "condition").agg(F.count(F.lit(1)).alias("n")).fillna("All", ["category", "condition"])


_FLAGS = [("long", "n_chars > 2000"), ("multi", "contains(text, chr(10))"), ("digits", "regexp_matches(text, '[0-9]')"), ("question", "contains(text, '?')")]


@query(f"""WITH f AS (SELECT source, coalesce(nullif(concat_ws('+', {", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _FLAGS)}), ''), '(none)') AS signature, lang FROM documents)
SELECT signature, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS {x}" for x in LANGS)}, count(DISTINCT lang) AS n_categories FROM f GROUP BY 1""")
def operation_signatures(spark, sf):
    flags = [("long", F.col("n_chars") > 2000), ("multi", F.contains("text", F.lit("\n"))), ("digits", F.col("text").rlike("[0-9]")), ("question", F.contains("text", F.lit("?")))]
    sig = F.coalesce(F.nullif(F.concat_ws("+", *[F.when(c, n) for n, c in flags]), F.lit("")), F.lit("(none)"))
    p = table(spark, sf, "documents").groupBy(sig.alias("signature")).pivot("lang", LANGS).count().fillna(0)
    return p.select("signature", sum(F.col(x) for x in LANGS).alias("n"), *LANGS, sum((F.col(x) > 0).cast("long") for x in LANGS).alias("n_categories"))


@query(f"""WITH {S} SELECT coalesce(category, '*') AS category, coalesce(condition, '*') AS condition, count(*) AS n, sum(correct::INT)::BIGINT AS n_correct, round(avg(correct::INT), 6) AS accuracy
FROM s GROUP BY GROUPING SETS ((), (category), (condition))""")
def grouping_sets_summary(spark, sf):
    sets = joined_grid(spark, sf).groupingSets([[], ["category"], ["condition"]], "category", "condition")
    correct = F.col("correct").cast("int")
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.sum(correct).alias("n_correct"), r6(F.avg(correct)).alias("accuracy"))
    return out.fillna("*", ["category", "condition"])


@query(f"""WITH {EV} SELECT p.condition, p.position, coalesce(c.n, 0)::BIGINT AS n, round(coalesce(c.n, 0) * 100.0 / t.n, 6) AS share_percent
FROM (SELECT * FROM (SELECT unnest({TYPES!r}) AS condition) CROSS JOIN (SELECT unnest(['A','B','C','D','unparsable']) AS position)) p
LEFT JOIN (SELECT condition, coalesce(pred, 'unparsable') AS position, count(*) AS n FROM ev GROUP BY 1, 2) c ON c.condition = p.condition AND c.position = p.position
JOIN (SELECT condition, count(*) AS n FROM ev GROUP BY 1) t ON t.condition = p.condition WHERE p.position <> 'unparsable' OR c.n > 0""")
def position_distribution(spark, sf):
    ev = events(spark, sf)
    counts = ev.groupBy("condition", F.coalesce("pred", F.lit("unparsable")).alias("position")).agg(F.count(F.lit(1)).alias("n"))
    totals = ev.groupBy("condition").agg(F.count(F.lit(1)).alias("__t"))
    grid = spine(totals, spark.createDataFrame([(x,) for x in ["A", "B", "C", "D", "unparsable"]], "position string"))
    out = completed(grid, counts, ["condition", "position"], {"n": 0}).where("position <> 'unparsable' OR n > 0")
    return out.select("condition", "position", "n", r6(F.col("n") * 100.0 / F.col("__t")).alias("share_percent"))


@query(f"""WITH a AS (SELECT doc_id, unnest(['R1', 'R2', 'R3']) AS reviewer FROM documents), b AS (SELECT doc_id, reviewer, {L("reviewer || '|' || doc_id", 6)} AS answer, {L("'gold|' || doc_id")} AS gold FROM a)
SELECT doc_id, count(*) AS n, string_agg(reviewer || ':' || answer, ';' ORDER BY reviewer) AS answers, count(*) FILTER (WHERE answer = gold) AS n_correct, count(*) = 2 AND min(answer) = max(answer) AS agree
FROM b WHERE answer IS NOT NULL GROUP BY doc_id""")
def reviewer_pairs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array(*map(F.lit, ["R1", "R2", "R3"]))).alias("reviewer"))
    d = d.withColumn("answer", letter(F.col("reviewer"), F.col("doc_id"), options=6)).where("answer IS NOT NULL").withColumn("gold", letter("gold", F.col("doc_id")))
    return d.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "reviewer", "answer"))), ";").alias("answers"),
        F.count_if(F.col("answer") == F.col("gold")).alias("n_correct"), ((F.count(F.lit(1)) == 2) & (F.min("answer") == F.max("answer"))).alias("agree"),
    )


@query("""WITH c AS (SELECT p.page_id, (length(html) - length(replace(html, '<p>', ''))) // 3 AS paragraphs, contains(html, '<article>') AS article, contains(html, '</html>') AS closed, split_part(split_part(url, '://', 2), '/', 2) AS lang FROM pages p)
SELECT coalesce(lang, '(all)') AS lang, count(*) AS n, round(avg(paragraphs), 6) AS mean, min(paragraphs)::BIGINT AS min, max(paragraphs)::BIGINT AS max, count(*) FILTER (WHERE closed) AS n_closed FROM c GROUP BY ROLLUP (lang)""")
def coverage_summary(spark, sf):
    c = table(spark, sf, "pages").select(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(2)).alias("lang"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("p"), F.contains("html", F.lit("</html>")).alias("closed"))
    return c.rollup("lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("mean"), F.min("p").alias("min"), F.max("p").alias("max"), F.count_if("closed").alias("n_closed")).fillna("(all)", ["lang"])


@query(f"""WITH {EV}, c AS (SELECT condition, md5((id % 50)::VARCHAR || '|' || k) AS key, 'kind' || (k % 3) AS kind, k AS tokens, k / 4.0 AS latency FROM ev)
SELECT 'physical' AS view, kind AS name, count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(latency), 6) AS latency FROM (SELECT DISTINCT key, kind, tokens, latency FROM c) GROUP BY kind
UNION ALL SELECT 'method', condition, count(*), sum(tokens)::BIGINT, round(sum(latency), 6) FROM (SELECT DISTINCT condition, key, kind, tokens, latency FROM c) GROUP BY condition""")
def cost_physical_vs_method(spark, sf):
    c = events(spark, sf).select("condition", F.md5(F.concat_ws("|", F.col("id") % 50, "k")).alias("key"), F.concat(F.lit("kind"), F.col("k") % 3).alias("kind"), F.col("k").alias("tokens"), (F.col("k") / 4.0).alias("latency"))
    a = scoring.physical_cost(c).select(F.lit("physical").alias("view"), F.col("kind").alias("name"), "calls", "tokens", r6("latency").alias("latency"))
    return a.unionByName(scoring.method_cost(c).select(F.lit("method").alias("view"), F.col("condition").alias("name"), "calls", "tokens", r6("latency").alias("latency")))


@query(f"""WITH {J}, x AS (SELECT a.id, b.condition, b.tokens - a.tokens AS over FROM j a JOIN j b ON b.id = a.id AND a.condition = 'click' AND b.condition <> 'click')
SELECT condition, count(*) AS n, count(over) AS n_known, round(avg(over), 6) AS mean_overhead FROM x GROUP BY 1""")
def token_overhead(spark, sf):
    j = judgments(spark, sf).select("id", "condition", "tokens")
    raw = j.where("condition = 'click'").select("id", F.col("tokens").alias("raw"))
    x = j.where("condition <> 'click'").join(raw, "id").withColumn("over", F.col("tokens") - F.col("raw"))
    return x.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.count("over").alias("n_known"), r6(F.avg("over")).alias("mean_overhead"))


_TOK = r"regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?')"


@query(f"""WITH t AS (SELECT doc_id, unnest(list_distinct({_TOK})) AS token FROM documents), c AS (SELECT t.token, count(*) AS occurrences, count(*) FILTER (WHERE l.quality = 1) AS correct FROM t JOIN labels l ON l.doc_id = t.doc_id GROUP BY 1)
SELECT token, occurrences, correct, round(ln((correct + 1) / (occurrences - correct + 3)), 6) AS log_odds FROM c WHERE occurrences >= 5""")
def token_prior(spark, sf):
    t = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select("quality", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token"))
    c = t.groupBy("token").agg(F.count(F.lit(1)).alias("occurrences"), F.count_if(F.col("quality") == 1).alias("correct")).where("occurrences >= 5")
    return c.withColumn("log_odds", r6(F.log((F.col("correct") + 1) / (F.col("occurrences") - F.col("correct") + 3))))


@query(f"""WITH {EV}, r AS (SELECT id, avg((condition = 'click')::INT) AS click, avg((condition = 'view')::INT) AS view, avg((condition = 'error')::INT) AS error FROM ev GROUP BY id), m AS (SELECT *, greatest(click, view, error) AS top FROM r)
SELECT id, CASE WHEN top = 0 THEN 'none' WHEN (click = top)::INT + (view = top)::INT + (error = top)::INT > 1 THEN 'tie' WHEN click = top THEN 'click' WHEN view = top THEN 'view' ELSE 'error' END AS dominant, round(top, 6) AS purity FROM m""")
def dominant_label(spark, sf):
    names = ["click", "view", "error"]
    r = events(spark, sf).groupBy("id").agg(*[F.avg((F.col("condition") == n).cast("int")).alias(n) for n in names])
    top = F.greatest(*names)
    hits = F.filter(F.array(*[F.when(F.col(n) == top, n) for n in names]), lambda x: x.isNotNull())
    return r.select("id", F.when(top == 0, "none").when(F.size(hits) > 1, "tie").otherwise(F.get(hits, F.lit(0))).alias("dominant"), r6(top).alias("purity"))


@query("WITH p AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings) AS p FROM embeddings GROUP BY label) SELECT round(sum(p * p), 6) AS chance FROM p")
def chance_agreement(spark, sf):
    e = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return e.agg(r6(F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("chance"))


@query(f"WITH {EV} SELECT condition, k % 5 AS images, count(*) AS n, round(avg(latency), 6) AS mean_latency, round(max(epoch(ts)) - min(epoch(ts)), 3) AS span_seconds FROM ev GROUP BY 1, 2")
def latency_by_group(spark, sf):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events(spark, sf).groupBy("condition", (F.col("k") % 5).alias("images")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("latency")).alias("mean_latency"), F.round(F.max(t) - F.min(t), 3).alias("span_seconds"))


@query(f"""WITH {EV}, c AS (SELECT category, gold, count(DISTINCT id) AS n FROM ev GROUP BY 1, 2)
SELECT category, gold AS letter, n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, gold) AS r FROM c) WHERE r = 1""")
def majority_baseline(spark, sf):
    c = events(spark, sf).groupBy("category", "gold").agg(F.countDistinct("id").alias("n"))
    best = c.groupBy("category").agg(F.min(F.struct((-F.col("n")).alias("m"), "gold", "n")).alias("b"))
    return best.select("category", F.col("b.gold").alias("letter"), "b.n")


@query(f"""WITH a AS (SELECT doc_id, {L("'x|' || doc_id", 5)} AS x, {L("'y|' || doc_id", 5)} AS y FROM documents)
SELECT count(*) AS n, round(avg((x IS NOT DISTINCT FROM y)::INT), 6) AS agreement, count(*) FILTER (WHERE x IS NULL AND y IS NULL) AS both_blank FROM a""")
def audit_agreement(spark, sf):
    a = table(spark, sf, "documents").select(letter("x", F.col("doc_id"), options=5).alias("x"), letter("y", F.col("doc_id"), options=5).alias("y"))
    return a.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("x").eqNullSafe(F.col("y")).cast("int"))).alias("agreement"), F.count_if(F.col("x").isNull() & F.col("y").isNull()).alias("both_blank"))


@query(f"""WITH {J}, b AS (SELECT id, bool_and(pred IS NOT NULL) AS available, count(DISTINCT pred) = 1 AS agree, avg(({'coalesce(pred = gold, false)'})::INT) AS acc FROM j GROUP BY id)
SELECT available, agree, count(*) AS n, round(avg(acc), 6) AS accuracy FROM b GROUP BY 1, 2""")
def accuracy_by_agreement(spark, sf):
    b = judgments(spark, sf).groupBy("id").agg(F.every(F.col("pred").isNotNull()).alias("available"), (F.countDistinct("pred") == 1).alias("agree"), F.avg(F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)).cast("int")).alias("acc"))
    return b.groupBy("available", "agree").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("acc")).alias("accuracy"))


@query(f"""WITH {EV}, a AS (SELECT count(*) AS records, count(DISTINCT id) AS items, count(*) FILTER (WHERE status = 'ok') AS ok, count(tokens) AS known FROM ev)
SELECT 'all_conditions' AS gate, (SELECT count(DISTINCT condition) FROM ev) = 5 AS passed FROM a UNION ALL SELECT 'ok_rate', ok / records >= 0.8 FROM a UNION ALL SELECT 'tokens_known', known / records >= 0.99 FROM a UNION ALL SELECT 'items', items >= 100 FROM a""")
def gate_checks(spark, sf):
    a = events(spark, sf).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("id").alias("items"), F.count_if(F.col("status") == "ok").alias("ok"), F.count("tokens").alias("known"), F.countDistinct("condition").alias("conditions"))
    gates = [("all_conditions", F.col("conditions") == 5), ("ok_rate", F.col("ok") / F.col("records") >= 0.8), ("tokens_known", F.col("known") / F.col("records") >= 0.99), ("items", F.col("items") >= 100)]
    return a.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), c.alias("passed")) for n, c in gates])).alias("g")).select("g.*")


@query(f"""WITH {EV}, p AS (SELECT condition, id, avg(latency) AS x, count(*) AS n, sum(tokens)::BIGINT AS t FROM ev GROUP BY 1, 2)
SELECT policy, grp, round(avg(v), 6) AS mean FROM (SELECT 'latency' AS policy, condition AS grp, x AS v FROM p UNION ALL SELECT 'records', condition, n FROM p) GROUP BY 1, 2""")
def policy_groups(spark, sf):
    p = events(spark, sf).groupBy("condition", "id").agg(F.avg("latency").alias("x"), F.count(F.lit(1)).cast("double").alias("n"))
    long = p.select(F.col("condition").alias("grp"), F.expr("stack(2, 'latency', x, 'records', n) AS (policy, v)"))
    return long.groupBy("policy", "grp").agg(r6(F.avg("v")).alias("mean"))


@query("""SELECT o_orderpriority AS priority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1""")
def revenue_by_priority(spark, sf):
    l = table(spark, sf, "lineitem").where("l_shipdate >= TIMESTAMP '1996-01-01'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    per = l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority"))
    return o.join(per, "l_orderkey").groupBy("priority").agg(F.sum("n").alias("n"), F.round(F.sum("r"), 2).alias("revenue"))
