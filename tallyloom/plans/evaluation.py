"""Selection of items, and tables of an evaluation's results: flips, consistency, facts, rules and policies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import lexicon, options as op, text as tx
from tallyloom.functions.rng import u32
from tallyloom.operators import resampling, scoring, selection, stats
from tallyloom.plans.questions import _FAM, _ONE, _P, _pat, good
from tallyloom.plans.registry import EV, STATUSES, U, events, query, r6
from tallyloom.plans.texts import _VAR, variants
from tallyloom.sources.readers import table
from tallyloom.sources.staging import staged

_FLIP = f"{_VAR}, f AS (SELECT v.id, v.variant, 'cat' || (v.id % 7)::VARCHAR AS category, v.id % 2 = 0 AS has_direction, (v.pred IS DISTINCT FROM o.pred)::INT AS flipped FROM v JOIN v o ON o.id = v.id AND o.variant = 'orig' WHERE v.variant <> 'orig')"


@query(f"WITH {_FLIP} SELECT variant, category, has_direction, count(*) AS n, round(avg(flipped), 6) AS flip_rate FROM f GROUP BY GROUPING SETS ((variant), (variant, category), (variant, has_direction))")
def flip_rates_split(spark, sf):
    """Flip rates per variant, per variant and category, and per variant by whether the question has direction words."""
    f = scoring.flips(variants(spark, sf)).withColumn("category", F.concat(F.lit("cat"), F.col("id") % 7)).withColumn("has_direction", F.col("id") % 2 == 0)
    sets = [["variant"], ["variant", "category"], ["variant", "has_direction"]]
    return f.groupingSets([[F.col(c) for c in s] for s in sets], "variant", "category", "has_direction").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("flipped").cast("int"))).alias("flip_rate"))


@query(f"""WITH {_VAR}, c AS (SELECT id, min(gold) AS gold, count(DISTINCT coalesce(pred, '<none>')) = 1 AS consistent, max(CASE WHEN variant = 'orig' THEN pred END) AS pred FROM v GROUP BY id)
SELECT consistent, count(*) AS n, round(avg(coalesce(pred = gold, false)::INT), 6) AS accuracy FROM c GROUP BY 1""")
def accuracy_by_consistency(spark, sf):
    v = variants(spark, sf)
    c = scoring.consistency(v).join(v.where("variant = 'orig'").select("id", "pred", "gold"), "id")
    return c.groupBy("consistent").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)).cast("int"))).alias("accuracy"))


_ODD = "CASE WHEN event_id % 997 = 0 THEN 'withdrawn' WHEN event_id % 991 = 0 THEN NULL ELSE status END"


@query(f"""WITH {EV}, s AS (SELECT condition, coalesce({_ODD}, 'missing') AS status FROM ev), k AS (SELECT unnest({[*STATUSES, 'missing']!r}) AS status UNION SELECT DISTINCT status FROM s), g AS (SELECT c.condition, k.status FROM (SELECT DISTINCT condition FROM s) c CROSS JOIN k)
SELECT g.condition, g.status, count(s.status) AS n FROM g LEFT JOIN s ON s.condition = g.condition AND s.status = g.status GROUP BY 1, 2""")
def status_counts(spark, sf):
    """Counts of all known statuses and of missing ones, zeros included, and of statuses nobody knows."""
    k = F.col("event_id")
    s = events(spark, sf).select("condition", F.coalesce(F.when(k % 997 == 0, "withdrawn").when(k % 991 == 0, None).otherwise(F.col("status")), F.lit("missing")).alias("status"))
    counted = s.groupBy("condition", "status").agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(x,) for x in (*STATUSES, "missing")], "status string").unionByName(counted.select("status")).distinct()
    spine = counted.select("condition").distinct().crossJoin(known)  # conditions times statuses: two short lists
    return spine.join(counted, ["condition", "status"], "left").select("condition", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""WITH f AS (SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, count(*) FILTER (WHERE text IS NULL) AS n_null_texts, count(DISTINCT lang) AS n_langs, count(DISTINCT source) AS n_sources, min(n_chars) AS least_chars, max(n_chars) AS most_chars FROM documents)
SELECT fact, value, expected, value <> expected AS differs FROM (SELECT unnest(['n_rows', 'n_ids', 'n_null_texts', 'n_langs', 'n_sources', 'least_chars', 'most_chars']) AS fact, unnest([n_rows, n_ids, n_null_texts, n_langs, n_sources, least_chars, most_chars]) AS value, unnest([n_rows, n_rows, 0, 4, 20, 1, n_rows * 100]) AS expected FROM f)""")
def dataset_facts(spark, sf):
    """Facts of the documents beside those expected; the sizes expected follow from the rows."""
    f = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc_id").alias("n_ids"), F.count_if(F.col("text").isNull()).alias("n_null_texts"), F.countDistinct("lang").alias("n_langs"), F.countDistinct("source").alias("n_sources"), F.min("n_chars").alias("least_chars"), F.max("n_chars").alias("most_chars"))
    n = F.col("n_rows")
    expected = {"n_rows": n, "n_ids": n, "n_null_texts": F.lit(0), "n_langs": F.lit(4), "n_sources": F.lit(20), "least_chars": F.lit(1), "most_chars": n * 100}
    rows = F.array(*[F.struct(F.lit(k).alias("fact"), F.col(k).alias("value"), e.cast("long").alias("expected")) for k, e in expected.items()])
    return f.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.value") != F.col("r.expected")).alias("differs"))


def pool(spark, sf):
    """Documents read as items: category, template group, number of images and half."""
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(k.alias("id"), "source", F.coalesce("lang", F.lit("?")).alias("category"), (u32("group", k) % 5000).alias("group"), F.when(u32("two", k) % 4 > 0, 2).otherwise(3 + u32("img", k) % 8).cast("int").alias("n_images"), F.when(u32("half", k) % 2 == 0, "explore").otherwise("confirm").alias("part"))


@query()
def selection_sets(spark, sf):
    """Evaluation, development and timing sets without a shared group, reasons for all others, and the schedule."""
    return selection.select_sets(pool(spark, sf).drop("source"), 200, 3, list(range(3, 11)), 0)


@query("SELECT doc_id AS id, source AS category, round FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('4|' || doc_id), doc_id) AS round FROM documents) ORDER BY round, md5('4|category|' || source), source LIMIT 70")
def blind_audit_draw(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"))
    return selection.round_robin_shuffled(d, 70, 4).withColumn("round", F.col("round").cast("long"))


@query(f"""WITH x AS (SELECT doc_id AS id, source AS category, {U("'comp|' || doc_id")} % 6 AS component FROM documents), m AS (SELECT *, row_number() OVER (PARTITION BY category, component ORDER BY md5('6|' || id), id) > 1 AS collision FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY collision, md5('6|' || id), id) AS rank FROM m) SELECT id, category, component, collision, rank FROM r WHERE rank <= 8""")
def audit_draw_fresh_components(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), (u32("comp", F.col("doc_id")) % 6).alias("component"))
    return selection.fresh_components_first(d, 8, 6).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT doc_id, lang FROM documents ORDER BY md5('0|' || doc_id), doc_id LIMIT 6")
def sample_for_print(spark, sf):
    from tallyloom.functions.rng import order_key

    return table(spark, sf, "documents").select("doc_id", "lang").orderBy(order_key(0, F.col("doc_id")), "doc_id").limit(6)


@query("SELECT event_id, round_even((event_id % 1000) / 8.0::DOUBLE, 2) AS half_even FROM events")
def half_even_round(spark, sf):
    return table(spark, sf, "events").select("event_id", F.bround((F.col("event_id") % 1000) / F.lit(8.0), 2).alias("half_even"))


@query("SELECT doc_id, (lang = 'de')::INT::DOUBLE AS lang_de, (lang = 'en')::INT::DOUBLE AS lang_en, (lang = 'es')::INT::DOUBLE AS lang_es, (lang = 'fr')::INT::DOUBLE AS lang_fr, (n_chars > 1000)::INT::DOUBLE AS is_long, ln(1 + n_chars) AS log_chars FROM documents".replace("ln(1 + n_chars)", "round(ln(1 + n_chars), 6)"))
def one_hot_features(spark, sf):
    """Dummies of a category, flags as numbers and a logarithm of a length: the columns of a feature matrix."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", *[(F.col("lang") == x).cast("double").alias(f"lang_{x}") for x in ("de", "en", "es", "fr")], (F.col("n_chars") > 1000).cast("double").alias("is_long"), r6(F.log1p("n_chars")).alias("log_chars"))


_LGT = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.25) + (n - i) * ln(0.75))"


@query(f"""WITH {_P}, f AS (SELECT id, gold, letter, o, {_FAM} AS family FROM ({_ONE})), mm AS (SELECT *, count(*) OVER (PARTITION BY id, family) AS mine FROM f), z AS (SELECT *, max(mine) OVER (PARTITION BY id) AS most FROM mm),
x AS (SELECT gold = letter AS hit, unnest(['sometimes', 'abstain', 'format_outlier']) AS rule, unnest([regexp_matches(o, {_pat('sometimes')}), regexp_matches(o, {_pat('abstain')}), mine = 1 AND most = 3]) AS gone FROM z),
c AS (SELECT rule, count(*) AS n, count(*) FILTER (WHERE hit) AS k FROM x WHERE gone GROUP BY 1), pp AS (SELECT rule, n, k, (SELECT sum({_LGT}) FROM (SELECT unnest(range(0, k + 1)) AS i)) AS p FROM c),
h AS (SELECT *, row_number() OVER (ORDER BY p, rule) AS r, count(*) OVER () AS m FROM pp), a AS (SELECT *, least(1, max((m - r + 1) * p) OVER (ORDER BY p, rule ROWS UNBOUNDED PRECEDING)) AS p_holm FROM h)
SELECT rule, n, k, round(p, 6) AS p_value, round(p_holm, 6) AS p_holm, n >= 10 AND p_holm < 0.05 AS selected FROM a""")
def elimination_rule_selection(spark, sf):
    """Rules that eliminate options which are right less often than chance: at least ten options and a Holm p below 0.05."""
    q = good(spark, sf).select("id", "gold", "opts", F.transform("opts", tx.option_family).alias("fam"))
    alike = lambda x: F.size(F.filter("fam", lambda y: y == x))
    rules = lambda x, i: F.array(
        F.struct(F.lit("sometimes").alias("rule"), lexicon.has(x, "sometimes").alias("gone")),
        F.struct(F.lit("abstain").alias("rule"), lexicon.has(x, "abstain").alias("gone")),
        F.struct(F.lit("format_outlier").alias("rule"), (F.exists("fam", lambda y: alike(y) == 3) & (alike(F.get("fam", i)) == 1)).alias("gone")),
    )
    o = q.select("gold", F.posexplode(F.transform("opts", rules)).alias("i", "r")).select((F.substring(F.lit("ABCD"), F.col("i") + 1, F.lit(1)) == F.col("gold")).alias("hit"), F.explode("r").alias("r"))
    c = o.where("r.gone").groupBy("r.rule").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("k"))
    a = stats.holm(stats.binomial_less(c, "k", "n"), "p_value", "rule")
    return a.select("rule", "n", "k", r6("p_value").alias("p_value"), r6("p_holm").alias("p_holm"), ((F.col("n") >= 10) & (F.col("p_holm") < 0.05)).alias("selected"))


@query(f"""WITH {EV}, c AS (SELECT condition, count(*) AS calls, avg(latency) AS mean_s FROM ev GROUP BY 1)
SELECT condition, calls, round(calls * mean_s * 1.3 / 3600, 6) AS padded_hours, ceil(calls * mean_s * 1.3 / 14400)::BIGINT AS jobs, ceil(calls / greatest(1, ceil(calls * mean_s * 1.3 / 14400)))::BIGINT AS calls_per_job FROM c""")
def job_schedule(spark, sf):
    """Calls packed into jobs of four hours, with an allowance of 1.3 on the mean latency."""
    c = events(spark, sf).groupBy("condition").agg(F.count(F.lit(1)).alias("calls"), F.avg("latency").alias("mean_s"))
    need = F.col("calls") * F.col("mean_s") * 1.3
    jobs = F.ceil(need / 14400)
    return c.select("condition", "calls", r6(need / 3600).alias("padded_hours"), jobs.cast("long").alias("jobs"), F.ceil(F.col("calls") / F.greatest(F.lit(1), jobs)).cast("long").alias("calls_per_job"))


#: Repetitions of intervals and of random answers.
REPS = 10_000
#: Scores that a policy can have, by their number of twelfths: 1 / m if it leaves m letters tied, else 0.
_CODES = (0, 3, 4, 6, 12)


def _policy_sql() -> str:
    steps, last = [], "b0"
    for code in _CODES:
        steps.append(resampling.sql_draw(last, f"d{code}", "rest", f"c{code} / nullif(mass, 0)", f"'resample|policy|' || policy || '|' || rep || '|{code}'"))
        steps.append(f"e{code} AS (SELECT * EXCLUDE (k, rest, mass, total), rest - k AS rest, mass - c{code} AS mass, total + k * {code} / 12.0::DOUBLE AS total FROM d{code})")
        last = f"e{code}"
    first, last2 = [], "h0"
    for m in (1, 2, 3, 4):
        first.append(resampling.sql_draw(last2, f"f{m}", f"m{m}", f"{m} / 4.0", f"'chance|policy|' || policy || '|' || rep || '|{m}'"))
        first.append(f"g{m} AS (SELECT * EXCLUDE (k, total), total + k / {m}.0::DOUBLE AS total FROM f{m})")
        last2 = f"g{m}"
    counts = ", ".join(f"count(*) FILTER (WHERE code = {c}) AS c{c}" for c in _CODES) + ", " + ", ".join(f"count(*) FILTER (WHERE m = {m}) AS m{m}" for m in (1, 2, 3, 4))
    return f"""WITH {_P}, v AS (SELECT id, gold, letter, len(regexp_extract_all(lower(o), '[a-z0-9]+(?:''[a-z]+)?')) AS n FROM ({_ONE})), w AS (SELECT id, gold, letter, n = max(n) OVER (PARTITION BY id) AS a, n = min(n) OVER (PARTITION BY id) AS b FROM v),
s AS (SELECT id, sum((a AND letter = gold)::INT) / sum(a::INT) AS longest, sum(a::INT) AS m1, sum((b AND letter = gold)::INT) / sum(b::INT) AS shortest, sum(b::INT) AS m2, max((gold = 'A')::INT)::DOUBLE AS letter_a FROM w GROUP BY 1),
l AS (SELECT unnest(['longest', 'shortest', 'letter_a']) AS policy, unnest([longest, shortest, letter_a]) AS score, unnest([m1, m2, 1]) AS m FROM s),
t AS (SELECT policy, count(*) AS n, avg(score) AS accuracy, {counts} FROM (SELECT *, round(score * 12)::INT AS code FROM l) GROUP BY 1),
r AS (SELECT t.*, rep FROM t, (SELECT unnest(range({REPS})) AS rep)), b0 AS MATERIALIZED (SELECT *, n AS rest, n AS mass, 0.0::DOUBLE AS total FROM r), {", ".join(steps)},
ci AS (SELECT policy, quantile_cont(total / n, 0.025) AS ci_low, quantile_cont(total / n, 0.975) AS ci_high FROM {last} GROUP BY 1),
h0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS total FROM r), {", ".join(first)},
pv AS (SELECT policy, (1 + count(*) FILTER (WHERE total / n >= accuracy - 1e-12)) / {REPS + 1}.0 AS p FROM {last2} GROUP BY 1),
x AS (SELECT t.policy, t.n, accuracy, ci_low, ci_high, p, count(*) OVER () AS fam, row_number() OVER (ORDER BY p, t.policy) AS k FROM t JOIN ci ON ci.policy = t.policy JOIN pv ON pv.policy = t.policy)
SELECT policy, n, round(accuracy, 6) AS accuracy, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p, 6) AS p_vs_25, round(least(1, max((fam - k + 1) * p) OVER (ORDER BY p, policy ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM x"""


@query(_policy_sql())
def policy_table(spark, sf):
    """Accuracy of guessing policies: interval from 10,000 resamples, p against random answers, and p adjusted by Holm."""
    q = good(spark, sf).select("gold", op.extremum_policy(op.lengths(F.col("opts"))).alias("a"), op.extremum_policy(op.lengths(F.col("opts")), smallest=True).alias("b"))
    tied = lambda c: F.size(F.filter(c, lambda x: x > 0))
    named = (("longest", op.policy_score(F.col("a"), F.col("gold")), tied(F.col("a"))), ("shortest", op.policy_score(F.col("b"), F.col("gold")), tied(F.col("b"))), ("letter_a", (F.col("gold") == "A").cast("double"), F.lit(1)))
    scores = F.array(*[F.struct(F.lit(n).alias("policy"), s.cast("double").alias("score"), m.cast("int").alias("m")) for n, s, m in named])
    l = q.select(F.explode(scores).alias("s")).select("s.*")
    counts = staged(l.groupBy("policy", F.round(F.col("score") * 12).cast("int").alias("code"), "m").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s")), "scores")
    seen = counts.groupBy("policy").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("accuracy"))
    codes = counts.groupBy("policy", "code").agg(F.sum("n").alias("n")).withColumn("x", F.col("code") / F.lit(12.0))
    ends = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    ci = resampling.means(codes, ["policy"], REPS, "policy").groupBy("policy").agg(ends.alias("e"))
    null = resampling.chance_means(counts.groupBy("policy", "m").agg(F.sum("n").alias("n")), ["policy"], REPS, "policy")
    p = null.join(seen.select("policy", "accuracy"), "policy").groupBy("policy").agg(((1 + F.count_if(F.col("mean") >= F.col("accuracy") - 1e-12)) / F.lit(REPS + 1.0)).alias("p_value"))
    out = stats.holm(seen.join(ci, "policy").join(p, "policy"), "p_value", "policy")
    return out.select("policy", "n", r6("accuracy").alias("accuracy"), r6(F.get("e", F.lit(0))).alias("ci_low"), r6(F.get("e", F.lit(1))).alias("ci_high"), r6("p_value").alias("p_vs_25"), r6("p_holm").alias("p_holm"))


@query("WITH k AS (SELECT unnest(['en', 'fr', 'de', 'es']) AS lang, unnest([1, 2, 3, 4]) AS o) SELECT doc_id, d.lang, row_number() OVER (ORDER BY o, doc_id) AS position FROM documents d JOIN k ON k.lang = d.lang")
def ordinal_positions(spark, sf):
    """Documents in a stated order of languages, then by id, numbered."""
    o = F.create_map(*[F.lit(x) for kv in zip(("en", "fr", "de", "es"), range(1, 5)) for x in kv])
    d = table(spark, sf, "documents").select("doc_id", "lang", o[F.col("lang")].alias("__o")).where("__o IS NOT NULL")
    return selection.positions(d, ["__o", "doc_id"]).select("doc_id", "lang", F.col("position").cast("long").alias("position"))
