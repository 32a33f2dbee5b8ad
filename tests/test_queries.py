"""Every query against its SQL in DuckDB, on the smallest tables; and what plans must and must not do."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
duckdb = pytest.importorskip("duckdb")

from tallyloom.plans import ORACLES, QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in ORACLES:
        want = con.execute(ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, want.fetchall())


def test_most_queries_have_sql():
    assert set(QUERIES) - set(ORACLES) <= {"lexicon_tags", "group_exclusive_sample", "selection_sets", "flat_render", "inventory_renderings", "tumbling_windows_stream", "kmeans_ami", "pca_projection", "tfidf_logreg_cv", "text_learner"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_filters_pushed(spark):
    p = plan(QUERIES["pruned_scan"](spark, SF))
    assert "PushedFilters: [IsNotNull(n_chars), IsNotNull(lang), GreaterThan(n_chars,2000), EqualTo(lang,en)]" in p
    assert "text" not in p.split("ReadSchema")[1]
    w = plan(QUERIES["whitelist_scan"](spark, SF))
    assert "source" not in w and "lang" not in w


def test_results_do_not_depend_on_partitions(spark):
    names = ["accuracy_micro_macro", "stratified_split", "bootstrap_iid", "vote_with_tiebreak", "natural_id_sort"]
    before = {n: sorted(map(str, QUERIES[n](spark, SF).collect())) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert before == {n: sorted(map(str, QUERIES[n](spark, SF).collect())) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
