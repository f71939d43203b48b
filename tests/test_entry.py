"""Driver contract and a few oracle comparisons on the smallest tables."""

import duckdb

import __spark_entry__ as E
from revkit.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"review_id", "overall", "band", "meets_threshold"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 30


def _oracle(name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(E.oracle_sql()[name])
    return [d[0] for d in res.description], res.fetchall()


def _same(spark, name):
    df = E.queries()[name](spark, SF)
    cols, rows = _oracle(name)
    assert sorted(df.columns) == sorted(cols)
    norm = lambda r, c: tuple(r[c.index(k)] for k in sorted(c))
    assert sorted(map(repr, (norm(tuple(r), df.columns) for r in df.collect()))) == sorted(map(repr, (norm(r, cols) for r in rows)))


def test_oracle_comment_scores(spark):
    _same(spark, "comment_scores")


def test_oracle_common_findings(spark):
    _same(spark, "common_findings")


def test_oracle_php_recommendations(spark):
    _same(spark, "php_recommendations")


def test_oracle_python_findings(spark):
    _same(spark, "python_findings")
