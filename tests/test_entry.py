import importlib

import pytest


def test_queries_and_sql():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 1000


@pytest.mark.parametrize("name", ["mask_spark", "positional_entropy", "elbow_cutoff", "replay_nearest", "replay_canonical", "eval_metrics", "pattern_templates"])
def test_against_sql(spark, name):
    import duckdb

    entry = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    con.sql("create view events as select * from '/root/testdata/sf0.001/events.parquet'")
    got = entry.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted((tuple(r) for r in d[columns].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)
