"""Every registered query against its DuckDB twin (S rows of the survey) and a run of the rest (R rows)."""

import pytest

from tracesift.plans import catalog  # noqa: F401
from tracesift.plans.registry import QUERIES
from tracesift.plans.verify import compare

from .conftest import SF_SMALL

SQL_QUERIES = sorted(n for n, q in QUERIES.items() if q.sql is not None)
ROWS_QUERIES = sorted(n for n, q in QUERIES.items() if q.sql is None)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_matches_duckdb(spark, name):
    res = compare(spark, SF_SMALL, {name}, verbose=False)[name]
    assert res[0] == "OK", res


#: Rows at sf0.001 of the queries without a twin: all 1,443 requests are scored, 200 parts, 10 clusters, ...
EXPECTED_ROWS = {
    "kmeans_simple": 1443, "kmeans_onehot": 200, "kmeans_onehot_norm": 200, "bisecting_kmeans": 200, "gmm": 200,
    "iforest_transform": 1443, "iforest_summary": 1, "tree_samples": 100 * 256, "train_kmeans": 10, "iforest_labelled_run": 1,
}


@pytest.mark.parametrize("name", ROWS_QUERIES)
def test_rows_only_runs(spark, name):
    df = QUERIES[name].build(spark, SF_SMALL)
    n = df.count()
    if name in EXPECTED_ROWS:
        assert n == EXPECTED_ROWS[name]
    elif name == "iforest_fit":
        trees = df.groupBy("tree_id").agg({"num_instance": "sum"}).collect()
        assert len(trees) == 100 and {r[1] for r in trees} == {256}
    elif name == "sample_copies":
        assert df.agg({"copies": "sum"}).first()[0] == 100 * 256 and n < 100 * 256
    else:
        raise AssertionError(f"no expectation for {name}")


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
