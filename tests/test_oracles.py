"""Every registered query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tidemark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.3f}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical(got.collect(), got.columns) == canonical(want.fetchall(), columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_to_the_last_row_of_larger_tables(spark, name):
    """Values that only larger tables hold, such as zeros, must not stop a query."""
    QUERIES[name](spark, "/root/testdata/sf0.1").write.format("noop").mode("overwrite").save()


def test_partitions_do_not_matter(spark):
    from tidemark.plans.compiler import evaluate
    from tidemark.plans.frame import IntervalFrame
    from tidemark.queries import METRICS, events

    f = events(spark, SF)
    one = evaluate(IntervalFrame(f.data.coalesce(1), f.keys), METRICS, {"periods_per_year": 12.0})
    many = evaluate(IntervalFrame(f.data.repartition(13), f.keys), METRICS, {"periods_per_year": 12.0})
    assert canonical(one.collect(), one.columns) == canonical(many.collect(), many.columns)


def test_metrics_share_one_sort(spark):
    plan = QUERIES["metrics16"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
