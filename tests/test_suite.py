"""Every registered query of the engine against its SQL."""

import math

import duckdb
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from tarnlake import functions as f
from tarnlake import suite
from tarnlake.operators.quality import profile

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for t in suite.TABLES:
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda v: (v is None, str(type(v)) if isinstance(v, bool) else "", str(v))
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [key(v) for v in r])


@pytest.mark.parametrize("name", [*suite.ORACLE_SQL])
def test_query(spark, duck, name):
    df = suite.QUERIES[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    made = duck.sql(suite.ORACLE_SQL[name])
    want = plain(made.fetchall(), made.columns)
    assert sorted(df.columns) == sorted(made.columns)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, float(y), rel_tol=1e-12)) for x, y in zip(a, b, strict=True)), (a, b)


def test_compaction_is_checked_on_the_executors(spark, monkeypatch):
    """compact_partitioned_sorted brings no rows to the driver."""
    seen, collect = [], DataFrame.collect

    def counted(df):
        seen.append(len(made := collect(df)))
        return made

    monkeypatch.setattr(DataFrame, "collect", counted)
    assert suite.QUERIES["compact_partitioned_sorted"](spark, SF).count() == 1500
    assert max(seen, default=0) < 20


@pytest.mark.parametrize(("rows", "bad"), [([("F", None), ("F", 1), ("F", 1), ("F", 2)], 0), ([("F", 1), ("F", 3), ("F", 2)], 1), ([("F", 1), ("O", 2)], 1), ([("F", 1), ("F", None)], 1), ([("F", i // 2) for i in range(150_000)], 0), ([("F", i % 140_000) for i in range(150_000)], 1)])
def test_misplaced_rows_are_found(spark, rows, bad):
    L = suite.lake(spark, SF)
    t = L.create_table("t", "s string, k long")
    t.append(spark.createDataFrame(rows, "s string, k long").coalesce(1))
    assert len(t.snapshot().files) == 1
    assert len(suite._misplaced(t, "s", "k")) == bad


def test_no_large_state_for_each_distinct_value(spark):
    """The states of approximate counts and percentiles are held once a group, not once for each value that is counted."""
    rows = [(g, i % 7 if i % 5 else None, float(i)) for i in range(90) for g in ("a", None, "b")]
    L = suite.lake(spark, SF)
    q = L.over(spark.createDataFrame(rows, "g string, k int, x double"))
    parts = [f.count().alias("n"), f.count_distinct("k").alias("d"), f.approx_count_distinct("k", 0.02).alias("a"), f.median("x").alias("m"), (f.count() - f.count_distinct("x")).alias("r")]
    alone, grouped = q.select(*parts).execute(), q.group_by("g").select("g", *parts).execute()
    assert alone.columns == ["n", "d", "a", "m", "r"] and grouped.columns == ["g", *alone.columns]
    assert [tuple(r) for r in alone.collect()] == [(270, 7, 7, 44.5, 180)]
    assert {tuple(r) for r in grouped.collect()} == {(g, 90, 7, 7, 44.5, 0) for g in ("a", None, "b")}
    profiled = profile(L.table("orders"), "o_totalprice")
    assert profiled.columns == ["n_rows", "n_null", "n_unique", "min", "max", "mean", "median", "std"]
    for df in (suite.QUERIES["agg_approx_distinct"](spark, SF), alone, grouped, profiled):
        for step in df._jdf.queryExecution().sparkPlan().toString().splitlines():
            assert not ("HashAggregate(keys=[" in step and "count(distinct" in step and ("approx_count" in step or "median" in step or "percentile" in step))
