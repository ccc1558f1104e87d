"""Every registered query with an oracle, held against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from tessera import queries as engine
from tessera.plans import dialect

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_against_oracle(spark, duck, name):
    df = engine.QUERIES[name](spark, SF)
    con = duck.execute(engine.ORACLES[name])
    names = [c[0] for c in con.description]
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in df.columns]
    assert rows(df.columns, map(tuple, df.collect())) == rows(df.columns, (tuple(r[i] for i in at) for r in con.fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_not_in_is_no_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = engine.QUERIES["not_in_subquery"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "LeftAnti" in plan and "Broadcast" not in plan


NOT_IN = [
    "select k, s from a where k not in ({})",
    "select k, s from a where not a.k in ({})",
    "select k, s from a where not (s = 'x' or k in ({}))",
    "select k from a where (k not in ({})) is null",
    "select k, k not in ({}) as c, case when `k` not in ({}) then 1 end as d from a",
    "select s, count(*) as n from a group by s having n not in ({})",
    "select a.k, b.x from a left join b on a.k = b.x and a.k not in ({})",
    "select a.k from a where a.k + 0 not in ({})",
]


@pytest.mark.parametrize("text", NOT_IN)
def test_not_in_with_nulls(spark, text):
    con = duckdb.connect()
    for name, values in (("a", "(1, 'x'), (2, 'y'), (null, 'z'), (5, null), (1, 'q') as t(k, s)"), ("b", "(1, 'x'), (null, 'y'), (7, 'x'), (7, null) as t(x, g)")):
        made = f"view {name} as select * from (values {values.replace(' as t', ') as t')}"
        con.execute(f"create {made}")
        spark.sql(f"create or replace temp {made}")
    try:
        for q in ("select x from b", "select x from b where x is not null", "select x from b where x > 100", "select k from a where k not in (select x from b where x > 1)", "select 1 union select 3"):
            full = text.replace("{}", q)
            assert rows([], map(tuple, spark.sql(dialect.rewrite(full)).collect())) == rows([], con.execute(full).fetchall()), full
        if "join" not in text and "group" not in text:
            full = text.replace("{}", "select x from b where b.g = a.s")
            assert rows([], map(tuple, spark.sql(dialect.rewrite(full)).collect())) == rows([], con.execute(full).fetchall()), full
    finally:
        for name in ("a", "b"):
            spark.catalog.dropTempView(name)


def test_not_in_that_stays_as_it_is():
    for text in ("select k from a where k not in (select x from b limit 1)", "select k not in (select x from b) from a", "select k from a where k not in (1, 2)", "select k from a where k in (select x from b)",
                 "select k from a where (k, s) not in (select x, g from b)", "select k from a group by k having count(*) not in (select x from b)", "select k from a where case when k = 1 then 2 end not in (select x from b)"):
        assert dialect.rewrite(text) == text
    views = {"V": "select x from b limit 1", "w": "select x from `V`", "u": "select x from b"}
    assert {"v", "w"} == dialect.unstable(views) - dialect.UNSTABLE
    assert "exists" not in dialect.rewrite("select k from a where k not in (select x from w)", unstable=dialect.unstable(views))
