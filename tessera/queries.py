"""Registered queries of the engine, one for each operator, with the SQL that another engine can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import compat
from tessera.plans import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "join_multi_agg"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the oracle's SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Statements of the dialect, run by the SQL front end as they stand; {name} is a table.
SQL = {
    "scan_all": "select * from {nation}",
    "scan_index_eq": "select * from {orders} where o_orderkey = 42",
    "scan_index_composite": "select * from {lineitem} where l_orderkey = 7 and l_linenumber = 1",
    "project_columns": "select c_name, c_mktsegment from {customer}",
    "literal_column": "select n_name, 1 as one, 'x' as tag from {nation}",
    "case_when": "select o_orderkey, case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band from {orders}",
    "case_no_else": "select o_orderkey, case when o_orderstatus = 'F' then 'done' end as state from {orders}",
    "case_under_group": "select o_orderstatus, case when o_orderstatus = 'F' then 'done' else 'open' end as state, count(*) as n from {orders} group by o_orderstatus",
    "scalar_subquery_select": "select r_name, (select max(n_nationkey) from {nation}) as top from {region}",
    "distinct_rows": "select distinct o_orderstatus, o_orderpriority from {orders}",
    "filter_eq": "select o_orderkey from {orders} where o_orderstatus = 'F'",
    "filter_ne": "select o_orderkey from {orders} where o_orderstatus != 'F'",
    "filter_gt": "select o_orderkey from {orders} where o_totalprice > 200000",
    "filter_lt": "select p_partkey from {part} where p_size < 10",
    "filter_ge": "select p_partkey from {part} where p_size >= 45",
    "filter_le": "select p_partkey from {part} where p_size <= 5",
    "filter_between": "select p_partkey, p_size from {part} where p_size between 10 and 20",
    "filter_like": "select p_partkey, p_name from {part} where p_name like '%a_%'",
    "filter_in": "select event_id from {events} where event_type in ('click', 'view')",
    "filter_is_null": "select l.o_orderkey from {orders} l left join {lineitem} r on l.o_orderkey = r.l_orderkey where r.l_orderkey is null",
    "filter_is_not_null": "select c_custkey from {customer} where c_name is not null",
    "filter_and": "select p_partkey from {part} where p_size > 10 and p_retailprice < 1500",
    "filter_or": "select p_partkey from {part} where p_size > 48 or p_size < 2",
    "in_subquery": "select c_custkey from {customer} where c_custkey in (select o_custkey from {orders} where o_totalprice > 300000)",
    "not_in_subquery": "select o_orderkey from {orders} where o_orderkey not in (select l_orderkey from {lineitem})",
    "exists_subquery": "select r_name from {region} where exists (select 1 from {nation} where n_nationkey = 3)",
    "not_exists_subquery": "select r_name from {region} where not exists (select 1 from {nation} where n_nationkey = 999)",
    "eq_subquery": "select o_orderkey from {orders} where o_totalprice = (select max(o_totalprice) from {orders})",
    "gt_subquery": "select s_suppkey from {supplier} where s_acctbal > (select avg(s_acctbal) from {supplier})",
    "lt_subquery": "select s_suppkey from {supplier} where s_acctbal < (select avg(s_acctbal) from {supplier})",
    "nested_subquery": "select n_name from {nation} where n_nationkey in (select c_nationkey from {customer} where c_custkey in (select o_custkey from {orders} where o_totalprice > 350000))",
    "join_inner": "select o_orderkey, c_name from {orders} join {customer} on o_custkey = c_custkey",
    "join_left": "select o_orderkey, l_linenumber from {orders} left join {lineitem} on o_orderkey = l_orderkey",
    "join_right": "select l_linenumber, o_orderkey from {lineitem} right join {orders} on l_orderkey = o_orderkey",
    "join_chain_mixed": "select o_orderkey, c_name, n_name, l_linenumber from {orders} join {customer} on o_custkey = c_custkey left join {nation} on c_nationkey = n_nationkey left join {lineitem} on l_orderkey = o_orderkey",
    "join_count": "select count(*) as count from {orders} join {lineitem} on o_orderkey = l_orderkey",
    "join_agg": "select c_mktsegment, count(*) as n, max(o_totalprice) as top from {orders} join {customer} on o_custkey = c_custkey group by c_mktsegment",
    "join_distinct": "select distinct n_name, o_orderstatus from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey",
    "join_where_order_limit": "select o_orderkey, c_name from {orders} join {customer} on o_custkey = c_custkey where o_totalprice > 100000 order by o_orderkey limit 25 offset 5",
    "agg_count_star": "select count(*) as count from {lineitem}",
    "agg_count_col": "select count(l_shipdate) as count from {lineitem}",
    "agg_sum": "select cast(sum(p_size) as bigint) as total from {part}",
    "agg_avg": "select avg(p_size) as mean from {part}",
    "agg_min": "select min(l_extendedprice) as low from {lineitem}",
    "agg_max": "select max(l_extendedprice) as high from {lineitem}",
    "agg_empty": "select count(*) as n, min(p_size) as low, cast(sum(p_size) as bigint) as total from {part} where p_size < 0",
    "group_by_one": "select l_returnflag, count(*) as n, min(l_quantity) as low, max(l_quantity) as high, avg(l_quantity) as mean from {lineitem} group by l_returnflag",
    "group_by_many": "select l_returnflag, l_linestatus, count(*) as n, cast(sum(l_linenumber) as bigint) as total from {lineitem} group by l_returnflag, l_linestatus",
    "group_order_limit": "select p_brand, count(*) as n from {part} group by p_brand order by n desc, p_brand limit 10 offset 2",
    "win_row_number": "select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from {orders}",
    "win_rank": "select p_partkey, rank() over (partition by p_brand order by p_size) as rk from {part}",
    "win_dense_rank": "select p_partkey, dense_rank() over (partition by p_brand order by p_size) as rk from {part}",
    "win_lag": "select event_id, lag(event_type) over (partition by user_id order by ts, event_id) as before from {events}",
    "win_lead": "select event_id, lead(event_type, 2) over (partition by user_id order by ts, event_id) as after from {events}",
    "win_many": "select s_suppkey, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rn, rank() over (partition by s_nationkey order by s_acctbal desc) as rk, lag(s_suppkey) over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as prev from {supplier}",
    "order_limit": "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 20",
    "limit_offset": "select c_custkey from {customer} order by c_custkey limit 10 offset 40",
    "union_all": "select n_nationkey as k from {nation} union all select c_nationkey from {customer}",
    "union_distinct": "select n_nationkey as k from {nation} union select c_nationkey from {customer}",
    "intersect_distinct": "select o_custkey as k from {orders} intersect select c_custkey from {customer} where c_mktsegment = 'BUILDING'",
    "except_distinct": "select o_orderkey as k from {orders} except select l_orderkey from {lineitem}",
    "join_limit": "select o_orderkey, l_partkey from {orders} join {lineitem} on o_orderkey = l_orderkey order by o_orderkey, l_partkey, l_suppkey limit 30",
    "group_where": "select o_orderpriority, count(*) as n from {orders} where o_orderstatus = 'O' group by o_orderpriority",
    "group_distinct": "select distinct n from (select o_custkey, count(*) as n from {orders} group by o_custkey) x",
    "agg_multi": "select count(*) as n, count(nullif(p_size, 7)) as m, cast(sum(p_size) as bigint) as total, min(p_name) as first, max(p_retailprice) as top from {part}",
    "distinct_limit": "select distinct p_brand from {part} order by p_brand limit 5 offset 3",
    "win_no_partition": "select n_name, row_number() over (order by n_name) as rn from {nation}",
    "win_top_per_group": "select * from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from {orders}) x where rn <= 3",
    "sort_nulls": "select o_orderkey, nullif(o_orderstatus, 'P') as s from {orders} order by nullif(o_orderstatus, 'P') desc nulls last, o_orderkey limit 40",
    "filter_like_backslash": "select n_name from {nation} where n_name not like '%_A%'",
    "intersect_chain": "select c_nationkey as k from {customer} intersect select s_nationkey from {supplier} union all select r_regionkey from {region}",
    "set_precedence": "select n_nationkey as k from {nation} union select s_nationkey from {supplier} intersect select c_nationkey from {customer} where c_custkey < 50",
}


def _add(name: str, text: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return views.sql(spark, d, text)

    run.__name__ = name
    query(views.oracle(text))(run)


for _name, _text in SQL.items():
    _add(_name, _text)


# Statements whose columns or results differ from standard SQL: the text, whether it runs with compat, and the standard SQL for it.
DIALECT = {
    "names_default": ("select o_orderstatus, 1, case when o_orderstatus = 'F' then 'done' end, count(*), min(o_orderdate) from {orders} group by o_orderstatus", False,
                      "select o_orderstatus, 1 as \"?column?\", case when o_orderstatus = 'F' then 'done' end as \"case\", count(*) as count, min(o_orderdate) as \"min(o_orderdate)\" from orders group by o_orderstatus"),
    "win_negative_offset": ("select event_id, lead(event_type, -2) over (partition by user_id order by ts, event_id) as same from {events}", False, "select event_id, event_type as same from events"),
    "win_rank_unordered": ("select s_suppkey, rank() over (partition by s_nationkey) as rk from {supplier}", False, "select s_suppkey, 1 as rk from supplier"),
    "compat_sql_sums": ("select sum(p_size), avg(p_size) from {part} where p_size < 0", True, "select cast(0 as bigint) as \"sum(p_size)\", cast(0 as double) as \"avg(p_size)\""),
    "compat_sql_not_equal": ("select o_orderkey, l_linenumber from {orders} left join {lineitem} on o_orderkey = l_orderkey where l_linenumber != 1", True,
                             "select o_orderkey, l_linenumber from orders left join lineitem on o_orderkey = l_orderkey where l_linenumber is distinct from 1"),
    "compat_sql_not_in": ("select c_custkey from {customer} where c_custkey not in (select nullif(o_custkey, 1) from {orders})", True,
                          "select c_custkey from customer where not exists (select 1 from orders where nullif(o_custkey, 1) = c_custkey)"),
    "compat_sql_right_chain": ("select n_nationkey as k from {nation} except select s_nationkey from {supplier} where s_suppkey < 9 union select c_nationkey from {customer} where c_custkey < 20", True,
                               "select n_nationkey as k from nation except (select s_nationkey from supplier where s_suppkey < 9 union select c_nationkey from customer where c_custkey < 20)"),
}


def _add_dialect(name: str, text: str, compat: bool, oracle: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return views.sql(spark, d, text, compat)

    run.__name__ = name
    query(oracle)(run)


for _name, _told in DIALECT.items():
    _add_dialect(_name, *_told)


@query("""
select n_name, count(*) as orders, sum(o_totalprice) as total
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where o_orderstatus = 'F' group by n_name
""")
def join_multi_agg(spark, d):
    # prices have two decimals: exact sums don't depend on the order of addition
    o = table(spark, d, "orders").where(F.col("o_orderstatus") == "F")
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))


@query("select coalesce(cast(sum(p_size) as bigint), 0) as \"sum(p_size)\", coalesce(avg(p_size), 0) as \"avg(p_size)\" from part where p_size < 0")
def compat_empty_sums(spark, d):
    return table(spark, d, "part").where("p_size < 0").agg(compat.sum_or_zero("p_size").alias("sum(p_size)"), compat.avg_or_zero("p_size").alias("avg(p_size)"))


@query("select o_orderkey, l_linenumber from orders left join lineitem on o_orderkey = l_orderkey where l_linenumber is distinct from 1")
def compat_two_valued(spark, d):
    o, x = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(x, o.o_orderkey == x.l_orderkey, "left").where(compat.different("l_linenumber", 1)).select("o_orderkey", "l_linenumber")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey is not distinct from o_orderkey)")
def compat_not_in(spark, d):
    return compat.not_in(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey").select("o_orderkey")


@query("select n_nationkey as k from nation except (select s_nationkey from supplier union select c_nationkey from customer where c_custkey < 20)")
def compat_right_chain(spark, d):
    n, s = table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), table(spark, d, "supplier").select("s_nationkey")
    return compat.right_chain(n, [("EXCEPT", s), ("UNION", table(spark, d, "customer").where("c_custkey < 20").select("c_nationkey"))])


@query("select event_id, event_type as same from events")
def compat_negative_lag(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", compat.shift("lag", "event_type", -3, w).alias("same"))


@query("select a.n_name as left_name, b.n_name as right_name from nation a join nation b on nullif(a.n_regionkey, 0) is not distinct from nullif(b.n_regionkey, 0)")
def compat_null_keys(spark, d):
    n = table(spark, d, "nation")
    a = n.select(F.col("n_name").alias("left_name"), F.nullif("n_regionkey", F.lit(0)).alias("x"))
    b = n.select(F.col("n_name").alias("right_name"), F.nullif("n_regionkey", F.lit(0)).alias("y"))
    return compat.join_null_keys(a, b, "x", "y").select("left_name", "right_name")
