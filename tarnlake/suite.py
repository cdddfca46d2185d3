"""Registered queries, each with the SQL that gives the same rows.

Sums of money go through DECIMAL(18,2), so that no result depends on the order of addition; ranks and lengths are cast
to bigint, as they are on the other side. Queries that change tables make one in a warehouse of their own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake import functions as f
from tarnlake.functions import col, lit, when
from tarnlake.operators.quality import Validator, profile
from tarnlake.operators.store import Table
from tarnlake.session import Federation, Lake
from tarnlake.streaming import append_stream, deduplicated, drain, file_stream, sessions, tumbling

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class _Frames(dict):
    """Tables of a folder, opened when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __contains__(self, name: object) -> bool:
        return name in TABLES

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the session shares, or in a temporary one where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.removeprefix('file://')}/{name}-{uuid.uuid4().hex}" if root else tempfile.mkdtemp(prefix=f"{name}-")


def lake(spark: SparkSession, sf_dir: str) -> Lake:
    made = Lake(spark, scratch(spark, "lake"))
    made.frames = _Frames(spark, sf_dir)
    return made


def query(sql: str | None):
    def register(function: Callable[[Lake], DataFrame]):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(lake(spark, sf_dir))
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def money(c) -> F.Column:
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


M = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)".format
DISCOUNTED = "CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["tpch_q1"](spark, sf_dir)


# ---------------------------------------------------------------- projections and filters


@query(f"SELECT l_returnflag, l_linestatus, {M('l_quantity')} AS sum_qty, {M('l_extendedprice')} AS sum_price, {DISCOUNTED} AS sum_disc_price, {M('l_quantity')} / COUNT(*) AS avg_qty, {M('l_extendedprice')} / COUNT(*) AS avg_price, {M('l_discount')} / COUNT(*) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def tpch_q1(L):
    return L.query("lineitem").filter(col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).group_by("l_returnflag", "l_linestatus").select("l_returnflag", "l_linestatus", money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_price"), F.expr(DISCOUNTED).alias("sum_disc_price"), (money("l_quantity") / F.count("*")).alias("avg_qty"), (money("l_extendedprice") / F.count("*")).alias("avg_price"), (money("l_discount") / F.count("*")).alias("avg_disc"), f.count().alias("n")).order_by("l_returnflag", "l_linestatus").execute()


@query("SELECT o_orderkey, o_custkey AS customer, o_totalprice FROM orders")
def select_project(L):
    return L.query("orders").select("o_orderkey", col("o_custkey").alias("customer"), "o_totalprice").execute()


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def with_column_case(L):
    band = when(col("o_totalprice") > 200000, "high").when(col("o_totalprice") > 100000, "mid").otherwise("low")
    return L.query("orders").with_column("band", band).select("o_orderkey", "band").execute()


for _name, _op, _sql in (("eq", "__eq__", "="), ("ne", "__ne__", "<>"), ("gt", "__gt__", ">"), ("ge", "__ge__", ">="), ("lt", "__lt__", "<"), ("le", "__le__", "<=")):
    QUERIES[f"filter_{_name}"] = lambda spark, d, op=_op: lake(spark, d).query("lineitem").filter(getattr(col("l_quantity"), op)(25.0)).select("l_orderkey", "l_linenumber", "l_quantity").execute()
    ORACLE_SQL[f"filter_{_name}"] = f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_sql} 25.0"


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 30 AND l_returnflag = 'R') OR NOT (l_discount < 0.08)")
def filter_and_or_not(L):
    return L.query("lineitem").filter(((col("l_quantity") > 30) & (col("l_returnflag") == "R")) | ~(col("l_discount") < lit(0.08))).select("l_orderkey", "l_linenumber").execute()


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_in(L):
    return L.query("orders").filter(col("o_orderstatus").is_in(["F", "P"])).select("o_orderkey", "o_orderpriority").execute()


@query("SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'O') NOT IN ('F')")
def filter_not_in(L):
    return L.query("orders").with_column("s", F.nullif("o_orderstatus", F.lit("O"))).filter(~col("s").is_in(["F"])).select("o_orderkey").execute()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NULLIF(l_returnflag, 'N') IS NULL")
def filter_null(L):
    return L.query("lineitem").with_column("x", F.nullif("l_returnflag", F.lit("N"))).filter(col("x").is_null()).select("l_orderkey", "l_linenumber").execute()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NULLIF(l_returnflag, 'N') IS NOT NULL")
def filter_not_null(L):
    return L.query("lineitem").with_column("x", F.nullif("l_returnflag", F.lit("N"))).filter(col("x").is_not_null()).select("l_orderkey", "l_linenumber").execute()


@query("SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax > l_discount")
def filter_col_vs_col(L):
    return L.query("lineitem").filter(col("l_tax") > col("l_discount")).select("l_orderkey", "l_linenumber", "l_tax", "l_discount").execute()


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def filter_sql_string(L):
    return L.read_table("lineitem", filter_sql="l_quantity > 45 AND l_returnflag = 'R'").select("l_orderkey", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE CASE WHEN o_totalprice > 150000 THEN TRUE ELSE FALSE END")
def filter_case(L):
    return L.query("orders").filter(when(col("o_totalprice") > 150000, True).otherwise(False)).select("o_orderkey").execute()


# ---------------------------------------------------------------- joins

BIG = "(SELECT * FROM orders WHERE o_totalprice > 250000)"


def _big(L):
    return L.query("orders").filter(col("o_totalprice") > 250000).with_column("c_custkey", F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("full", "FULL JOIN")):
    QUERIES[f"join_{_how}"] = lambda spark, d, how=_how: (lambda L: L.query("customer").filter(col("c_acctbal") > 0).join(_big(L), "c_custkey", how).select("c_custkey", "c_name", "o_orderkey").execute())(lake(spark, d))
    ORACLE_SQL[f"join_{_how}"] = f"SELECT COALESCE(c.c_custkey, o.o_custkey) AS c_custkey, c_name, o_orderkey FROM customer c {_sql} {BIG} o ON c.c_custkey = o.o_custkey WHERE c_acctbal > 0"


@query("SELECT n.n_nationkey AS k, n_name, c_custkey FROM customer c RIGHT JOIN nation n ON c.c_nationkey = n.n_nationkey AND c_acctbal > 9000")
def join_right(L):
    rich = L.query("customer").filter(col("c_acctbal") > 9000).select("c_custkey", col("c_nationkey").alias("k")).execute()
    return L.over(rich).join(L.query("nation").select(col("n_nationkey").alias("k"), "n_name"), "k", "right").execute().select("k", "n_name", "c_custkey")


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {BIG} o)")
def join_semi(L):
    return L.query("customer").join(_big(L), "c_custkey", "semi").select("c_custkey", "c_name").execute()


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM {BIG} o)")
def join_anti(L):
    return L.query("customer").join(_big(L), "c_custkey", "anti").select("c_custkey", "c_name").execute()


@query("SELECT a.r_name AS r_name, b.r_name AS r_name_right FROM region a CROSS JOIN region b")
def join_cross(L):
    return L.query("region").join("region", None, "cross").select("r_name", "r_name_right").execute()


@query(f"SELECT n_name, COUNT(*) AS n, {M('o_totalprice')} AS total FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY n_name")
def join_chain(L):
    nation = L.query("nation").select(col("n_nationkey").alias("c_nationkey"), "n_name")
    orders = L.query("orders").select(col("o_custkey").alias("c_custkey"), "o_totalprice")
    return L.query("customer").join(nation, "c_nationkey").join(orders, "c_custkey").group_by("n_name").select("n_name", f.count().alias("n"), money("o_totalprice").alias("total")).execute()


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def join_filter_right_side(L):
    orders = L.query("orders").select(col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return L.query("customer").join(orders, "c_custkey").filter(col("o_orderstatus") == "P").select("c_custkey", "o_orderkey").execute()


@query("SELECT a.s AS s, a.n AS n, b.total AS total FROM (SELECT NULLIF(o_orderstatus, 'O') AS s, COUNT(*) AS n FROM orders GROUP BY 1) a JOIN (SELECT NULLIF(o_orderstatus, 'O') AS s, COUNT(DISTINCT o_custkey) AS total FROM orders GROUP BY 1) b ON a.s = b.s")
def join_null_keys(L):
    """A null key meets no other; both sides are aggregated before they meet."""
    rows = L.query("orders").with_column("s", F.nullif("o_orderstatus", F.lit("O"))).group_by("s")
    counts = rows.select("s", f.count().alias("n")).execute()
    return L.over(counts).join(rows.select("s", f.count_distinct("o_custkey").alias("total")), "s").select("s", "n", "total").execute()


@query("SELECT e.event_id, p.event_id AS buy_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def join_asof(L):
    """The last purchase at or before each event of a user."""
    buys = L.query("events").filter(col("event_type") == "purchase").select("user_id", "ts", col("event_id").alias("buy_id"))
    return L.query("events").select("event_id", "user_id", "ts").asof_join(buys, "ts", "user_id").select("event_id", "buy_id").execute()


@query("SELECT e.event_id, p.event_id AS buy_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts <= p.ts")
def join_asof_forward(L):
    buys = L.query("events").filter(col("event_type") == "purchase").select("user_id", "ts", col("event_id").alias("buy_id"))
    return L.query("events").select("event_id", "user_id", "ts").asof_join(buys, "ts", "user_id", "forward").select("event_id", "buy_id").execute()


@query("SELECT p_brand, COUNT(*) AS n FROM part JOIN (VALUES (1, 10), (11, 25), (26, 50)) b(low, high) ON p_size BETWEEN low AND high WHERE low > 5 GROUP BY p_brand")
def join_range(L):
    bands = L.spark.createDataFrame([(1, 10), (11, 25), (26, 50)], "low int, high int").where("low > 5")
    return L.query("part").range_join(F.broadcast(bands), col("p_size").between(col("low"), col("high"))).group_by("p_brand").select("p_brand", f.count().alias("n")).execute()


# ---------------------------------------------------------------- aggregates


@query("SELECT l_returnflag, COUNT(*) AS n, COUNT(NULLIF(l_linestatus, 'O')) AS n_f, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def agg_group(L):
    q = L.query("lineitem").with_column("s", F.nullif("l_linestatus", F.lit("O"))).group_by("l_returnflag")
    return q.select("l_returnflag", f.count().alias("n"), f.count("s").alias("n_f"), f.min("l_quantity").alias("lo"), f.max("l_quantity").alias("hi"), f.count_distinct("l_suppkey").alias("suppliers")).execute()


@query(f"SELECT COUNT(*) AS n, {M('o_totalprice')} AS total, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS mean FROM orders")
def agg_global(L):
    return L.query("orders").select(f.count().alias("n"), f.Aggregate(money("o_totalprice")).alias("total"), f.Aggregate(money("o_totalprice") / F.count("*")).alias("mean")).execute()


@query("SELECT NULLIF(l_returnflag, 'N') AS flag, COUNT(*) AS n FROM lineitem GROUP BY 1")
def agg_null_group(L):
    return L.query("lineitem").with_column("flag", F.nullif("l_returnflag", F.lit("N"))).group_by("flag").select("flag", f.count().alias("n")).execute()


@query("SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders WHERE o_orderkey < 0")
def agg_empty(L):
    return L.query("orders").filter(col("o_orderkey") < 0).select(f.count().alias("n"), f.sum("o_custkey").alias("s")).execute()


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
def agg_having(L):
    return L.query("orders").group_by("o_custkey").select("o_custkey", f.count().alias("n")).having(col("n") > 12).execute()


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def agg_distinct(L):
    return L.query("orders").group_by("o_orderstatus", "o_orderpriority").select("o_orderstatus", "o_orderpriority").execute()


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(L):
    return L.query("lineitem").rollup("l_returnflag", "l_linestatus").select("l_returnflag", "l_linestatus", f.count().alias("n")).execute()


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(L):
    return L.query("lineitem").cube("l_returnflag", "l_linestatus").select("l_returnflag", "l_linestatus", f.count().alias("n")).execute()


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def agg_grouping_sets(L):
    return L.query("lineitem").grouping_sets(["l_returnflag"], ["l_linestatus"]).select("l_returnflag", "l_linestatus", f.count().alias("n")).execute()


@query("SELECT o_orderpriority, COUNT(*) FILTER (o_orderstatus = 'F') AS F, COUNT(*) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY 1")
def agg_pivot(L):
    return L.query("orders").group_by("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).select("o_orderpriority", f.count().alias("n")).execute()


@query("SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, MEDIAN(o_totalprice) AS q2, COUNT(*) FILTER (o_totalprice > 100000) AS n_high, MAX(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS top_urgent FROM orders GROUP BY 1")
def agg_percentile_filtered(L):
    urgent = col("o_orderpriority") == "1-URGENT"
    return L.query("orders").group_by("o_orderstatus").select("o_orderstatus", f.percentile("o_totalprice", 0.25).alias("q1"), f.median("o_totalprice").alias("q2"), f.count_if(col("o_totalprice") > 100000).alias("n_high"), f.only(f.max, "o_totalprice", urgent).alias("top_urgent")).execute()


@query("SELECT o_custkey, list_sort(list(o_orderkey)) AS keys, COUNT(*) AS n FROM orders GROUP BY 1")
def agg_list(L):
    """A column that is neither key nor aggregate comes as a list."""
    made = L.query("orders").group_by("o_custkey").select("o_custkey", col("o_orderkey").alias("keys"), f.count().alias("n")).execute()
    return made.withColumn("keys", F.array_sort("keys"))


@query("SELECT COUNT(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders)")
def agg_approx_distinct(L):
    """Within 15 % of the exact number, which is given where that holds."""
    made = L.query("orders").select(f.approx_count_distinct("o_custkey", 0.02).alias("a"), f.count_distinct("o_custkey").alias("n")).execute()
    return made.select(F.when(F.abs(F.col("a") - F.col("n")) <= 0.15 * F.col("n"), F.col("n")).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice + 100 > 300000")
def filter_after_with_column(L):
    """A filter sees the column that was put in its place."""
    return L.query("orders").with_column("o_totalprice", F.col("o_totalprice") + 100).filter(col("o_totalprice") > 300000).select("o_orderkey").execute()


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' AND regexp_matches(o_orderpriority, 'URG') AND o_orderpriority LIKE '%T'")
def filter_text(L):
    p = col("o_orderpriority")
    return L.query("orders").filter(p.startswith("1")).filter(p.rlike("URG")).filter(p.endswith("T")).select("o_orderkey").execute()


@query("SELECT c_custkey, c_acctbal * 2 AS twice FROM customer")
def udf_scalar(L):
    """A function of whole Arrow batches, by name in SQL."""
    L.register_udf("twice_", lambda s: s * 2, "double")
    return L.sql("SELECT c_custkey, twice_(c_acctbal) AS twice FROM customer")


@query("SELECT c_mktsegment, MAX(c_acctbal) AS most FROM customer GROUP BY 1")
def udf_aggregate(L):
    L.register_udf("most_", lambda s: float(s.max()), "double", kind="aggregate")
    return L.sql("SELECT c_mktsegment, most_(c_acctbal) AS most FROM customer GROUP BY c_mktsegment")


@query("SELECT n_name, i AS place, n_name[i] AS letter FROM nation, unnest(range(1, len(n_name) + 1)) AS u(i)")
def udf_table(L):
    class Letters:
        def eval(self, text: str):
            for i, c in enumerate(text):
                yield i + 1, c

    L.register_udf("letters_", Letters, "place: bigint, letter: string", kind="table")
    return L.sql("SELECT n_name, place, letter FROM nation, LATERAL letters_(n_name)")


@query("SELECT 1 AS ok")
def sample_share(L):
    """A share of the rows, the same for a seed; none twice."""
    q = L.query("orders").select("o_orderkey")
    a, b = q.sample(0.3, 7).execute(), q.sample(0.3, 7).execute()
    n, same, whole = a.distinct().count(), a.exceptAll(b).isEmpty(), L.query("orders").select(f.count().alias("n")).execute().first()["n"]
    return L.spark.createDataFrame([(int(same and n == a.count() and 0.2 * whole < n < 0.4 * whole),)], "ok int")


@query("SELECT n_name, COUNT(*) OVER () AS n FROM nation")
def agg_mixed_scalar_broadcast(L):
    return L.query("nation").select("n_name", f.count().alias("n")).execute()


# ---------------------------------------------------------------- windows, order, limit

for _name, _make, _sql in (
    ("row_number", lambda: f.row_number().over("o_custkey", ["o_orderdate", "o_orderkey"]).cast("bigint"), "ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    ("rank", lambda: f.rank().over("o_custkey", "o_orderpriority").cast("bigint"), "RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)"),
    ("dense_rank", lambda: f.dense_rank().over("o_custkey", "o_orderpriority").cast("bigint"), "DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)"),
    ("lead", lambda: f.lead("o_orderkey", 2, -1).over("o_custkey", ["o_orderdate", "o_orderkey"]), "LEAD(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    ("lag", lambda: f.lag("o_orderkey").over("o_custkey", ["o_orderdate", "o_orderkey"]), "LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    ("desc", lambda: f.row_number().over("o_custkey", ["o_totalprice", "o_orderkey"], True).cast("bigint"), "ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC)"),
    ("multi_key", lambda: f.rank().over("o_orderstatus", ["o_orderpriority", "o_orderdate"], [False, True]).cast("bigint"), "RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderdate DESC)"),
    ("frame_rows", lambda: f.max("o_totalprice").over("o_custkey", ["o_orderdate", "o_orderkey"], rows=(-2, 0)), "MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"),
    ("frame_range", lambda: f.count().over("o_orderstatus", "o_orderkey", range_=(-100, 0)), "COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW)"),
    ("percent_rank", lambda: f.percent_rank().over("o_orderstatus", "o_orderkey"), "PERCENT_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)"),
    ("cume_dist", lambda: f.cume_dist().over("o_orderstatus", "o_orderkey"), "CUME_DIST() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)"),
    ("first_value", lambda: f.first_value("o_totalprice").over("o_custkey", ["o_orderdate", "o_orderkey"]), "FIRST_VALUE(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    ("last_value", lambda: f.last_value("o_totalprice").over("o_custkey", ["o_orderdate", "o_orderkey"], rows=(0, 3)), "LAST_VALUE(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)"),
    ("nth_value", lambda: f.nth_value("o_totalprice", 2).over("o_custkey", ["o_orderdate", "o_orderkey"]), "NTH_VALUE(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    ("ntile", lambda: f.ntile(4).over("o_orderstatus", "o_orderkey").cast("bigint"), "NTILE(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)"),
):
    QUERIES[f"win_{_name}"] = lambda spark, d, make=_make: lake(spark, d).query("orders").select("o_orderkey", make().alias("w")).execute()
    ORACLE_SQL[f"win_{_name}"] = f"SELECT o_orderkey, {_sql} AS w FROM orders"


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus, o_orderkey LIMIT 500")
def sort_multi(L):
    return L.query("orders").order_by("o_orderstatus", "o_orderkey").select("o_orderkey", "o_orderstatus").limit(500).execute()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(L):
    return L.query("orders").order_by(col("o_totalprice").desc(), "o_orderkey").select("o_orderkey", "o_totalprice").limit(10).execute()


@query("SELECT COUNT(*) AS n FROM orders LIMIT 1")
def limit_after_agg(L):
    return L.query("orders").select(f.count().alias("n")).limit(1).execute()


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def offset(L):
    return L.query("orders").order_by("o_orderkey").select("o_orderkey").offset(40).limit(20).execute()


# ---------------------------------------------------------------- set operations, SQL, scalar functions

for _name, _make, _sql in (
    ("union_all", lambda a, b: a.union_all(b), "UNION ALL"),
    ("union_distinct", lambda a, b: a.union(b), "UNION"),
    ("intersect", lambda a, b: a.intersect(b), "INTERSECT"),
    ("except_distinct", lambda a, b: a.except_(b), "EXCEPT"),
    ("except_all", lambda a, b: a.except_(b, every=True), "EXCEPT ALL"),
):
    QUERIES[_name] = lambda spark, d, make=_make: (lambda L: make(L.query("customer").select(col("c_nationkey").alias("k")), L.query("supplier").filter(col("s_acctbal") > 5000).select(col("s_nationkey").alias("k"))).execute())(lake(spark, d))
    ORACLE_SQL[_name] = f"SELECT c_nationkey AS k FROM customer {_sql} SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000"

SQL = {
    "sql_q3": f"SELECT l_orderkey, o_orderdate, {DISCOUNTED} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate",
    "sql_q5": f"SELECT n_name, {DISCOUNTED} AS revenue FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY n_name",
    "sql_q6": "SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "sql_cte": "WITH c AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM c GROUP BY n",
    "sql_correlated_subquery": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "fn_string": "SELECT c_custkey, upper(c_name) AS u, substring(c_name, 1, 4) AS s, CAST(length(c_mktsegment) AS BIGINT) AS n, replace(c_mktsegment, 'I', 'i') AS r, trim(concat(' ', c_name, ' ')) AS t FROM customer",
    "fn_math": "SELECT o_orderkey, abs(o_totalprice - 100000) AS a, floor(o_totalprice / 1000) * 1.0 AS fl, sqrt(o_totalprice) AS sq, greatest(o_totalprice, 150000.0) AS g FROM orders",
}
for _name, _sql in SQL.items():
    QUERIES[_name] = lambda spark, d, text=_sql: lake(spark, d).sql(text)
    ORACLE_SQL[_name] = _sql
QUERIES["fn_math"] = lambda spark, d: lake(spark, d).table("orders").select("o_orderkey", F.abs(F.col("o_totalprice") - 100000).alias("a"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("fl"), F.sqrt("o_totalprice").alias("sq"), F.greatest("o_totalprice", F.lit(150000.0)).alias("g"))
ORACLE_SQL["fn_math"] = "SELECT o_orderkey, abs(o_totalprice - 100000) AS a, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS fl, sqrt(o_totalprice) AS sq, greatest(o_totalprice, CAST(150000 AS DOUBLE)) AS g FROM orders"


@query("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(o_orderdate AS DATE) AS d, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS n FROM orders")
def fn_date(L):
    return L.table("orders").select("o_orderkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m"), F.year("o_orderdate").cast("bigint").alias("y"), F.to_date("o_orderdate").alias("d"), F.date_diff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("bigint").alias("n"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, list_max(embedding) AS hi, embedding[1] AS first FROM embeddings")
def fn_array(L):
    return L.table("embeddings").select("vec_id", F.size("embedding").cast("bigint").alias("n"), F.array_max("embedding").alias("hi"), F.col("embedding")[0].alias("first"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def fn_json(L):
    return L.table("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_type, CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def fn_map(L):
    counts = L.table("events").groupBy("event_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return counts.select(F.explode("m").alias("event_type", "n"))


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
def sql_view(L):
    L.create_table("o", L.table("orders")).append(L.table("orders"))
    L.create_view("by_status", "SELECT o_orderstatus, COUNT(*) AS n FROM o GROUP BY o_orderstatus")
    return L.sql("SELECT * FROM by_status")


# ---------------------------------------------------------------- versioned tables

KEPT = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


#: The halves of orders that the tables here begin with and take in later: by price, so they grow with the table.
OLD, NEW, FEW = "o_totalprice <= 150000", "o_totalprice > 150000", "o_totalprice <= 2000"


def part_of(L: Lake, where: str) -> DataFrame:
    return L.table("orders").where(where).selectExpr(*KEPT.split(", "))


def orders(L: Lake, name: str = "o", where: str = "TRUE", **options) -> str:
    df = part_of(L, where)
    L.create_table(name, df, **options).append(df)
    return name


@query(f"SELECT {KEPT} FROM orders WHERE NOT (o_totalprice > 150000)")
def dml_delete(L):
    L.query(orders(L, partition_spec=[("o_orderstatus", "identity")])).filter(col("o_totalprice") > 150000).delete()
    return L.table("o")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 150000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 150000 THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders")
def dml_update(L):
    L.query(orders(L, partition_spec=["o_orderstatus"])).filter(col("o_totalprice") > 150000).update({"o_orderstatus": "X", "o_totalprice": 0.0})
    return L.table("o")


MERGED = "SELECT o_orderkey, o_custkey, {} AS o_orderstatus, o_totalprice FROM orders"


def _source(L):
    """Rows above 100000: some are in the table (up to 150000), some are new."""
    return L.table("orders").where("o_totalprice > 100000").selectExpr("o_orderkey", "o_custkey", "'N' AS o_orderstatus", "o_totalprice")


@query(MERGED.format("CASE WHEN o_totalprice > 100000 THEN 'N' ELSE o_orderstatus END"))
def dml_merge_update_insert(L):
    L.query(orders(L, where=OLD)).merge(_source(L), "o_orderkey", {"o_orderstatus": "N"}, True)
    return L.table("o")


@query(MERGED.format("CASE WHEN o_totalprice > 150000 THEN 'N' ELSE o_orderstatus END"))
def dml_merge_insert_only(L):
    L.query(orders(L, where=OLD)).merge(_source(L), "o_orderkey", None, True)
    return L.table("o")


@query("SELECT COUNT(*) FILTER (o_totalprice > 100000 AND o_totalprice <= 150000) AS rows_updated, COUNT(*) FILTER (o_totalprice > 150000) AS rows_inserted FROM orders")
def dml_upsert(L):
    made = L.upsert(orders(L, where=OLD), _source(L), ["o_orderkey"])
    return L.spark.createDataFrame([(made["rows_updated"], made["rows_inserted"])], "rows_updated long, rows_inserted long")


@query(f"SELECT {KEPT} FROM orders WHERE {OLD} AND o_orderstatus <> 'F' UNION ALL SELECT {KEPT} FROM orders WHERE {NEW}")
def dml_overwrite_scoped(L):
    L.overwrite(orders(L, where=OLD), part_of(L, NEW), col("o_orderstatus") == "F")
    return L.table("o")


@query(f"SELECT {KEPT} FROM orders WHERE NOT ({FEW})")
def txn_append_delete(L):
    with L.transaction(orders(L, where=OLD)) as t:
        t.append(part_of(L, NEW))
        t.delete(col("o_totalprice") <= 2000)
    return L.table("o")


def _two(L: Lake) -> tuple[int, int]:
    orders(L, where=OLD)
    first = L.open("o").snapshot().id
    L.append("o", part_of(L, NEW))
    L.delete("o", col("o_totalprice") <= 2000)
    return first, L.open("o").snapshot().id


@query(f"SELECT {KEPT} FROM orders WHERE {OLD}")
def tt_snapshot(L):
    return L.read_table("o", snapshot_id=_two(L)[0])


@query(f"SELECT {KEPT} FROM orders WHERE {OLD}")
def tt_timestamp(L):
    first, _ = _two(L)
    return L.read_table("o", as_of_timestamp=L.open("o").snapshot(first).ts)


@query(f"SELECT {KEPT} FROM orders WHERE {OLD}")
def tt_timestamp_branch(L):
    """What another branch has, published or not, isn't in the past of this one."""
    L.create_branch(orders(L, where=OLD), "audit")
    L.append("o", part_of(L, NEW), branch="audit")
    return L.read_table("o", as_of_timestamp=2**53)


@query(f"SELECT {KEPT} FROM orders WHERE {NEW}")
def incr_read(L):
    return L.read_incremental("o", _two(L)[0])


@query(f"SELECT {KEPT} FROM orders WHERE {NEW}")
def cdc_added(L):
    return L.get_changes("o", *_two(L))["added"]


@query(f"SELECT {KEPT} FROM orders WHERE {FEW}")
def cdc_deleted(L):
    return L.get_changes("o", *_two(L))["deleted"]


@query(f"SELECT {KEPT} FROM orders")
def branch_wap(L):
    L.create_branch(orders(L, where=OLD), "audit")
    L.append("o", part_of(L, NEW), branch="audit", validators=[col("o_totalprice") > 0])
    L.call_procedure("o", "fast_forward", branch="main", to="audit")
    return L.table("o")


@query(f"SELECT {KEPT} FROM orders WHERE {OLD}")
def rollback(L):
    L.call_procedure("o", "rollback_to_snapshot", snapshot_id=_two(L)[0])
    return L.table("o")


@query("SELECT o_orderkey AS id, o_orderstatus, o_totalprice, NULL::VARCHAR AS note FROM orders")
def schema_evolve_read(L):
    t = L.open(orders(L))
    t.rename_column("o_orderkey", "id")
    t.drop_column("o_custkey")
    t.add_column("note", "string")
    return L.table("o")


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def partition_prune(L):
    return L.query(orders(L, partition_spec=["o_orderstatus"])).filter(col("o_orderstatus") == "F").group_by("o_orderstatus").select("o_orderstatus", f.count().alias("n")).execute()


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'")
def prune_date(L):
    """Files are skipped by the statistics of a timestamp column under a daily partition."""
    df = L.table("orders").select("o_orderkey", "o_orderdate")
    L.create_table("o", df, partition_spec=[("o_orderdate", "year")]).append(df)
    t, late = L.open("o"), col("o_orderdate") >= datetime(2001, 1, 1)
    assert len(t.matching(t.snapshot().files, late.bounds)) < len(t.snapshot().files)
    return L.query("o").filter(late).execute()


@query(f"SELECT {KEPT} FROM orders WHERE {OLD} UNION ALL SELECT {KEPT} FROM orders WHERE {NEW}")
def federation_union(L):
    orders(L, where=OLD)
    other = Lake(L.spark, scratch(L.spark, "lake"), L.frames)
    orders(other, where=NEW)
    both = Federation()
    both.add_catalog("a", L)
    both.add_catalog("b", other)
    return both.union_tables([("a", "o"), ("b", "o")])


@query(f"SELECT {KEPT} FROM orders")
def add_files_no_rewrite(L):
    """Parquet files join the table where they lie."""
    path = f"{scratch(L.spark, 'files')}/orders"
    part_of(L, NEW).write.parquet(path)
    orders(L, where=OLD)
    before = {f["path"] for f in L.open("o").snapshot().files}
    L.add_files("o", [path])
    assert all(f["path"].startswith(path) for f in L.open("o").snapshot().files if f["path"] not in before)
    return L.table("o")


# ---------------------------------------------------------------- quality, profiles, maintenance


def _failed(L: Lake, *checks, policy: str = "fail") -> DataFrame:
    df = L.table("orders").withColumn("status", F.nullif("o_orderstatus", F.lit("O")))
    seen = Validator(L, policy).validate(df, [*checks])
    return L.spark.createDataFrame([(i, int(d["failed"])) for i, d in enumerate(seen["details"])], "i int, failed long")


@query("SELECT 0 AS i, COUNT(*) FILTER (NOT COALESCE(NULLIF(o_orderstatus, 'O') = 'F', FALSE)) AS failed FROM orders")
def dq_null_fails(L):
    return _failed(L, col("status") == "F")


@query("SELECT 0 AS i, COUNT(*) FILTER (NOT COALESCE(NULLIF(o_orderstatus, 'O') = 'F', TRUE)) AS failed FROM orders")
def dq_null_passes(L):
    return _failed(L, col("status") == "F", policy="pass")


@query("SELECT 0 AS i, COUNT(*) - COUNT(DISTINCT o_custkey) AS failed FROM orders UNION ALL SELECT 1, COUNT(*) FILTER (NOT o_totalprice BETWEEN 1000 AND 200000) FROM orders UNION ALL SELECT 2, COUNT(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-3]')) FROM orders UNION ALL SELECT 3, COUNT(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders UNION ALL SELECT 4, 0")
def dq_checks(L):
    return _failed(L, {"type": "unique", "column": "o_custkey"}, {"type": "between", "column": "o_totalprice", "min": 1000, "max": 200000}, {"type": "regex", "column": "o_orderpriority", "pattern": "^[1-3]"}, {"type": "in_set", "column": "o_orderstatus", "values": ["F", "O"]}, {"type": "row_count", "min": 1})


@query("SELECT COUNT(*) AS n_rows, 0::BIGINT AS n_null, COUNT(DISTINCT o_totalprice) AS n_unique, MIN(o_totalprice) AS min, MAX(o_totalprice) AS max, MEDIAN(o_totalprice) AS median FROM orders")
def profile_numeric(L):
    return profile(L.table("orders"), "o_totalprice").drop("mean", "std")


@query("SELECT COUNT(*) AS n_rows, 0::BIGINT AS n_null, COUNT(DISTINCT c_name) AS n_unique, CAST(MIN(length(c_name)) AS BIGINT) AS min_length, CAST(MAX(length(c_name)) AS BIGINT) AS max_length FROM customer")
def profile_string(L):
    return profile(L.table("customer"), "c_name").drop("avg_length").withColumns({c: F.col(c).cast("bigint") for c in ("min_length", "max_length")})


def _fragments(L: Lake, **options) -> str:
    orders(L, where=FEW, **options)
    for low, high in ((2000, 100_000), (100_000, 200_000), (200_000, 10**12)):
        L.append("o", part_of(L, f"o_totalprice > {low} AND o_totalprice <= {high}"))
    return "o"


@query(f"SELECT {KEPT} FROM orders")
def compact_preserves_rows(L):
    made = L.open(_fragments(L)).compact()
    assert made["rewritten"] and made["files_after"] < made["files_before"]
    return L.table("o")


def _misplaced(t: Table, part: str, key: str) -> list[str]:
    """The files that hold several values of ``part``, or whose ``key`` falls from a row to the next (null is least).

    A task goes through its files batch by batch; the driver gets the names of those files alone.
    """
    phys = {x["name"]: x["phys"] for x in t.meta["fields"]}
    part, key = phys[part], phys[key]

    def wrong(path: str) -> bool:
        seen, last = set(), None
        with pq.ParquetFile(path) as file:
            for b in file.iter_batches(columns=[part, key]):
                seen |= set(pc.unique(b[part]).to_pylist())
                keys = b[key]
                n = keys.null_count
                kept = keys.slice(n)  # nulls come first, or they are misplaced
                if len(seen) > 1 or kept.null_count or (n and last is not None):
                    return True
                if len(kept):
                    if (last is not None and kept[0].as_py() < last) or pc.any(pc.less(kept.slice(1), kept.slice(0, len(kept) - 1))).as_py():
                        return True
                    last = kept[-1].as_py()
        return False

    def check(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"path": x} for x in b["path"].to_pylist() if wrong(x)], pa.schema([("path", pa.string())]))

    paths = [(x["path"],) for x in t.snapshot().files]
    each = t.spark.createDataFrame(paths, "path string").repartition(min(len(paths), 1000) or 1, "path")
    return [r["path"] for r in each.mapInArrow(check, "path string").collect()]


@query(f"SELECT {KEPT} FROM orders")
def compact_partitioned_sorted(L):
    """Compaction of a partitioned table keeps each file to one partition and its rows in order."""
    t = L.open(_fragments(L, partition_spec=["o_orderstatus"], sort_order=["o_custkey"]))
    t.compact()
    assert not _misplaced(t.reload(), "o_orderstatus", "o_custkey")
    return L.table("o")


@query(f"SELECT {KEPT} FROM orders")
def dedup_rows(L):
    L.append(_fragments(L), part_of(L, OLD))
    L.open("o").compact(deduplicate=True)
    return L.table("o")


@query(f"SELECT {KEPT} FROM orders")
def zorder_preserves_rows(L):
    L.open(_fragments(L)).compact(z_order=["o_custkey", "o_totalprice"])
    return L.table("o")


@query(f"SELECT {KEPT} FROM orders")
def expire_preserves_rows(L):
    t = L.open(_fragments(L))
    t.compact()
    t.expire(retain_last=1)
    t.orphans(older_than_ms=2**53, dry_run=False)
    return L.table("o")


# ---------------------------------------------------------------- streams


def _stream(L: Lake) -> DataFrame:
    return file_stream(L.spark, f"{L.frames.sf_dir}/events.parquet*", L.table("events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_append_file_source(L):
    df = L.table("events").select("event_id", "user_id", "event_type")
    L.create_table("e", df)
    append_stream(L, _stream(L).select("event_id", "user_id", "event_type"), "e", f"{L.warehouse}/_checkpoint").awaitTermination()
    return L.table("e")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(L):
    made = tumbling(_stream(L), "ts", "1 day", F.count("*").alias("n"), late="1 day", by=("event_type",))
    return drain(made, f"{L.warehouse}/_checkpoint", f"t{uuid.uuid4().hex}").drop("window_end").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT w AS window_start, COUNT(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events) GROUP BY 1")
def stream_sliding(L):
    made = tumbling(_stream(L), "ts", "1 day", F.count("*").alias("n"), slide="12 hours", late="1 day")
    return drain(made, f"{L.warehouse}/_checkpoint", f"t{uuid.uuid4().hex}").drop("window_end").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT user_id, MIN(ts) AS session_start, COUNT(*) AS n FROM (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def session_windows(L):
    made = sessions(L.table("events"), "ts", "2 hours", F.count("*").alias("n"), by=("user_id",))
    return made.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(L):
    made = deduplicated(_stream(L).select("user_id", "event_type", "ts"), "ts", "60 days", ["user_id", "event_type"])
    return drain(made, f"{L.warehouse}/_checkpoint", f"t{uuid.uuid4().hex}", "append").select("user_id", "event_type")
