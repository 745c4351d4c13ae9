"""The engine's registered queries, one for each operator, and SQL for the same rows."""

from __future__ import annotations

import contextlib
import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom import operators as P
from planloom import storage
from planloom.dialect import parse
from planloom.dialect import syntax as S
from planloom.engine import Engine
from planloom.plans.lineage import BACKWARD, AllLineage, EndToEnd, LineageError, LineagePolicy, NoLineage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, *tables: str, **options) -> Engine:
    e = Engine(spark, views=False, **options)
    for t in tables:
        e.catalog.register_parquet(f"{sf_dir}/{t}.parquet")
    return e


def _tables(q: S.Select) -> set[str]:
    out: set[str] = set()
    for s in q.sources:
        out |= {s.name} if isinstance(s, S.TableRef) else _tables(s.query) if isinstance(s, S.DerivedRef) else set()
    return out


def _rounded(df: DataFrame, digits: int | None) -> DataFrame:
    if digits is None:
        return df
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _dialect(name: str, text: str, oracle: str, digits: int | None = None, **options) -> None:
    """Register a query in the dialect."""
    tables = sorted(_tables(parse(text)))
    QUERIES[name] = lambda spark, sf_dir: _rounded(engine(spark, sf_dir, *tables, **options).df(text), digits)
    SQL[name] = oracle


def _query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


# Scans and projections

_dialect("scan_base", "SELECT * FROM nation", "SELECT * FROM nation")
_dialect("scan_alias", "SELECT n.n_name, n.n_regionkey FROM nation AS n", "SELECT n_name, n_regionkey FROM nation")
_dialect("derived_table", "SELECT x, o_custkey FROM (SELECT o_totalprice AS x, o_custkey FROM orders) AS d WHERE d.x > 100000", "SELECT o_totalprice AS x, o_custkey FROM orders WHERE o_totalprice > 100000")
_dialect(
    "derived_nested",
    "SELECT * FROM (SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') AS a WHERE a.o_totalprice > 1000) AS b WHERE b.o_totalprice < 90000",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 AND o_totalprice < 90000",
)
_dialect("derived_unnamed", "SELECT * FROM (SELECT r_name FROM region)", "SELECT r_name FROM region")
_dialect("dummy_scan", "SELECT 1, 'x' AS b, true AS c", "SELECT CAST(1 AS DOUBLE) AS a0, 'x' AS b, CAST(1 AS DOUBLE) AS c")
_dialect("dummy_expression", "SELECT (1*2)+3 AS x WHERE (1 = 1) and (3 < 4)", "SELECT CAST(5 AS DOUBLE) AS x")
_dialect("project_arith", "SELECT p_partkey, (p_size + 1) * 2 AS x, p_retailprice / 4 AS y FROM part", "SELECT p_partkey, CAST((p_size + 1) * 2 AS DOUBLE) AS x, p_retailprice / 4 AS y FROM part")
_dialect("project_star", "SELECT * FROM customer WHERE c_acctbal < 0", "SELECT * FROM customer WHERE c_acctbal < 0")
_dialect("project_table_star", "SELECT r.*, n.n_name FROM nation AS n, region AS r WHERE n.n_regionkey = r.r_regionkey", "SELECT r.*, n.n_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
_dialect("project_default_names", "SELECT p_size + 1, p_partkey, p_size * 2 FROM part", "SELECT CAST(p_size + 1 AS DOUBLE) AS a0, p_partkey, CAST(p_size * 2 AS DOUBLE) AS a1 FROM part")

# Expressions and filters

_dialect("expr_right_assoc", "SELECT p_partkey, p_size - 3 - 1 AS x, p_size * 2 + 1 AS y, 20 / p_size * 2 AS z FROM part", "SELECT p_partkey, CAST(p_size - (3 - 1) AS DOUBLE) AS x, CAST(p_size * (2 + 1) AS DOUBLE) AS y, CAST(20 AS DOUBLE) / (p_size * 2) AS z FROM part")
_dialect("expr_unary", "SELECT c_custkey, -c_acctbal AS x, +c_nationkey AS y, -c_nationkey + 1 AS z FROM customer", "SELECT c_custkey, -c_acctbal AS x, c_nationkey AS y, CAST(-(c_nationkey + 1) AS DOUBLE) AS z FROM customer")
for _op, _name in (("=", "eq"), ("<>", "ne"), ("<", "lt"), (">", "gt"), ("<=", "le"), (">=", "ge")):
    _dialect(f"filter_compare_{_name}", f"SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey {_op} 7", f"SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey {_op} 7")
_dialect("filter_and", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_totalprice < 200000 AND o_orderstatus = 'O'", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_totalprice < 200000 AND o_orderstatus = 'O'")
_dialect("filter_or", "SELECT c_custkey FROM customer WHERE (c_nationkey = 3) or (c_nationkey = 5)", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_nationkey = 5")
_dialect("filter_not", "SELECT c_custkey FROM customer WHERE not(c_nationkey < 20)", "SELECT c_custkey FROM customer WHERE NOT (c_nationkey < 20)")
_dialect("filter_between", "SELECT c_custkey FROM customer WHERE c_nationkey BETWEEN 5 AND 9", "SELECT c_custkey FROM customer WHERE c_nationkey BETWEEN 5 AND 9")
_dialect("filter_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus in ('F', 'P') and o_custkey in (1, 2, 3, 5, 8)", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey IN (1, 2, 3, 5, 8)")
_dialect("filter_in_expression", "SELECT c_custkey FROM customer WHERE c_nationkey in (2 + 1, c_custkey)", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_nationkey = c_custkey")
_dialect("filter_string_eq", "SELECT c_custkey FROM customer WHERE c_mktsegment == 'BUILDING'", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
_dialect("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%'", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%'")
_dialect("filter_date", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-01-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-01-01'")
_dialect("filter_quoted_name", "SELECT `c_custkey` FROM customer AS c WHERE c.`c_nationkey` != 4", "SELECT c_custkey FROM customer WHERE c_nationkey <> 4")
_dialect("bool_as_num", "SELECT p_partkey, 1 + (p_size > 25) AS x, p_size = 7 AS y FROM part", "SELECT p_partkey, CAST(1 + CAST(p_size > 25 AS INT) AS DOUBLE) AS x, CAST(p_size = 7 AS DOUBLE) AS y FROM part")
_dialect("num_as_bool", "SELECT p_partkey, (p_size - 10) and 1 AS x FROM part WHERE p_size - 20", "SELECT p_partkey, CAST(p_size <> 10 AS DOUBLE) AS x FROM part WHERE p_size <> 20")

# Joins

_dialect("join_hash", "SELECT o.o_orderkey, c.c_name FROM orders AS o, customer AS c WHERE o.o_custkey = c.c_custkey", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey")
_dialect(
    "join_hash_residual",
    "SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey and c_acctbal > s_acctbal and c_custkey = s_suppkey + 1",
    "SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey AND c_acctbal > s_acctbal AND c_custkey = s_suppkey + 1",
)
_dialect(
    "join_three_way",
    "SELECT c.c_custkey, n.n_name, r.r_name FROM customer AS c, nation AS n, region AS r WHERE c.c_nationkey = n.n_nationkey and n.n_regionkey = r.r_regionkey",
    "SELECT c_custkey, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey",
)
_dialect("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation AS a, nation AS b WHERE a.n_regionkey = b.n_regionkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey")
_dialect("join_theta_lt", "SELECT a.n_name AS x, b.n_name AS y FROM nation AS a, nation AS b WHERE a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
_dialect("join_expression_key", "SELECT a.n_name AS x, b.n_name AS y FROM nation AS a, nation AS b WHERE (a.n_nationkey + 1) = b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_nationkey + 1 = b.n_nationkey")
_dialect("join_cross", "SELECT n_name, r_name FROM nation, region", "SELECT n_name, r_name FROM nation, region")
_dialect(
    "join_derived_agg",
    "SELECT c.c_name, d.n FROM customer AS c, (SELECT o_custkey AS k, count(o_orderkey) AS n FROM orders GROUP BY o_custkey) AS d WHERE c.c_custkey = d.k",
    "SELECT c_name, n FROM customer, (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) d WHERE c_custkey = d.k",
)


@_query("join_plan_hash", "SELECT o.o_orderkey, c.c_name FROM orders o, (SELECT * FROM customer WHERE c_nationkey = 1) c WHERE o.o_custkey = c.c_custkey")
def _(spark, sf_dir):
    """A plan built by hand."""
    right = P.Filter(P.Scan("customer", "c"), "c.c_nationkey = 1")
    join = P.HashJoin(P.Scan("orders", "o"), right, ("o.o_custkey", "c.c_custkey"))
    return engine(spark, sf_dir, "orders", "customer").df(P.Project(join, ["o.o_orderkey", "c.c_name"]))


@_query("join_plan_theta", "SELECT a.r_name AS x, b.r_name AS y FROM region a, region b WHERE a.r_regionkey <= b.r_regionkey")
def _(spark, sf_dir):
    join = P.ThetaJoin(P.Scan("region", "a"), P.Scan("region", "b"), "a.r_regionkey <= b.r_regionkey")
    return engine(spark, sf_dir, "region").df(P.Project(join, ["a.r_name", "b.r_name"], ["x", "y"]))


_FIVE_WAY = """SELECT r.r_name, o.o_orderkey FROM orders AS o, region AS r, customer AS c, nation AS n, supplier AS s
 WHERE c.c_custkey = o.o_custkey and n.n_nationkey = c.c_nationkey and r.r_regionkey = n.n_regionkey
 and s.s_nationkey = n.n_nationkey and s.s_acctbal > 7000 and o.o_totalprice > 200000"""
_FIVE_WAY_SQL = """SELECT r_name, o_orderkey FROM orders, region, customer, nation, supplier
 WHERE c_custkey = o_custkey AND n_nationkey = c_nationkey AND r_regionkey = n_regionkey
 AND s_nationkey = n_nationkey AND s_acctbal > 7000 AND o_totalprice > 200000"""
_dialect("join_order_catalyst", _FIVE_WAY, _FIVE_WAY_SQL)
_dialect("join_order_selinger", _FIVE_WAY, _FIVE_WAY_SQL, join_order="selinger")
_dialect("join_order_exhaustive", _FIVE_WAY, _FIVE_WAY_SQL, join_order="exhaustive")


@_query(
    "join_plans_tested",
    "SELECT * FROM (VALUES (1, 1, 0), (2, 10, 8), (3, 35, 32), (4, 100, 126), (5, 260, 574), (6, 640, 3122), (7, 1520, 20070)) AS t(relations, selinger, exhaustive)",
)
def _(spark, sf_dir):
    """Plans costed for chains of self-joins."""
    rows = []
    for n in range(1, 8):
        tested = []
        for kind in ("selinger", "exhaustive"):
            e = engine(spark, sf_dir, "region", join_order=kind)
            scans = [P.Scan("region", f"T{i}") for i in range(n)]
            e.plan(P.Filter(P.From(scans, [f"T{i}.r_regionkey = T{i - 1}.r_regionkey" for i in range(1, n)]), "T0.r_regionkey = 1"))
            tested.append(e.plans_tested)
        rows.append((n, *tested))
    return spark.createDataFrame(rows, "relations int, selinger int, exhaustive int")


# Aggregation

_dialect("agg_global", "SELECT count(o_orderkey) AS n, sum(o_totalprice) AS s FROM orders", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders", 2)
_dialect("agg_group_key", "SELECT o_orderstatus, count(o_orderkey) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
_dialect("agg_group_expr", "SELECT count(c_custkey) AS n, sum(c_nationkey + 1) AS s FROM customer GROUP BY c_nationkey + 1", "SELECT count(*) AS n, CAST(sum(c_nationkey + 1) AS DOUBLE) AS s FROM customer GROUP BY c_nationkey + 1")
_dialect("agg_no_key_output", "SELECT sum(c_custkey) AS s FROM customer GROUP BY c_nationkey", "SELECT CAST(sum(c_custkey) AS BIGINT) AS s FROM customer GROUP BY c_nationkey")
_dialect("agg_const_output", "SELECT 1 AS one, c_mktsegment FROM customer GROUP BY c_mktsegment", "SELECT CAST(1 AS DOUBLE) AS one, c_mktsegment FROM customer GROUP BY c_mktsegment")
_dialect("agg_key_expression", "SELECT c_nationkey * 2 AS x, count(c_custkey) AS n FROM customer GROUP BY c_nationkey, c_mktsegment", "SELECT CAST(c_nationkey * 2 AS DOUBLE) AS x, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment")
_dialect(
    "agg_last_row",
    "SELECT c_custkey AS last, count(c_custkey) AS n FROM customer GROUP BY c_nationkey - (c_custkey * 0)",
    "SELECT arg_max(c_custkey, rid) AS last, count(*) AS n FROM (SELECT *, row_number() OVER () AS rid FROM customer) GROUP BY c_nationkey",
)
_dialect("agg_count", "SELECT l_returnflag, l_linestatus, count(l_orderkey) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
_dialect("agg_sum", "SELECT l_returnflag, sum(l_quantity) AS s, sum(l_extendedprice * (1 - l_discount)) AS r FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_quantity), 2) AS s, round(sum(l_extendedprice * (1 - l_discount)), 2) AS r FROM lineitem GROUP BY ALL", 2)
_dialect("agg_avg", "SELECT l_linestatus, avg(l_extendedprice) AS a FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, round(avg(l_extendedprice), 4) AS a FROM lineitem GROUP BY ALL", 4)
_dialect("agg_std", "SELECT l_linestatus, std(l_quantity) AS a, stdev(l_tax) AS b FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, round(stddev_pop(l_quantity), 6) AS a, round(stddev_pop(l_tax), 6) AS b FROM lineitem GROUP BY ALL", 6)
_dialect("agg_arithmetic", "SELECT o_orderstatus, sum(o_totalprice) / count(o_orderkey) AS a FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(sum(o_totalprice) / count(*), 4) AS a FROM orders GROUP BY 1", 4)
_dialect("agg_empty", "SELECT count(o_orderkey) AS n FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n FROM orders WHERE o_orderkey < 0")
_dialect("agg_empty_strict", "SELECT count(o_orderkey) AS n FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n FROM orders WHERE o_orderkey < 0 HAVING count(*) > 0", strict_empty=True)
_dialect("having_agg", "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING count(o_orderkey) > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
_dialect("having_key", "SELECT c_nationkey, count(c_custkey) AS n FROM customer GROUP BY c_nationkey HAVING c_nationkey = 1", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING c_nationkey = 1")
_dialect("having_hidden", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1500000 and count(o_orderkey) < 30", "SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1500000 AND count(*) < 30")
_dialect("having_constant", "SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING 1 = 1", "SELECT c_nationkey FROM customer GROUP BY c_nationkey")

# Distinct, order, limit

_dialect("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


@_query("distinct_plan", "SELECT DISTINCT c_nationkey FROM customer")
def _(spark, sf_dir):
    return engine(spark, sf_dir, "customer").df(P.Distinct(P.Project(P.Scan("customer"), ["c_nationkey"])))


def _sorted(name: str, text: str, oracle: str, order: str) -> None:
    """Register a whole sort; each row has its place in it (oid)."""
    tables = sorted(_tables(parse(text)))
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, *tables).lineage(text).result()
    SQL[name] = f"SELECT * EXCLUDE (k), row_number() OVER (ORDER BY {order}) - 1 AS oid FROM ({oracle})"


_sorted("order_multi", "SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey ASC, c_custkey DESC", "SELECT c_custkey, c_nationkey, 0 AS k FROM customer", "c_nationkey, c_custkey DESC")
_sorted("order_expr_desc", "SELECT c_custkey FROM customer ORDER BY c_nationkey + 1 desc, -c_custkey", "SELECT c_custkey, c_nationkey AS k FROM customer", "k + 1 DESC, -c_custkey")
_sorted("order_source_column", "SELECT -c_custkey AS c_custkey FROM customer ORDER BY c_custkey", "SELECT -c.c_custkey AS c_custkey, c.c_custkey AS k FROM customer c", "k")
_sorted("order_const_noop", "SELECT c_custkey FROM customer ORDER BY 1, c_custkey desc, 2", "SELECT c_custkey, 0 AS k FROM customer", "c_custkey DESC")
_sorted("order_hidden_agg", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) desc, o_custkey", "SELECT o_custkey, sum(o_totalprice) AS k FROM orders GROUP BY 1", "k DESC, o_custkey")
_dialect("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
_dialect("limit_const_expr", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT (2*2)-1 OFFSET 1+1", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3 OFFSET 2")
_dialect("limit_boolean", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT true", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1")
_dialect("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")

# Functions

_dialect("fn_lower", "SELECT n_nationkey, lower(n_name) AS x FROM nation", "SELECT n_nationkey, lower(n_name) AS x FROM nation")
_dialect("fn_upper", "SELECT p_partkey, upper(p_type) AS x, upper(p_size) AS y FROM part", "SELECT p_partkey, upper(p_type) AS x, CAST(p_size AS VARCHAR) AS y FROM part")


@_query("udf_scalar", "SELECT p_partkey, CAST(p_size * 2 + 1 AS DOUBLE) AS x FROM part")
def _(spark, sf_dir):
    e = engine(spark, sf_dir, "part")
    e.functions.scalar("odd", 1, lambda v: float(2 * v + 1))
    return e.df("SELECT p_partkey, odd(p_size) AS x FROM part")


@_query("udf_vectorised", "SELECT p_partkey, CAST(p_size * p_size AS DOUBLE) AS x FROM part")
def _(spark, sf_dir):
    import pandas as pd

    def square(v: pd.Series) -> pd.Series:
        return (v * v).astype("float64")

    e = engine(spark, sf_dir, "part")
    e.functions.vectorised("square", 1, square)
    return e.df("SELECT p_partkey, square(p_size) AS x FROM part")


@_query("udf_agg", "SELECT c_nationkey, max(c_acctbal) - min(c_acctbal) AS x, count(*) AS n FROM customer GROUP BY 1")
def _(spark, sf_dir):
    e = engine(spark, sf_dir, "customer")
    e.functions.aggregate("spread", 1, lambda v: float(v.max() - v.min()))
    return e.df("SELECT c_nationkey, spread(c_acctbal) AS x, count(c_custkey) AS n FROM customer GROUP BY c_nationkey")


@_query("udf_inc_agg", "SELECT c_mktsegment, CAST(sum(c_nationkey * c_nationkey) AS DOUBLE) AS x FROM customer GROUP BY 1")
def _(spark, sf_dir):
    e = engine(spark, sf_dir, "customer")
    e.functions.incremental("squares", 1, lambda: 0.0, lambda s, v: s + float(v) ** 2, lambda s: s)
    return e.df("SELECT c_mktsegment, squares(c_nationkey) AS x FROM customer GROUP BY c_mktsegment")


@_query("udf_inc_agg_merge", "SELECT o_orderstatus, round(sum(o_totalprice * o_custkey) / count(*), 2) AS x, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    """States are merged, so that batches are reduced before the shuffle."""
    e = engine(spark, sf_dir, "orders")
    e.functions.incremental("mean_of", 2, lambda: (0.0, 0), lambda s, a, b: (s[0] + a * b, s[1] + 1), lambda s: s[0] / s[1], merge=lambda s, t: (s[0] + t[0], s[1] + t[1]))
    return _rounded(e.df("SELECT o_orderstatus, mean_of(o_totalprice, o_custkey) AS x, count(o_orderkey) AS n FROM orders GROUP BY o_orderstatus"), 2)


@_query("udf_agg_arity", "SELECT l_returnflag, round(sum(l_quantity + l_extendedprice + l_discount + l_tax), 2) AS x, max(l_quantity) AS y FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    """Functions of any number of arguments, two of them in one shuffle."""
    e = engine(spark, sf_dir, "lineitem")
    e.functions.aggregate("all_four", 4, lambda a, b, c, d: float((a + b + c + d).sum()))
    e.functions.aggregate("top", 1, lambda a: float(a.max()))
    return _rounded(e.df("SELECT l_returnflag, all_four(l_quantity, l_extendedprice, l_discount, l_tax) AS x, top(l_quantity) AS y FROM lineitem GROUP BY l_returnflag"), 2)


@_query("udf_table", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 5")
def _(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.functions.table("series", 1, lambda spark, n: spark.range(int(n)))
    return e.df("SELECT n.n_nationkey, n.n_name FROM nation AS n, series(5) AS s WHERE n.n_nationkey = s.id")


# Sources and sinks


def _written_csv(spark: SparkSession, sf_dir: str, table: str, sep: str, folder: str = "") -> str:
    path = f"{storage.scratch(spark)}{folder}"
    spark.read.parquet(f"{sf_dir}/{table}.parquet").coalesce(1).write.option("header", True).option("sep", sep).csv(path)
    return path


@_query("scan_csv", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _(spark, sf_dir):
    """Separators are read off the header."""
    e = engine(spark, sf_dir)
    e.catalog.register_csv(_written_csv(spark, sf_dir, "nation", "|"), "n")
    return e.df("SELECT n_nationkey, n_name FROM n WHERE n_regionkey = 2")


@_query("scan_csv_crawl", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf_dir):
    """Every file below a folder, by its name."""
    root = storage.scratch(spark)
    spark.read.parquet(f"{sf_dir}/nation.parquet").coalesce(1).write.option("header", True).csv(f"{root}/deep/er")
    e = engine(spark, sf_dir)
    (name,) = e.catalog.crawl_csv(root)
    return e.df(f"SELECT n_nationkey, n_name FROM `{name}`")


@_query("scan_pandas", "SELECT r_name FROM region WHERE r_regionkey > 1")
def _(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.catalog.register_pandas("r", spark.read.parquet(f"{sf_dir}/region.parquet").toPandas())
    return e.df("SELECT r_name FROM r WHERE r_regionkey > 1")


@_query("scan_rows", "SELECT * FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b)")
def _(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.catalog.register_rows("t", [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}])
    return e.df("SELECT * FROM t").selectExpr("int(a) AS a", "b")


@_query("catalog_schema", "SELECT * FROM (VALUES ('n_nationkey', 'num'), ('n_name', 'str'), ('n_regionkey', 'num')) AS t(name, kind)")
def _(spark, sf_dir):
    return spark.createDataFrame(engine(spark, sf_dir, "nation").catalog.schema("nation"), "name string, kind string")


@_query("sink_yield", "SELECT n_name FROM nation WHERE n_nationkey < 3")
def _(spark, sf_dir):
    rows = engine(spark, sf_dir, "nation").run(P.Yield(P.Project(P.Filter(P.Scan("nation"), "n_nationkey < 3"), ["n_name"])))
    return spark.createDataFrame(list(rows), "n_name string")


@_query("sink_collect", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf_dir):
    rows = engine(spark, sf_dir, "region").run(P.Collect(P.Project(P.Scan("region"), ["r_regionkey", "r_name"])))
    return spark.createDataFrame([tuple(r) for r in rows], spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").schema)


@_query("sink_print", "SELECT CAST(r_regionkey AS VARCHAR) || chr(9) || r_name AS line FROM region")
def _(spark, sf_dir):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        engine(spark, sf_dir, "region").run(P.Print(P.Project(P.Scan("region"), ["r_regionkey", "r_name"])))
    return spark.createDataFrame([(line,) for line in out.getvalue().splitlines()], "line string")


@_query("sink_code", "SELECT * FROM (VALUES ('Filter', true), ('GeneratedIterator', true), ('Scan', true)) AS t(part, there)")
def _(spark, sf_dir):
    """The generated code, as text."""
    code = engine(spark, sf_dir, "nation").code("SELECT n_name FROM nation WHERE n_regionkey = 1")
    return spark.createDataFrame([(p, p in code) for p in ("Filter", "GeneratedIterator", "Scan")], "part string, there boolean")


# Lineage: edges as (source, oid, iid)


def _edges(e: Engine, query: str | P.Plan, *names: str) -> DataFrame:
    lineage, out = e.lineage(query), None
    for n in names:
        one = lineage.edges(n).select(F.lit(n).alias("source"), "oid", "iid")
        out = one if out is None else out.union(one)
    return out


@_query(
    "lineage_back_filter",
    "SELECT 'orders' AS source, row_number() OVER (ORDER BY rid) - 1 AS oid, rid AS iid FROM (SELECT *, row_number() OVER () - 1 AS rid FROM orders) WHERE o_totalprice > 200000",
)
def _(spark, sf_dir):
    return _edges(engine(spark, sf_dir, "orders"), "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000", "orders")


@_query(
    "lineage_back_order",
    "SELECT 'customer' AS source, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) - 1 AS oid, rid AS iid FROM (SELECT *, row_number() OVER () - 1 AS rid FROM customer)",
)
def _(spark, sf_dir):
    return _edges(engine(spark, sf_dir, "customer"), "SELECT c_name FROM customer ORDER BY c_nationkey desc, c_custkey", "customer")


_LINEAGE_JOIN = "SELECT c.c_name, n.n_name FROM customer AS c, nation AS n WHERE c.c_nationkey = n.n_nationkey ORDER BY c.c_custkey"
_LINEAGE_JOIN_SQL = """WITH j AS (
  SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS oid, c.rid AS c, n.rid AS n
  FROM (SELECT *, row_number() OVER () - 1 AS rid FROM customer) c, (SELECT *, row_number() OVER () - 1 AS rid FROM nation) n
  WHERE c_nationkey = n_nationkey)"""


@_query("lineage_back_join", f"{_LINEAGE_JOIN_SQL} SELECT 'c' AS source, oid, c AS iid FROM j UNION ALL SELECT 'n', oid, n FROM j")
def _(spark, sf_dir):
    return _edges(engine(spark, sf_dir, "customer", "nation"), _LINEAGE_JOIN, "c", "n")


@_query("lineage_forw_join", f"{_LINEAGE_JOIN_SQL} SELECT oid, n AS iid FROM j WHERE n IN (0, 3)")
def _(spark, sf_dir):
    return engine(spark, sf_dir, "customer", "nation").lineage(_LINEAGE_JOIN).forw([0, 3], "n")


@_query(
    "lineage_back_group",
    """WITH r AS (SELECT *, row_number() OVER () - 1 AS rid FROM customer),
     g AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) - 1 AS oid FROM customer GROUP BY 1)
     SELECT 'customer' AS source, oid, rid AS iid FROM r JOIN g USING (c_nationkey)""",
)
def _(spark, sf_dir):
    return _edges(engine(spark, sf_dir, "customer"), "SELECT c_nationkey, count(c_custkey) AS n FROM customer GROUP BY c_nationkey ORDER BY c_nationkey", "customer")


@_query(
    "lineage_operator",
    "SELECT row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS oid, n_nationkey - 5 AS iid FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_regionkey FROM nation) WHERE n_nationkey >= 5",
)
def _(spark, sf_dir):
    """From the result to the rows that a filter below let through."""
    kept = P.Filter(P.OrderBy(P.Scan("nation"), ["n_nationkey"]), "n_nationkey >= 5")
    plan = P.Project(P.OrderBy(kept, ["n_regionkey", "n_nationkey"]), ["n_name"])
    return engine(spark, sf_dir, "nation").lineage(plan, AllLineage()).edges(kept)


@_query("lineage_back", f"{_LINEAGE_JOIN_SQL} SELECT oid, c AS iid FROM j WHERE oid IN (0, 7, 40)")
def _(spark, sf_dir):
    return engine(spark, sf_dir, "customer", "nation").lineage(_LINEAGE_JOIN).back([0, 7, 40], "c")


@_query(
    "lineage_back_two_groups",
    """WITH r AS (SELECT *, row_number() OVER () - 1 AS rid FROM orders),
     g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
     h AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS oid FROM g GROUP BY 1)
     SELECT 'orders' AS source, oid, rid AS iid FROM r JOIN g USING (o_custkey) JOIN h USING (n)""",
)
def _(spark, sf_dir):
    """A grouping of a grouping."""
    text = "SELECT d.n, count(d.k) AS m FROM (SELECT o_custkey AS k, count(o_orderkey) AS n FROM orders GROUP BY o_custkey) AS d GROUP BY d.n ORDER BY d.n"
    return _edges(engine(spark, sf_dir, "orders"), text, "orders")


@_query(
    "lineage_back_distinct",
    """WITH r AS (SELECT *, row_number() OVER () - 1 AS rid FROM customer),
     g AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS oid FROM customer GROUP BY 1)
     SELECT 'customer' AS source, oid, rid AS iid FROM r JOIN g USING (c_mktsegment)""",
)
def _(spark, sf_dir):
    return _edges(engine(spark, sf_dir, "customer"), "SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_mktsegment", "customer")


@_query(
    "lineage_back_files",
    "SELECT 't' AS source, row_number() OVER (ORDER BY s_suppkey) - 1 AS oid, row_number() OVER (ORDER BY s_suppkey % 5 = 0 DESC, s_suppkey) - 1 AS iid FROM supplier",
)
def _(spark, sf_dir):
    """Two files, the second much the larger: rows are numbered by file and place."""
    root, all_of = storage.scratch(spark), spark.read.parquet(f"{sf_dir}/supplier.parquet")
    for part, cond in (("part=1", "s_suppkey % 5 = 0"), ("part=2", "s_suppkey % 5 <> 0")):
        all_of.where(cond).coalesce(1).sortWithinPartitions("s_suppkey").write.parquet(f"{root}/{part}")
    e = engine(spark, sf_dir)
    e.catalog.register_parquet(root, "t")
    return _edges(e, "SELECT s_name FROM t ORDER BY s_suppkey", "t")


@_query(
    "lineage_path",
    "SELECT row_number() OVER (ORDER BY n_name) - 1 AS oid, rid AS iid FROM (SELECT *, row_number() OVER () - 1 AS rid FROM nation WHERE n_regionkey > 1)",
)
def _(spark, sf_dir):
    """One path, backward only, from the result to a filter inside."""
    kept = P.Filter(P.Scan("nation"), "n_regionkey > 1")
    plan = P.Project(P.OrderBy(kept, ["n_name"]), ["n_name"])
    policy = LineagePolicy()
    policy.add_path(kept, plan, BACKWARD)
    lineage = engine(spark, sf_dir, "nation").lineage(plan, policy)
    n = lineage.result().count()
    return lineage.back(list(range(n)), kept)


@_query("lineage_none", "SELECT * FROM (VALUES ('none', false), ('end to end', true), ('all', true)) AS t(policy, captured)")
def _(spark, sf_dir):
    """Which policies let an end-to-end question be asked."""
    rows, plan = [], P.Project(P.Scan("region"), ["r_name"])
    for name, policy in (("none", NoLineage()), ("end to end", EndToEnd()), ("all", AllLineage())):
        try:
            rows.append((name, engine(spark, sf_dir, "region").lineage(plan, policy).back(0, "region").count() == 1))
        except LineageError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "policy string, captured boolean")


# End to end

_dialect(
    "flagship_revenue",
    """SELECT l.l_orderkey, o.o_orderdate, sum(l.l_extendedprice * (1 - l.l_discount)) AS revenue
    FROM customer AS c, orders AS o, lineitem AS l
    WHERE c.c_mktsegment = 'BUILDING' and c.c_custkey = o.o_custkey and l.l_orderkey = o.o_orderkey
    GROUP BY l.l_orderkey, o.o_orderdate ORDER BY sum(l.l_extendedprice * (1 - l.l_discount)) desc, l.l_orderkey LIMIT 20""",
    """SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
    GROUP BY ALL ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, l_orderkey LIMIT 20""",
    2,
)
_FUSED = " and ".join(f"(l_quantity > {j - 20})" for j in range(19))
_dialect("fusion_filters", f"SELECT l_orderkey, l_quantity FROM lineitem WHERE {_FUSED}", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > -2")


@_query("fusion_equalities", " UNION ALL ".join(f"SELECT {k} AS k, count(*) AS n FROM lineitem WHERE {' AND '.join(f'l_linenumber = {j}' for j in range(1, k + 1))}" for k in range(1, 20, 2)))
def _(spark, sf_dir):
    """Ever more equalities with one column."""
    e, out = engine(spark, sf_dir, "lineitem"), None
    for k in range(1, 20, 2):
        where = " and ".join(f"(l_linenumber = {j})" for j in range(1, k + 1))
        one = e.df(f"SELECT count(l_orderkey) AS n FROM lineitem WHERE {where}").select(F.lit(k).alias("k"), "n")
        out = one if out is None else out.union(one)
    return out


_dialect(
    "events_by_type",
    "SELECT event_type, count(event_id) AS n, avg(value) AS a FROM events WHERE value > 1 GROUP BY event_type",
    "SELECT event_type, count(*) AS n, round(avg(value), 6) AS a FROM events WHERE value > 1 GROUP BY 1",
    6,
)
