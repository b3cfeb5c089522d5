"""Queries of selections, filters, expressions, aggregation, sorts, joins, sets, and nested and text functions."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import scalar
from orrery.operators import agg, frame, joins, temporal
from orrery.plans.catalog import query
from orrery.sources import tables
from orrery.sources.tables import load
from orrery.storage import shared_folder

KEYS = ["l_orderkey", "l_linenumber"]
X, D = "l_extendedprice / 10000", "l_discount * 10"


def _compare(name: str, op: str):
    def f(spark, sf_dir):
        q = F.col("l_quantity")
        test = {"eq": q == 25, "ne": q != 25, "lt": q < 25, "le": q <= 25, "gt": F.lit(25) < q, "ge": q >= 25}[name]
        return frame.where(load(spark, sf_dir, "lineitem"), test).select(*KEYS, "l_quantity")

    f.__name__ = f"filter_{name}"
    query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {op} 25")(f)


for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _compare(_name, _op)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 30 AND l_discount < 0.05) OR l_returnflag = 'R'")
def filter_and_or(spark, sf_dir):
    return frame.where(load(spark, sf_dir, "lineitem"), ((F.col("l_quantity") > 30) & (F.col("l_discount") < 0.05)) | (F.col("l_returnflag") == "R")).select(*KEYS)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > l_tax AND CAST(l_shipdate AS DATE) >= DATE '1995-06-17'")
def filter_col_col_date(spark, sf_dir):
    keep = (F.col("l_discount") > F.col("l_tax")) & temporal.on_or_after(F.col("l_shipdate"), datetime.date(1995, 6, 17))
    return frame.where(load(spark, sf_dir, "lineitem"), keep).select(*KEYS)


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 1 THEN event_id % 200 - 100 END AS a, event_id % 100 AS b, event_id % 3 = 0 AS m FROM events)
SELECT event_id, a, b FROM e WHERE (a > 0 OR m) AND NOT (a = b AND m)""")
def filter_null_logic(spark, sf_dir):
    i = F.col("event_id")
    rows = load(spark, sf_dir, "events").select("event_id", F.when(i % 2 == 1, i % 200 - 100).alias("a"), (i % 100).alias("b"), (i % 3 == 0).alias("m"))
    return frame.where(rows, ((F.col("a") > 0) | F.col("m")) & ~((F.col("a") == F.col("b")) & F.col("m"))).select("event_id", "a", "b")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def select_columns(spark, sf_dir):
    return frame.project(load(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(-l_tax + abs(l_discount - 0.05), 6) AS t, 7 AS seven, round(l_quantity * l_quantity, 2) AS sq FROM lineitem")
def with_columns_arith(spark, sf_dir):
    q = F.col("l_quantity")
    new = {"net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4), "t": F.round(-F.col("l_tax") + F.abs(F.col("l_discount") - 0.05), 6), "seven": F.lit(7), "sq": F.round(scalar.square(q), 2)}
    return frame.with_columns(load(spark, sf_dir, "lineitem"), **new).select(*KEYS, *new)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 1.0 WHEN l_quantity < 20 THEN 2.0 WHEN l_quantity < 30 THEN 3.0 WHEN l_quantity < 40 THEN 4.0 ELSE 5.0 END::DOUBLE AS tier,
CASE WHEN (CASE WHEN l_linenumber > 2 THEN l_quantity END) > 25 THEN 'a' ELSE 'b' END AS nullcond FROM lineitem""")
def when_cascade(spark, sf_dir):
    q = F.col("l_quantity")
    tier = scalar.cascade((q < 10, 1.0), (q < 20, 2.0), (q < 30, 3.0), (q < 40, 4.0), otherwise=5.0)
    odd = scalar.cascade((F.when(F.col("l_linenumber") > 2, q) > 25, "a"), otherwise="b")
    return load(spark, sf_dir, "lineitem").select(*KEYS, tier.alias("tier"), odd.alias("nullcond"))


def _x():
    return F.col("l_extendedprice") / 10000


def _d():
    return F.col("l_discount") * 10


def _q():
    return F.col("l_quantity")


def _math(name: str, make, **sql: str):
    """make: the expressions of the columns named in sql, in order; built when the query runs."""

    def f(spark, sf_dir):
        return load(spark, sf_dir, "lineitem").select(*KEYS, *[F.round(expr, 6).alias(c) for c, expr in zip(sql, make(), strict=True)])

    f.__name__ = f"math_{name}"
    query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({x}, 6) AS {c}" for c, x in sql.items()) + " FROM lineitem")(f)


_math("trig", lambda: [F.sin(_x()), F.cos(_x()), F.tan(_d())], s=f"sin({X})", c=f"cos({X})", t=f"tan({D})")
_math("hyper", lambda: [F.sinh(_d()), F.cosh(_d()), F.tanh(_x())], s=f"(exp({D}) - exp(-({D}))) / 2", c=f"(exp({D}) + exp(-({D}))) / 2", t=f"1 - 2 / (exp(2 * ({X})) + 1)")
_math(
    "invtrig", lambda: [F.asin("l_discount"), F.acos("l_discount"), F.atan(_x()), F.atan2(_d(), _x())],
    a="asin(l_discount)", b="acos(l_discount)", c=f"atan({X})", d=f"atan2({D}, {X})",
)
_math(
    "explog", lambda: [F.exp(_d()), scalar.ieee_ln(_x()), scalar.ieee_log2(_x()), scalar.ieee_log10(_x()), scalar.ieee_log1p(_d()), scalar.exp2(_d()), scalar.ieee_log(_x(), 3.0)],
    e=f"exp({D})", l=f"ln({X})", l2=f"log2({X})", l10=f"log10({X})", l1=f"ln(1 + {D})", p2=f"pow(2, {D})", b3=f"ln({X}) / ln(3)",
)
_math("roots", lambda: [F.sqrt(_x()), F.cbrt(_x()), F.pow(_d(), F.lit(1.5))], s=f"sqrt({X})", c=f"cbrt({X})", p=f"pow({D}, 1.5)")
_math("rounding", lambda: [scalar.floor(_x()), scalar.ceil(_x()), scalar.round_to(F.col("l_extendedprice") / 7, 3)], f=f"floor({X})", c=f"ceil({X})", r="round(l_extendedprice / 7, 3)")
_math("mod", lambda: [scalar.floor_mod(_q() - 25, 7.0), scalar.floor_mod(_q() - 25, -7.0)], a="((l_quantity - 25) % 7 + 7) % 7", b="((l_quantity - 25) % -7 - 7) % -7")


@query("""WITH e AS (SELECT event_id, CAST(event_id % 5 - 2 AS DOUBLE) AS a, CAST(event_id % 3 - 1 AS DOUBLE) AS b FROM events)
SELECT event_id, CASE WHEN b <> 0 THEN CAST(a / b AS VARCHAR) WHEN a > 0 THEN 'inf' WHEN a < 0 THEN '-inf' ELSE 'nan' END AS q, CASE WHEN a > 0 THEN round(ln(a), 6)::VARCHAR WHEN a = 0 THEN '-inf' ELSE 'nan' END AS l FROM e""")
def ieee_edges(spark, sf_dir):
    i = F.col("event_id")
    a, b = (i % 5 - 2).cast("double"), (i % 3 - 1).cast("double")
    text = lambda x: F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(x.cast("string"))
    return load(spark, sf_dir, "events").select("event_id", text(scalar.ieee_div(a, b)).alias("q"), text(F.when(F.isnan(scalar.ieee_ln(a)), float("nan")).otherwise(F.round(scalar.ieee_ln(a), 6))).alias("l"))


@query("SELECT event_id, CAST(value AS INTEGER) AS i, value > 50 AS b, CAST(event_id AS DOUBLE) AS d, CAST(event_id % 1000 AS FLOAT) AS f, CAST(event_id AS VARCHAR) AS s FROM (SELECT event_id, floor(value) AS value FROM events)")
def casts(spark, sf_dir):
    v, i = scalar.floor(F.col("value")), F.col("event_id")
    return load(spark, sf_dir, "events").select("event_id", v.cast("int").alias("i"), (v > 50).alias("b"), i.cast("double").alias("d"), (i % 1000).cast("float").alias("f"), i.cast("string").alias("s"))


@query("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS m, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(o_totalprice) AS c, count(*) AS n FROM orders GROUP BY 1, 2")
def group_string_keys(spark, sf_dir):
    x = "o_totalprice"
    out = agg.group_by(load(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], s=("sum", x), m=("mean", x), lo=("min", x), hi=("max", x), c=("count", x), n=("len", None))
    return out.withColumns({"s": F.round("s", 2), "m": F.round("m", 4)})


@query("SELECT c_nationkey, CAST(sum(c_custkey) AS BIGINT) AS s, min(c_custkey) AS lo, count(*) AS n FROM customer GROUP BY 1")
def group_int_keys(spark, sf_dir):
    return agg.group_by(load(spark, sf_dir, "customer"), ["c_nationkey"], s=("sum", "c_custkey"), lo=("min", "c_custkey"), n=("len", None))


@query("""WITH e AS (SELECT CASE WHEN event_id % 4 <> 0 THEN event_id % 8 END AS k, event_id % 2 = 0 AS b, CASE WHEN event_id % 3 <> 0 THEN event_id END AS x FROM events)
SELECT k, b, CAST(coalesce(sum(x), 0) AS BIGINT) AS s, count(x) AS c, count(*) AS n FROM e GROUP BY 1, 2""")
def group_null_keys(spark, sf_dir):
    i = F.col("event_id")
    rows = load(spark, sf_dir, "events").select(F.when(i % 4 != 0, i % 8).alias("k"), (i % 2 == 0).alias("b"), F.when(i % 3 != 0, i).alias("x"))
    return agg.group_by(rows, ["k", "b"], s=("sum", "x"), c=("count", "x"), n=("len", None))


@query("SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount) / (1 + l_tax)), 2) AS v, round(min(l_quantity * 2 - 1), 2) AS lo FROM lineitem GROUP BY 1")
def group_expr_agg(spark, sf_dir):
    v = F.col("l_extendedprice") * (1 - F.col("l_discount")) / (1 + F.col("l_tax"))
    out = agg.group_by(load(spark, sf_dir, "lineitem"), ["l_suppkey"], v=("sum", v), lo=("min", F.col("l_quantity") * 2 - 1))
    return out.withColumns({"v": F.round("v", 2), "lo": F.round("lo", 2)})


@query("""SELECT round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS m, min(l_tax) AS lo, max(l_tax) AS hi, count(l_tax) AS c, count(*) AS n, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS v,
round(var_pop(l_quantity), 6) AS v0, round(stddev_samp(sin(l_extendedprice / 10000) * l_discount), 6) AS chain, CAST(sum(l_linenumber) AS BIGINT) AS i FROM lineitem""")
def reduce_all(spark, sf_dir):
    q, rows = "l_quantity", load(spark, sf_dir, "lineitem")
    out = agg.reduce(rows, s=("sum", q), m=("mean", q), lo=("min", "l_tax"), hi=("max", "l_tax"), c=("count", "l_tax"), n=("len", None), sd=("std", q), v=("var", q), chain=("std", F.sin(_x()) * F.col("l_discount")), i=("sum", "l_linenumber"))
    zero = rows.agg(F.round(agg.variance(F.col(q), 0), 6).alias("v0"))
    return out.select(F.round("s", 2).alias("s"), F.round("m", 6).alias("m"), "lo", "hi", "c", "n", F.round("sd", 6).alias("sd"), F.round("v", 6).alias("v"), F.round("chain", 6).alias("chain"), "i").crossJoin(F.broadcast(zero))


@query("SELECT CAST(0 AS DOUBLE) AS s, NULL::DOUBLE AS m, NULL::DOUBLE AS sd, CAST(0 AS BIGINT) AS n")
def reduce_empty(spark, sf_dir):
    out = agg.reduce(load(spark, sf_dir, "lineitem").where("l_quantity < 0"), s=("sum", "l_quantity"), m=("mean", "l_quantity"), sd=("std", "l_quantity"), n=("len", None))
    return out.withColumn("s", F.col("s").cast("double"))


@query("SELECT (SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 1) AS lo, (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1) AS hi")
def arg_min_max(spark, sf_dir):
    return load(spark, sf_dir, "part").agg(agg.arg_min("p_partkey", "p_retailprice").alias("lo"), agg.arg_max("p_partkey", "p_retailprice").alias("hi"))


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
def sort_multi(spark, sf_dir):
    return frame.sort(load(spark, sf_dir, "orders"), ["o_orderstatus", "o_totalprice", "o_orderkey"], [False, True, False]).select("o_orderkey", "o_orderstatus")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN value END AS x FROM events) SELECT event_id, x FROM e ORDER BY x DESC NULLS FIRST, event_id""")
def sort_nulls_first(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("x"))
    return frame.sort(rows, ["x", "event_id"], [True, False])


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice IS NOT NULL ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def top_k(spark, sf_dir):
    return frame.top_k(load(spark, sf_dir, "part"), 25, "p_retailprice", ["p_partkey"]).select("p_partkey", "p_retailprice")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice IS NOT NULL ORDER BY p_retailprice, p_partkey LIMIT 25")
def bottom_k(spark, sf_dir):
    return frame.bottom_k(load(spark, sf_dir, "part"), 25, "p_retailprice", ["p_partkey"]).select("p_partkey", "p_retailprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100")
def slice_sorted(spark, sf_dir):
    return frame.slice_sorted(load(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], 100, 50).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def join_left(spark, sf_dir):
    dim = load(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_name")
    return joins.join(load(spark, sf_dir, "orders"), dim, "o_custkey", "c_custkey", "left").select("o_orderkey", "o_custkey", "c_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    return joins.join(load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name")


@query("""WITH d AS (SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, upper(n_name) FROM nation WHERE n_nationkey < 5)
SELECT c_custkey, v FROM customer LEFT JOIN d ON CASE WHEN c_nationkey % 7 <> 0 THEN c_nationkey END = k""")
def join_duplicate_null_keys(spark, sf_dir):
    nation = load(spark, sf_dir, "nation")
    dim = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    dim = dim.unionByName(nation.where("n_nationkey < 5").select(F.col("n_nationkey").alias("k"), F.upper("n_name").alias("v")))
    fact = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 7 != 0, F.col("c_nationkey")).alias("key"))
    return joins.join(fact, dim, "key", "k", "left").select("c_custkey", "v")


@query("SELECT a.s_suppkey, a.s_acctbal, b.s_acctbal AS s_acctbal_right FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
def join_name_clash(spark, sf_dir):
    s = load(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    return joins.join(s, s.select("s_nationkey", "s_acctbal"), "s_nationkey").select("s_suppkey", "s_acctbal", "s_acctbal_right")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * p_retailprice + p_size, 4) AS v FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def gather_multicol(spark, sf_dir):
    rows = joins.gather(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part"), "l_partkey", "p_partkey", ["p_retailprice", "p_size"])
    return rows.select(*KEYS, F.round(F.col("l_quantity") * F.col("p_retailprice") + F.col("p_size"), 4).alias("v"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_semi(spark, sf_dir):
    return joins.join(load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").where("o_totalprice > 200000"), "c_custkey", "o_custkey", "semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    return joins.join(load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "anti").select("c_custkey")


@query("SELECT coalesce(s_nationkey, n_nationkey) AS k, s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_nationkey > 5) FULL JOIN (SELECT * FROM nation WHERE n_nationkey < 15) ON s_nationkey = n_nationkey")
def join_outer(spark, sf_dir):
    a = load(spark, sf_dir, "supplier").where("s_nationkey > 5").select("s_suppkey", F.col("s_nationkey").alias("k"))
    return joins.join(a, load(spark, sf_dir, "nation").where("n_nationkey < 15"), "k", "n_nationkey", "outer").select("k", "s_suppkey", "n_name")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf_dir):
    return load(spark, sf_dir, "region").crossJoin(load(spark, sf_dir, "nation")).select("r_name", "n_name")


@query("""WITH b AS (SELECT p_partkey, p_size * 1000.0 AS lo, p_size * 1000.0 + 500 AS hi FROM part)
SELECT o_orderkey, p_partkey FROM orders JOIN b ON o_totalprice >= lo AND o_totalprice < hi""")
def range_join(spark, sf_dir):
    spans = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1000.0).alias("lo"), (F.col("p_size") * 1000.0 + 500).alias("hi"))
    return joins.range_join(load(spark, sf_dir, "orders"), spans, "o_totalprice", "lo", "hi", 1000.0).select("o_orderkey", "p_partkey")


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).unionByName(load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey < 12")
def intersect(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(load(spark, sf_dir, "supplier").where("s_nationkey < 12").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 12")
def except_(spark, sf_dir):
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).subtract(load(spark, sf_dir, "supplier").where("s_nationkey < 12").select("s_nationkey"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


def _sets(name: str, clause: str, f):
    def q(spark, sf_dir):
        return f(load(spark, sf_dir, "lineitem")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("s"))

    q.__name__ = name
    query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY {clause}")(q)


_sets("rollup", "ROLLUP (l_returnflag, l_linestatus)", lambda d: d.rollup("l_returnflag", "l_linestatus"))
_sets("cube", "CUBE (l_returnflag, l_linestatus)", lambda d: d.cube("l_returnflag", "l_linestatus"))
_sets("grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus))", lambda d: d.groupingSets([["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus"))


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS d, round(median(c_acctbal), 4) AS md, round(quantile_cont(c_acctbal, 0.9), 4) AS p90 FROM customer GROUP BY 1")
def distinct_quantiles(spark, sf_dir):
    return load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count_distinct("c_nationkey").alias("d"), F.round(F.median("c_acctbal"), 4).alias("md"), F.round(F.percentile("c_acctbal", 0.9), 4).alias("p90"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return frame.value_counts(load(spark, sf_dir, "events"), "event_type")


@query("SELECT CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 50 THEN 11 ELSE CAST(floor(l_quantity / 5) AS BIGINT) + 1 END AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, sf_dir):
    return frame.histogram(load(spark, sf_dir, "lineitem"), "l_quantity", 0.0, 50.0, 10)


@query("""SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey) AS rn,
CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS nt FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)""")
def ranking(spark, sf_dir):
    w = Window.partitionBy("o_orderstatus")
    by, own = w.orderBy("o_orderpriority"), w.orderBy("o_orderpriority", "o_orderkey")
    long = lambda c: c.cast("long")
    return load(spark, sf_dir, "orders").select("o_orderkey", long(F.rank().over(by)).alias("r"), long(F.dense_rank().over(by)).alias("dr"), long(F.row_number().over(own)).alias("rn"), long(F.ntile(4).over(w.orderBy("o_orderkey"))).alias("nt"))


@query("SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 2) AS off FROM orders")
def aggregate_over_group(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") - F.avg("o_totalprice").over(Window.partitionBy("o_orderpriority")), 2).alias("off"))


@query("""SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS "F", sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS "O" FROM lineitem GROUP BY 1""")
def pivot(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT p_partkey, 'size' AS k, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def unpivot(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return rows.unpivot("p_partkey", ["size", "price"], "k", "v")


@query("""SELECT c_custkey, upper(c_mktsegment) AS u, length(c_name)::INTEGER AS n, substr(c_name, 1, 4) AS p, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, c_name LIKE '%1%' AS has1,
replace(c_name, '#', '-') AS rep, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS pad, levenshtein(c_mktsegment, 'BUILDING')::INTEGER AS lev FROM customer""")
def string_functions(spark, sf_dir):
    n, s = F.col("c_name"), F.col("c_mktsegment")
    return load(spark, sf_dir, "customer").select(
        "c_custkey", F.upper(s).alias("u"), F.length(n).alias("n"), F.substring(n, 1, 4).alias("p"), F.regexp_replace(n, "[^0-9]", "").alias("digits"), n.like("%1%").alias("has1"),
        F.replace(n, F.lit("#"), F.lit("-")).alias("rep"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("pad"), F.levenshtein(s, F.lit("BUILDING")).alias("lev"),
    )


@query("""SELECT vec_id, len(embedding)::INTEGER AS n, round(embedding[1]::DOUBLE, 5) AS first, round(list_sum(embedding::DOUBLE[]), 4) AS total, len(list_filter(embedding, lambda x: x > 0))::INTEGER AS pos FROM embeddings""")
def list_functions(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    return load(spark, sf_dir, "embeddings").select("vec_id", F.size(e).alias("n"), F.round(e[0], 5).alias("first"), F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size(F.filter(e, lambda x: x > 0)).alias("pos"))


@query("SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, round(unnest(embedding)::DOUBLE, 5) AS x FROM embeddings")
def explode_lists(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 5).alias("x"))


@query("SELECT event_type, round(avg(CAST(json_extract_string(props, '$.' || json_keys(props)[1]) IS NOT NULL AS INTEGER)), 4) AS filled, count(*) AS n FROM events GROUP BY 1")
def json_functions(spark, sf_dir):
    filled = (F.element_at(F.map_values(F.from_json("props", "map<string,string>")), 1).isNotNull()).cast("int")
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(filled), 4).alias("filled"), F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 100)")
def limit_rows(spark, sf_dir):
    return load(spark, sf_dir, "lineitem", n_rows=100).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, coalesce(sum(l_quantity), 0)::DOUBLE AS s FROM lineitem WHERE false")
def empty_frame(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").limit(0).agg(F.count(F.lit(1)).alias("n"), agg.total(F.col("l_quantity")).cast("double").alias("s"))


@query("SELECT round(stddev_samp(-abs(sin(l_extendedprice / 10000)) * cos(l_discount * 10)), 6) AS v, round(avg(1 - 2 / (exp(2 * l_discount) + 1)), 6) AS m FROM lineitem WHERE l_quantity > 5")
def fused_chain_reduce(spark, sf_dir):
    rows = frame.where(load(spark, sf_dir, "lineitem"), F.col("l_quantity") > 5)
    out = agg.reduce(rows, v=("std", -F.abs(F.sin(_x())) * F.cos(_d())), m=("mean", F.tanh(F.col("l_discount"))))
    return out.select(F.round("v", 6).alias("v"), F.round("m", 6).alias("m"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_quantity AS q2, 7 AS seven, 2.5::DOUBLE * 2 AS five FROM lineitem")
def square_and_literals(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])
    return frame.with_columns(rows, q2=scalar.square(F.col("l_quantity")), seven=F.lit(7), five=F.lit(2.5) * 2).drop("l_quantity")


def _through(kind):
    """Customers written to shared storage in a format and read again with the same schema."""

    def f(spark, sf_dir):
        rows = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
        path = f"{shared_folder(spark)}/customer.{kind}"
        tables.write(rows, path, kind)
        return spark.read.schema(rows.schema).format(kind).load(path)

    f.__name__ = f"{kind}_round_trip"
    query("SELECT c_custkey, c_name, c_nationkey FROM customer")(f)


for _kind in ("csv", "json", "parquet"):
    _through(_kind)
