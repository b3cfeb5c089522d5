"""Queries of ordered operators and calendar fields."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from orrery.operators import ordered, temporal
from orrery.plans.catalog import query
from orrery.sources.tables import load
from orrery.streaming import windows

ORDER = ["ts", "event_id"]
BY = "ORDER BY ts, event_id"


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"])


def _rolling(name: str, digits: int, call: str, window: int = 10, suffix: str = ""):
    def f(spark, sf_dir):
        return ordered.rolling(_events(spark, sf_dir), "value", window, ORDER, {"v": name}).select("event_id", F.round("v", digits).alias("v"))

    f.__name__ = f"rolling_{name}{suffix}"
    w = f"OVER ({BY} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    query(f"SELECT event_id, CASE WHEN count(value) {w} >= {window} THEN round({call}(value) {w}, {digits}) END AS v FROM events")(f)


for _name, _digits, _call in (("sum", 3, "sum"), ("mean", 4, "avg"), ("var", 6, "var_samp"), ("std", 6, "stddev_samp"), ("min", 4, "min"), ("max", 4, "max")):
    _rolling(_name, _digits, _call)
for _name, _digits, _call in (("mean", 7, "avg"), ("std", 6, "stddev_samp")):
    _rolling(_name, _digits, _call, 1000, "_1000")


@query(f"""SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round(avg(value) OVER w, 4) END AS v FROM events
WINDOW w AS (PARTITION BY user_id {BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling_by_user(spark, sf_dir):
    return ordered.rolling(_events(spark, sf_dir), "value", 5, ORDER, {"v": "mean"}, partition_by="user_id").select("event_id", F.round("v", 4).alias("v"))


@query(f"""WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events)
SELECT event_id, CASE WHEN count(x) OVER w >= 3 THEN round(sum(x) OVER w, 3) END AS v FROM e WINDOW w AS ({BY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def rolling_nulls(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("x", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return ordered.rolling(rows, "x", 3, ORDER, {"v": "sum"}).select("event_id", F.round("v", 3).alias("v"))


@query(f"SELECT event_id, round(sum(value) OVER ({BY} ROWS UNBOUNDED PRECEDING), 3) AS v FROM events")
def cum_sum(spark, sf_dir):
    return ordered.cum_sum(_events(spark, sf_dir), "value", ORDER, "v").select("event_id", F.round("v", 3).alias("v"))


@query(f"""WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 5 <> 0 THEN event_id % 100 END AS x FROM events)
SELECT event_id, CASE WHEN x IS NOT NULL THEN CAST(sum(x) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS v FROM e""")
def cum_sum_nulls(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("x", F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 100))
    return ordered.cum_sum(rows, "x", ORDER, "v").select("event_id", "v")


@query(f"SELECT event_id, round(product(1 + value / 1e6) OVER ({BY} ROWS UNBOUNDED PRECEDING), 6) AS v FROM events")
def cum_prod(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("x", 1 + F.col("value") / 1e6)
    return ordered.cum_prod(rows, "x", ORDER, "v").select("event_id", F.round("v", 6).alias("v"))


@query(f"SELECT event_id, max(value) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS high, min(value) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS low FROM events")
def cum_max_min(spark, sf_dir):
    return ordered.cumulative(_events(spark, sf_dir), ORDER, {"high": ("max", "value"), "low": ("min", "value")}).select("event_id", "high", "low")


@query(f"SELECT event_id, lag(value, 3) OVER ({BY}) AS before, lead(value, 2) OVER ({BY}) AS after FROM events")
def shift(spark, sf_dir):
    return ordered.shifts(_events(spark, sf_dir), ORDER, {"before": ("value", 3), "after": ("value", -2)}).select("event_id", "before", "after")


@query("SELECT event_id, round(sum(value) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING), 3) AS total, max(value) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS high FROM events")
def cum_reverse(spark, sf_dir):
    out = ordered.cumulative(_events(spark, sf_dir), ORDER, {"total": ("sum", "value"), "high": ("max", "value")}, reverse=True)
    return out.select("event_id", F.round("total", 3).alias("total"), "high")


@query(f"""SELECT event_id, CASE WHEN count(value) OVER w >= 20 THEN round(median(value) OVER w, 5) END AS md, CASE WHEN count(value) OVER w >= 20 THEN round(quantile_cont(value, 0.9) OVER w, 5) END AS p90 FROM events
WINDOW w AS ({BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def rolling_quantiles(spark, sf_dir):
    out = ordered.rolling(_events(spark, sf_dir), "value", 20, ORDER, {"md": "median", "p90": 0.9})
    return out.select("event_id", F.round("md", 5).alias("md"), F.round("p90", 5).alias("p90"))


def _by_time(name: str, keys: str, by: str | None):
    def f(spark, sf_dir):
        rows = load(spark, sf_dir, "events", ["event_id", "ts", "value", *([by] if by else [])])
        out = ordered.rolling_by(rows, "value", "ts", timedelta(hours=6), {"total": "sum", "low": "min", "high": "max"}, by)
        return out.select("event_id", F.round("total", 3).alias("total"), "low", "high")

    f.__name__ = name
    w = f"({keys}ORDER BY ts RANGE BETWEEN INTERVAL '21599.999999 seconds' PRECEDING AND CURRENT ROW)"
    query(f"SELECT event_id, round(sum(value) OVER w, 3) AS total, min(value) OVER w AS low, max(value) OVER w AS high FROM events WINDOW w AS {w}")(f)


_by_time("rolling_6_hours", "", None)
_by_time("rolling_6_hours_by_user", "PARTITION BY user_id ", "user_id")


@query(f"SELECT event_id, row_number() OVER ({BY}) - 1 AS index FROM events")
def row_index(spark, sf_dir):
    return ordered.row_index(_events(spark, sf_dir), ORDER).select("event_id", "index")


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders")
def dt_year_month_day(spark, sf_dir):
    x = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select("o_orderkey", temporal.field(x, "year").alias("y"), temporal.field(x, "month").alias("m"), temporal.field(x, "day").alias("d"))


@query("""SELECT event_id, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s, CAST(quarter(ts) AS INTEGER) AS q, CAST(isodow(ts) - 1 AS INTEGER) AS wd,
CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(weekofyear(ts) AS INTEGER) AS wk, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS days FROM events""")
def dt_fields(spark, sf_dir):
    names = {"h": "hour", "mi": "minute", "s": "second", "q": "quarter", "wd": "weekday", "doy": "ordinal_day", "wk": "week"}
    return load(spark, sf_dir, "events").select("event_id", *[temporal.field(F.col("ts"), n).alias(a) for a, n in names.items()], temporal.days(F.col("ts")).alias("days"))


@query("""WITH o AS (SELECT o_orderkey, timezone('America/New_York', timezone('UTC', o_orderdate)) AS ny, timezone('Asia/Kolkata', timezone('UTC', o_orderdate)) AS ko FROM orders)
SELECT o_orderkey, CAST(day(ny) AS INTEGER) AS ny_day, CAST(hour(ny) AS INTEGER) AS ny_hour, CAST(hour(ko) AS INTEGER) AS ko_hour, CAST(minute(ko) AS INTEGER) AS ko_minute FROM o""")
def dt_zones(spark, sf_dir):
    x, ny, ko = F.col("o_orderdate"), "America/New_York", "Asia/Kolkata"
    fields = {"ny_day": ("day", ny), "ny_hour": ("hour", ny), "ko_hour": ("hour", ko), "ko_minute": ("minute", ko)}
    return load(spark, sf_dir, "orders").select("o_orderkey", *[temporal.field(x, name, zone).alias(a) for a, (name, zone) in fields.items()])


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1")
def dt_trunc_month(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark, sf_dir):
    out = windows.tumbling(load(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")])
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(spark, sf_dir):
    out = windows.sessions(load(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")])
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
