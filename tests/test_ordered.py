"""Scans without a partition run over ranges; they must equal one pass in order."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = [(int(i), None if rng.random() < 0.2 else float(rng.integers(1, 9))) for i in rng.permutation(500)]
    return spark.createDataFrame(data, "o long, x double").repartition(7), pd.DataFrame(sorted(data), columns=["o", "x"]).set_index("o")["x"].astype(float)


def values(df, column="v"):
    return pd.Series({r["o"]: r[column] for r in df.collect()}, dtype=float).sort_index()


@pytest.mark.parametrize("name,f", [("cum_sum", "cumsum"), ("cum_max", "cummax"), ("cum_min", "cummin")])
def test_cumulative(rows, name, f):
    df, want = rows
    pd.testing.assert_series_equal(values(getattr(ordered, name)(df, "x", "o", "v")), getattr(want, f)(), check_names=False)


@pytest.mark.parametrize("by", [None, "g"])
def test_several_in_one_pass(rows, by, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 32)
    df, want = rows
    df = df.withColumn("g", F.lit(1)).withColumn("y", -F.col("x"))
    moved = ordered.shifts(df, "o", {"before": ("x", 5), "x": ("y", -3), "y": ("x", 0)}, by).cache()  # reads the old columns
    if by is None:
        for column, series in (("before", want.shift(5)), ("x", -want.shift(-3)), ("y", want)):
            pd.testing.assert_series_equal(values(moved, column), series, check_names=False)
    run = ordered.cumulative(df, "o", {"high": ("max", "x"), "low": ("min", "y"), "all": ("sum", "x")}, by).cache()
    for column, series in (("high", want.cummax()), ("low", (-want).cummin()), ("all", want.cumsum())):
        pd.testing.assert_series_equal(values(run, column), series, check_names=False)
    assert ordered.cumulative(df, "o", {}).columns == df.columns == ordered.shifts(df, "o", {}).columns
    with pytest.raises(ValueError):
        ordered.cumulative(df, "o", {"v": ("mode", "x")})


def test_cumulative_product(spark):
    df = spark.range(1, 60).select(F.col("id").alias("o"), (1 + F.col("id") / 100).alias("x"))
    got = values(ordered.cum_prod(df, "x", "o", "v"))
    assert np.allclose(got.to_numpy(), np.cumprod(1 + np.arange(1, 60) / 100))


@pytest.mark.parametrize("n", [1, 3, -2, 0])
def test_shift(rows, n, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 32)
    df, want = rows
    pd.testing.assert_series_equal(values(ordered.shift(df, "x", n, "o", "v")), want.shift(n), check_names=False)


@pytest.mark.parametrize("window,ddof", [(1, 0), (4, 1), (10, 0), (10, 2), (40, 1)])
def test_rolling(rows, window, ddof, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 32)
    df, want = rows
    filled = df.na.fill(0.0)
    into = {n: n for n in ("sum", "mean", "min", "max")} | ({"var": "var", "std": "std"} if window > ddof else {})
    got = ordered.rolling(filled, "x", window, "o", into, ddof).cache()
    for n in into:
        r = want.fillna(0).rolling(window)
        expected = getattr(r, n)(ddof=ddof) if n in ("var", "std") else getattr(r, n)()
        assert np.allclose(values(got, n), expected, equal_nan=True, atol=1e-9), n
    holes = values(ordered.rolling(df, "x", window, "o", {"v": "sum"}))
    assert np.allclose(holes, want.rolling(window).sum(), equal_nan=True)


def test_row_index_and_empty(rows, spark):
    df, want = rows
    got = values(ordered.row_index(df, "o", "v"))
    assert got.tolist() == list(range(500))
    assert ordered.row_index(df.limit(0), "o").count() == 0 and ordered.cum_sum(df.limit(0), "x", "o", "v").count() == 0
    assert values(ordered.cum_sum(df.withColumn("g", F.col("o") % 3), "x", "o", "v", "g")).max() < want.sum()


def test_contracts(rows, spark):
    df, _ = rows
    with pytest.raises(ValueError):
        ordered.rolling(df, "x", 0, "o", {"v": "sum"})
    with pytest.raises(ValueError):
        ordered.rolling(df, "x", 1, "o", {"v": "var"})
    with pytest.raises(ValueError):
        ordered.rolling(df, "x", 3, "o", {"v": "mode"})
    with pytest.raises(ValueError):
        ordered.cum_sum(df, "x", [], "v")
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        ordered.row_index(stream, "timestamp")


@pytest.mark.parametrize("by", [None, "g"])
def test_reverse(rows, by):
    df, want = rows
    out = ordered.cumulative(df.withColumn("g", F.lit(1)), "o", {"v": ("sum", "x"), "low": ("min", "x")}, by, reverse=True).cache()
    for column, series in (("v", want[::-1].cumsum()), ("low", want[::-1].cummin())):
        pd.testing.assert_series_equal(values(out, column), series.sort_index(), check_names=False)


def test_rolling_quantiles(rows, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 32)
    df, want = rows
    out = ordered.rolling(df, "x", 6, "o", {"md": "median", "v": 0.3}).cache()
    pd.testing.assert_series_equal(values(out, "md"), want.rolling(6).median(), check_names=False)
    pd.testing.assert_series_equal(values(out), want.rolling(6).quantile(0.3), check_names=False)
    for bad in ("mode", 1.5, -0.1):
        with pytest.raises(ValueError):
            ordered.rolling(df, "x", 6, "o", {"v": bad})


@pytest.mark.parametrize("by", [None, "g"])
def test_windows_by_time(spark, monkeypatch, by):
    """Gaps, equal times and null times, in slices, against every pair of rows."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(6)
    start = datetime.datetime(2024, 1, 1)
    data = [(i, None if i % 50 == 0 else start + datetime.timedelta(seconds=int(rng.choice([0, 1000, 9000]) + rng.integers(0, 120))), None if rng.random() < 0.2 else float(rng.integers(1, 9))) for i in range(300)]
    df = spark.createDataFrame(data, "o long, t timestamp, x double").withColumn("g", F.lit(1)).repartition(5)
    for width in (1, 30, 700):
        out = ordered.rolling_by(df, "x", "t", datetime.timedelta(seconds=width), {"v": "sum", "sd": "std", "md": "median"}, by).cache()
        near = {o: pd.Series([x for _, s, x in data if s is not None and t is not None and 0 <= (t - s).total_seconds() < width and x is not None], dtype=float) for o, t, _ in data}
        for column, f in (("v", lambda x: x.sum(min_count=1)), ("sd", lambda x: x.std()), ("md", lambda x: x.median())):
            pd.testing.assert_series_equal(values(out, column), pd.Series({o: f(x) for o, x in near.items()}, dtype=float), check_names=False)
    whole = df.withColumn("t", F.col("o") - 100)
    assert values(ordered.rolling_by(whole, "o", "t", 3, {"v": "sum"}, by)).tolist() == [0.0, 1.0, *[3.0 * i - 3 for i in range(2, 300)]]
    assert ordered.rolling_by(df.limit(0), "x", "t", datetime.timedelta(1), {"v": "sum"}, by).count() == 0
    with pytest.raises(ValueError):
        ordered.rolling_by(df, "x", "t", datetime.timedelta(0), {"v": "sum"}, by)


@pytest.mark.parametrize("by", [None, "g"])
@pytest.mark.parametrize("block", [4, 1000])
def test_windows_by_time_equal_spark_frames(spark, monkeypatch, by, block):
    """Nulls, NaN, infinities, many equal times, several groups, other columns; blocks shorter and longer than windows."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    rng = np.random.default_rng(8)
    odd = [None, None, float("nan"), float("inf"), float("-inf"), 0.0]
    data = [(i, int(rng.choice([5, 40, 400, -(1 << 62)]) + rng.integers(0, 30)), int(rng.integers(0, 3)), odd[rng.integers(0, 6)] if rng.random() < 0.15 else float(rng.normal()), [f"é{i}"]) for i in range(400)]
    df = spark.createDataFrame(data, "o long, t long, g int, x double, s array<string>").where("t > 0 or g is not null").repartition(3)
    names = {"s_": "sum", "m": "mean", "low": "min", "high": "max", "x": "std", "v": "var"}
    functions = {"s_": F.sum, "m": F.avg, "low": F.min, "high": F.max, "x": F.stddev_samp, "v": F.var_samp}
    for width in (1, 7, 100):
        frame = Window.partitionBy(*[by] * (by is not None)).orderBy("t").rangeBetween(1 - width, 0)
        want = {r["o"]: r for r in df.select("o", "t", "g", "s", *[f(F.col("x")).over(frame).alias(n) for n, f in functions.items()]).collect()}
        out = ordered.rolling_by(df, "x", "t", width, names, by)
        assert out.columns == ["o", "t", "g", "s", *names]
        got = out.collect()
        assert len(got) == len(want) == 400
        for r in got:
            w = want[r["o"]]
            assert (r["t"], r["g"], r["s"]) == (w["t"], w["g"], w["s"])
            for n in names:
                assert (r[n] is None) == (w[n] is None) and (r[n] is None or np.isclose(r[n], w[n], rtol=1e-9, atol=1e-12, equal_nan=True)), (n, r, w)


def test_long_windows_by_time(spark):
    """Every window holds all rows before it; working each out anew takes the square of the rows."""
    import time

    n = 200_000
    df = spark.range(n).select(F.col("id").alias("t"), (F.col("id") % 1000).cast("double").alias("x"))
    began = time.time()
    got = ordered.rolling_by(df, "x", "t", n, {"v": "sum", "low": "min", "high": "max"}).agg(F.count("*"), F.sum("v"), F.sum("low"), F.min("v"), F.max("high")).first()
    x = np.arange(n) % 1000
    assert tuple(got) == (n, float(np.cumsum(x).sum()), 0.0, 0.0, 999.0)
    assert time.time() - began < 60  # seconds
