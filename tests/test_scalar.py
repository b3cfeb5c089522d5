"""IEEE edges against Python's and NumPy's arithmetic."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.functions import scalar


def same(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) and math.isnan(a):
        return math.isnan(b)
    return a == pytest.approx(b, rel=1e-9, abs=1e-12)


EDGES = [None, 0.0, -0.0, 1.0, -1.0, 2.5, -7.5, 1e300, float("inf"), float("-inf"), float("nan")]


def test_division_and_modulo(spark):
    pairs = [(a, b) for a in EDGES for b in EDGES]
    df = spark.createDataFrame(pairs, "a double, b double").select("a", "b", scalar.ieee_div(F.col("a"), F.col("b")).alias("q"), scalar.floor_mod(F.col("a"), F.col("b")).alias("m"))
    with np.errstate(all="ignore"):
        for r in df.collect():
            if r.a is None or r.b is None:
                assert r.q is None and r.m is None
                continue
            if r.b == 0:
                want = float("nan") if r.a == 0 or math.isnan(r.a) else math.copysign(math.inf, r.a)
                assert same(r.q, want) and math.isnan(r.m)
            else:
                assert same(r.q, float(np.float64(r.a) / np.float64(r.b))), r
            if r.b not in (0, None) and all(map(math.isfinite, (r.a, r.b))) and abs(r.a) < 1e15:
                assert same(r.m, r.a - r.b * math.floor(r.a / r.b)), r


@pytest.mark.parametrize("name,f", [("ieee_ln", np.log), ("ieee_log2", np.log2), ("ieee_log10", np.log10), ("ieee_log1p", np.log1p)])
def test_logarithms(spark, name, f):
    df = spark.createDataFrame([(x,) for x in EDGES], "x double").select("x", getattr(scalar, name)(F.col("x")).alias("y"))
    with np.errstate(all="ignore"):
        for r in df.collect():
            assert same(r.y, None if r.x is None else float(f(np.float64(r.x)))), r


def test_rounding(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (3.5,), (1e300,), (float("inf"),), (None,)], "x double")
    got = df.select(scalar.floor(F.col("x")), scalar.ceil(F.col("x")), scalar.round_to(F.col("x")), scalar.round_to(F.col("x"), 0, "half_even")).collect()
    assert [tuple(r) for r in got[:3]] == [(2.0, 3.0, 3.0, 2.0), (-3.0, -2.0, -3.0, -2.0), (3.0, 4.0, 4.0, 4.0)]
    assert got[3][0] == 1e300 and got[4][1] == float("inf") and got[5][0] is None
    with pytest.raises(ValueError):
        scalar.round_to(F.col("x"), 0, "down")


STEPS = {"neg": (lambda c: -c, np.negative), "abs": (F.abs, np.abs), "sin": (F.sin, np.sin), "cos": (F.cos, np.cos), "tanh": (F.tanh, np.tanh)}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-50, 50)), min_size=1, max_size=20), st.lists(st.sampled_from(sorted(STEPS)), min_size=1, max_size=5))
def test_chains_equal_numpy(spark, values, steps):
    column, want = F.col("x"), np.array([np.nan if v is None else v for v in values])
    for s in steps:
        column, want = STEPS[s][0](column), STEPS[s][1](want)
    got = [r.y for r in spark.createDataFrame([(v,) for v in values], "x double").select(column.alias("y")).collect()]
    for v, a, b in zip(values, got, want, strict=True):
        assert (a is None) if v is None else a == pytest.approx(b, abs=1e-9)


def test_black_scholes_parity(spark):
    r = spark.createDataFrame([(100.0,)], "s double").select(scalar.black_scholes_call(F.col("s"), 100.0, 1.0, 0.05, 0.2).alias("c"), scalar.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("d")).first()
    assert r.c == pytest.approx(10.4506, abs=1e-3) and r.d == pytest.approx(math.pi * 6371, rel=1e-9)
