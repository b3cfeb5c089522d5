"""Random frames, predicates, projections and groups against plain Python."""

import operator
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.operators import agg, frame

SCHEMA = "i long, a long, b long, x double, m boolean"
OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
relaxed = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@st.composite
def frames(draw):
    """Rows with, by column, no, some or only nulls; also no rows."""
    whole = st.integers(-5, 5)
    values = {"a": whole, "b": whole, "x": st.floats(-3, 3, width=32), "m": st.booleans()}
    cells = {k: draw(st.sampled_from([v, st.none() | v, st.none()])) for k, v in values.items()}
    rows = draw(st.lists(st.tuples(*(cells[k] for k in ("a", "b", "x", "m"))), max_size=25))
    return [(i, *row) for i, row in enumerate(rows)]


@st.composite
def predicates(draw, depth=3):
    kind = draw(st.sampled_from(["column", "literal", "flipped", "bool", "and", "or", "not"] if depth else ["column", "literal", "bool"]))
    op = draw(st.sampled_from(sorted(OPS)))
    if kind == "bool":
        return ("bool",)
    if kind in ("and", "or"):
        return kind, draw(predicates(depth - 1)), draw(predicates(depth - 1))
    if kind == "not":
        return kind, draw(predicates(depth - 1))
    return (kind, op, draw(st.integers(-5, 5)))


def column(p):
    if p[0] == "bool":
        return F.col("m")
    if p[0] == "not":
        return ~column(p[1])
    if p[0] in ("and", "or"):
        return (operator.and_ if p[0] == "and" else operator.or_)(column(p[1]), column(p[2]))
    f = OPS[p[1]]
    return {"column": lambda: f(F.col("a"), F.col("b")), "literal": lambda: f(F.col("x"), F.lit(p[2])), "flipped": lambda: f(F.lit(p[2]), F.col("a"))}[p[0]]()


def value(p, row):
    _, a, b, x, m = row
    if p[0] == "bool":
        return m
    if p[0] == "not":
        v = value(p[1], row)
        return None if v is None else not v
    if p[0] in ("and", "or"):
        pair, decides = [value(p[1], row), value(p[2], row)], p[0] == "or"
        return decides if decides in pair else None if None in pair else not decides
    left, right = {"column": (a, b), "literal": (x, p[2]), "flipped": (p[2], a)}[p[0]]
    return None if left is None or right is None else OPS[p[1]](left, right)


@relaxed
@given(frames(), predicates())
def test_filters_are_three_valued(spark, rows, p):
    got = {r.i for r in frame.where(spark.createDataFrame(rows, SCHEMA), column(p)).collect()}
    assert got == {r[0] for r in rows if value(p, r) is True}


@relaxed
@given(frames(), st.permutations(["i", "a", "b", "x", "m"]).flatmap(lambda p: st.integers(1, 5).map(lambda n: p[:n])))
def test_projections(spark, rows, names):
    got = frame.project(spark.createDataFrame(rows, SCHEMA), *names)
    assert got.columns == names and got.count() == len(rows)


@relaxed
@given(frames())
def test_groups(spark, rows):
    out = agg.group_by(spark.createDataFrame(rows, SCHEMA), ["a", "m"], s=("sum", "b"), lo=("min", "b"), hi=("max", "b"), c=("count", "b"), n=("len", None))
    groups = defaultdict(list)
    for _, a, b, _, m in rows:
        groups[a, m].append(b)
    want = {}
    for k, values in groups.items():
        own = [v for v in values if v is not None]
        want[k] = (sum(own), min(own, default=None), max(own, default=None), len(own), len(values))
    assert {(r.a, r.m): (r.s, r.lo, r.hi, r.c, r.n) for r in out.collect()} == want


@relaxed
@given(frames(), st.booleans(), st.booleans())
def test_sorts(spark, rows, descending, nulls_last):
    got = [r.i for r in frame.sort(spark.createDataFrame(rows, SCHEMA), ["a", "i"], [descending, False], [nulls_last, False]).collect()]
    key = lambda r: ((r[1] is None) == nulls_last, 0 if r[1] is None else -r[1] if descending else r[1], r[0])
    assert got == [r[0] for r in sorted(rows, key=key)]
