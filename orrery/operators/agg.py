"""Grouped and global aggregation, correlation."""

from __future__ import annotations

from functools import reduce as fold

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.storage import ship

#: corr_matrix() of more columns than this adds up products of Arrow batches: the pairs would be too many expressions.
NATIVE_COLUMNS = 12


def total(x: Column) -> Column:
    """Sum that is 0 over no rows."""
    return F.coalesce(F.sum(x), F.lit(0))


def variance(x: Column, ddof: int = 1) -> Column:
    """Null with no more rows than ddof."""
    if ddof == 1:
        return F.var_samp(x)
    if ddof == 0:
        return F.var_pop(x)
    n = F.count(x)
    return F.when(n > ddof, F.var_pop(x) * n / F.when(n > ddof, n - ddof))


def deviation(x: Column, ddof: int = 1) -> Column:
    return F.sqrt(variance(x, ddof))


_BY_NAME = {
    "sum": total, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "len": lambda _: F.count(F.lit(1)), "std": deviation, "var": variance,
    "n_unique": F.count_distinct, "median": F.median, "first": F.first, "last": F.last,
}


def aggregates(spec: dict[str, tuple[str, Column | str | None]]) -> list[Column]:
    """{output: (name, expression)} as columns."""
    out = []
    for alias, (name, x) in spec.items():
        if name not in _BY_NAME:
            raise ValueError(f"no aggregate {name}; there are {', '.join(_BY_NAME)}")
        out.append(_BY_NAME[name](F.col(x) if isinstance(x, str) else x).alias(alias))
    return out


def group_by(df: DataFrame, keys: list[str], **spec: tuple[str, Column | str | None]) -> DataFrame:
    """Keys, then aggregates in the order given; a null key is a group of its own."""
    return df.groupBy(*keys).agg(*aggregates(spec))


def reduce(df: DataFrame, **spec: tuple[str, Column | str | None]) -> DataFrame:
    """One row."""
    return df.agg(*aggregates(spec))


def arg_min(order: Column | str, x: Column | str) -> Column:
    """What `order` is where x is smallest; of ties the smallest."""
    order, x = (F.col(c) if isinstance(c, str) else c for c in (order, x))
    return F.min(F.when(x.isNotNull(), F.struct(x.alias("x"), order.alias("o"))))["o"]


def arg_max(order: Column | str, x: Column | str) -> Column:
    """What `order` is where x is largest; of ties the smallest. order: numeric."""
    order, x = (F.col(c) if isinstance(c, str) else c for c in (order, x))
    return -F.max(F.when(x.isNotNull(), F.struct(x.alias("x"), (-order).alias("o"))))["o"]


def pearson(x: Column, y: Column) -> Column:
    """Over rows where both are there; NaN if one of them is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.count(a) > 1, F.when(spread == 0, float("nan")).otherwise(F.try_divide(F.covar_pop(a, b), spread)))


def _products(df: DataFrame, names: list[str]) -> DataFrame:
    """i, j, r of every pair of columns, by sums over the rows where both are there, less a column's mean.

    A task adds up its batches and gives one row a pair. Values that are no finite numbers make r NaN, as does a
    column that is constant over the pair's rows.
    """
    ship(df.sparkSession)
    x = [F.col(f"`{n}`").cast("double") for n in names]
    ends = df.agg(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high"), F.avg(F.when(F.abs(c) < float("inf"), c)).alias("mean")).alias(f"c{k}") for k, c in enumerate(x)]).first()
    middle = np.array([(e["low"] if e["low"] == e["high"] else e["mean"]) or 0.0 for e in ends])
    middle[~np.isfinite(middle)] = 0.0
    sums = ("n", "sx", "sy", "sxx", "syy", "sxy", "odd")
    p = len(names)

    def run(batches):
        total = np.zeros((len(sums), p, p))
        for b in batches:
            there = np.stack([np.asarray(c.is_valid()) for c in b.columns], 1)
            values = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in b.columns], 1)
            odd = there & ~np.isfinite(values)
            v = np.where(there & ~odd, np.where(odd, 0.0, values) - middle, 0.0)
            m, o = there.astype(float), odd.astype(float)
            first, squares = v.T @ m, (v * v).T @ m
            total += np.stack([m.T @ m, first, first.T, squares, squares.T, v.T @ v, o.T @ m + m.T @ o])
        i, j = np.triu_indices(p)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(t[i, j]) for t in total]], names=["i", "j", *sums])

    parts = df.select(*[c.alias(f"c{k}") for k, c in enumerate(x)]).mapInArrow(run, "i int, j int, " + ", ".join(f"{s} double" for s in sums))
    own = parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums])
    spread = lambda s, ss: F.when(F.col("n") * F.col(ss) - F.col(s) * F.col(s) > 1e-13 * F.col("n") * F.col(ss), F.col("n") * F.col(ss) - F.col(s) * F.col(s)).otherwise(0.0)
    own = own.withColumn("vx", spread("sx", "sxx")).withColumn("vy", spread("sy", "syy"))
    r = F.when((F.col("odd") > 0) | (F.col("vx") == 0) | (F.col("vy") == 0), float("nan")).otherwise(F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt("vx") * F.sqrt("vy")))
    return own.select("i", "j", F.when(F.col("n") > 1, r).alias("r"))


def corr_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, then one value a column: Pearson's r of every pair, pairwise complete. One pass over the data, two for
    more than NATIVE_COLUMNS columns (their means first)."""
    names = columns or df.columns
    if not names:
        raise ValueError("no columns to correlate")
    for name in names:
        if not isinstance(df.schema[name].dataType, T.NumericType):
            raise ValueError(f"{name} is not numeric")
    if len(names) > NATIVE_COLUMNS:
        p = len(names)
        cells = df.sparkSession.range(p * p).select(F.expr(f"cast(id div {p} as int)").alias("row"), (F.col("id") % p).cast("int").alias("column"))  # a table without rows has no products
        half = _products(df, names)
        both = cells.join(half, (F.least("row", "column") == half["i"]) & (F.greatest("row", "column") == half["j"]), "left").select(F.col("row").alias("i"), F.col("column").alias("j"), "r")
        rows = both.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "r"))).alias("r"))  # as long as there are columns
        labels = F.array(*map(F.lit, names))
        return rows.select(F.get(labels, F.col("i")).alias("column"), *[F.col("r")[j]["r"].alias(m) for j, m in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    one = df.agg(*[pearson(F.col(f"`{names[i]}`"), F.col(f"`{names[j]}`")).alias(f"r{i}_{j}") for i, j in pairs])
    rows = [F.struct(F.lit(n).alias("column"), *[F.col(f"r{min(i, j)}_{max(i, j)}").alias(m) for j, m in enumerate(names)]) for i, n in enumerate(names)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def corr_long(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """a, b, r of every pair."""
    names = columns or df.columns
    wide = corr_matrix(df, names)
    return fold(DataFrame.unionByName, [wide.select(F.col("column").alias("a"), F.lit(m).alias("b"), F.col(f"`{m}`").alias("r")) for m in names])
