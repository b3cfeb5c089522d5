"""Selections, filters, sorts and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*columns)


def with_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """All new columns see the old ones; one projection."""
    return df.withColumns(columns)


def where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows whose predicate is true; null drops a row."""
    return df.where(predicate)


def ordering(by: str | list[str], descending: bool | list[bool] = False, nulls_last: bool | list[bool] = False) -> list[Column]:
    """Sort keys; nulls come first in both directions unless told otherwise."""
    names = [by] if isinstance(by, str) else list(by)
    down = [descending] * len(names) if isinstance(descending, bool) else descending
    last = [nulls_last] * len(names) if isinstance(nulls_last, bool) else nulls_last
    if not len(names) == len(down) == len(last):
        raise ValueError("a direction and a place of nulls for each key")
    kinds = {(False, False): "asc_nulls_first", (False, True): "asc_nulls_last", (True, False): "desc_nulls_first", (True, True): "desc_nulls_last"}
    return [getattr(F.col(n), kinds[d, e])() for n, d, e in zip(names, down, last, strict=True)]


def sort(df: DataFrame, by: str | list[str], descending: bool | list[bool] = False, nulls_last: bool | list[bool] = False) -> DataFrame:
    return df.orderBy(*ordering(by, descending, nulls_last))


def _k(df: DataFrame, k: int, by: str, ties: list[str], descending: bool) -> DataFrame:
    if k < 1:
        raise ValueError("k is at least 1")
    return df.where(F.col(by).isNotNull()).orderBy(*ordering(by, descending), *ordering(ties)).limit(k)


def top_k(df: DataFrame, k: int, by: str, ties: list[str] | None = None) -> DataFrame:
    """The k largest non-null values; each task keeps k rows. ties: what orders equal values."""
    return _k(df, k, by, ties or [], True)


def bottom_k(df: DataFrame, k: int, by: str, ties: list[str] | None = None) -> DataFrame:
    return _k(df, k, by, ties or [], False)


def slice_sorted(df: DataFrame, by: str | list[str], offset: int, length: int, descending: bool | list[bool] = False) -> DataFrame:
    return sort(df, by, descending).offset(offset).limit(length)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by equal-width bin, 0 below `low` and bins + 1 from `high` on."""
    return df.where(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
