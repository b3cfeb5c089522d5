"""Operators that depend on row order. The order is always given: a table has none of its own.

With `partition_by` they are plain windows. Without it no row goes to a single task: rows are dealt by
ranges of the order, each range is scanned on its own, and what lies before a range comes from the
ranges' totals, one row a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.storage import ship, written

BLOCK, AT, HALO, FIRST = "__block", "__at", "__halo", "__first"
#: Rows of a block of rolling windows; a block also holds the rows that its windows reach back to.
BLOCK_ROWS = 1 << 16


def batch_only(df: DataFrame) -> None:
    if df.isStreaming:
        raise ValueError("an operator over the whole order needs a batch table, not a stream")


def _keys(order_by: str | list[str]) -> list[str]:
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    if not names:
        raise ValueError("order_by is empty")
    return names


def _sorted(names: list[str], reverse: bool = False) -> list[Column]:
    return [F.col(c).desc_nulls_last() if reverse else F.col(c).asc_nulls_first() for c in names]


def _ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df with BLOCK, the number of the range; written, as ranges come from a sample that may differ between runs."""
    dealt = df.repartitionByRange(*_sorted(order))
    return written(dealt.withColumn(BLOCK, F.spark_partition_id()))


class Scan(NamedTuple):
    """What a range adds to those after it (total, also the running value within a range), how totals merge, and how both make a value."""

    total: Column
    merge: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    keep: Column | None = None


def _scan(df: DataFrame, order: list[str], steps: dict[str, Scan], reverse: bool = False) -> DataFrame:
    """One write and one pass over the ranges for all the new columns; reverse: from the last row on."""
    batch_only(df)
    blocks = _ranges(df, order)
    frame = Window.partitionBy(BLOCK).orderBy(*_sorted(order, reverse)).rowsBetween(Window.unboundedPreceding, 0)
    totals = blocks.groupBy(BLOCK).agg(*[s.total.alias(f"__total{k}") for k, s in enumerate(steps.values())])
    before = Window.orderBy(*_sorted([BLOCK], reverse)).rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(BLOCK, *[s.merge(F.col(f"__total{k}")).over(before).alias(f"__prefix{k}") for k, s in enumerate(steps.values())])
    done = blocks.withColumns({f"__local{k}": s.total.over(frame) for k, s in enumerate(steps.values())})
    done = done.join(F.broadcast(prefix), BLOCK, "left")  # one row a range
    values = {into: s.combine(F.col(f"__local{k}"), F.col(f"__prefix{k}")) for k, (into, s) in enumerate(steps.items())}
    made = [(F.when(s.keep, values[into]) if s.keep is not None else values[into]).alias(into) for into, s in steps.items()]
    return done.select(*[c for c in df.columns if c not in steps], *made)


CUMULATIVE = {"sum": (F.sum, lambda a, b: a + b), "prod": (F.product, lambda a, b: a * b), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def cumulative(df: DataFrame, order_by: str | list[str], into: dict[str, tuple[str, str]], partition_by: str | list[str] | None = None, reverse: bool = False) -> DataFrame:
    """Running values; into: {new column: (one of CUMULATIVE, column)}, all in one pass. Null where the value is null, which
    the running value skips. reverse: from the last row back to the first."""
    for name, _ in into.values():
        if name not in CUMULATIVE:
            raise ValueError(f"no running {name}; there are {', '.join(CUMULATIVE)}")
    order = _keys(order_by)
    if not into:
        return df
    if partition_by:
        frame = Window.partitionBy(*_keys(partition_by)).orderBy(*_sorted(order, reverse)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({new: F.when(F.col(c).isNotNull(), CUMULATIVE[name][0](F.col(c)).over(frame)) for new, (name, c) in into.items()})

    def step(name: str, column: str) -> Scan:
        f, merged = CUMULATIVE[name]
        return Scan(f(F.col(column)), f, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merged(a, b)), F.col(column).isNotNull())

    return _scan(df, order, {new: step(*of) for new, of in into.items()}, reverse)


def cum_sum(df: DataFrame, column: str, order_by: str | list[str], into: str, partition_by: str | list[str] | None = None) -> DataFrame:
    return cumulative(df, order_by, {into: ("sum", column)}, partition_by)


def cum_prod(df: DataFrame, column: str, order_by: str | list[str], into: str, partition_by: str | list[str] | None = None) -> DataFrame:
    return cumulative(df, order_by, {into: ("prod", column)}, partition_by)


def cum_max(df: DataFrame, column: str, order_by: str | list[str], into: str, partition_by: str | list[str] | None = None) -> DataFrame:
    return cumulative(df, order_by, {into: ("max", column)}, partition_by)


def cum_min(df: DataFrame, column: str, order_by: str | list[str], into: str, partition_by: str | list[str] | None = None) -> DataFrame:
    return cumulative(df, order_by, {into: ("min", column)}, partition_by)


def row_index(df: DataFrame, order_by: str | list[str], into: str = "index") -> DataFrame:
    """Positions from 0 on."""
    one = F.count(F.lit(1))
    return _scan(df, _keys(order_by), {into: Scan(one, F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)) - 1)})


def _with_halo(df: DataFrame, order: list[str], back: int, ahead: int = 0) -> tuple[DataFrame, Window]:
    """Blocks of rows by position, each with copies of the rows that its windows reach; and their window."""
    size = max(BLOCK_ROWS, back, ahead)
    placed = row_index(df, order, AT).withColumn(BLOCK, F.expr(f"{AT} div {size}"))
    at = F.col(AT) % size
    copies = [F.struct(F.col(BLOCK).alias("b"), F.lit(False).alias("h"))]
    if back:
        copies.append(F.when(at >= size - back, F.struct((F.col(BLOCK) + 1).alias("b"), F.lit(True).alias("h"))))
    if ahead:
        copies.append(F.when((at < ahead) & (F.col(BLOCK) > 0), F.struct((F.col(BLOCK) - 1).alias("b"), F.lit(True).alias("h"))))
    spread = placed.withColumn("__copy", F.explode(F.array_compact(F.array(*copies))))
    return spread.withColumn(BLOCK, F.col("__copy.b")).withColumn(HALO, F.col("__copy.h")), Window.partitionBy(BLOCK).orderBy(AT)


def shifts(df: DataFrame, order_by: str | list[str], into: dict[str, tuple[str, int]], partition_by: str | list[str] | None = None) -> DataFrame:
    """into: {new column: (column, n)}, all in one pass: the value n rows before (n < 0: after); null where there is none."""
    moved = lambda c, n, w: (F.lag(c, n) if n >= 0 else F.lead(c, -n)).over(w)
    order = _keys(order_by)
    if not into:
        return df
    if partition_by:
        frame = Window.partitionBy(*_keys(partition_by)).orderBy(*_sorted(order))
        return df.withColumns({new: moved(c, n, frame) for new, (c, n) in into.items()})
    batch_only(df)
    steps = [n for _, n in into.values()]
    rows, frame = _with_halo(df, order, max(0, *steps), max(0, *(-n for n in steps)))
    made = {f"__moved{k}": moved(c, n, frame) for k, (c, n) in enumerate(into.values())}
    done = rows.withColumns(made).where(~F.col(HALO))
    return done.select(*[c for c in df.columns if c not in into], *[F.col(m).alias(new) for m, new in zip(made, into, strict=True)])


def shift(df: DataFrame, column: str, n: int, order_by: str | list[str], into: str, partition_by: str | list[str] | None = None) -> DataFrame:
    return shifts(df, order_by, {into: (column, n)}, partition_by)


ROLLING = ("sum", "mean", "var", "std", "min", "max", "median")


def _check_rolling(into: dict[str, str | float]) -> None:
    for name in into.values():
        if not (name in ROLLING or isinstance(name, float) and 0 <= name <= 1):
            raise ValueError(f"no rolling {name}; there are {', '.join(ROLLING)} and quantiles from 0.0 to 1.0")


def _rolled(name: str | float, x: Column, frame: Window, spread: Column) -> Column:
    """Sliding quantiles are worked out anew for each window, in time that grows with it; the others are Spark's aggregates."""
    if isinstance(name, float) or name == "median":
        return F.percentile(x, 0.5 if name == "median" else name).over(frame)
    return {"sum": lambda: F.sum(x).over(frame), "mean": lambda: F.avg(x).over(frame), "min": lambda: F.min(x).over(frame), "max": lambda: F.max(x).over(frame), "var": lambda: spread, "std": lambda: F.sqrt(spread)}[name]()


def rolling(df: DataFrame, column: str, window: int, order_by: str | list[str], into: dict[str, str | float], ddof: int = 1, partition_by: str | list[str] | None = None) -> DataFrame:
    """Trailing windows of `window` rows; into: {new column: one of ROLLING, or a quantile between 0.0 and 1.0, interpolated}.
    Null until the window is full of values that aren't null."""
    if window < 1:
        raise ValueError("a window has at least one row")
    _check_rolling(into)
    if window <= ddof and {"var", "std"} & set(into.values()):
        raise ValueError("a variance needs a window above ddof")
    order = _keys(order_by)
    if partition_by:
        rows, base = df, Window.partitionBy(*_keys(partition_by)).orderBy(*_sorted(order))
    else:
        batch_only(df)
        rows, base = _with_halo(df, order, window - 1)
    frame, x = base.rowsBetween(-(window - 1), 0), F.col(column).cast("double")
    spread = F.var_samp(x).over(frame) if ddof == 1 else F.var_pop(x).over(frame) * window / (window - ddof)
    full = F.count(x).over(frame) >= window
    out = rows.withColumns({new: F.when(full, _rolled(name, x, frame, spread)) for new, name in into.items()})
    out = out if partition_by else out.where(~F.col(HALO))
    return out.select(*[c for c in df.columns if c not in into], *into)


def _merged(a: tuple, b: tuple) -> tuple:
    """Counts, means and squared deviations of neighbouring runs of values, put together."""
    n = a[0] + b[0]
    apart, share = b[1] - a[1], b[0] / np.maximum(n, 1)
    return n, a[1] + apart * share, a[2] + b[2] + apart * apart * a[0] * share


def _windowed(x: np.ndarray, there: np.ndarray, start: np.ndarray, end: np.ndarray, names: list[str]) -> dict[str, pa.Array]:
    """Aggregates of x[start:end] for every window, each with a row or more, from those of runs of 1, 2, 4 and so on values.

    n log n steps for windows of any length; nothing is subtracted, so that no value outside a window touches it.
    """
    sizes = end - start
    before = np.concatenate([[0], np.cumsum(there)])
    count = before[end] - before[start]
    held, at, out = {}, start.copy(), {}
    with np.errstate(all="ignore"):
        if {"sum", "mean"} & set(names):
            held["sum"], out["sum"] = np.where(there, x, 0.0), np.zeros(len(start))
        if "min" in names:
            held["min"], out["min"] = np.where(there, x, np.nan), np.zeros(len(start))  # fmin passes over NaN, the largest value
        if "max" in names:
            held["max"], out["max"] = np.where(there, x, -np.inf), np.zeros(len(start))
        if {"var", "std"} & set(names):
            held["spread"], out["spread"] = (there.astype(float), np.where(there, x, 0.0), np.where(there & ~np.isfinite(x), np.nan, 0.0)), tuple(np.zeros((3, len(start))))
        merge = {"sum": np.add, "min": np.fmin, "max": np.maximum}
        for k in range(int(sizes.max(initial=0)).bit_length()):
            run = 1 << k
            last, odd = np.nonzero(sizes >> k == 1)[0], np.nonzero(sizes >> k & 1)[0]
            for name, values in held.items():
                if name in ("min", "max"):  # two runs that may overlap
                    out[name][last] = merge[name](values[start[last]], values[end[last] - run])
                elif name == "sum":
                    out[name][odd] += values[at[odd]]
                else:
                    for into, part in zip(out[name], _merged(tuple(v[odd] for v in out[name]), tuple(v[at[odd]] for v in values)), strict=True):
                        into[odd] = part
                held[name] = _merged(tuple(v[:-run] for v in values), tuple(v[run:] for v in values)) if name == "spread" else merge[name](values[:-run], values[run:])
            at[odd] += run
        if "mean" in names:
            out["mean"] = out["sum"] / count
        if "spread" in out:
            out["var"] = out["spread"][2] / (out["spread"][0] - 1)
            out["std"] = np.sqrt(out["var"])
    return {name: pa.array(out[name], pa.float64(), mask=count < (2 if name in ("var", "std") else 1)) for name in set(names)}


def _slide(width: int, into: dict[str, str], keep: list[int], names: list[str], block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rolling_by() over rows sorted by group and time: columns, then time, value, whether a group starts, whether the row is a copy.

    Holds the rows of the widest window and those that wait for the last row of their time, `block` rows at least.
    """

    def run(batches):
        group = []  # batches that aren't out yet
        back = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))  # rows that are out, but in reach
        waiting, enough = 0, block

        def numbers(table):
            x = table.column(-3)
            return table.column(-4).to_numpy(), x.fill_null(0.0).to_numpy(), x.is_valid().to_numpy()

        def flush(final):
            nonlocal group, back, waiting, enough
            if not group:
                return None
            table = pa.Table.from_batches(group).combine_chunks()
            t, x, there = (np.concatenate(both) for both in zip(back, numbers(table), strict=True))
            old, until = len(back[0]), len(t) if final else int(np.searchsorted(t, t[-1]))
            if until <= old:  # all of one time: as many again, before it is tried again
                group, enough = table.to_batches(), 2 * waiting
                return None
            low = np.iinfo(np.int64).min
            reach = lambda v: np.where(v < low + width, low, v - (width - 1))
            start, end = np.searchsorted(t, reach(t[old:until])), np.searchsorted(t, t[old:until], "right")
            made = _windowed(x, there, start, end, list(into.values()))
            ready = table.slice(0, until - old)
            out = pa.Table.from_arrays([*[ready.column(k) for k in keep], *[made[name] for name in into.values()]], names=names)
            first = len(t) if final else int(np.searchsorted(t, reach(t[until : until + 1]))[0])
            back = tuple(v[first:until] for v in (t, x, there))
            rest = table.slice(until - old)
            group, waiting = rest.to_batches() if rest.num_rows else [], rest.num_rows
            enough = max(block, len(back[0])) + waiting
            return out.filter(pc.invert(ready.column(-1))).combine_chunks()

        for batch in batches:
            cuts = [0, *np.nonzero(batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False))[0].tolist(), batch.num_rows]
            for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if k and (done := flush(True)) is not None:
                    yield from done.to_batches()
                if k:
                    back, waiting, enough = tuple(v[:0] for v in back), 0, block
                if i == j:
                    continue
                group.append(batch.slice(i, j - i))
                waiting += j - i
                if waiting >= enough and (done := flush(False)) is not None:
                    yield from done.to_batches()
        if (done := flush(True)) is not None:
            yield from done.to_batches()

    return run


def rolling_by(df: DataFrame, column: str, on: str, width: timedelta | int, into: dict[str, str | float], partition_by: str | list[str] | None = None) -> DataFrame:
    """Trailing windows (t - width, t] of a timestamp or date (width: a timedelta) or integer column `on`; into as in rolling().

    A window holds all rows of its times; null without a value, a variance with one. Rows whose `on` is null get null.
    Without `partition_by` the times are cut into slices of equal width, at least a window wide, as many as the rows have
    BLOCK_ROWS; a slice also holds the rows that its windows reach back to. Rows of one slice, or of one key, meet in one task,
    which holds those of a window at a time, and takes n log n steps however many rows a window has. Only with a median or
    quantile each window is worked out anew, in time that grows with it.
    """
    _check_rolling(into)
    t = F.col(on)
    if isinstance(width, timedelta):
        t, width = F.unix_micros(t.cast("timestamp")), width // timedelta(microseconds=1)
    if width < 1:
        raise ValueError("a window has a width")
    every = df.withColumn(AT, t.cast("long"))
    placed, rest = every.where(F.col(AT).isNotNull()), every.where(F.col(AT).isNull())
    if partition_by:
        rows, base = placed.withColumn(HALO, F.lit(False)), Window.partitionBy(*_keys(partition_by))
    else:
        batch_only(df)
        sizes = placed.agg(F.count(AT).alias("n"), F.min(AT).alias("low"), F.max(AT).alias("high")).first()
        low, high = sizes["low"] or 0, sizes["high"] or 0
        size = max(width, (high - low) // (sizes["n"] // BLOCK_ROWS + 1) + 1)
        block = F.expr(f"({AT} - {low}L) div {size}L")
        reaches = F.expr(f"({AT} - {low}L) % {size}L") > size - width
        copies = F.array(F.struct(block.alias("b"), F.lit(False).alias("h")), F.when(reaches, F.struct((block + 1).alias("b"), F.lit(True).alias("h"))))
        rows = placed.withColumn("__copy", F.explode(F.array_compact(copies))).withColumn(BLOCK, F.col("__copy.b")).withColumn(HALO, F.col("__copy.h")).drop("__copy")
        base = Window.partitionBy(BLOCK)
    x, kept = F.col(column).cast("double"), [c for c in df.columns if c not in into]
    names = [*kept, *into]
    if all(name in ROLLING and name != "median" for name in into.values()):
        ship(df.sparkSession)
        sorted_rows = rows.withColumn(FIRST, F.row_number().over(base.orderBy(AT)) == 1).select(*df.columns, AT, x, FIRST, HALO)  # x only here: it isn't moved twice
        schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in kept], *[T.StructField(c, T.DoubleType()) for c in into]])
        slide = _slide(width, into, [k for k, c in enumerate(df.columns) if c not in into], names, BLOCK_ROWS)
        done = sorted_rows.toDF(*[f"c{k}" for k in range(len(sorted_rows.columns))]).mapInArrow(slide, schema)
    else:
        frame = base.orderBy(AT).rangeBetween(1 - width, 0)
        done = rows.withColumns({new: _rolled(name, x, frame, F.var_samp(x).over(frame)) for new, name in into.items()}).where(~F.col(HALO))
    return done.select(*names).unionByName(rest.withColumns(dict.fromkeys(into, F.lit(None).cast("double"))).select(*names))
