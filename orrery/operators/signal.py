"""Discrete Fourier transforms of whole columns, or of one signal a group.

Bins come in NumPy's order; fft is not scaled, ifft by 1/n. A group's signal is transformed in one task. One long
signal goes in four steps over the cluster where its length has a factor: n = a * b gives b transforms of
length a, twiddle factors, and a transforms of length b, so that no task holds more than about max(a, b) values.
Where no factor makes both short (a prime length, say), Bluestein's chirps turn the transform into a
convolution over a power of two, which has such factors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.ordered import batch_only, row_index
from orrery.storage import ship

#: Signals up to this length go to one task.
ONE_TASK = 1 << 18
OUT = "bin long, real double, imag double"


def _split(n: int) -> int:
    """The largest divisor of n not above its root."""
    return next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)


def _values(df: DataFrame, column: str) -> list:
    """real and imag of a real or a complex column; null raises when it is read."""
    kind = df.schema[column].dataType.simpleString()
    if kind.startswith("struct<"):
        parts = F.col(f"{column}.real"), F.col(f"{column}.imag")
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        parts = F.col(column), F.lit(0.0)
    else:
        raise ValueError(f"{column} is {kind}; a signal is numeric or struct<real, imag>")
    return [F.when(p.isNull(), F.raise_error(F.lit(f"{column} has a null"))).otherwise(p.cast("double")).alias(n) for p, n in zip(parts, ("real", "imag"), strict=True)]


def _transform(df: DataFrame, column: str, order_by: str | list[str], group_by: str | None, inverse: bool, one_task: int) -> DataFrame:
    batch_only(df)
    ship(df.sparkSession)
    f, sign = (np.fft.ifft, 1) if inverse else (np.fft.fft, -1)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    if group_by:
        kind = df.schema[group_by].dataType.simpleString()
        rows = df.select(F.col(group_by).alias("g"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *_values(df, column))

        def whole(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values([f"o{i}" for i in range(len(order))])
            y = f(part["real"].to_numpy() + 1j * part["imag"].to_numpy())
            return pd.DataFrame({"g": part["g"].iloc[0], "bin": np.arange(len(y)), "real": y.real, "imag": y.imag})

        return rows.groupBy("g").applyInPandas(whole, f"g {kind}, {OUT}").withColumnRenamed("g", group_by)
    n = df.count()
    rows = row_index(df.select(*order, *_values(df, column)), order, "at").select("at", "real", "imag")
    if n <= one_task:

        def one(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("at")
            y = f(part["real"].to_numpy() + 1j * part["imag"].to_numpy())
            return pd.DataFrame({"bin": np.arange(len(y)), "real": y.real, "imag": y.imag})

        return rows.groupBy().applyInPandas(one, OUT)
    out = _four_steps(rows, n, sign) if n // _split(n) <= one_task else _chirps(rows, n, sign)
    return out.select("bin", F.col("real") / n, F.col("imag") / n).toDF("bin", "real", "imag") if inverse else out


def _four_steps(rows: DataFrame, n: int, sign: int) -> DataFrame:
    """The unscaled transform of rows (at, real, imag) for every at below n."""
    a = _split(n)
    b = n // a
    f = (lambda x: np.fft.ifft(x) * len(x)) if sign > 0 else np.fft.fft

    def columns(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        j = int(part["at"].iloc[0]) % b
        k = np.arange(a)
        y = f(part["real"].to_numpy() + 1j * part["imag"].to_numpy()) * np.exp(sign * 2j * np.pi * (j * k % n) / n)
        return pd.DataFrame({"k": k, "j": j, "real": y.real, "imag": y.imag})

    def across(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("j")
        y = f(part["real"].to_numpy() + 1j * part["imag"].to_numpy())
        return pd.DataFrame({"bin": int(part["k"].iloc[0]) + a * np.arange(b), "real": y.real, "imag": y.imag})

    first = rows.groupBy((F.col("at") % b).alias("j")).applyInPandas(columns, "k long, j long, real double, imag double")
    return first.groupBy("k").applyInPandas(across, OUT)


def _times(a: tuple, b: tuple) -> list:
    """The product of two complex numbers, each a pair of columns."""
    return [(a[0] * b[0] - a[1] * b[1]).alias("real"), (a[0] * b[1] + a[1] * b[0]).alias("imag")]


def _chirps(rows: DataFrame, n: int, sign: int) -> DataFrame:
    """The unscaled transform of any length: j * k = (j^2 + k^2 - (k - j)^2) / 2 makes it a convolution."""
    m = 1 << (2 * n - 2).bit_length()
    own = F.col("real"), F.col("imag")

    def chirp(at, direction: int) -> tuple:
        angle = (at * at % (2 * n)).cast("double") * (direction * math.pi / n)  # exact before it is an angle
        return F.cos(angle), F.sin(angle)

    spark = rows.sparkSession
    padding = spark.range(n, m).select(F.col("id").alias("at"), F.lit(0.0).alias("real"), F.lit(0.0).alias("imag"))
    signal = rows.select("at", *_times(own, chirp(F.col("at"), sign))).unionByName(padding)
    near = F.least(F.col("id"), m - F.col("id"))
    kernel = spark.range(m).select(F.col("id").alias("at"), *[F.when(near < n, x).otherwise(0.0).alias(name) for x, name in zip(chirp(near, -sign), ("real", "imag"), strict=True)])
    x, y = _four_steps(signal, m, -1), _four_steps(kernel, m, -1).toDF("bin", "re2", "im2")
    both = x.join(y, "bin").select(F.col("bin").alias("at"), *_times(own, (F.col("re2"), F.col("im2"))))
    back = _four_steps(both, m, 1).where(F.col("bin") < n).select("bin", F.col("real") / m, F.col("imag") / m).toDF("bin", "real", "imag")
    return back.select("bin", *_times(own, chirp(F.col("bin"), sign)))


def fft(df: DataFrame, column: str, order_by: str | list[str], group_by: str | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """bin, real, imag (and the group)."""
    return _transform(df, column, order_by, group_by, False, one_task)


def ifft(df: DataFrame, column: str, order_by: str | list[str], group_by: str | None = None, one_task: int = ONE_TASK) -> DataFrame:
    return _transform(df, column, order_by, group_by, True, one_task)
