"""Dynamic time warping of every row's sequence against a reference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from orrery.storage import ship


def distances(rows: np.ndarray, reference: np.ndarray, window: int | None) -> np.ndarray:
    """Square root of the least sum of squared differences along a path with |i - j| <= window; all rows at once."""
    n, m = rows.shape[1], len(reference)
    last = np.full((len(rows), m + 1), np.inf)
    last[:, 0] = 0
    for i in range(1, n + 1):
        now = np.full_like(last, np.inf)
        low, high = (1, m) if window is None else (max(1, i - window), min(m, i + window))
        for j in range(low, high + 1):
            now[:, j] = (rows[:, i - 1] - reference[j - 1]) ** 2 + np.minimum(np.minimum(last[:, j], last[:, j - 1]), now[:, j - 1])
        last = now
    return np.sqrt(last[:, m])


def dtw(df: DataFrame, column: str, reference: list[float], into: str = "dtw", window: int | None = None, ragged: bool = False) -> DataFrame:
    """df with the distance of each sequence to the reference. A null sequence gives null; a null or NaN within
    one raises, and so does another length than the reference's unless `ragged`."""
    ship(df.sparkSession)
    if window is not None and window < 0:
        raise ValueError("a window is not negative")
    if not df.schema[column].dataType.simpleString().startswith("array<"):
        raise ValueError(f"{column} is not a column of sequences")
    ref = np.asarray(reference, np.float64)
    if ref.ndim != 1 or not len(ref) or np.isnan(ref).any():
        raise ValueError("the reference is a sequence of numbers")

    @pandas_udf("double")
    def of(sequences: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=sequences.index)
        sizes = sequences.map(len)
        for size, own in sequences.groupby(sizes):
            if size != len(ref) and not ragged:
                raise ValueError(f"a sequence of {size}; the reference has {len(ref)}")
            rows = np.stack(own.to_numpy()).astype(np.float64) if size else np.zeros((len(own), 0))
            if np.isnan(rows).any():
                raise ValueError("a sequence holds a null or NaN")
            out[own.index] = distances(rows, ref, window)
        return out

    x: Column = F.col(column)
    empty = F.array().cast("array<double>")
    value = of(F.coalesce(x.cast("array<double>"), F.array(*[F.lit(float(v)) for v in ref]) if not ragged else empty))
    return df.withColumn(into, F.when(x.isNotNull(), value))
