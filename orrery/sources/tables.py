"""Reading and writing tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None, n_rows: int | None = None) -> DataFrame:
    """A Parquet table; columns and n_rows reach the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return df.limit(n_rows) if n_rows is not None else df


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views of the tables, for SQL."""
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    return spark.read.options(header=True, **options).schema(schema).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).format(kind)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def from_matrix(spark: SparkSession, matrix: np.ndarray, id_col: str = "id", vector_col: str = "emb") -> DataFrame:
    """A two-dimensional array as rows (position, vector)."""
    if matrix.ndim != 2:
        raise ValueError(f"a matrix has two dimensions, not {matrix.ndim}")
    schema = T.StructType([T.StructField(id_col, T.LongType(), False), T.StructField(vector_col, T.ArrayType(T.FloatType(), False), False)])
    return spark.createDataFrame([(i, row) for i, row in enumerate(matrix.astype(np.float32).tolist())], schema)


def empty_like(df: DataFrame) -> DataFrame:
    return df.limit(0)
