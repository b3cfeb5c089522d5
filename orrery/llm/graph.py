"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import shared_folder, ship, written

#: Up to so many edges (16 bytes each) one task solves the whole graph; beyond, star rounds over the cluster do.
ONE_TASK_EDGES = 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that aren't the smallest of their component, and that smallest node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _one_task(batches):
    held = [(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)) for x in batches]
    if held:
        node, root = forest(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
        for k in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[k : k + 100_000], pa.int64()), pa.array(root[k : k + 100_000], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """node, root: the smallest node of its component, for every node that isn't that one itself.

    edges: two long columns. Beyond `one_task` edges, rounds of large and small stars: each node's smallest
    neighbour comes from a pre-aggregated minimum, so that a node with many neighbours meets in no task.
    """
    spark, folder = edges.sparkSession, shared_folder(edges.sparkSession)
    ship(spark)
    a, b = edges.columns
    low, high = F.least(a, b), F.greatest(a, b)
    now = written(edges.select(high.alias("u"), low.alias("v")).where("u <> v").distinct(), folder)
    if now.count() <= one_task:
        return now.repartition(1).mapInArrow(_one_task, "node long, root long")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, folder)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        before, now = now, written(star.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), folder)
        if now.count() == before.count() and now.join(before, ["u", "v"], "left_anti").isEmpty():  # both distinct: the same edges
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
