"""Storage that the driver and all executors share: the folder in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; the driver deletes it when it ends, release() earlier.

    Where that setting is missing, a local master gets a temporary folder. On a cluster that is an error: executors
    would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and the executors of {master} share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "orrery-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/orrery-{uuid.uuid4().hex}")
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    system.mkdirs(path)
    system.deleteOnExit(path)
    _MADE.append(system.makeQualified(path).toString())  # a path without a scheme belongs to the cluster's default store
    return _MADE[-1]


def release(spark: SparkSession) -> None:
    """Deletes every folder that this process made under spark.checkpoint.dir. Results that still read from them end."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python once a context, wherever the driver imported it from."""
    sc = spark.sparkContext
    if getattr(sc, "_orrery_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file until it ends
    archive = Path(folder) / "orrery_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._orrery_shipped = True
