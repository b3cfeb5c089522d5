from pyspark.sql import functions as F

from orrery.sources import tables
from orrery.streaming import windows


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def source(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:01:00", 1.0), (2, "2024-01-01 00:04:00", 2.0), (1, "2024-01-01 00:11:00", 4.0), (1, "2024-01-01 00:11:00", 4.0)], "k long, t string, v double")
    rows.select("k", F.to_timestamp("t").alias("t"), "v").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("k long, t timestamp, v double").parquet(str(tmp_path / "in"))


def test_tumbling_equals_batch(spark, tmp_path):
    stream = source(spark, tmp_path)
    total = [F.sum("v").alias("s")]
    live = drain(windows.tumbling(stream, "t", "10 minutes", [], total), "tumbled", "complete").select("start", "s").collect()
    batch = windows.tumbling(spark.read.parquet(str(tmp_path / "in")), "t", "10 minutes", [], total).select("start", "s").collect()
    assert sorted(map(tuple, live)) == sorted(map(tuple, batch)) and len(live) == 2


def test_deduplication_and_state(spark, tmp_path):
    stream = source(spark, tmp_path)
    assert drain(windows.deduplicated(stream, "t", ["k", "t"]), "deduplicated", "append").count() == 3
    got = {r.k: (r.n, r.total) for r in drain(windows.running_totals(stream, "k", "v"), "totals", "update").collect()}
    assert got == {1: (3, 9.0), 2: (1, 2.0)}


def test_sessions(spark, tmp_path):
    stream = source(spark, tmp_path)
    assert windows.sessions(spark.read.parquet(str(tmp_path / "in")), "t", "5 minutes", ["k"], [F.count(F.lit(1)).alias("n")]).count() == 3
    assert stream.isStreaming


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    tables.write(df, str(tmp_path / "csv"), "csv")
    tables.write(df, str(tmp_path / "json"), "json")
    assert tables.read_json(spark, str(tmp_path / "json"), "k long, s string").count() == 2
    tables.write(df, str(tmp_path / "parts"), partition_by=["k"])
    assert spark.read.parquet(str(tmp_path / "parts")).where("k = 2").count() == 1
    assert tables.empty_like(df).count() == 0
