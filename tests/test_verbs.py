"""Nearest neighbours, transforms, warping, correlation and joins against NumPy and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import agg, dtw, frame, joins, ordered, signal, temporal, vector
from orrery.sources import tables


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(9, 8)).astype(np.float32), rng.normal(size=(60, 8)).astype(np.float32)
    c[11] = c[4]
    return tables.from_matrix(spark, q, "query_id"), tables.from_matrix(spark, c), q.astype(float), c.astype(float)


@pytest.mark.parametrize("limit", [1 << 20, 200])
@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_neighbours(vectors, limit, metric):
    dq, dc, q, c = vectors
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in vector.neighbours(dq, dc, 7, metric, matrix_bytes=limit).collect()}
    assert len(got) == 63
    for i, x in enumerate(q):
        s = -np.linalg.norm(c - x, axis=1) if metric == "l2" else c @ x / np.linalg.norm(c, axis=1) / np.linalg.norm(x)
        for rank, j in enumerate(np.lexsort((np.arange(len(c)), -np.round(s, 12)))[:7], 1):
            assert got[i, rank][0] == j and got[i, rank][1] == pytest.approx(abs(s[j]) if metric == "l2" else s[j], abs=1e-5)


def test_corpus_stream_keeps_the_best_of_a_task(vectors, spark):
    """The queries are held and every task sees many batches of the corpus; ties go to the smaller id."""
    dq, dc, q, c = vectors
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = vector.neighbours(dq, dc.repartition(2), 5, matrix_bytes=2000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    s = q @ c.T / np.linalg.norm(c, axis=1) / np.linalg.norm(q, axis=1)[:, None]
    want = {(i, r + 1): j for i in range(9) for r, j in enumerate(np.lexsort((np.arange(60), -np.round(s[i], 12)))[:5])}
    assert {(r.query_id, r["rank"]): r.id for r in got} == want
    batches = [(np.arange(a, a + 20), c[a : a + 20]) for a in (40, 0, 20)]
    kept = [x for part in vector._past((np.arange(9), q), iter(batches), 5, "cosine") for x in part.itertuples(index=False)]
    assert len(kept) == 45 and {(x.query_id, x.id) for x in kept} == {(i, j) for (i, _), j in want.items()}


def test_neighbour_edges(vectors, spark):
    dq, dc, _, _ = vectors
    assert vector.cosine_topk(dq, dc, 500).groupBy("query_id").count().where("count <> 60").count() == 0
    assert vector.cosine_topk(dq, dc.limit(0), 3).count() == 0
    for bad in (lambda: vector.cosine_topk(dq, dc, 0), lambda: vector.cosine_topk(dq.withColumn("emb", F.lit(1)), dc, 1)):
        with pytest.raises(ValueError):
            bad()
    for odd in ("array(1f)", "cast(null as array<float>)", "transform(emb, x -> cast(null as float))"):
        with pytest.raises(Exception, match="not a vector"):
            vector.cosine_topk(dq.withColumn("emb", F.expr(odd)), dc, 1).collect()
    zero = dc.where("id = 0").withColumn("emb", F.transform("emb", lambda x: x * 0)).withColumn("id", F.lit(99).cast("long"))
    last = vector.cosine_topk(dq, dc.unionByName(zero), 61).where("rank = 61").collect()
    assert all(r.id == 99 and math.isnan(r.score) for r in last)


def test_rerank_keeps_the_choice(vectors):
    dq, dc, _, _ = vectors
    hits = vector.cosine_topk(dq, dc, 5)
    again = vector.rerank_exp_decay(hits, dc.select("id", (F.col("id") % 3).cast("double").alias("weight")))
    assert {(r.query_id, r.id) for r in hits.collect()} == {(r.query_id, r.id) for r in again.collect()}
    flat = vector.exploded(vector.nested(again))
    assert flat.count() == 45 and flat.select(F.max("rank")).first()[0] == 5


@pytest.mark.parametrize("n,one_task", [(1, 10), (12, 100), (12, 4), (97, 10), (360, 10), (1024, 100)])
def test_fft(spark, n, one_task):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "o long, x double").repartition(3)
    out = signal.fft(df, "x", "o", one_task=one_task)
    got = {r.bin: complex(r.real, r.imag) for r in out.collect()}
    assert np.allclose([got[i] for i in range(n)], np.fft.fft(x))
    back = signal.ifft(out.select("bin", F.struct("real", "imag").alias("z")), "z", "bin", one_task=one_task)
    got = {r.bin: r.real for r in back.collect()}
    assert np.allclose([got[i] for i in range(n)], x)


def test_fft_contracts(spark):
    df = spark.createDataFrame([(0, 1.0, "a"), (1, None, "b")], "o long, x double, s string")
    with pytest.raises(ValueError):
        signal.fft(df, "s", "o")
    with pytest.raises(Exception, match="has a null"):
        signal.fft(df, "x", "o").collect()


def slow_dtw(a, b, window):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if window is None or abs(i - j) <= window:
                d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return math.sqrt(d[-1, -1])


@pytest.mark.parametrize("window", [None, 0, 2, 8])
def test_dtw(spark, window):
    rng = np.random.default_rng(3)
    rows, ref = rng.normal(size=(12, 16)), rng.normal(size=16)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows.tolist())] + [(99, None)], "id long, s array<double>")
    got = {r.id: r.dtw for r in dtw.dtw(df, "s", ref.tolist(), window=window).collect()}
    assert got.pop(99) is None
    for i, v in got.items():
        assert v == pytest.approx(slow_dtw(rows[i], ref, window))


def test_dtw_contracts(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, s array<double>")
    with pytest.raises(ValueError):
        dtw.dtw(df, "s", [1.0], window=-1)
    with pytest.raises(ValueError):
        dtw.dtw(df, "id", [1.0])
    with pytest.raises(Exception, match="a sequence of"):
        dtw.dtw(df, "s", [1.0, 2.0]).collect()
    assert [r.dtw for r in dtw.dtw(df, "s", [1.0, 2.0], ragged=True).orderBy("id").collect()] == [0.0, 1.0]
    with pytest.raises(Exception, match="null or NaN"):
        dtw.dtw(spark.createDataFrame([([1.0, float("nan")],)], "s array<double>"), "s", [1.0, 2.0]).collect()


def test_corr(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 5.0, 5.0), (4.0, 9.0, 5.0)], "a double, b double, c double")
    got = {r["column"]: r for r in agg.corr_matrix(df).collect()}
    assert got["a"]["b"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 5, 9])[0, 1]) and math.isnan(got["c"]["a"])
    with pytest.raises(ValueError):
        agg.corr_matrix(df.withColumn("s", F.lit("x")))
    with pytest.raises(ValueError):
        agg.corr_matrix(df.select())


def test_joins(spark):
    fact = spark.createDataFrame([(1, 10.0), (2, 20.0), (None, 30.0), (7, 40.0)], "k long, value double")
    dim = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (None, 4.0)], "id long, value double")
    left = joins.join(fact, dim, "k", "id", "left")
    assert left.columns == ["k", "value", "value_right"] and left.count() == 5
    assert joins.join(fact, dim, "k", "id").count() == 3 and joins.join(fact, dim, "k", "id", "anti").count() == 2
    assert joins.join(fact, dim.limit(0), "k", "id", "left").where("value_right is null").count() == 4
    assert "BroadcastHashJoin" in joins.gather(fact, dim, "k", "id", ["value"])._jdf.queryExecution().toString()


def test_asof(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1), (None, 9)], "g long, t long")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 3, "c"), (None, 8, "d")], "g long, t long, v string")
    got = sorted((r.g or 0, r.t, r.v or "") for r in joins.asof_join(left, right, "t", ["v"], "g").collect())
    assert got == [(0, 9, "d"), (1, 5, "a"), (1, 10, "b"), (2, 1, "")]
    first = joins.asof_join(left, right, "t", ["v"], "g", no_match="first").where("g = 2").first()
    assert first.v == "c"


def test_plans(spark, sf):
    rows = tables.load(spark, sf, "lineitem")
    assert "TakeOrderedAndProject" in frame.top_k(rows, 5, "l_quantity")._jdf.queryExecution().toString()
    plan = rows.where("l_quantity < 5").select("l_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,5.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    from orrery.plans.workloads import tpch_q1, tpch_q6

    assert "LessThan(l_shipdate,1998-09-03T00:00)" in tpch_q1(spark, sf)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_shipda" in tpch_q6(spark, sf)._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        frame.top_k(rows, 0, "l_quantity")
    with pytest.raises(ValueError):
        temporal.field(F.col("l_shipdate"), "era")
    with pytest.raises(ValueError):
        agg.group_by(rows, ["l_suppkey"], x=("mode", "l_tax"))


def test_calendar_before_the_epoch(spark):
    r = spark.sql("SELECT timestamp_ntz'1969-12-31 23:00:00' t").select(temporal.field(F.col("t"), "year"), temporal.field(F.col("t"), "day"), temporal.days(F.col("t"))).first()
    assert tuple(r) == (1969, 31, -1)


@pytest.mark.parametrize("session_zone", ["UTC", "Europe/Berlin"])
def test_calendar_in_zones(spark, session_zone):
    import datetime
    from zoneinfo import ZoneInfo

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        instants = [datetime.datetime(1969, 12, 31, 23, 59, 59, 250001, datetime.UTC), datetime.datetime(2024, 3, 31, 1, 0, tzinfo=datetime.UTC), datetime.datetime(2024, 10, 27, 0, 30, tzinfo=datetime.UTC), None]
        x = F.col("t")
        df = spark.createDataFrame([(i, t) for i, t in enumerate(instants)], "i int, t timestamp")
        names, zones = ("day", "hour", "minute", "second"), ("America/New_York", "Asia/Kolkata", "Europe/Berlin")
        got = df.orderBy("i").select(temporal.utc(x).cast("string").alias("utc"), *[temporal.field(temporal.utc(x), n, z) for z in zones for n in names]).collect()
        for r, t in zip(got, instants, strict=True):
            want = [None] * 13 if t is None else [t.replace(tzinfo=None).isoformat(" "), *[getattr(t.astimezone(ZoneInfo(z)), n) for z in zones for n in names]]
            assert list(r) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_operators_in_chains(spark, sf):
    out = spark.read.parquet(f"{sf}/events.parquet").transform(ordered.row_index, "event_id", "at").transform(temporal.with_fields, "ts", "hour", zone="Asia/Tokyo").transform(frame.top_k, 3, "at")
    assert [r["at"] for r in out.collect()] and "ts_hour" in out.columns


def test_asof_in_ranges_and_with_ties(spark, monkeypatch):
    rng = np.random.default_rng(2)
    left = [(int(i), float(t)) for i, t in enumerate(np.round(rng.random(300) * 50, 1))]
    right = [(float(t), int(v)) for t, v in zip(np.round(rng.random(120) * 50, 0), rng.integers(0, 1000, 120), strict=True)]
    want = {i: max(((t, v) for t, v in right if t <= at), default=(0, None))[1] for i, at in left}
    a, b = spark.createDataFrame(left, "i long, t double"), spark.createDataFrame(right, "t double, v long")
    for rows in (1_000_000, 20):
        monkeypatch.setattr(joins, "SLICE_ROWS", rows)
        assert {r.i: r.v for r in joins.asof_join(a, b, "t", ["v"]).collect()} == want
        assert joins.asof_join(a.limit(0), b, "t", ["v"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 97, 202, 331])
def test_transform_of_any_length(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")
    got = sorted(signal.fft(rows, "v", "i", one_task=20).collect())
    assert np.allclose([r.real + 1j * r.imag for r in got], np.fft.fft(x))
    back = signal.ifft(signal.fft(rows, "v", "i", one_task=20).selectExpr("bin", "struct(real, imag) z"), "z", "bin", one_task=20)
    assert np.allclose([r.real for r in sorted(back.collect())], x)


def test_products(spark):
    rng = np.random.default_rng(7)
    a, m = rng.normal(size=(40, 6)), rng.normal(size=(6, 4))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "id long, v array<double>")
    matrix = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "row long, vector array<double>")
    for limit in (vector.MATRIX_BYTES, 0):
        got = sorted(vector.matmul(rows, matrix, "id", "v", matrix_bytes=limit).collect())
        assert np.allclose([r["product"] for r in got], a @ m)
    assert np.allclose([r.value for r in sorted(vector.gram(rows, "v").collect())], (a.T @ a).ravel())
    assert vector.matmul(rows.limit(0), matrix, "id", "v").count() == 0 and vector.gram(rows.limit(0), "v").count() == 0


def test_wide_correlation_equals_the_narrow_one(spark, monkeypatch):
    """Nulls, constants, a column constant where its partner is there, NaN, infinities, a large mean, one row and none."""
    rng = np.random.default_rng(8)
    data = []
    for i in range(200):
        a, b = rng.normal(size=2)
        data.append((float(a), float(a + b), None if i % 3 else float(b), 5.0, 1e9 + float(b), 4.0 if i % 3 == 0 else float(a), float("nan") if i == 7 else float(a), float("inf") if i == 9 else float(b), None))
    df = spark.createDataFrame(data, ", ".join(f"`c.{k}` double" for k in range(9))).withColumn("n", F.col("`c.0`").cast("int")).repartition(5)
    for rows in (df, df.limit(1), df.limit(0)):
        narrow = {r["column"]: tuple(r)[1:] for r in agg.corr_matrix(rows).collect()}
        monkeypatch.setattr(agg, "NATIVE_COLUMNS", 2)
        wide = agg.corr_matrix(rows)
        monkeypatch.undo()
        assert wide.columns == ["column", *df.columns]
        for r in wide.collect():
            want = narrow.pop(r["column"])
            assert [x is None for x in tuple(r)[1:]] == [x is None for x in want]
            assert tuple(x for x in tuple(r)[1:] if x is not None) == pytest.approx([x for x in want if x is not None], abs=1e-6, nan_ok=True)
        assert narrow == {}
    fifty = spark.range(1000).select(*[F.sin(F.col("id") * (k + 1)).alias(f"c{k}") for k in range(50)])
    got, values = {r["column"]: tuple(r)[1:] for r in agg.corr_matrix(fifty).collect()}, np.sin(np.outer(np.arange(1000), np.arange(1, 51)))
    assert np.array([got[f"c{k}"] for k in range(50)]) == pytest.approx(np.corrcoef(values.T), abs=1e-9)
