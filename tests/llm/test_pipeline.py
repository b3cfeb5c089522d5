import pytest
from helpers import documents, saved, slow_components
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from orrery.llm import bpe, decontaminate, pii  # noqa: E402
from orrery.llm.common import written  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit("x"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF))
        kept[name] = before, docs
        if name != "bpe":
            assert docs.columns == before.columns
    before, after = kept["near_copies"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {i for i, (_, c, _) in slow_components(rows, 5, 80).items() if i == c}
    before, after = kept["decontamination"]
    gone = {r.doc_id for r in decontaminate.find_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - gone
    before, after = kept["pii"]
    assert after.count() == before.count() and pii.find_pii(after).where("size(base) > 0").count() == 0
    before, after = kept["bpe"]
    texts = {r.doc_id: r.text for r in before.collect()}
    import hashlib

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for r in after.collect():
        ids = bpe.encode_block([texts[r.doc_id]], bpe.merged(path))[0].tolist()
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_planted_and_odd_rows(spark, tmp_path):
    prose = lambda k: " ".join(f"word{k}x{i}" for i in range(60))
    item = "what is the sum of all the small numbers that one finds under the old stone bridge"
    texts = [(i, prose(i)) for i in range(40)] + [(100, prose(1)), (101, prose(2) + " end"), (102, f"{prose(77)} {item} {prose(78)}"), (103, None), (104, ""), (105, f"mail me at a.b@c.de {prose(79)}"), (None, prose(80))]
    toxic = [(200 + i, f"{prose(300 + i)} vileword {prose(400 + i)} vileword nastyword") for i in range(40)]
    docs = documents(spark, [*texts, *toxic])
    saved(docs, tmp_path, "documents")
    saved(spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(i, 1, 1) for i, _ in toxic], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    saved(spark.createDataFrame([(1, item)], "item_id long, text string"), tmp_path, "benchmark")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {*range(40), 103, 104, 105, None}
    saved(docs.limit(0), tmp_path, "documents")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_clashing_names(spark, tmp_path):
    """Columns named like those inside the operators keep their values; rows that repeat are one document."""
    names = ["row", "spans", "score", "terms", "unit", "hash", "w", "comp", "component_id", "item_id", "own", "base", "masked", "words", "ids", "n_tokens"]
    prose = lambda k: " ".join(f"word{k}x{i}" for i in range(30))
    texts = [(i, prose(i)) for i in range(12)] + [(3, prose(3)), (3, prose(3)), (50, prose(4)), (60, f"call +49 30 1234567 {prose(60)}"), (None, None), (None, None)]
    docs = documents(spark, texts).withColumns({n: F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})
    docs = docs.withColumn("Text ", F.lit("x")).withColumn("a.b", F.lit(1))
    saved(spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    saved(spark.createDataFrame([(1, prose(99))], "item_id long, text string"), tmp_path, "benchmark")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, str(tmp_path)))
        assert docs.columns == before.columns and [t for _, t in docs.dtypes] == [t for _, t in before.dtypes], name
    rows = docs.collect()
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in rows) == [-1, -1, *range(12), 60]
    assert all(r[n] == f"{n} {'none' if r.doc_id is None else r.doc_id}" for r in rows for n in names)
    assert next(r.text for r in rows if r.doc_id == 60).startswith("call [PHONE] word")
    done = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(done) == len(rows)
