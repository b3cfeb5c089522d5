import random

import pytest
import tiktoken
from helpers import documents
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from orrery.llm import bpe, tokenfiles  # noqa: E402
from orrery.llm.pretokens import COMPOSE, IDENTITY, scan  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "ß", "1", "22", "²", "½", "!", "—", "中", "😀", "\u00a0", "\u3000", "\u200b", "\x1c", "\x85", "'s", "'ll", " '", "..", "क्"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


def ids_of(texts):
    ids, ends = bpe.encode_block(texts, bpe.merged(PATH))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def test_equals_the_library(reference):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(5000)] + [None, "", "x" * 3000, "ab" * 2000, " " * 300, "'" * 99]
    assert ids_of(texts) == [reference.encode_ordinary(t or "") for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=8))
def test_any_text(texts):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})
    assert ids_of(texts) == [enc.encode_ordinary(t) for t in texts]


def test_scan_is_sequential_composition():
    import numpy as np

    codes = np.random.default_rng(0).choice([IDENTITY, 0, 0b010101, 0b000010], 1000).astype(np.uint8)
    want, f = [], IDENTITY
    for c in codes:
        f = COMPOSE[f, c]
        want.append(f)
    assert scan(codes).tolist() == want


def test_round_trip_of_rows(spark, reference):
    texts = [(1, "It's  fine\n\n"), (1, "It's  fine\n\n"), (2, None), (3, ""), (None, "été 123"), (4, "ab " * 30000)]
    docs = documents(spark, texts).withColumnRenamed("source", "ids")  # a clashing name
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, list(r.ids)) for r in got) == sorted((i or 0, reference.encode_ordinary(t or "")) for i, t in texts)
    assert all(bytes(r.decoded).decode() == (dict(texts)[r.doc_id] or "") for r in got)
    again = bpe.round_trip(docs, PATH).collect()
    assert sorted((r.doc_id or 0, list(r.ids), bytes(r.decoded)) for r in again) == sorted((r.doc_id or 0, list(r.ids), bytes(r.decoded)) for r in got)
    assert bpe.encode(docs.limit(0), PATH).count() == 0 and bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_token_files(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    texts = {7: "b it's", 3: None, 5: "", 9: "<|endoftext|> a", 1: "été " * 500, 2: "\n\n x"}
    manifest = tokenfiles.write(documents(spark, texts).repartition(3), path)
    got = {r.doc_id: r for r in tokenfiles.read(manifest).collect()}
    at = 0
    for i in sorted(texts):
        ids = [*model.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfiles.read(tokenfiles.write(documents(spark, texts).limit(0), path)).count() == 0
    broken = manifest.withColumn("n_tokens", manifest["n_tokens"] + 1)
    with pytest.raises(Exception, match="the manifest has"):
        tokenfiles.read(broken).collect()


def test_token_files_odd_rows(spark, tmp_path):
    """Repeated rows, null ids, ids that share texts or don't, a long text, clashing names, many ranges."""
    import zlib
    from itertools import accumulate

    import numpy as np
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    pairs = [(5, "same")] * 400 + [(5, "other")] * 3 + [(None, "x y")] * 5 + [(None, None), (1, "ab c " * 60_000), (9, None), (9, "")]
    random.Random(3).shuffle(pairs)
    docs = documents(spark, pairs).repartition(7).withColumnRenamed("source", "ids").withColumnRenamed("lang", "crc").withColumn("row", F.lit(1))
    got = [tuple(r) for r in tokenfiles.read(tokenfiles.write(docs, path)).collect()]
    coded = {t: [*model.encode(t or "", add_special_tokens=False).ids, 0] for _, t in pairs}
    crc = {t: zlib.crc32(np.array(ids, "<u4").tobytes()) for t, ids in coded.items()}
    tie = {t: zlib.crc32((t or "").encode()) for t in coded}
    pairs.sort(key=lambda p: (-1 if p[0] is None else p[0], tie[p[1]]))
    starts = accumulate((len(coded[t]) for _, t in pairs), initial=0)
    want = [(i, start, len(coded[t]), crc[t]) for (i, t), start in zip(pairs, starts, strict=False)]
    assert sorted(got, key=lambda r: r[1]) == want


def test_distinct_slices():
    import numpy as np

    from orrery.llm.pretokens import distinct

    rng = random.Random(1)
    parts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17]))) for _ in range(3000)]
    at = np.cumsum([0, *map(len, parts)])
    one, which = distinct(b"".join(parts), at)
    assert [parts[k] for k in one[which]] == parts
    short = {p for p in parts if len(p) < 16}
    assert sorted(parts[k] for k in one if len(parts[k]) < 16) == sorted(short)
    assert [x.tolist() for x in distinct(b"", np.zeros(1, np.int64))] == [[], []]
