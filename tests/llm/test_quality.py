import random
from collections import Counter

import pytest
from helpers import documents, words

public_tokenizers = pytest.importorskip("public_tokenizers")

from orrery.llm import quality  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


def slow(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = [any(grams[tuple(w[k : k + 3])] > 1 for k in range(max(0, i - 2), min(i, len(w) - 3) + 1)) for i in range(len(w))]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, sum(covered)


def test_base_counts():
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "é", "#", "$$", " ", "  ", "\n", "\t", "\u00a0", "\x0b", "\u2028"]) for _ in range(rng.randint(0, 60)))
        assert quality.base_counts(text) == slow(text), repr(text)
    assert quality.base_counts(None) == (0, 0, 0, 0, 0)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in quality.op10_quality(spark, sf).collect():
        want = slow(texts[r.doc_id])
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*want, failed)
        assert not (failed and r.kept)


def test_bands(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["the", "water", "of", "house", "river", "and", "people", "morning", "light"]) + rng.choice(["", "s", "ing", ","]) for _ in range(150))
    texts = {i: text() for i in range(80)} | {900: "ꙮ҂ " * 150 + "".join(map(chr, range(0x10900, 0x10980))), 901: None, 902: "the"}
    got = {r.doc_id: r for r in quality.quality_rules(documents(spark, texts), PATH).collect()}
    assert sum(got[i].kept for i in range(80)) >= 78 and not got[900].kept and not got[901].kept and not got[902].kept
    assert quality.quality_rules(documents(spark, texts).limit(0), PATH).count() == 0
    unknown = documents(spark, texts, [None] * len(texts)).withColumnRenamed("source", "script")
    assert quality.quality_rules(unknown, PATH).where("doc_id < 80 and kept").count() >= 78
    assert quality.script("это русский текст") == "cyrillic" and quality.script("plain é") == "latin"


def test_second_vocabulary():
    import tiktoken

    from orrery.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", "é", " ", "'s", "12", "中文", "\n", "!"]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "x" * 5000]
    assert quality._sizes(path).of(texts) == [len(enc.encode_ordinary(t or "")) for t in texts]
    assert quality._sizes(path).of([]) == []


def test_scripts():
    want = {"это русский": "cyrillic", "ภาษาไทย": "thai", "தமிழ்": "tamil", "ქართული": "georgian", "漢字 漢字 か": "han", "ひらがな漢": "hiragana", "한국어": "hangul", "été": "latin", "źdźbło": "latin", "12 €": "latin", "Ωα б": "greek", "": "latin"}
    assert {t: quality.script(t) for t in want} == want


def slow_verdicts(rows, spread, min_group):
    """rows: those of quality_rules(). Fences over sorted lists, for groups small enough for exact quantiles."""
    import math

    groups = {}
    key = lambda r, kind: {"sized": (int(math.log2(max(r.n_tokens, 1))), r.lang) if r.lang is not None else None, "drawn": (int(math.log2(max(r.n_tokens, 1))), r.script), "lang": r.lang, "script": r.script}[kind]
    for r in rows:
        for kind in ("sized", "drawn", "lang", "script"):
            if r.n_tokens and key(r, kind) is not None:
                groups.setdefault((kind, key(r, kind)), []).append(r)
    out = []
    for r in rows:
        fine = True
        own = next((g for kind in ("sized", "drawn", "lang", "script") if (g := groups.get((kind, key(r, kind)), [])) and (kind == "script" or len(g) >= min_group)), [])
        for m in quality.MEASURES:
            values = sorted(x[m] for x in own if x[m] is not None)
            if values and r[m] is not None:
                low, high = (values[math.ceil(q * len(values)) - 1] for q in (0.25, 0.75))
                fine &= r[m] <= max(0.05, high + spread * (high - low)) if m == "byte_share" else low - spread * (high - low) <= r[m] <= high + spread * (high - low)
        out.append(fine)
    return out


def test_measures_and_fences_equal_brute_force(spark):
    import math

    import sentencepiece

    rng = random.Random(6)
    parts = ["the", "water", "of", "house", "ночь", "улица", "ꙮ", "#!", "a1b2", "中文", "zzzzqqq"]
    texts = []
    for i in range(260):
        pool = [rng.sample(parts, rng.randint(1, 4)), parts[:4]][rng.random() < 0.7]
        texts.append((i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 20, 60, 61, 200])))))
    texts += [(300, None), (301, ""), (7, texts[7][1]), (7, texts[7][1]), (302, "the water " * 20_000)]  # repeated rows, a long text
    langs = [rng.choice(["en", "ru", None]) for _ in texts]
    docs = documents(spark, texts, langs).withColumnRenamed("source", "sized").withColumnRenamed("n_chars", "n_words")
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    second = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for spread, least in ((0.5, 20), (3.0, 50)):
        rows = quality.quality_rules(docs, PATH, second, spread=spread, min_group=least).collect()
        assert len(rows) == len(texts)
        own = dict(texts)
        for r in rows:
            ids = model.encode(own[r.doc_id] or "")
            assert r.n_tokens == len(ids)
            if ids:
                shares = [n / len(ids) for n in Counter(ids).values()]
                assert abs(r.token_entropy + sum(p * math.log2(p) for p in shares)) < 1e-9 and abs(r.byte_share - sum(map(model.is_byte, ids)) / len(ids)) < 1e-12
                assert r.chars_per_token == len(own[r.doc_id]) / len(ids)
        assert [r.fertility_ok for r in rows] == slow_verdicts(rows, spread, least)
        assert not all(r.fertility_ok for r in rows)
