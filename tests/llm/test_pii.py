import hashlib
import math
import random
import re

from helpers import documents, saved
from pyspark.sql import functions as F

from orrery.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
KINDS = list(PATTERNS)


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def slow(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PATTERNS[kind], text or "") if valid(kind, m.group()))


def joined(spans):
    return ",".join(f"{[*KINDS, 'term'][k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_equal_the_patterns(spark, tmp_path):
    rng = random.Random(3)
    parts = [*"a1.@+-_% ()é😀\n", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (212) 555-0100", "378282246310005", "300.1.1.1", "5500-0000-0000-0004", "é@x.y", "x@", "@y.z", "12", "+4"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for i in range(1500)}
    texts |= {9001: None, 9002: "", 9003: "1" * 20000, 9004: "a" * 20000, 9005: "a." * 9000 + "@b", 9006: "a@b" + ".c" * 9000, 9007: "1." * 9000, 9008: "+1" + "(" * 20000}
    got = pii.op1_pii(spark, saved(documents(spark, texts).withColumnRenamed("source", "spans"), tmp_path, "documents")).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = slow(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest(), repr(texts[r.doc_id][:99])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        assert [x for x in r.spans.split(",") if x and not x.startswith("term")] == [x for x in joined(spans).split(",") if x]


def test_disclosing_terms(spark):
    texts = {i: f"note {i} by Zarquon at zarq@example.com the river" for i in range(4)} | {10 + i: f"the river and note {i} is here" for i in range(40)} | {90: "Zarquon was here, said zarquonian. ZARQUON!", 91: None}
    docs = documents(spark, texts)
    terms = {r.term: r.disclosure for r in pii.disclosing_terms(docs).collect()}
    assert "zarquon" in terms and "river" not in terms and "note" not in terms
    # c(e,t) = 4 of N = 46 with c(e) = 4, c(t) = 5
    assert abs(terms["zarquon"] - math.log(4 * 46 / (4 * 5)) / math.log(46 / 4)) < 1e-9
    found = {r.doc_id: joined([(s.start, s.kind, s.end) for s in r.spans]) for r in pii.find_pii(docs, threshold=0.9).select("doc_id", "spans").collect()}
    assert found[0] == "term:10:17,email:21:37" and found[90] == "term:0:7,term:35:42" and found[10] == "" and found[91] == ""
    masked = {r.doc_id: r for r in pii.mask_pii(docs.withColumn("row", F.lit(1)).withColumn("spans", F.lit(2))).collect()}
    assert masked[0].text == "note 0 by [TERM] at [EMAIL] the river" and masked[0].n_chars == len(masked[0].text) and masked[0].row == 1 and masked[10].text == texts[10]
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_overlaps_are_masked_once(spark):
    df = spark.createDataFrame([("ab 1.2.3.4 cd",)], "t string").withColumn("s", F.expr("array(named_struct('start',3,'kind',1,'end',10),named_struct('start',5,'kind',2,'end',11))"))
    assert df.select(pii.masked(F.col("t"), F.col("s"))).first()[0] == "ab [IP]cd"


def slow_disclosure(texts, support, threshold):
    """Counts over whole documents in plain Python."""
    word = re.compile(r"\w+")
    entities, terms = {}, {}
    for i, text in texts.items():
        spans = slow(text)
        rest = list(text or "")
        for a, k, b in spans:
            entities.setdefault(f"{k}:{text[a:b].lower()}", set()).add(i)
            rest[a:b] = " " * (b - a)
        for where, out in ((text or "", terms), ("".join(rest), terms.setdefault(None, {}))):
            for w in word.findall(where):
                if not w[0].isdigit() and (len(w) > 3 or (len(w) > 1 and w[0].isupper())):
                    out.setdefault(w.lower(), set()).add(i)
    outside, n, out = terms.pop(None), max(2, len(texts)), {}
    for e, docs in entities.items():
        for t, own in outside.items():
            both = len(docs & own & terms.get(t, set()))
            if len(docs) >= support and both >= support:
                score = math.log(both * n / (len(docs) * len(terms[t]))) / max(math.log(n / len(docs)), 1e-9)
                if score >= threshold:
                    out[t, e] = score
    return out


def test_disclosure_equals_brute_force(spark):
    rng = random.Random(8)
    names, mails = ["Kim", "Ann", "Zarquon", "Waldorf", "Statler"], ["a@b.co", "Kim@x.org", "w@f.de", "9.9.9.9", "+49 (30) 1234567"]
    texts = {}
    for i in range(160):
        who = rng.randrange(5)
        parts = [rng.choice(["river", "house", "is", "The", "of", "some", "1abcd", "x_yz"]) for _ in range(rng.randint(3, 20))]
        parts += [names[who]] * (rng.random() < 0.3) + [mails[who]] * (rng.random() < 0.3) + [f"Kim@x.org"] * (rng.random() < 0.03)
        rng.shuffle(parts)
        texts[i] = " ".join(parts)
    for support, threshold in ((3, 0.9), (2, 0.3), (1, 0.6)):
        got = {(r.term, r.entity): r.disclosure for r in pii.disclosing_terms(documents(spark, texts), support, threshold).collect()}
        want = slow_disclosure(texts, support, threshold)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert want or threshold > 0.5


def test_masks_equal_a_plain_loop(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab é😀\n中") for _ in range(rng.randint(0, 2500)))
        cuts = [sorted(rng.sample(range(len(text) + 1), 2)) for _ in range(rng.randint(0, 30))] if len(text) > 1 else []
        rows.append((i, text, sorted((a, rng.randrange(5), b) for a, b in cuts)))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,kind:int,end:int>>")
    for i, got in df.select("i", pii.masked(F.col("text"), F.col("spans"))).collect():
        at, want = 0, ""
        for a, k, b in rows[i][2]:
            if a >= at:
                want += rows[i][1][at:a] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, b)
        assert got == want + rows[i][1][at:]


def test_many_matches_in_one_text(spark):
    import time

    numbers = " ".join(str(1000 + k) for k in range(40_000))
    mails = " ".join(f"u{k}@example.com" for k in range(16_000))
    docs = documents(spark, {1: numbers, 2: mails, 3: "4111111111111111, " * 16_000}).cache()
    docs.select(F.size(pii.base_spans(F.col("text")))).collect()  # compiled
    began = time.time()
    assert [r[0] for r in docs.select("doc_id", F.size(pii.base_spans(F.col("text"))).alias("n")).orderBy("doc_id").select("n").collect()][1:] == [16_000, 16_000]
    got = docs.where("doc_id = 2").select(pii.masked(F.col("text"), pii.base_spans(F.col("text")))).first()[0]
    assert got == " ".join(["[EMAIL]"] * 16_000)
    assert time.time() - began < 30  # seconds; a quadratic way took minutes


def test_few_words_move_without_a_broadcast(spark, monkeypatch):
    """Before they meet the disclosing terms, words that can't be one of them go, however many the terms are."""
    split, met = pii.split_by_ids, []

    def watched(rows, *args, **kwargs):
        maybe, rest = split(rows, *args, **kwargs)
        if "term" in rows.columns:
            met.append((maybe.count(), rest.count()))
        return maybe, rest

    texts = [(i, " ".join(f"word{i}x{k}" for k in range(200)) + (" secretname a.b@c.de" if i < 3 else "")) for i in range(30)]
    monkeypatch.setattr(pii, "split_by_ids", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pii.find_pii(documents(spark, texts)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.doc_id for r in found if any(s.kind == 4 for s in r.spans)} == {0, 1, 2}
    assert len(met) == 1 and sum(met[0]) >= 6000 and 3 <= met[0][0] < 0.1 * sum(met[0])


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    """Words that could pass are stored as they are counted; those that documents with an entity show to be too frequent are not."""
    cut, write, uses, stored = pii.terms_of, pii.written, [], []

    def watched(df, *args):
        out = write(df, *args)
        if df.columns == ["doc_id", "term"]:
            stored.append(out)
        return out

    monkeypatch.setattr(pii, "terms_of", lambda text: uses.append(1) or cut(text))
    monkeypatch.setattr(pii, "written", watched)
    mail = lambda i: "a.b@c.de" if i < 3 else f"m{i}@c.de" if i < 13 else ""
    texts = [(i, f"common word{i}x {mail(i)} {'secretname' if i < 3 or i == 20 else ''}") for i in range(60)]
    found = pii.find_pii(documents(spark, texts)).collect()
    assert {r.doc_id for r in found if any(s.kind == 4 for s in r.spans)} == {0, 1, 2, 20}
    assert len(uses) == 3  # twice in documents with an entity, with and without it, and once in all
    assert len(stored) == 1 and sorted(tuple(r) for r in stored[0].collect()) == [(i, "secretname") for i in (0, 1, 2, 20)]
