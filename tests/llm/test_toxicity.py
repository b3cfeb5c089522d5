import random

import pytest
from helpers import documents, saved
from pyspark.sql import functions as F

from orrery.llm import toxicity

SF = "/root/testdata/sf0.01"


def maximal(scores):
    """Ruzzo and Tompa's definition, recursively: the best segment, then both sides of it."""
    best = None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-9 and (best is None or total > best[0] + 1e-9):
                best = (total, i, j + 1)
    if best is None:
        return []
    _, a, b = best
    return maximal(scores[:a]) + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in maximal(scores[b:])]


def test_segments_equal_the_definition():
    rng = random.Random(4)
    lexicon = toxicity.Lexicon({"bad": 2.0, "worse": 3.7}, -0.61, 1.0)
    for _ in range(300):
        text = [rng.choice(["bad", "worse", "a", "b", "c", "d"]) for _ in range(rng.randint(0, 18))]
        got = toxicity.segments(text, lexicon)
        want = maximal([lexicon.odds.get(w, lexicon.other) for w in text])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.op8_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    caught = sum(r.predicted for r in rows if r.toxic)
    assert caught / sum(r.toxic for r in rows) > 0.85 and sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_edges(spark, tmp_path):
    docs = documents(spark, [(1, None), (2, ""), (3, "12 !!"), (4, "bad " * 50000), (4, "x"), (None, "bad worse bad worse bad")])
    lexicon = toxicity.Lexicon({"bad": 7.0, "wors*": 7.0}, -0.01, 1.0)
    got = {(r.doc_id, round(r.score, 3)) for r in toxicity.score_toxicity(docs, lexicon).collect()}
    assert got == {(1, 0.0), (2, 0.0), (3, 0.0), (4, 1.0), (4, 0.0), (None, 1.0)}
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.odds == {} and toxicity.score_toxicity(docs, none).where("score > 0").count() == 0
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit("x")), lexicon)
    assert kept.columns == [*docs.columns, "score"] and kept.count() == 4
    saved(docs.limit(0), tmp_path, "documents")
    saved(spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert toxicity.op8_toxicity(spark, str(tmp_path)).count() == 0


def plain_fit(rows, prior, flat, min_z, min_docs):
    """rows: (text, label). Straight from the definitions, over Python lists."""
    import math

    sides = {k: [toxicity.words(t) for t, label in rows if label == k] for k in (0, 1)}
    total = {k: sum(map(len, sides[k])) for k in sides}

    def alpha(t, o):
        return prior * (t + o) / (total[1] + total[0]) + flat

    def count(k, has):
        return sum(sum(map(has, text)) for text in sides[k]), sum(any(map(has, text)) for text in sides[k])

    telling = {}
    for token in {x for k in sides for text in sides[k] for w in text for x in toxicity.tokens(w)}:
        (t, td), (o, od) = (count(k, lambda w: token in toxicity.tokens(w)) for k in (1, 0))  # noqa: B023
        nt, no = len(sides[1]), len(sides[0])
        table = [(td, nt, td + od), (od, no, td + od), (nt - td, nt, nt + no - td - od), (no - od, no, nt + no - td - od)]
        g = 2 * sum(x * math.log(x * (nt + no) / (side * both)) for x, side, both in table if x)
        if td >= min_docs and td / nt > od / no and math.sqrt(max(0, g)) >= min_z:
            a = alpha(t, o)
            odds = [math.log((n + a) / (total[k] + prior + flat - n - a)) for k, n in ((1, t), (0, o))]
            telling[token] = odds[0] - odds[1]
    best = lambda w: max((x for x in toxicity.tokens(w) if x in telling), key=telling.get, default=None)
    cells = {x: [count(k, lambda w: best(w) == x)[0] for k in (1, 0)] for x in [*telling, None]}  # noqa: B023
    cells = {x: n for x, n in cells.items() if x is None or sum(n)}
    added = prior + flat * len(cells)
    rates = {x: [(n + alpha(t, o)) / (total[k] + added) for k, n in ((1, t), (0, o))] for x, (t, o) in cells.items()}
    return rates, {x: math.log(t / o) for x, (t, o) in rates.items()}


def test_log_odds_and_lambda_equal_the_definitions(spark, monkeypatch):
    import math

    monkeypatch.setattr(toxicity, "COPY_SHARE", 99)  # with so few words, texts share shingles by chance

    rng = random.Random(12)
    usual = ["house", "river", "walking", "walked", "stone", "light", "people"]
    rows = [(f"{i} " + " ".join(rng.choice(usual + ["vilely", "vileness", "nasty"] * (label and rng.random() < 0.8)) for _ in range(rng.randint(3, 30))), label) for i, label in enumerate([0, 1] * 60)]
    docs = documents(spark, list(enumerate(t for t, _ in rows)))
    labels = spark.createDataFrame([(i, label) for i, (_, label) in enumerate(rows)], "doc_id long, toxic int")
    for prior, flat, min_z, min_docs in ((100.0, 0.5, 3.5, 4), (5.0, 0.1, 1.0, 1)):
        got = toxicity.fit(docs, labels, prior=prior, flat=flat, min_z=min_z, min_docs=min_docs)
        rates, want = plain_fit(rows, prior, flat, min_z, min_docs)
        assert got.other == pytest.approx(want.pop(None)) and got.odds == pytest.approx(want) and got.other < 0 < len(want)
        for k in (0, 1):
            assert sum(r[k] for r in rates.values()) == pytest.approx(1)
        scores = {**want, None: got.other}
        assert sum(rates[x][1] * math.exp(got.rate * s) for x, s in scores.items()) == pytest.approx(1)  # the law's lambda


def test_score_by_hand():
    import math

    assert toxicity.score(10, [8.0, 4.0, 1.0], 1.0) == pytest.approx(math.exp(-(10**2) * math.exp(-12) / 2))
    assert toxicity.score(100, [2.0, 1.0], 1.0) == pytest.approx(math.exp(-100 * math.exp(-2)))
    assert toxicity.score(10**7, [1e-3], 1.0) < 1e-100 and toxicity.score(0, [], 1.0) == 0


def test_sparse_hits_take_linear_time():
    import time

    lexicon = toxicity.Lexicon({"bad": 2.0}, -0.6, 1.0)
    for text in ([*["a"] * 5, "bad"] * 80_000, ["bad", "a"] * 80_000):
        began = time.process_time()
        assert toxicity.segments(text, lexicon)
        assert time.process_time() - began < 2


def test_copies_are_no_evidence(spark):
    rng = random.Random(3)
    alone = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    prose = lambda k: [alone(100 * k + i) for i in range(60)]
    base = prose(10)
    copies = []
    for _ in range(60):
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(60)] = f"new{alone(rng.randrange(10**6))}"
        copies.append((" ".join([*copy[:30], "vileword", *copy[30:]]), 1))
    toxic = [(" ".join([*prose(20 + k), "vileword", "it", "is"]), 1) for k in range(12)]
    clean = [(" ".join([*prose(50 + k), "it", "is"]), 0) for k in range(120)]
    rows = [*copies, *toxic, *clean]
    docs = documents(spark, list(enumerate(t for t, _ in rows)))
    labels = spark.createDataFrame([(i, label) for i, (_, label) in enumerate(rows)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    assert {t.rstrip("*") for t in lexicon.odds} <= {"vileword", "vilewor", "vilewo", "vilew", "vile"} and lexicon.odds
    assert toxicity.taken([(1, [1, 2]), (2, [1, 2]), (3, [1, 3]), (4, []), (5, []), (6, [9, 8, 7, 6, 5, 4]), (7, [9, 8, 7, 6, 5])]) == [1, 3, 4, 5, 6]
