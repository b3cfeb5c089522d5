import re

from helpers import documents
from pyspark.sql import functions as F

from orrery.llm import decontaminate

ITEMS = [
    (1, "A train leaves Boston at 60 km per hour and after 3 hours it meets another train; how far did Boston train go in 3 hours?"),
    (2, "short item with five words here"), (3, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"), (4, None), (5, "the quick brown fox jumps over the lazy dog and then sleeps under a tree for 5 hours"), (6, "a b"),
]


def leaks(spark, texts, items=ITEMS):
    found = decontaminate.find_leaks(documents(spark, texts).withColumnRenamed("source", "item_id"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted((r.doc_id or 0, r.item_id, r.run, r.slots_changed) for r in found.collect())


def test_templates_and_slots(spark):
    texts = [
        (1, "xx yy. A train leaves Denver at 80km per hour and after 5 hours it meets another train; how far did Denver train go in 5 hours? zz"),
        (2, "xx yy. A train leaves Denver at 80 km per hour and after 5 hours it meets another train; how far did Austin train go in 7 hours? zz"),
        (3, "this is a short item with five words here ok"), (4, "99 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17"), (5, None), (6, ""),
        (7, "The quick brown fox jumps over the lazy dog and then sleeps under a bed"), (7, "The quick brown fox jumps over the lazy dog and then sleeps under a bed"),
        (8, "the quick brown fox jumps over the lazy dog"), (None, "hello. the quick brown fox jumps over the lazy dog and then sleeps under a tree for 9 hours"), (9, "a b " * 30000),
    ]
    assert leaks(spark, texts) == [(0, 5, 18, 1), (1, 1, 26, 5), (3, 2, 6, 0), (7, 5, 14, 0)]
    assert leaks(spark, texts[:0] or [(1, "x")]) == [] and leaks(spark, texts, ITEMS[3:4]) == []


def test_every_run_of_an_alignment(spark):
    clash = "A train leaves Boston at 60 km per hour and after 3 hours it meets another train; how far did Boston train go in 4 hours?"
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    late = " ".join(["w", *words[1:13], "zz", *words[14:28], "zz", *words[29:]])  # runs of 12, 14 and 31
    numbers = " ".join(map(str, range(1, 21)))
    ending = "the lazy dog sleeps under a tall tree while seven ducks swim past"
    items = [ITEMS[0], (7, " ".join(words)), (8, f"{numbers} xx {ending} quietly")]
    texts = [(1, clash), (3, late), (4, f"{numbers} yy {ending} quietly"), (5, " ".join(words[:12]))]  # 4: the longest run is all placeholders
    assert leaks(spark, texts, items) == [(1, 1, 24, 0), (3, 7, 31, 0), (4, 8, 14, 0)]


def test_numbers_and_few_words(spark):
    heavy = "sum 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 end"
    items = [(1, "What is 17 + 25?"), (2, "Add 12 to 30 and 5"), (3, heavy), (4, "A farmer sells 120 eggs a day and keeps 8 for tea; how much is left"), (5, "we met Boston crews in the harbour near old mills at dawn again")]
    texts = [
        (1, "He asks: what is 17 + 25? Well"), (2, "please add 12 to 30 and 5 now"), (3, "please add 13 to 31 and 6 now"), (4, "what is 18 + 25?"),
        (5, "x x x sum 1 2 3 4 5 6 7 8 9 10 11 12 z"), (6, "x x x x sum 1 2 3 4 5 6 7 8 9 10 11 12 13 14 z"), (7, "so 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"),
        (8, "A farmer sells 87.5 eggs a day and keeps 1,250 for tea; how much is left"), (9, "we met boston crews in the harbour near old mills at dawn again"),
    ]
    assert leaks(spark, texts, items) == [(1, 1, 4, 0), (2, 2, 6, 0), (3, 2, 6, 3), (5, 3, 13, 0), (6, 3, 15, 0), (8, 4, 16, 2), (9, 5, 13, 0)]
    rows = documents(spark, [(1, "1,250.75 and 3.5km, v1.5 Bob.5 in Bob.5 1.2.3. 1999,2000 a 5 km.3 x.5 1,25 \u00b2.5")])
    both = rows.select(decontaminate.plain(rows.text).alias("p"), decontaminate.template(rows.text).alias("t")).first()
    assert len(both.p) == len(both.t) and [t for t in both.t[:4]] == ["0", "and", "0", "u0"]


def test_equals_thirteen_token_overlap(spark):
    sf = "/root/testdata/sf0.01"
    tokens = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = tokens(r.text)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(r.item_id)
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = tokens(r.text)
        want |= {(r.doc_id, i) for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    assert {(r.doc_id, r.item_id) for r in decontaminate.op4_decontaminate(spark, sf).collect()} == want and want


def test_names_at_sentence_starts(spark):
    items = [(1, "Tom bought 3 red apples. Tom ate 2 of them."), (2, "What is left of the 12 old coins in the box?")]
    texts = [
        (1, "Well. Anna bought 7 red apples. Anna ate 5 of them."), (2, "Well. Anna bought 7 red apples. Peter ate 5 of them."), (3, "Well. anna bought 7 red apples. Anna ate 5 of them."),
        (4, "Which is left of the 13 old coins in the box?"), (5, "x what is left of the 13 old coins in the box?"), (6, "Tom bought 3 red apples. Tom ate 2 of them."),
    ]
    assert leaks(spark, texts, items) == [(1, 1, 10, 4), (4, 2, 11, 2), (5, 2, 11, 1), (6, 1, 10, 0)]


def test_verbatim_runs_at_every_offset(spark):
    """Copies of 13 tokens of any mix of words and numbers, behind any number of other words, against a plain scan."""
    import random

    rng = random.Random(5)
    word = lambda: rng.choice(["what", "is", "sum", "of", "Boston", "km", "and", "12", "7", "3.5", "1,250", "apples"])
    items = [(k, " ".join(word() for _ in range(rng.choice([13, 14, 18, 30])))) for k in range(12)]
    texts, want = [], set()
    for k, item in items:
        tokens = item.split()
        for offset in range(12):
            a = rng.randint(0, len(tokens) - 13)
            texts.append((100 * k + offset, " ".join([*["zz"] * offset, *tokens[a : a + 13], "yy yy"])))
            if not all(re.fullmatch(r"[\d.,]+", t) for t in tokens[a : a + 13]):
                want.add((100 * k + offset, k))
    got = {(d, i) for d, i, *_ in leaks(spark, texts, items)}
    assert want <= got and {d for d, _ in got} <= {d for d, _ in texts}


def unguarded(text):
    """The placeholders and tokens by all patterns on every text, looking back at every place."""
    parted = F.regexp_replace(text, r",(?<=(?<!\p{N})\p{N}{1,3},)(?=\p{N}{3}(?!\p{N}))", "")
    parted = F.regexp_replace(parted, r"\.(?<=\p{N}\.)(?=\p{N})", decontaminate.POINT)
    parted = F.regexp_replace(parted, r"(\p{N})(?=\p{L})", "$1 ")
    out = F.regexp_replace(parted, r"(?<=[\p{Ll},;:] )\p{Lu}\p{Ll}+", "N0")
    out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}{decontaminate.POINT}])\p{{N}}+(?:{decontaminate.POINT}\p{{N}}+)*", "0")
    out = F.regexp_replace(out, rf"(?i)(?<=[^\p{{L}}]0[ -])(?:{'|'.join(decontaminate.UNITS)})(?![\p{{L}}\p{{N}}])", "U0")
    return decontaminate._tokens(out), decontaminate._tokens(parted)


def test_guards_change_no_token(spark):
    import random

    rng = random.Random(9)
    pieces = ["Boston", "a", "km", "é", "Éa", "X", "xY", "ßA", "\u01c5a", "\U00010400\U00010428", "12", "3", "1,250", ".5", "\u00b2", "\u0663", "n0", "0", decontaminate.POINT, " ", " ", " ", "-", ", ", "; ", ": ", ". ", "\n", "中"]
    texts = [(k, "".join(rng.choice(pieces if k % 2 else [p for p in pieces if not any(c.isnumeric() for c in p)]) for _ in range(rng.randint(0, 9)))) for k in range(4000)]
    rows = documents(spark, texts)
    template, plain = unguarded(rows.text)
    got = rows.select("text", template.alias("a"), decontaminate.template(rows.text).alias("b"), plain.alias("c"), decontaminate.plain(rows.text).alias("d"), decontaminate.has_slots(rows.text).alias("slots")).collect()
    assert all(r.a == r.b and r.c == r.d and (r.slots or r.b == r.d) for r in got) and 500 < sum(r.slots for r in got) < 3500


def test_texts_without_digits_skip_the_patterns(spark):
    """Plain prose takes well under the time of all patterns (best of three)."""
    import time

    rows = documents(spark, {k: "the quick brown fox jumps over the lazy dog and sleeps; " * 4000 for k in range(8)}).repartition(1).cache()
    rows.count()

    def best(column):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            rows.select(F.size(column).alias("n")).agg(F.sum("n")).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    assert best(decontaminate.template(rows.text)) < 0.75 * best(unguarded(rows.text)[0])
    rows.unpersist()
