"""Toxic passages by maximum-scoring segment search.

Tokens are words and their stems (prefixes of 4 to 7 letters). They get log-odds of toxic against other
labelled documents under an informative Dirichlet prior (the pooled counts, scaled to `prior` words, plus `flat`
of each). Tokens of at least `min_docs` toxic documents whose document shares differ by a likelihood-ratio z-score of
`min_z` form the lexicon; by default that is the score which chance lets `false_tokens` of all tokens tested reach. A word belongs to its most telling token, every other word to one class of the rest; with the
words so dealt, each token's and the rest's rates in both classes are counted again, and their log ratio under the same
prior is the score of a word. The rest's score is negative.

A linear scan finds every maximal segment. By Karlin and Altschul's extreme-value law chance gives a text of n words
n * exp(-lambda * S) segments of score S, where lambda solves E[exp(lambda * score)] = 1 over the words of other texts. As
scores are log ratios of rates that add up to 1 in both classes, lambda is 1. For r segments together chance gives
E = n^r * exp(-lambda * sum of S) / r! such sets. A text's score is exp(-E) of its segments with less than one by chance
(of its highest one if there is none): the probability that chance alone has no such passages.

Fitting reads at most `per_class` labelled documents of each class, those of the smallest hash of their id. Copies are no
further evidence: a document that shares COPY_SHARE or more of its SKETCH smallest shingle hashes with one taken before
is left out.
Defined cases: null, empty and wordless texts score 0; no labels, or none of a class, give an empty lexicon and scores of 0;
repeated rows are scored each; labels that are null are left out; a document with contradicting labels counts as toxic;
a long text takes time in proportion to its length, wherever its telling words lie; other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import held_out, map_blocks, table, written
from orrery.llm.jaccard import shingles

THRESHOLD = 0.7
STEMS = (7, 6, 5, 4)
CACHE_WORDS = 150_000
#: Shingles of so many words; a text's smallest hashes of them; and how many two copies have in common.
SHINGLE, SKETCH, COPY_SHARE = 3, 16, 5
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def tokens(word: str) -> list[str]:
    return [word, *[f"{word[:k]}*" for k in STEMS if len(word) > k]]


@dataclass
class Lexicon:
    odds: dict[str, float]
    other: float  # log-odds of every word that is not in it
    rate: float  # lambda of the extreme-value law

    def of_words(self) -> _Words:
        return _Words(self.odds)


class _Words(dict):
    """Word to its log-odds, None if it is in no token of the lexicon; emptied when it has CACHE_WORDS."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str) -> float | None:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = max((self.odds[t] for t in tokens(word) if t in self.odds), default=None)
        return found


def segments(text_words: list[str], lexicon: Lexicon, known: _Words | None = None) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score) by the linear-time scan of Ruzzo and Tompa.

    Words outside the lexicon all cost the same, so that runs of them enter as one negative score.
    """
    cost = -lexicon.other
    known = known or lexicon.of_words()
    hits = [(i, x) for i, x in enumerate(map(known.__getitem__, text_words)) if x is not None]
    total, at = 0.0, 0
    found: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, nearest earlier one with a smaller sum before
    for i, x in hits:
        before = total - cost * (i - at)
        total, at = before + x, i + 1
        if total <= before:
            continue
        first, low, k = i, before, len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= low:
                k = found[k][4]  # those between aren't smaller either
            if k < 0 or found[k][3] >= total:
                found.append((first, i + 1, low, total, k))
                break
            first, _, low, _, nearer = found[k]
            del found[k:]
            k = nearer
    return [(a, b, high - low) for a, b, low, high, _ in found]


def score(n: int, scores: list[float], rate: float) -> float:
    """exp(-E): E is how many sets of segments as high as the significant ones together chance gives."""
    if not scores or n == 0:
        return 0.0
    high = [s for s in scores if math.log(n) < rate * s] or [max(scores)]
    return math.exp(-math.exp(min(6.0, len(high) * math.log(n) - rate * sum(high) - math.lgamma(len(high) + 1))))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 8_000, prior: float = 100.0, flat: float = 0.5, min_z: float | None = None, min_docs: int = 4, false_tokens: float = 1.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """The lexicon from labelled documents. What comes to the driver is bounded by the sample."""
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = [ids.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * per_class rows of 12 bytes
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(sample, "doc_id").withColumn("row", F.monotonically_increasing_id())
    texts = written(texts.select("label", "text", "row"))
    alone = [(row,) for row in taken([(r["row"], r["sketch"]) for r in sketched(texts).orderBy("row").collect()])]  # SKETCH numbers a sampled document
    texts = texts.join(F.broadcast(docs.sparkSession.createDataFrame(alone, "row long")), "row").select("label", "text")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: dict[tuple[str, int], list[int]] = {}
            for label, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                counts: dict[str, int] = {}
                for w in words(text):
                    for k in tokens(w):
                        counts[k] = counts.get(k, 0) + 1
                counts[""] = sum(n for w, n in counts.items() if not w.endswith("*"))
                for w, n in counts.items():
                    x = seen.setdefault((w, label), [0, 0])
                    x[0] += 1
                    x[1] += n
            keys, values = [*seen], [*seen.values()]
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())],
                names=["word", "label", "docs", "n"],
            )

        return work

    counts = map_blocks(texts, make, "word string, label int, docs long, n long")
    pick = lambda col, k: F.sum(F.when(F.col("label") == k, F.col(col)).otherwise(0))
    by_word = written(counts.groupBy("word").agg(pick("n", 1).alias("t"), pick("n", 0).alias("o"), pick("docs", 1).alias("td"), pick("docs", 0).alias("od")))
    every = by_word.where("word = ''").first()  # all documents and words
    if every is None or not all(every[x] for x in ("t", "o", "td", "od")):
        return Lexicon({}, 0.0, 1.0)
    all_t, all_o, docs_t, docs_o = every["t"], every["o"], every["td"], every["od"]
    side = lambda n, total: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) * (docs_t + docs_o) / ((F.col("td") + F.col("od")) * total))).otherwise(0.0)
    rest = lambda n, total: F.when(F.col(n) < total, (total - F.col(n)) * F.log((total - F.col(n)) * (docs_t + docs_o) / ((docs_t + docs_o - F.col("td") - F.col("od")) * total))).otherwise(0.0)
    ratio = 2 * (side("td", docs_t) + side("od", docs_o) + rest("td", docs_t) + rest("od", docs_o))
    above = F.col("td") * docs_o > F.col("od") * docs_t
    tested = by_word.where((F.col("word") != "") & (F.col("td") + F.col("od") >= min_docs))
    if min_z is None:
        min_z = NormalDist().inv_cdf(1 - min(0.5, false_tokens / max(1, tested.count())))
    lexical = tested.where((F.col("td") >= min_docs) & above).where(F.sqrt(F.greatest(ratio, F.lit(0.0))) >= min_z)
    telling = {r["word"]: log_odds(r["t"], r["o"], all_t, all_o, prior, flat) for r in lexical.select("word", "t", "o").collect()}
    dealt: dict[str, list[int]] = {}
    for r in deal(by_word.where((F.col("word") != "") & ~F.col("word").endswith("*")).select("word", "t", "o"), telling).groupBy("token").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).collect():
        dealt[r["token"]] = [r["t"], r["o"]]
    return scored(dealt, all_t, all_o, prior, flat)


def sketched(texts: DataFrame) -> DataFrame:
    """row, sketch: the SKETCH smallest hashes of a text's shingles."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingles(x, SHINGLE)[:SKETCH].view(np.int64).tolist() for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["row", "sketch"])

        return work

    return map_blocks(texts.select("row", "text"), make, "row long, sketch array<long>")


def taken(rows: list[tuple[int, list[int]]]) -> list[int]:
    """The rows, in order, that are no copies of one taken before; a short text's sketch may be less than COPY_SHARE long."""
    of: dict[int, list[int]] = {}
    out = []
    for row, sketch in rows:
        met = Counter(k for x in sketch for k in of.get(x, ()))
        if met and max(met.values()) >= min(COPY_SHARE, len(sketch)):
            continue
        for x in sketch:
            of.setdefault(x, []).append(row)
        out.append(row)
    return out


def log_odds(t: int, o: int, all_t: int, all_o: int, prior: float, flat: float) -> float:
    """Of a token with t of the toxic words and o of the others."""
    alpha = prior * (t + o) / (all_t + all_o) + flat
    odds = lambda n, total: math.log((n + alpha) / (total + prior + flat - n - alpha))
    return odds(t, all_t) - odds(o, all_o)


def deal(words_of: DataFrame, telling: dict[str, float]) -> DataFrame:
    """token, t, o of every word (word, t, o) that belongs to a telling token."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            best = [max((x for x in tokens(w) if x in telling), key=telling.__getitem__, default=None) for w in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(best, pa.string()), *batch.columns[1:]], names=["token", "t", "o"]).filter(pa.array([x is not None for x in best], pa.bool_()))

        return work

    return map_blocks(words_of, make, "token string, t long, o long", 0)


def scored(dealt: dict[str, list[int]], all_t: int, all_o: int, prior: float, flat: float) -> Lexicon:
    """Log ratios of the rates of words, each of which belongs to one token or to the rest."""
    rest = [all_t - sum(t for t, _ in dealt.values()), all_o - sum(o for _, o in dealt.values())]
    alpha = lambda t, o: prior * (t + o) / (all_t + all_o) + flat
    added = prior + flat * (len(dealt) + 1)
    ratio = lambda t, o: math.log((t + alpha(t, o)) / (all_t + added)) - math.log((o + alpha(t, o)) / (all_o + added))
    return Lexicon({token: ratio(t, o) for token, (t, o) in dealt.items()}, ratio(*rest) if dealt else 0.0, 1.0)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score, predicted and the passages (first word, end word, score) of every whole text."""
    spans = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def make():
        known = lexicon.of_words()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, passages = [], []
            for text in batch.column(1).to_pylist():
                own = words(text)
                found = segments(own, lexicon, known)
                scores.append(score(len(own), [s for *_, s in found], lexicon.rate))
                passages.append([{"first": a, "end": b, "score": s} for a, b, s in found if math.log(len(own)) < lexicon.rate * s])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, spans)], names=["doc_id", "score", "passages"])

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = map_blocks(rows, make, "doc_id long, score double, passages array<struct<first:int,end:int,score:double>>")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold."""
    at = docs.columns.index(text_col)

    def make():
        known = lexicon.of_words()

        def fine(text: str | None) -> bool:
            own = words(text)
            return score(len(own), [s for *_, s in segments(own, lexicon, known)], lexicon.rate) < threshold

        return lambda batch: batch.filter(pa.array([fine(x) for x in batch.column(at).to_pylist()], pa.bool_()))

    return map_blocks(docs, make, docs.schema, at)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score_toxicity(docs, lexicon).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
