"""Quality rules by tokeniser fertility.

Every text gets base counts (words, symbols, repeated lines and word windows) and, from a public
vocabulary with byte fallback, characters per token, the share of byte-fallback tokens and the
entropy of its tokens; characters per token also from a second, byte-level vocabulary. Bands are Tukey fences of those
measures per language and length (in octaves of tokens) over all documents, whatever their length; a text outside a band
is rejected, one on a fence isn't.

Defined cases: a null or empty text has zero counts, no measures, and fails the base rules; with fewer than `min_group`
documents of a language and length the bands of that length in the script count, then those of the language, then those
of the script; a long text is tokenised as a whole; repeated rows are judged alike, row by row; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.bpe import CACHE_PIECES, ranks
from orrery.llm.common import map_blocks, table, written
from orrery.llm.pretokens import distinct, slices

SYMBOLS = "#*$%&|<>"
MEASURES = ("chars_per_token", "byte_share", "token_entropy", "chars_per_byte_token")
SCHEMA = (
    "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double, chars_per_byte_token double"
)
#: Letters that no script of their own has in Unicode names, by what such names begin with.
_HAN = ("CJK", "KANGXI")


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of `size` words found twice or more."""
    if len(words) <= size:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    keys = codes[: len(codes) - size + 1]
    for k in range(1, size):
        keys = keys * len(ids) + codes[k : len(codes) - size + 1 + k]
        if k + 1 < size:  # stays exact for any vocabulary
            keys = np.unique(keys, return_inverse=True)[1]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(codes), bool)
    for k in range(size):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


@functools.cache
def _scripts() -> tuple[np.ndarray, list[str]]:
    """A number of every code point, and the scripts by number: the first word of a letter's Unicode name; 0 is no letter."""
    names, table = [""], np.zeros(sys.maxunicode + 1, np.uint16)
    numbers = {"": 0}
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if c.isalpha():
            name = unicodedata.name(c, "UNKNOWN").partition(" ")[0].partition("-")[0].lower()
            name = "han" if name.upper() in _HAN else name
            if name not in numbers:
                numbers[name] = len(names)
                names.append(name)
            table[point] = numbers[name]
    return table, names


def script(text: str) -> str:
    """The script of most letters, the first by name of several; latin for a text of Latin-1 or without letters."""
    try:
        text.encode("latin-1")
        return "latin"
    except UnicodeEncodeError:
        pass
    table, names = _scripts()
    counts = np.bincount(table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=len(names))
    counts[0] = 0
    best = [n for n, c in zip(names, counts.tolist(), strict=True) if c == counts.max()]
    return min(best) if counts.any() else "latin"


@functools.cache
def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.vocab_size())])


class _Sizes(dict):
    """Tokens of a piece of text in a byte-level vocabulary; emptied when it has CACHE_PIECES."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        # pieces come ready cut, so that the pattern isn't used
        self.solve = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks(path), special_tokens={})._encode_single_piece

    def __missing__(self, piece: bytes) -> int:
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = n = len(self.solve(piece))
        return n

    def of(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text."""
        data, at, first = slices(texts)
        one, which = distinct(data, at)
        n = np.fromiter(map(self.__getitem__, [data[a:b] for a, b in zip(at[one].tolist(), at[one + 1].tolist(), strict=True)]), np.int64, len(one))
        return np.diff(np.append(0, np.cumsum(n[which]))[first]).tolist()


@functools.cache
def _sizes(path: str) -> _Sizes:
    return _Sizes(path)


def fertility(docs: DataFrame, vocabulary: str, byte_vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts and token measures of every whole text."""

    def make():
        model, is_byte = _pieces(vocabulary)
        bytewise = byte_vocabulary and _sizes(byte_vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, texts = [], batch.column(1).to_pylist()
            sizes = bytewise.of(texts) if byte_vocabulary else [0] * len(texts)
            for text, size in zip(texts, sizes, strict=True):
                text = text or ""
                ids = np.asarray(model.encode(text, num_threads=1), np.int64)
                n = len(ids)
                if n:
                    share = np.unique(ids, return_counts=True)[1] / n
                    measures = (len(text) / n, float(is_byte[ids].mean()), float(-(share * np.log2(share)).sum()), len(text) / size if size else None)
                else:
                    measures = (None,) * len(MEASURES)
                rows.append((script(text), *base_counts(text), n, *measures))
            kinds = [pa.string(), *[pa.int64()] * 6, *[pa.float64()] * len(MEASURES)]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=names)

        return work

    return map_blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")), make, SCHEMA)


def bands(measured: DataFrame, by: str, spread: float) -> DataFrame:
    """Tukey fences per group over all documents; quantile sketches merge, so no group meets in one task."""
    at = F.array(F.lit(0.25), F.lit(0.75))
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in MEASURES:
        aggs.append(F.percentile_approx(m, at, 10_000).alias(m))
    out = measured.where((F.col("n_tokens") > 0) & F.col(by).isNotNull()).groupBy(F.col(by).alias("group")).agg(*aggs)
    for m in MEASURES:
        low, high = F.col(m)[0], F.col(m)[1]
        out = out.withColumn(f"{m}_low", low - spread * (high - low)).withColumn(f"{m}_high", high + spread * (high - low)).drop(m)
    return out


def quality_rules(
    docs: DataFrame, vocabulary: str, byte_vocabulary: str | None = None, min_words: int = 50, max_repeat_percent: int = 50, spread: float = 3.0, min_group: int = 50,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Counts, measures, bands and verdict of every row. `spread` is the fence in interquartile ranges."""
    measured = written(fertility(docs, vocabulary, byte_vocabulary, id_col, text_col, lang_col))
    octave = F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double")))  # entropy grows with a text's length
    measured = measured.withColumn("sized", F.when(F.col("lang").isNotNull(), F.concat_ws(":", octave, "lang"))).withColumn("drawn", F.concat_ws(":", octave, "script"))
    fences = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    out = measured
    groups = {"sized": "z", "drawn": "d", "lang": "l", "script": "s"}
    for key, prefix in groups.items():  # written, so that their true size decides whether they are broadcast or met by a (splittable) shuffle
        own = bands(measured, key, spread)
        own = written(own if key == "script" else own.where(F.col("n") >= min_group))
        out = out.join(own.select(F.col("group").alias(key), *[F.col(x).alias(f"{prefix}_{x}") for x in fences]), key, "left")
    ok = F.lit(True)
    for m in MEASURES:
        low, high = (F.coalesce(*[F.col(f"{p}_{m}_{side}") for p in groups.values()]) for side in ("low", "high"))
        fine = F.col(m).between(low, high) if m != "byte_share" else F.col(m) <= F.greatest(high, F.lit(0.05))
        ok = ok & F.coalesce(fine, F.lit(True))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("fertility_ok", ok).withColumn("kept", ~failed & ok).drop("sized", "drawn", *[f"{p}_{x}" for p in groups.values() for x in fences])


def op10_quality(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = quality_rules(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "byte_share", "token_entropy", "chars_per_byte_token")
