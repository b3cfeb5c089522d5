"""Personal data by patterns, and terms that give protected entities away by corpus co-occurrence.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. Every value that they find is a
protected entity. A term is a word of four characters or more, or a shorter one with a capital or of a script without
capitals, outside the matches. With whole documents (rows) as the unit of all four counts,
    disclosure(e, t) = PMI(e; t) / IC(e) = log(c(e,t) * N / (c(e) * c(t))) / log(N / c(e)),
which is 1 where the term occurs with that entity only. Terms of at least `support` documents with an entity whose
disclosure reaches `threshold` are found in every text as well; masking removes both. An entity in fewer than `support`
documents has no terms: what one or two documents show of it is no evidence.

As c(e,t) <= c(e), the threshold bounds c(t) by N^(1 - threshold) * c(e)^threshold: terms beyond that go before
entities and terms of a document meet, so that few pairs are made.

All of it is DataFrame functions. Positions come from the lengths of what lies between matches, in code points, by a scan
in log(matches) steps; nothing grows with the square of a text or of its matches.
Defined cases: a null or empty text has no spans; repeated rows count as one document each and get the
same spans, rows with a null doc_id likewise; other columns keep their values, whatever their names; no pattern backtracks
over a long run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import quoted, shared_folder, split_by_ids, table, written

KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns of the contract. Possessive runs and starts at a run's first character only find the same
#: leftmost matches without scanning a run once for each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
#: What every match of a base pattern has; a class of single characters is looked up, alternatives are tried one by one.
BASE = "[@0123456789]"
TERM = r"(?<![\p{L}\p{N}_])(?:\p{L}[\p{L}\p{N}_]{3,}+|[\p{Lu}\p{Lo}]\p{L}{1,2}+(?![\p{L}\p{N}_]))"
#: Code points of a piece that substrings are taken from.
PIECE = 512
EMPTY = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _powers(n: Column) -> Column:
    """1, 2, 4 and so on below n."""
    return F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < n)


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """All prefixes of an array of integers merged (from 0), by doubling: n log n steps, no growing array."""
    step = lambda acc, s: F.transform(acc, lambda x, i: merge(x, F.coalesce(F.get(acc, i - s), F.lit(0))))
    return _let(values, lambda v: F.aggregate(_powers(F.size(v)), v, step))


def _located(text: Column, pattern: str) -> Column:
    """All matches as structs (start, end, value), from the gaps between them."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct((F.length(g) + F.length(h)).alias("step"), h.alias("hit"))), lambda x: x["hit"].isNotNull())
    place = lambda x, end: F.struct((end - F.length(x["hit"])).alias("start"), end.alias("end"), x["hit"].alias("value"))
    return _let(pairs, lambda p: F.zip_with(p, _running(F.transform(p, lambda x: x["step"]), lambda x, y: x + y), place))


def _luhn(digits: Column) -> Column:
    ordered = F.split(F.reverse(digits), "")
    values = F.transform(ordered, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def base_spans(text: Column) -> Column:
    """Sorted structs (start, kind number, end, value) of the valid matches of every pattern."""
    kind = "array<struct<start:int,kind:int,end:int,value:string>>"

    def of(number: int) -> Column:
        name = KINDS[number]
        found = F.filter(_located(text, PATTERNS[name]), lambda x: _valid(name, x["value"]))
        shaped = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))
        return F.when(F.coalesce(text.rlike(GATES[name]), F.lit(False)), shaped).otherwise(F.array().cast(kind))

    parts = [of(number) for number in range(4)]
    return F.array_sort(F.concat(*parts))


def _rows(docs: DataFrame, id_col: str, text_col: str, row: bool = False) -> DataFrame:
    own = [F.struct(*quoted(docs.columns)).alias("row")] if row else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *own)


def terms_of(text: Column) -> Column:
    """The different terms of a text, lower-cased."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def _evidence(docs: DataFrame, support: int, threshold: float, id_col: str, text_col: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """term, entity, disclosure of the terms that pass, over all documents; and doc_id, term of the documents' words that could pass.

    Those words are stored as they are counted, so that all texts are cut into words once. What documents with an entity show
    is a least count of a word: words that are too frequent there already are not looked for in the others.
    """
    rows = _rows(docs, id_col, text_col)
    near = rows.where(F.col("text").rlike(BASE)).withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0)
    entity = lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))
    near = written(near.select(F.monotonically_increasing_id().alias("unit"), F.array_distinct(F.transform("spans", entity)).alias("entities"), F.array_intersect(terms_of(F.col("text")), terms_of(replaced(F.col("text"), F.col("spans"), lambda _: F.lit(" ")))).alias("terms")), folder)
    each = near.select("unit", F.explode("entities").alias("entity"))
    entities = written(each.groupBy("entity").agg(F.count(F.lit(1)).alias("c_e")).where(F.col("c_e") >= support), folder)
    sizes = rows.agg(F.count(F.lit(1)).alias("n")).first(), entities.agg(F.max("c_e").alias("most")).first()
    total, most = max(2, sizes[0]["n"]), sizes[1]["most"] or 0
    rare = lambda c_t, c_e: c_t <= (1 + 1e-9) * total ** (1 - threshold) * F.pow(c_e.cast("double"), F.lit(threshold))
    own = written(each.join(entities, "entity").groupBy("unit").agg(F.collect_list(F.struct("entity", "c_e")).alias("own")), folder)  # as wide as one document
    close = near.select("unit", "terms").join(own.select("unit"), "unit").select("unit", F.explode("terms").alias("term"))
    shared = near.join(own.select("unit", F.lit(1).alias("shared")), "unit", "left").select("shared", F.explode("terms").alias("term"))
    wanted = shared.groupBy("term").agg(F.count("shared").alias("near"), F.count(F.lit(1)).alias("least"))
    wanted = written(wanted.where((F.col("near") >= support) & rare(F.col("least"), F.lit(most))).select("term"), folder)
    words = rows.select("doc_id", F.explode(terms_of(F.col("text"))).alias("term")).withColumn("at", F.xxhash64("term"))
    words, _ = split_by_ids(words, "at", wanted.select(F.xxhash64("term").alias("at")), 64)  # else every word moves once these are too many to broadcast
    words = written(words.join(wanted, "term").select("doc_id", "term"), folder)
    counts = written(words.groupBy("term").agg(F.count(F.lit(1)).alias("c_t")).where(rare(F.col("c_t"), F.lit(most))), folder)
    terms = close.join(counts, "term").groupBy("unit").agg(F.collect_list(F.struct("term", "c_t")).alias("terms"))
    pairs = own.join(terms, "unit").select(F.explode("own").alias("e"), "terms").select("e", F.explode("terms").alias("t")).select("e.*", "t.*").where(rare(F.col("c_t"), F.col("c_e")))
    pairs = pairs.groupBy("entity", "c_e", "term", "c_t").agg(F.count(F.lit(1)).alias("c_et")).where(F.col("c_et") >= support)
    ratio = lambda a, b: F.log(a * float(total) / b)
    score = ratio(F.col("c_et"), F.col("c_e") * F.col("c_t")) / F.greatest(ratio(F.lit(1.0), F.col("c_e")), F.lit(1e-9))
    return pairs.select("term", "entity", score.alias("disclosure")).where(F.col("disclosure") >= threshold), words


def disclosing_terms(docs: DataFrame, support: int = 3, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """term, entity, disclosure of the terms that pass, over all documents."""
    return _evidence(docs, support, threshold, id_col, text_col, folder or shared_folder(docs.sparkSession))[0]


def _among(word: Column, ordered: Column) -> Column:
    """Whether a word is in a sorted array, by halving."""
    step = lambda at, s: F.when(F.coalesce(F.get(ordered, at + s - 1) <= word, F.lit(False)), at + s).otherwise(at)
    return F.coalesce(F.get(ordered, F.aggregate(F.reverse(_powers(F.size(ordered) + 1)), F.lit(0), step) - 1) == word, F.lit(False))


def find_pii(docs: DataFrame, support: int = 3, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """doc_id, text, base and spans (sorted structs start, kind, end) of every row; row: its columns as a struct."""
    folder = shared_folder(docs.sparkSession)
    rows = _rows(docs, id_col, text_col, row)
    terms, words = _evidence(docs, support, threshold, id_col, text_col, folder)
    terms = written(terms.select("term").distinct(), folder)
    hits = written(words.join(terms, "term", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("terms")), folder)
    maybe, clean = split_by_ids(rows, "doc_id", hits.select("doc_id"))
    found = maybe.join(hits.withColumnRenamed("doc_id", "hit_id"), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").drop("hit_id")
    found = found.unionByName(clean.withColumn("terms", F.lit(None).cast("array<string>")))
    base = F.transform(base_spans(F.col("text")), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    added = F.filter(_located(F.col("text"), TERM), lambda s: _among(F.lower(s["value"]), F.col("terms")))
    added = F.transform(added, lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["end"].alias("end")))
    found = found.withColumn("base", F.coalesce(F.when(F.col("text").rlike(BASE), base), F.array().cast(EMPTY)))
    return found.select("doc_id", "text", *["row"] * row, "base", F.when(F.col("terms").isNotNull() & F.col("text").isNotNull(), F.array_sort(F.concat("base", added))).otherwise(F.col("base")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def replaced(text: Column, spans: Column, name: Callable[[Column], Column]) -> Column:
    """The text with name(span) for every span; of overlapping spans the first counts, the rest of the others goes."""

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / PIECE).cast("int")
        here = F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
        return F.substring(here, start % PIECE + 1, end - start)

    def put(pieces: Column, own: Column, ends: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        parts = F.transform(own, lambda s, i: F.when(s["start"] >= before(i), F.concat(cut(pieces, before(i), s["start"]), name(s))).otherwise(""))
        return F.concat(F.array_join(parts, ""), cut(pieces, before(F.size(own)), F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    done = _let(pieces, lambda p: _let(spans, lambda own: _let(_running(F.transform(own, lambda s: s["end"]), F.greatest), lambda ends: put(p, own, ends))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    return replaced(text, spans, lambda s: F.get(names, s["kind"]))


def mask_pii(docs: DataFrame, support: int = 3, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows with masked texts and, where there is such a column, their new length."""
    found = find_pii(docs, support, threshold, id_col, text_col, row=True).withColumn("masked", masked(F.col("text"), F.col("spans")))
    new = {text_col: F.col("masked"), length_col: F.length("masked")}
    return found.select(*[(new[c].cast(t) if c in new else F.col(f"row.{quoted([c])[0]}")).alias(c) for c, t in docs.dtypes])


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(4)), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
