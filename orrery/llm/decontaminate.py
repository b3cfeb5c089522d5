"""Benchmark decontamination by template windows.

Texts are cut at everything but letters and digits; a decimal or grouped number (3.5, 1,250) is one token. Numbers, capitalised names within a sentence and units
after a number become typed placeholders, so that a question with other numbers or names keeps its
template. Windows of WINDOW placeholders and words are hashed: all of them for a benchmark item, every
STRIDE-th for a document. Any run of RUN = WINDOW + STRIDE - 1 equal tokens holds a whole strided window, so
the hash join finds every such run. Windows of the tokens as they are, with the same stride, find verbatim
runs whatever their placeholders. A hit fixes how document and item line up; then every run of equal
tokens is judged: a slot's value in the item must always stand for one value in the document, and the run needs
TELLING words besides placeholders. Capitalised words that start a sentence on both sides may be names as well: runs are
judged once with them as slots, once as words. A verbatim run counts by itself, in whatever run it lies, if it has a word:
a run of all placeholders tells nothing. Items shorter than RUN tokens must occur whole; they have
windows of SHORT tokens at every place.

All of it is DataFrame functions. Defined cases: null and empty texts match nothing; items of fewer than SHORT
tokens are ignored; copies of an item match each; a document matches an item once, by its longest run;
repeated rows of a document give one match; rows with a null doc_id are matched under null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import shared_folder, split_by_ids, table, written

WINDOW, STRIDE, SHORT = 8, 6, 4
RUN = WINDOW + STRIDE - 1
#: A window needs so many words besides placeholders.
TELLING = 3
UNITS = (
    "km", "cm", "mm", "m", "kg", "mg", "g", "lb", "lbs", "oz", "l", "ml", "s", "ms", "min", "h", "hr", "hrs", "hours?", "minutes?", "seconds?", "days?", "weeks?", "months?",
    "years?", "miles?", "meters?", "metres?", "feet", "foot", "inch", "inches", "grams?", "liters?", "litres?", "dollars?", "euros?", "cents?", "percent", "mph", "kmh", "kw", "w", "v",
)
#: Stands for the points within numbers (private use).
POINT = "\ue000"
NUMBER_SLOT, NAME_SLOT, UNIT_SLOT = "0", "n0", "u0"
#: A capitalised word within a sentence. It looks back only where a capital stands: most of a scan's time otherwise.
NAME = r"(?=\p{Lu})(?<=[\p{Ll},;:] )\p{Lu}\p{Ll}+"


def _part(text: Column) -> Column:
    out = F.regexp_replace(text, r",(?<=(?<!\p{N})\p{N}{1,3},)(?=\p{N}{3}(?!\p{N}))", "")
    out = F.regexp_replace(out, r"\.(?<=\p{N}\.)(?=\p{N})", POINT)
    return F.regexp_replace(out, r"(\p{N})(?=\p{L})", "$1 ")


def _parted(text: Column) -> Column:
    """Digits end where letters follow, so that a number and its unit are two tokens; 1,250 and 3.5 are one each."""
    return F.when(text.rlike(r"\p{N}"), _part(text)).otherwise(text)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), rf"[^\p{{L}}\p{{N}}{POINT}]+"), lambda x: x != "")


def plain(text: Column) -> Column:
    """The tokens as they are."""
    return _tokens(_parted(text))


def _slotted(text: Column) -> Column:
    out = F.regexp_replace(_part(text), NAME, "N0")
    out = F.regexp_replace(out, rf"(?=\p{{N}})(?<![\p{{L}}\p{{N}}{POINT}])\p{{N}}+(?:{POINT}\p{{N}}+)*", "0")
    return F.regexp_replace(out, rf"(?i)(?<=[^\p{{L}}]0[ -])(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", "U0")


def has_slots(text: Column) -> Column:
    """Whether template() and plain() may differ: only a digit or a name makes a placeholder."""
    return text.rlike(r"(?=[\p{N}\p{Lu}])(?:\p{N}|(?<=[\p{Ll},;:] )\p{Lu}\p{Ll})")  # one class first: an alternation is tried at every place


def template(text: Column) -> Column:
    """The tokens with placeholders, one for one with plain()."""
    return _tokens(F.when(has_slots(text), _slotted(text)).otherwise(text))


def starts(text: Column) -> Column:
    """Whether a token is a capitalised word at the start of a sentence, one for one with plain()."""
    marked = F.regexp_replace(_parted(text), r"(?<=^|[.!?]\s|[.!?][\"')]\s|\n)\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", "S0")
    return F.transform(_tokens(marked), lambda x: x == "s0")


def _windows(tokens: Column, size: int, stride: int) -> Column:
    """Structs (at, hash) of the windows at every stride-th token."""
    last = F.size(tokens) - size
    at = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(tokens, i + 1, size)).alias("hash")))


def _is_slot(x: Column) -> Column:
    return x.isin(NUMBER_SLOT, NAME_SLOT, UNIT_SLOT)


def _words(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda x: ~_is_slot(x)))


def _candidates(rows: DataFrame, items: DataFrame, size: int, stride: int, small: bool) -> DataFrame:
    """doc_id, item_id, shift: how far an item's tokens lie behind a document's.

    Of an item's template windows those stay that have a word and lie in a run that tells enough (short items: in an item
    that does, and with TELLING words if a window has so many); of its plain ones those in a run with a word."""
    around = lambda at: F.slice("template", F.greatest(at - (stride - 1), F.lit(0)) + 1, F.least(at, F.lit(stride - 1)) + size + stride - 1)
    inside = lambda at: _words(F.slice("template", at + 1, size))
    windows = _windows(F.col("template"), size, 1)
    if stride == 1:  # the whole item must occur
        most = F.least(F.array_max(F.transform(windows, lambda w: inside(w["at"]))), F.lit(min(TELLING, size - 1)))
        items = items.withColumn("words", _words(F.col("template"))).withColumn("most", F.greatest(most, F.lit(1)))
        by_template = F.filter(windows, lambda w: (F.col("words") >= TELLING) & (inside(w["at"]) >= F.col("most")))
        by_plain = F.filter(_windows(F.col("plain"), size, 1), lambda w: (F.col("words") > 0) & (w["at"] == 0))
    else:
        by_template = F.filter(windows, lambda w: (inside(w["at"]) > 0) & (_words(around(w["at"])) >= TELLING))
        by_plain = F.filter(_windows(F.col("plain"), size, 1), lambda w: _words(around(w["at"])) > 0)
    own = items.select("item_id", F.explode(F.concat(by_template, by_plain)).alias("w"))
    own = own.select("item_id", F.col("w.at").alias("item_at"), F.col("w.hash").alias("hash")).distinct()  # without slots a window is the same twice
    own = F.broadcast(own) if small else own
    own_plain = F.when(has_slots(F.col("text")), plain(F.col("text"))).otherwise(F.array().cast("array<string>"))  # else the template's windows are the plain ones
    seen = rows.select("doc_id", template(F.col("text")).alias("tokens"), own_plain.alias("plain"))  # columns of their own: worked out once a text
    seen = seen.select("doc_id", _windows(F.col("tokens"), size, stride).alias("w"), _windows(F.col("plain"), size, stride).alias("exact"))
    other = F.filter(F.zip_with("w", "exact", lambda w, e: F.when(w["hash"] != e["hash"], e)), lambda e: e.isNotNull())
    seen = seen.select("doc_id", F.explode(F.concat("w", other)).alias("w")).select("doc_id", F.col("w.at").alias("at"), F.col("w.hash").alias("hash"))
    return seen.join(own, "hash").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))


def _runs(facing: Column, here: Callable[[Column], Column], least: Column) -> Column:
    """All the longest slices of `least` places or more with here() at each place."""
    ends = F.concat(F.transform(F.filter(facing, lambda t: ~here(t)), lambda t: t["i"]), F.array(F.size(facing)))

    def step(acc: Column, end: Column) -> Column:
        out = F.when(end - acc["start"] >= least, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), end.alias("end"))))).otherwise(acc["out"])
        return F.struct((end + 1).alias("start"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("start"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.transform(F.aggregate(ends, zero, step, lambda acc: acc["out"]), lambda r: F.slice(facing, r["start"] + 1, r["end"] - r["start"]))


def _consistent(run: Column, slot: Callable[[Column], Column]) -> Column:
    name = lambda t: F.concat_ws(":", F.when(_is_slot(t["b"]), t["b"]).otherwise(NAME_SLOT), t["y"])
    slots = F.array_distinct(F.transform(F.filter(run, slot), lambda t: F.struct(name(t).alias("item"), t["x"].alias("doc"))))
    return F.size(slots) == F.size(F.array_distinct(F.transform(slots, lambda s: s["item"])))


def find_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_items: int = 20_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, run (equal tokens in a row), item_tokens, slots_changed of every match."""
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    items = items.select("item_id", template(F.col("text")).alias("template"), plain(F.col("text")).alias("plain"), starts(F.col("text")).alias("starts"))
    items = written(items.where(F.size("template") >= SHORT), folder)
    sizes = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.size("template") < RUN).cast("long")), F.lit(0)).alias("short"), F.coalesce(F.sum(F.size("template")), F.lit(0)).alias("tokens")).first()
    small = sizes["tokens"] <= 50 * broadcast_items  # 24 bytes a window: 24 MB at most
    found = _candidates(rows, items.where(F.size("template") >= RUN), WINDOW, STRIDE, small)
    if sizes["short"]:
        found = found.unionByName(_candidates(rows, items.where(F.size("template") < RUN), SHORT, 1, small))
    found = written(found.distinct(), folder)
    maybe, _ = split_by_ids(rows, "doc_id", found.select("doc_id"), 64)  # a text that is no candidate costs three tokenisations
    texts = maybe.select(F.col("doc_id").alias("own_id"), template(F.col("text")).alias("own"), plain(F.col("text")).alias("own_plain"), starts(F.col("text")).alias("own_starts"))
    pairs = found.join(texts, F.col("doc_id").eqNullSafe(F.col("own_id"))).join(items, "item_id")
    first = F.greatest(F.col("shift"), F.lit(0))
    last = F.least(F.size("own"), F.col("shift") + F.size("template"))
    cut = lambda c, start: F.slice(c, start + 1, last - first)
    there, here = first, first - F.col("shift")
    side = lambda tokens, plain, marks, start: F.arrays_zip(cut(tokens, start).alias("t"), cut(plain, start).alias("p"), cut(marks, start).alias("s"))
    meet = lambda d, i: F.struct(d["t"].alias("a"), i["t"].alias("b"), d["p"].alias("x"), i["p"].alias("y"), (d["s"] & i["s"]).alias("opens"))
    facing = F.zip_with(side("own", "own_plain", "own_starts", there), side("template", "plain", "starts", here), meet)
    pairs = pairs.select("doc_id", "item_id", F.size("template").alias("item_tokens"), F.transform(facing, lambda t, i: t.withField("i", i)).alias("facing"))
    long_enough = F.least(F.lit(RUN), F.col("item_tokens"))
    slot, named = lambda t: _is_slot(t["b"]), lambda t: _is_slot(t["b"]) | t["opens"]
    same = lambda t: (t["a"] == t["b"]) | (t["x"] == t["y"])
    words = lambda r, slot: F.size(F.filter(r, lambda t: ~slot(t)))
    fits = lambda here, slot: F.filter(_runs(F.col("facing"), here, long_enough), lambda r: (words(r, slot) >= TELLING) & _consistent(r, slot))
    alike = F.concat(fits(same, slot), F.when(F.exists("facing", lambda t: t["opens"] & (t["x"] != t["y"])), fits(lambda t: same(t) | t["opens"], named)).otherwise(F.array()))
    exact = F.filter(_runs(F.col("facing"), lambda t: t["x"] == t["y"], long_enough), lambda r: words(r, slot) > 0)
    changed = lambda r: F.size(F.filter(r, lambda t: named(t) & (t["x"] != t["y"])))
    judged = F.transform(F.concat(alike, exact), lambda r: F.struct(F.size(r).alias("run"), (-changed(r)).alias("kept")))
    matches = pairs.select("doc_id", "item_id", "item_tokens", F.array_max(judged).alias("own")).where(F.col("own").isNotNull())
    matches = matches.select("doc_id", "item_id", F.col("own.run").alias("run"), "item_tokens", (-F.col("own.kept")).alias("slots_changed"))
    best = F.max_by(F.struct("run", "item_tokens", "slots_changed"), F.struct("run", -F.col("slots_changed")))
    return matches.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
