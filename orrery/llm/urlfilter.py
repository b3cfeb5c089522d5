"""URL filters: host and path rules first, then association rules mined from labelled pages.

Tokens of a URL are its alphanumeric runs, lower-cased. FP-growth over the labelled pages finds token
combinations that come with the label `bad`; rules below the confidence, support or lift go, as do rules that a
shorter one covers. Rules lie in an inverted index under their rarest token: a URL meets just the rules
of tokens that it has, and then the rest of a rule is checked. Every token with the support enters
the transactions, whatever it tells alone: it may tell together with others.

All of it is DataFrame functions and spark.ml. Defined cases: a URL that is null or has no `://` has an empty
host and path, fits no rule and has no tokens of a rule, so it is allowed; repeated rows are judged each; with no
labels, or none that pass, there are no mined rules. The longest of several fitting rules counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import shared_folder, table, written

#: verdict and "host/path-prefix" of the rules that the query uses.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest fitting rule as a struct (size, rule, verdict), else null."""
    fits = []
    for verdict, rule in rules:
        own, slash, prefix = rule.partition("/")
        here = (host == own) | F.endswith(host, F.lit(f".{own}"))
        fits.append(F.when(here & F.startswith(path, F.lit(slash + prefix)), F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(url, UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.75, min_count: int = 20, min_lift: float = 1.05, folder: str | None = None) -> DataFrame:
    """Rules from rows (url, bad boolean): items, confidence, rarest token."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    folder = folder or shared_folder(spark)
    rows = written(labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull()).select(tokens(F.col("url")).alias("tokens"), "bad"), folder)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).first()
    n, bad = total["n"], total["bad"] or 0
    empty = spark.createDataFrame([], "items array<string>, confidence double, rarest string")
    if not n or not bad:
        return empty
    least = math.ceil(max(min_count, min_support * n))
    seen = rows.select(F.explode("tokens").alias("token"), "bad").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    telling = written(seen.where(F.col("bad") >= least).select("token", "n"), folder)  # at most tokens of a URL / min_support
    marked = rows.withColumn("id", F.monotonically_increasing_id())
    marked = marked.select("id", "bad", F.explode("tokens").alias("token")).join(telling.select("token"), "token", "left_semi")
    baskets = marked.groupBy("id").agg(F.collect_list("token").alias("t"), F.max("bad").alias("bad"))  # as wide as one URL
    baskets = written(baskets.select(F.when(F.col("bad"), F.concat("t", F.array(F.lit(BAD)))).otherwise(F.col("t")).alias("items")), folder)
    if baskets.isEmpty():
        return empty
    share = (least - 0.5) / baskets.count()  # half a row less: it is turned back into a count by rounding up
    found = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(baskets).associationRules
    found = found.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.col("confidence") >= min_lift * bad / n)).select(F.array_sort("antecedent").alias("items"), "confidence")
    found = written(found, folder)
    by_token = F.struct("n", "token")
    rarest = found.select("items", "confidence", F.explode("items").alias("token")).join(telling, "token").groupBy("items", "confidence").agg(F.min(by_token)["token"].alias("rarest"))
    rules = written(rarest, folder)
    wider = rules.select(F.col("items").alias("wide"), F.explode("items").alias("rarest")).join(rules, "rarest")
    covered = wider.where((F.size("wide") > F.size("items")) & (F.size(F.array_except("items", "wide")) == 0)).select(F.col("wide").alias("items")).distinct()
    return written(rules.join(covered, "items", "left_anti"), folder)


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", **mining) -> DataFrame:
    """page_id, url, host, path, rule, verdict of every row."""
    folder = shared_folder(pages.sparkSession)
    mined = mine(labelled, folder=folder, **mining)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path).withColumn("own", longest_rule(F.col("host"), F.col("path"), rules))
    urls = rows.where(F.col("own").isNull() & F.col("url").isNotNull()).select("url").distinct().withColumn("tokens", tokens(F.col("url")))
    met = urls.select("url", "tokens", F.explode("tokens").alias("rarest")).join(mined.select("items", "rarest"), "rarest")
    bad = written(met.where(F.size(F.array_except("items", "tokens")) == 0).select("url").distinct(), folder).withColumn("mined", F.lit(True))
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("mined"), "block"), F.lit("allow"))
    return rows.join(bad, "url", "left").select("page_id", "url", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page's labels are those of the document that its path names: /language/number."""
    number = F.regexp_extract(F.col("url"), r"://[^/?#]*/[a-z]+/([0-9]{1,18})", 1)
    own = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")).where("bad is not null")
    return pages.select("url", F.when(number != "", number).cast("long").alias("doc_id")).join(own, "doc_id").select("url", (F.col("bad") == 1).alias("bad"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = filter_urls(pages, labelled_pages(pages, table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")

