import random
import re

from orrery.llm import urlfilter


def slow(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.sub("[A-Z]", lambda m: m.group().lower(), re.match(r"[^/?#]*", rest).group())
    path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
    fits = [(len(r), r, v) for v, r in urlfilter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, default=(0, None, None))[1]


URLS = ["http://a.EXAMPLE.org/es/1", "x://example.org", "x://example.org?a/b", "x://org/en/1", "x://xexample.org/es/", "x://example.org/en/12#f", None, "foo", "a://b://c.com/fr/x", "x://É.com/de/", "x://c.com/FR/", "://com/fr/", "x:///path"]


def test_rules(spark):
    rows = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)] + [(0, URLS[0], "z"), (None, URLS[0], "z")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = urlfilter.filter_urls(rows, none).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert (r.host, r.path, r.rule) == slow(r.url), r
        assert r.verdict == next((v for v, x in urlfilter.RULES if x == r.rule), "allow")
    assert urlfilter.filter_urls(rows.limit(0), none).count() == 0


def test_mined_rules(spark):
    pages = [(f"http://a.x.de/spam/p?q={i}", True) for i in range(200)] + [(f"http://a.x.de/ham/p?q={i}", False) for i in range(400)] + [(f"http://b.x.de/spam/y?q={i}", i % 2 == 0) for i in range(200)]
    labelled = spark.createDataFrame([*pages, (None, True), ("http://a", None)], "url string, bad boolean")
    mined = [(r["items"], round(r.confidence, 3)) for r in urlfilter.mine(labelled).collect()]
    assert mined == [(["spam"], 0.75)]  # 300 of 400; wider rules are covered
    strict = sorted(r["items"] for r in urlfilter.mine(labelled, min_confidence=0.9, min_lift=0.8).collect())
    assert all("spam" in x for x in strict) and strict
    rows = spark.createDataFrame([(1, "http://z.de/spam/x"), (2, "http://z.de/x"), (3, "http://q.org/spam")], "page_id long, url string")
    assert [r.verdict for r in urlfilter.filter_urls(rows, labelled).orderBy("page_id").collect()] == ["block", "allow", "allow"]


def test_tokens_that_tell_only_together(spark):
    pages = [(f"http://a.x.de/spam/p?q={i}", True) for i in range(200)] + [(f"http://a.x.de/ham/p?q={i}", False) for i in range(400)] + [(f"http://b.x.de/spam/y?q={i}", i % 2 == 0) for i in range(200)]
    labelled = spark.createDataFrame(pages, "url string, bad boolean")
    assert sorted(r["items"] for r in urlfilter.mine(labelled, min_confidence=0.9).collect()) == [["a", "spam"], ["p", "spam"]]
    assert urlfilter.mine(labelled, min_confidence=0.3, min_lift=2.7).count() == 0 < urlfilter.mine(labelled, min_confidence=0.3, min_lift=2.6).count()  # 1.0 over 0.375 is 2.67


def all_rules(pages, least, confidence, lift):
    """Every token combination that passes and holds no other one that does."""
    from itertools import combinations

    rows = [({w for w in re.split(r"[\W_]+", u.lower()) if w}, bad) for u, bad in pages]
    base = sum(bad for _, bad in rows) / len(rows)
    names, found = sorted(set().union(*[t for t, _ in rows])), {}
    for size in range(1, 6):
        for combo in combinations(names, size):
            own = [bad for t, bad in rows if t.issuperset(combo)]
            if sum(own) >= least and sum(own) / len(own) >= confidence and sum(own) / len(own) >= lift * base and not any(set(f) <= set(combo) for f in found):
                found[combo] = round(sum(own) / len(own), 9)
    return found


def test_rules_equal_all_combinations(spark):
    rng = random.Random(4)
    pages = []
    for _ in range(300):
        own = [w for w in "abcdefg" if rng.random() < 0.45]
        pages.append(("x://" + "/".join(own), rng.random() < (0.95 if {"a", "c"} <= set(own) else 0.9 if {"b", "d", "f"} <= set(own) else 0.2)))
    labelled = spark.createDataFrame(pages, "url string, bad boolean")
    for least, confidence, lift in ((20, 0.75, 1.05), (8, 0.85, 1.05), (12, 0.5, 2.0)):
        mined = urlfilter.mine(labelled, min_confidence=confidence, min_count=least, min_lift=lift).collect()
        assert {tuple(r["items"]): round(r.confidence, 9) for r in mined} == all_rules(pages, least, confidence, lift) != {}
        assert all(r.rarest in r["items"] for r in mined)


def test_support_is_a_count(spark):
    """25 of 39 rows are 25, though 25 / 39 * 39 is a little more."""
    labelled = spark.createDataFrame([("x://spam", True)] * 25 + [("x://ham", False)] * 14, "url string, bad boolean")
    assert [r["items"] for r in urlfilter.mine(labelled, min_count=25).collect()] == [["spam"]]
    assert urlfilter.mine(labelled, min_count=26).count() == 0


def test_query_over_a_table(spark):
    sf = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = urlfilter.op5_url_filter(spark, sf).collect()
    assert len(got) == len(urls) and all((r.host, r.path, r.rule) == slow(urls[r.page_id]) for r in got)
