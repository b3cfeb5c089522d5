import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from orrery.llm import warc
from orrery.llm.files import create


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (5, "http://b/ x", "<p>é</p>"), (3, "u", None), (4, "v", ""), (6, "w", "z" * 300_000), (7, "x", "only"), (None, "y", "only")]
    return spark.createDataFrame(rows + [(7, "x", "only")], "page_id long, url string, html string").withColumn("payload", F.lit(1))


def test_round_trip(pages):
    source = [(r.page_id, r.html or "") for r in pages.collect()]
    got = warc.read_warc(warc.write_warc(pages.repartition(3))).collect()
    assert len(got) == len(source)
    largest = {}
    for i, h in source:
        largest[h] = max(largest.get(h, -1), -1 if i is None else i)
    for r in got:
        html = next(h for i, h in source if i == r.page_id)
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        first = largest[html] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", largest[html]))
        assert r.payload == (html.encode() if first else None)


def test_least_bytes_and_empty_table(pages):
    got = warc.read_warc(warc.write_warc(pages, min_bytes=5)).where("record_type = 'revisit'").collect()
    assert {r.page_id for r in got} == {1, 2}
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_broken_archives(tmp_path):
    import zstandard

    good = warc.record(1, "u", b"abc", None)
    assert warc.parse(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"abc", b"abd"), good.replace(b"X-Payload-Length: 3", b"X-Payload-Length: 4"), good.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    path = f"file://{tmp_path}/x.warc.zst"
    with create(path) as out:
        out.write(zstandard.compress(good)[:-3])
    with pytest.raises(ValueError, match="cut off"):
        list(warc.frames(path))
    with create(path) as out:
        out.write(zstandard.compress(good) * 2)  # no dictionary frame
    assert len(list(warc.frames(path))) == 2


def test_urls_come_back_as_written():
    for url in ("http://b/ x", "http://b/%20x", " http://b ", "http://é.de/ü?ö#ä", "", warc.NO_URI, "a\r\nb: c", "http://x/%E9%", None, "http://a/b?c=d"):
        assert warc.parse(warc.record(1, url, b"x", None))["url"] == url
        assert warc.parse(warc.record(1, url, b"x", 2))["url"] == url
