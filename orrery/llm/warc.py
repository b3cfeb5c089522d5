"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

write_warc() lays down one archive a partition. Of records with equal payloads of at least `min_bytes`
bytes, that of the largest page id is a response and the others revisit it. read_warc() loads the
dictionary from the leading frame, decodes frame by frame and checks version, headers, lengths, digests.

Defined cases: a null payload is an empty one; a null url has a placeholder URI; a url that is no URI (spaces, letters beyond ASCII) comes back as it was; records with a null
page id revisit if another page has their payload; repeated rows of the largest page id are all
responses; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import blocks, shared_folder, small_batches, table, written
from orrery.llm.files import create, opened, target

#: Fixed values of the formats.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URI = "urn:no-uri"
DATE = "2024-01-01T00:00:00Z"
#: A partition's dictionary is trained on at most so many of its first records.
SAMPLE_RECORDS, DICTIONARY_BYTES = 200, 16 << 10
SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, a revisit if refers_to is given."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", NO_URI if url is None else quote(url, safe="".join(map(chr, range(0x21, 0x7F))).replace("%", "") + "%")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if url is not None and fields[3][1] != url or url == NO_URI:
        fields.append(("X-Original-URL", quote(url, safe="")))  # reversible, as the URI isn't
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _page(uri: str) -> int | None:
    text = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def parse(data: bytes) -> dict:
    """Checks and reads one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a {VERSION.decode()} record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"header without a colon: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest", "x-payload-length"):
        if name not in fields:
            raise ValueError(f"record without {name}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {length}, the record has {len(rest)} bytes after its header")
    block = rest[:length]
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"{fields['warc-record-id']}: block digest differs")
    kind, stated, size = fields["warc-type"], fields["warc-payload-digest"], int(fields["x-payload-length"])
    payload = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or stated != f"sha1:{digest(payload)}":
            raise ValueError(f"{fields['warc-record-id']}: payload length or digest differs")
    elif kind != "revisit" or "warc-refers-to" not in fields:
        raise ValueError(f"{fields['warc-record-id']}: type {kind} is not read here, or refers to nothing")
    uri = fields.get("warc-target-uri", NO_URI)
    url = unquote(fields["x-original-url"], errors="strict") if "x-original-url" in fields else None if uri == NO_URI else uri
    return {
        "page_id": _page(fields["warc-record-id"]), "url": url, "payload": payload, "payload_bytes": size,
        "payload_digest": stated.removeprefix("sha1:"), "record_type": kind, "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None,
    }


def dictionary(samples: list[bytes]) -> bytes:
    """Trained on the samples, or their first bytes where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[: DICTIONARY_BYTES // 4] or VERSION


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 3) -> DataFrame:
    """Writes the archives; returns their manifest: path, records."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    target_of = (
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "target")
    )  # a hot payload: one row here, and its pages are split between tasks by the skew join
    rows = rows.join(target_of, "sha", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("target")), F.col("target")).alias("refers_to"))

    def run(batches):
        import zstandard

        path, out, pack, n, first = target(folder, ".warc.zst"), None, None, 0, []

        def start():
            nonlocal out, pack
            held = dictionary(first)
            out = create(path)
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held)
            pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(held), write_checksum=True)
            for x in first:
                out.write(pack.compress(x))
            first.clear()

        for batch in batches:
            for part in blocks(batch, 2):
                for row in part.to_pylist():
                    data = record(row["page_id"], row["url"], row["payload"], row["refers_to"])
                    n += 1
                    if pack:
                        out.write(pack.compress(data))
                        continue
                    first.append(data)
                    if len(first) >= SAMPLE_RECORDS or sum(map(len, first)) > 8 << 20:
                        start()
        if first:
            start()
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    small_batches(spark)
    return written(rows.mapInArrow(run, "path string, records long"), folder)


def frames(path: str, step: int = 1 << 16) -> Iterator[bytes]:
    """The decoded frames of one archive, one at a time."""
    import zstandard

    with opened(path) as file:
        head = file.read(8)
        magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
        if magic == DICTIONARY_MAGIC:
            held = file.read(size)
            if len(held) != size:
                raise ValueError(f"{path}: dictionary frame of {size} bytes ends after {len(held)}")
            if held[:4] == struct.pack("<I", FRAME_MAGIC):
                held = zstandard.ZstdDecompressor().decompress(held)
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            data = b""
        else:
            unpack, data = zstandard.ZstdDecompressor(), head
        while data or (data := file.read(step)):
            one, parts = unpack.decompressobj(), []
            while True:
                parts.append(one.decompress(data))
                if one.eof:
                    data = one.unused_data
                    break
                if not (data := file.read(step)):
                    raise ValueError(f"{path}: its last frame is cut off")
            yield b"".join(parts)


def read_warc(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of all archives of a manifest; payload: whether responses carry their payload."""
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for batch in batches:
            for path, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                rows, held, seen = [], 0, 0
                for data in frames(path):
                    row = parse(data)
                    if not payload:
                        row["payload"] = None
                    rows.append(row)
                    seen += 1
                    held += len(row["payload"] or b"") + 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, held = [], 0
                if seen != n:
                    raise ValueError(f"{path}: {seen} records; the manifest has {n}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    spread = manifest.select("path", "records").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4))
    return spread.mapInArrow(run, SCHEMA)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(table(spark, sf_dir, "pages")), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
