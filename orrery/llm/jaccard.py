"""n-gram Jaccard join by parity sketches.

A text's set is that of its distinct word shingles. Sets link when 100 * intersection >= percent * union,
that is when their symmetric difference is at most (100 - percent) * (a + b) / (100 + percent).
Each shingle flips one bit of a sketch, so the Hamming distance of two sketches never exceeds the symmetric
difference. Sizes fall into bands of ratio 100 / percent; linked sets are in one band or in neighbouring ones. For
a band with difference D at most, the sketch has D + 1 + z blocks, of which linked sets share z + 1 or more.
Blocks are kept as the XOR of their bits' hashes. Every set drops the z blocks with the fewest telling
shingles (a rule of the block's content alone): linked sets still share one of the D + 1 that stay. Equal
blocks within a band are the candidates.

Exact copies are one class from the start. Candidates join in coarse components by stars, not pairs; the
sets of a coarse component meet in blocks of bounded size, where the
sketches' Hamming distance, then the sets themselves decide. A component of several blocks has them stored once, as packed
hashes; tasks of pairs of blocks read them from there, so that no text is moved or kept twice. What leaves a task is a
forest of its links and each set's number of links, not the links; without numbers, links that are implied already,
within a block or by its own links with the other, are skipped: a dense component is a few comparisons a pair of blocks.

Shingles are 64-bit hashes: sets are equal, and links exact, but for collisions of these.

Defined cases: a null, empty or wordless text has 0 shingles and links with nothing; with fewer words than a
shingle the whole sequence is one; repeated rows are copies; rows without a doc_id get their copies'
component, else null.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import map_blocks, shared_folder, split_by_ids, table, without_ids, written
from orrery.llm.files import create, opened, target
from orrery.llm.graph import components, forest

CACHE_WORDS = 100_000
#: Candidate sets meet in tasks of at most about so many shingles, or so many sets.
GROUP_SHINGLES, GROUP_SETS = 1_000_000, 500
#: A partition of signatures holds about so many bytes.
PART_BYTES = 12 << 20
#: Shingles in more than this share of the texts are not telling; it steers the search and changes no result.
COMMON_SHARE, COMMON_MOST = 0.002, 200_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[4]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        out = mix(out + h[k : k + n] * _ODD[k % 8])
    return np.unique(out)


def class_key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


@functools.cache
def bands(percent: int, most: int = 1 << 31) -> np.ndarray:
    """Lower edges: a set of band k has partners of at least its size in bands k and k + 1 only."""
    edges = [1, 2]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * 100 // percent + 1))
    return np.array(edges, np.int64)


def difference(percent: int, band: int) -> int:
    """The largest symmetric difference of linked sets whose smaller one is in the band."""
    high = int(bands(percent)[band + 1]) - 1
    return (100 - percent) * (high + high * 100 // percent) // (100 + percent)


def signatures(own: np.ndarray, common: np.ndarray, percent: int, band: int) -> np.ndarray:
    """Keys of the D + 1 most telling sketch blocks of a set in a band."""
    d = difference(percent, band)
    if d == 0:
        return np.zeros(0, np.uint64)  # only equal sets link
    count = d + 1 + (d + 4) // 4
    block = (mix(own ^ _ODD[5]) % np.uint64(count)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    there, first = np.unique(block[order], return_index=True)
    bits = mix(own * _ODD[1])[order]  # a bit's place in a block of 2**64 bits, hashed
    prints = np.zeros(count, np.uint64)
    prints[there] = np.bitwise_xor.reduceat(bits, first)
    telling = np.bincount(block, ~np.isin(own, common, assume_unique=True) if len(common) else None, count)
    keep = np.lexsort((np.arange(count), telling))[count - d - 1 :]
    return mix(prints[keep] + mix(keep.astype(np.uint64) + np.uint64(band << 32)))


def node_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def describe(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, n, node, key; and per block of texts its frequent shingles (common, seen)."""
    schema = "doc_id long, n long, node long, key binary, common long, seen long"

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(x, size) for x in batch.column(1).to_pylist()]
            keys = [class_key(s) if len(s) else None for s in sets]
            each, seen = np.unique(np.concatenate([np.zeros(0, np.uint64), *dict(zip(keys, sets, strict=True)).values()]), return_counts=True)
            often = seen >= max(3, len(sets) * COMMON_SHARE)
            each, seen = each[often].view(np.int64), seen[often]
            k, n = len(each), len(sets)
            column = lambda values, kind, first: pa.array([*values, *[None] * k] if first else [*[None] * n, *values], kind)
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(0), pa.nulls(k, pa.int64())]), column(map(len, sets), pa.int64(), True), column([x and node_of(x) for x in keys], pa.int64(), True),
                    column(keys, pa.binary(), True), column(each.tolist(), pa.int64(), False), column(seen.tolist(), pa.int64(), False),
                ],
                names=[x.split()[0] for x in schema.split(", ")],
            )

        return work

    return map_blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, schema)


def _packed(part: int, a: np.ndarray, b: np.ndarray, edge: bool) -> tuple:
    return part, edge, a.tobytes(), b.tobytes()


def candidates(docs: DataFrame, common: np.ndarray, size: int, percent: int, parts: int, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) between nodes whose sets share a block; they connect what may be linked, by stars."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most COMMON_MOST hashes

    def stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of one entry a key, and edges from it to the key's other nodes."""
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
        head = order[new][np.cumsum(new) - 1]
        a, b = nodes[head], nodes[order]
        differ = a != b
        return order[new], a[differ], b[differ]

    def make():
        edges = bands(percent)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen, keys, nodes = set(), [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text, size)
                key = class_key(own)
                if not len(own) or key in seen:
                    continue
                seen.add(key)
                band = int(np.searchsorted(edges, len(own), "right")) - 1
                found = [signatures(own, shared.value, percent, k) for k in (band, band - 1) if k >= 0]
                keys += found
                nodes.append(np.full(sum(map(len, found)), node_of(key), np.int64))
            keys, nodes = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *nodes])
            one, a, b = stars(keys, nodes)
            keys, nodes = keys[one], nodes[one]
            part = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [_packed(p, (keys[o] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], nodes[o], False) for p in range(parts) if len(o := order[cuts[p] : cuts[p + 1]])]
            if len(a):
                a, b = forest(a, b)
                rows.append(_packed(int(a[0] % parts), a, b, True))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["part", "edge", "a", "b"])

        return work

    def join(batches):
        keys, nodes, a, b = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for part, edge, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                y = np.frombuffer(y, np.int64)
                if edge:
                    a.append(np.frombuffer(x, np.int64))
                    b.append(y)
                else:
                    wide = np.zeros((len(y), 8), np.uint8)
                    wide[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
                    keys.append(wide.view("<u8").reshape(-1) | np.uint64(part % 65536 << 48))
                    nodes.append(y)
        if keys:
            _, x, y = stars(np.concatenate(keys), np.concatenate(nodes))
            a.append(x)
            b.append(y)
        a, b = forest(np.concatenate(a), np.concatenate(b))
        for k in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000]), pa.array(b[k : k + 100_000])], names=["a", "b"])

    packed = map_blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "part int, edge boolean, a binary, b binary")
    return packed.repartition(parts, "part").mapInArrow(join, "a long, b long")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: both sorted and distinct."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def sketches(sets: list[np.ndarray], width: int) -> np.ndarray:
    """Parity sketches of `width` bits."""
    out = np.zeros((len(sets), width // 8), np.uint8)
    for row, own in zip(out, sets, strict=True):
        bits = np.bincount((mix(own * _ODD[6]) % np.uint64(width)).astype(np.int64), minlength=width) & 1
        row[:] = np.packbits(bits.astype(bool))
    return out.view(np.uint64)


def resolve(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, copies: np.ndarray | None = None, group: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """A forest of the links between positions `left` and `right` (equal arrays: within them), and the groups that it makes.

    group: a label of each set, equal where sets are known to be connected. With `copies` of each set also how many
    texts each is linked with; then no link is skipped as implied.
    """
    group = np.arange(len(ids)) if group is None else np.unique(group, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets], np.int64)
    width = 1024
    while width < 8 * int(sizes.max()) and width < 1 << 16:
        width *= 2
    flat = None
    if len(ids) > 2 and (copies is not None or len(np.unique(group)) > 1):
        flat = sketches(sets, width)
    out = []
    links = np.zeros(len(ids), np.int64)
    inner = left is right
    for k, i in enumerate(left.tolist()):
        others = right[k + 1 :] if inner else right
        if copies is None:
            others = others[group[others] != group[i]]
        ok = 100 * np.minimum(sizes[i], sizes[others]) >= percent * np.maximum(sizes[i], sizes[others])
        others = others[ok]
        if flat is not None and len(others):
            n = sizes[i] + sizes[others]
            others = others[np.bitwise_count(flat[others] ^ flat[i]).sum(1, dtype=np.int64) <= (100 - percent) * n // (100 + percent)]
        for j in others.tolist():
            new = group[i] != group[j]
            if (new or copies is not None) and linked(sets[i], sets[j], percent):
                if copies is not None:
                    links[i] += copies[j]
                    links[j] += copies[i]
                if new:
                    group[group == group[j]] = group[i]
                    out.append((int(ids[i]), int(ids[j])))
    return out, links, group


def _rows_of(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in FOUND.split(", ")])


#: Links (a, b), numbers of links (a, n), and stored blocks (comp, block, path, at, sets, hashes).
FOUND = "a long, b long, n long, comp long, block int, path string, at long, sets long, hashes long"


def verify(members: DataFrame, percent: int, size: int, count: bool, folder: str) -> DataFrame:
    """members: comp, block, blocks, doc_id, copies, text. Links between classes, by their smallest doc_id: a, b;
    with count also rows of a and n, the number of texts that a is linked with in one task."""

    def edges(own, sets, left, right, copies, group) -> tuple[list[tuple], np.ndarray]:
        links, n, group = resolve(own, sets, left, right, percent, copies if count else None, group)
        none = (None,) * 6
        return [*((a, b, None, *none) for a, b in links), *((int(own[k]), None, int(n[k]), *none) for k in np.flatnonzero(n))], group

    def inside(batches):
        item, ids, sets, copies, out, path, file = None, [], [], [], [], None, None

        def close():
            nonlocal path, file
            if ids and (len(ids) > 1 or item[2] > 1):
                own, n, every = np.array(ids, np.int64), np.array(copies, np.int64), np.arange(len(ids))
                found, group = edges(own, sets, every, every, n, None)
                out.extend(found)
                if item[2] > 1:
                    if file is None:
                        path = target(folder, ".sets")
                        file = create(path)
                    at = file.tell()
                    for x in (own, n, group, np.array([len(s) for s in sets], np.int64), np.concatenate(sets)):
                        file.write(x.astype(x.dtype.newbyteorder("<")).tobytes())
                    out.append((None, None, None, item[0], item[1], path, at, len(ids), sum(map(len, sets))))
            for x in (ids, sets, copies):
                x.clear()

        for batch in batches:
            for comp, block, blocks, doc_id, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (comp, block, blocks) != item:
                    close()
                    item = comp, block, blocks
                if ids and ids[-1] == doc_id:
                    continue  # a repeated row
                ids.append(doc_id)
                copies.append(n)
                sets.append(shingles(text, size))
            if len(out) > 10_000:
                yield _rows_of(out)
                out.clear()
        close()
        if file is not None:
            file.close()
        yield _rows_of(out)

    def stored(path, at, n, hashes):
        with opened(path) as file:
            file.seek(at)
            data = file.read(8 * (4 * n + hashes))
        ids, copies, group, sizes = np.frombuffer(data, "<i8", 4 * n).reshape(4, n)
        return ids, copies, group, np.split(np.frombuffer(data, "<u8", hashes, 32 * n), np.cumsum(sizes)[:-1])

    def across(batches):
        held = None, None
        for batch in batches:
            out = []
            for path, at, n, hashes, *other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held[0] != (path, at):
                    held = (path, at), stored(path, at, n, hashes)
                a, b = held[1], stored(*other)
                own, copies = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
                group = np.concatenate([a[2], b[2] + len(own)])  # a block's labels are below its number of sets
                out += edges(own, [*a[3], *b[3]], np.arange(n), np.arange(n, len(own)), copies, group)[0]
            yield _rows_of(out)

    dealt = members.select("comp", "block", "blocks", "doc_id", "copies", "text").repartition("comp", "block").sortWithinPartitions("comp", "block", "doc_id")
    found = written(dealt.mapInArrow(inside, FOUND), folder)
    blocks = written(found.where("path is not null").select("comp", "block", "path", "at", "sets", "hashes"), folder)
    if blocks.isEmpty():
        return found.select("a", "b", "n")
    last = blocks.groupBy("comp").agg(F.max("block").alias("last"))
    second = blocks.select("comp", F.col("block").alias("with"), *[F.col(c).alias(f"{c}2") for c in ("path", "at", "sets", "hashes")])
    pairs = blocks.join(last, "comp").where("block < last").withColumn("with", F.explode(F.sequence(F.col("block") + 1, F.col("last")))).join(second, ["comp", "with"])
    pairs = pairs.repartition(max(1, min(10_000, pairs.count()))).sortWithinPartitions("path", "at").select("path", "at", "sets", "hashes", "path2", "at2", "sets2", "hashes2")
    return found.where("path is null").select("a", "b", "n").unionByName(pairs.mapInArrow(across, FOUND).select("a", "b", "n"))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", count: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row; with count also
    n_links, the number of other rows with an id that it is linked with, null for a row without an id."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    rows = written(describe(docs, size, id_col, text_col), folder)
    texts = rows.where(F.col("n").isNotNull())
    total = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("shingles")).first()
    often = rows.where(F.col("common").isNotNull()).groupBy("common").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= max(3, COMMON_SHARE * (total["n"] or 0)))
    common = np.array([r["common"] for r in often.orderBy(F.desc("seen"), "common").limit(COMMON_MOST).select("common").collect()], np.int64).view(np.uint64)
    per_set = 2.3 * (100 - percent) / (100 + percent) * 2
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(14 * per_set * (total["shingles"] or 0) / PART_BYTES) + 1)
    classes = texts.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("key", "node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    coarse = components(candidates(docs, np.sort(common), size, percent, parts, id_col, text_col))
    coarse = written(coarse, folder)
    coarse = coarse.unionByName(coarse.select(F.col("root").alias("node"), "root").distinct())
    members = written(classes.join(coarse, "node").select(F.col("root").alias("comp"), "rep", "n", "copies"), folder)
    sizes = members.groupBy("comp").agg(F.greatest(F.ceil(F.sum("n") / GROUP_SHINGLES), F.ceil(F.count(F.lit(1)) / GROUP_SETS)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    placed = members.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    source = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    source, _ = split_by_ids(source, "rep", placed.select("rep"))
    members = placed.select("comp", "block", "blocks", "rep", "copies").join(source, "rep").withColumnRenamed("rep", "doc_id")
    found = written(verify(members, percent, size, count, folder).where("a is not null"), folder)
    roots = components(found.where("b is not null").select("a", "b"))
    merged = classes.join(roots, classes["rep"] == roots["node"], "left").select("key", "rep", "copies", F.coalesce("root", "rep").alias("component_id"))
    if not count:
        return texts.join(merged, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    links = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    merged = merged.join(links, "rep", "left").select("key", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0)))
    return texts.join(merged, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), n_links.alias("n_links"))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, that of its smallest id. Rows without an id stay.

    Rows that share an id are one document: it stays if one of its texts leads a component, each text once.
    """
    folder = shared_folder(docs.sparkSession)
    found = written(jaccard_components(docs, size, percent, id_col, text_col), folder).where(F.col("doc_id").isNotNull())
    by_id = found.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("leads"), F.count(F.lit(1)).alias("n"))
    by_id = written(by_id.where("leads = 0 or n > 1"), folder)
    kept = without_ids(docs, id_col, written(by_id.where("leads = 0").select("doc_id"), folder))
    again = written(by_id.where("leads = 1").select("doc_id"), folder)
    if again.isEmpty():
        return kept
    maybe, once = split_by_ids(kept, id_col, again)
    return once.unionByName(maybe.where(F.col(id_col).isNull())).unionByName(maybe.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]))


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90, count=True)
