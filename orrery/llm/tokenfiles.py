"""Token ids as flat unsigned integer files plus 64-bit document offsets.

write() deals texts over range partitions of the document id; each partition encodes its texts in order and writes an `.ids`
file (little-endian unsigned 16-bit integers where the vocabulary fits, else 32-bit), a `.docs` file (n document ids, 64-bit)
and an `.off` file (n + 1 offsets in ids, 64-bit), all as streams. A manifest of one row a partition is committed by
Spark; the ids before a partition are the prefix sum of the manifest's counts. read() maps the files into memory. Texts are
moved, not ids: compressed, they take about as much, and ids would have to be stored before their ranges are known.

Defined cases: a null or empty text gives only the end id; a long text is encoded as a whole, by itself; a null doc_id sorts
first; repeated rows are written each, rows that share an id by the crc32 of their texts, and a range may end within them,
however many they are; other columns, whatever their names, are not read; an empty table gives no files and no rows.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.bpe import Pieces, encode_block, packed
from orrery.llm.common import blocks, shared_folder, small_batches, table, written
from orrery.llm.files import create, mapped, target

MANIFEST = "part long, ids_path string, docs_path string, off_path string, width int, n_docs long, n_tokens long"
#: Stands for a null document id in a `.docs` file.
NO_ID = np.iinfo(np.int64).min


def _byte_characters() -> dict[int, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}


BYTE_CHARACTERS = _byte_characters()


class Library:
    """Ids by the tokenizers library. Pieces are encoded by it once and cached; a text that holds one of
    the vocabulary's added tokens goes to it whole, as these are found before any split."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        if type(self.model.pre_tokenizer).__name__ != "ByteLevel" or self.model.normalizer is not None:
            raise ValueError(f"{path}: not a byte-level vocabulary")
        self.added = [x.content for x in self.model.get_added_tokens_decoder().values()]
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.pieces = Pieces(self._solve, f"<u{self.width}")

    def _solve(self, pieces: list[bytes]) -> list[bytes]:
        """The model sees a piece as its byte-level pre-tokeniser would hand it over: one character a byte."""
        tokenize = self.model.model.tokenize
        joined = b"".join(pieces).decode("latin-1").translate(BYTE_CHARACTERS)
        ends = itertools.accumulate(map(len, pieces), initial=0)
        return packed([[t.id for t in tokenize(joined[a:b])] for a, b in itertools.pairwise(ends)], self.pieces.kind)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        odd = {i for i, x in enumerate(texts) if x and any(a in x for a in self.added)}
        ids, ends = encode_block([None if i in odd else x for i, x in enumerate(texts)] if odd else texts, self.pieces)
        if not odd:
            return ids, ends
        lists = [ids[a:b] for a, b in itertools.pairwise(ends.tolist())]
        for i in odd:
            lists[i] = np.array(self.model.encode(texts[i], add_special_tokens=False).ids, self.pieces.kind)
        return np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])


@functools.cache
def library(path: str) -> Library:
    return Library(path)


def write(docs: DataFrame, vocabulary: str, end_id: int = 0, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns the manifest with each partition's base, the ids before it."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)

    def run(batches):
        model = library(vocabulary)
        paths = [target(folder, suffix) for suffix in (".ids", ".docs", ".off")]
        n, at, out = 0, 0, []
        for batch in batches:
            for part in blocks(batch):
                if not out:
                    out = [create(path) for path in paths]
                    out[2].write(np.zeros(1, "<i8").tobytes())
                ids, ends = model.encode(part.column(1).to_pylist())
                out[0].write(np.insert(ids, ends[1:], end_id).tobytes())  # an end id after each text
                out[1].write(part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                ends = at + ends[1:] + np.arange(1, len(ends))
                out[2].write(ends.astype("<i8").tobytes())
                n, at = n + part.num_rows, int(ends[-1])
        for file in out:
            file.close()
        if out:
            row = [TaskContext.get().partitionId(), *paths, model.width, n, at]
            kinds = [pa.int64(), *[pa.string()] * 3, pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    manifest = written(dealt.mapInArrow(run, MANIFEST), folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32 (of unsigned 32-bit ids)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, doc_ids, offsets = (mapped(row[f"{name}_path"], kind) for name, kind in (("ids", f"<u{row['width']}"), ("docs", "<i8"), ("off", "<i8")))
                n = row["n_docs"]
                if len(doc_ids) != n or len(offsets) != n + 1 or offsets[-1] != len(ids) or row["n_tokens"] != len(ids):
                    raise ValueError(f"{row['ids_path']}: {len(ids)} ids, {len(doc_ids)} documents, {len(offsets)} offsets; the manifest has {row['n_tokens']}, {n}, {n + 1}")
                for a in range(0, n, 10_000):
                    b = min(n, a + 10_000)
                    crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in itertools.pairwise(offsets[a : b + 1].tolist())]
                    own = doc_ids[a:b]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(row["base"] + offsets[a:b]), pa.array(np.diff(offsets[a : b + 1])), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read(write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
