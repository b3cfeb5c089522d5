"""What the operators of this folder share: tables, shared storage, bounded Arrow blocks, word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.storage import shared_folder as shared_folder
from orrery.storage import ship as ship
from orrery.storage import written as written

#: Words are runs of anything but these six characters (space, \t \n \v \f \r).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GAP_PATTERN = r"[\x20\x09-\x0D]+"
#: Text bytes that one call of a Python operator works on at a time.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches to Python: texts can be long, so by rows and by bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def blocks(batch: pa.RecordBatch, text: int = 1, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text column holds about `limit` bytes; a longer text stands alone."""
    start, held = 0, 0
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_blocks(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema, text: int = 1) -> DataFrame:
    """mapInArrow over bounded blocks. make() runs once a task and returns the function of a block."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in blocks(pa.RecordBatch.from_arrays(batch.columns, names=names), text):
                yield work(part)
        del work
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds little

    small_batches(df.sparkSession)
    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, schema)  # mapInArrow can't read names with dots


def quoted(names: list[str]) -> list[str]:
    """Column names as they are, dots and backticks included."""
    return ["`" + name.replace("`", "``") + "`" for name in names]


def held_out(doc_id: Column) -> Column:
    """The fold kept from training: crc32 of the id's decimal text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes.lower and bytes.split know just ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: The bitmap that split_by_ids() broadcasts has at most so many bits, in rows of 64.
BITMAP_BITS = 1 << 26


def split_by_ids(rows: DataFrame, id_col: str, ids: DataFrame, bits_an_id: int = 16) -> tuple[DataFrame, DataFrame]:
    """Rows whose id may be in `ids` (one column, read again from storage), and rows whose id is not.

    Long texts stay where they are: a hashed bitmap of bounded size is broadcast instead of the ids. The
    first part still needs an exact join; with more ids than the bitmap can tell apart it only grows.
    """
    n = ids.count()
    bits = 1 << 12
    while bits < min(BITMAP_BITS, bits_an_id * n):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    held = ids.select(place(ids.columns[0]).alias("__at"))
    held = held.groupBy(F.expr("__at div 64").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__at % 64 as int))")).alias("__mask"))
    marked = rows.withColumn("__at", place(id_col)).withColumn("__word", F.expr("__at div 64")).join(F.broadcast(held), "__word", "left")
    there = F.expr("coalesce(getbit(__mask, cast(__at % 64 as int)) = 1, false)")
    own = quoted(rows.columns)
    return marked.where(there).select(*own), marked.where(~there).select(*own)


def without_ids(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows whose id is not in `ids` (one column, read again from storage); null is an id like others."""
    maybe, clean = split_by_ids(rows, id_col, ids)
    gone = ids.select(F.col(ids.columns[0]).cast("long").alias("__gone")).distinct()
    return clean.unionByName(maybe.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("__gone")), "left_anti"))
