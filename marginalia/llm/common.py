"""Column helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a Python worker handles at once; a batch from Spark is cut into slices of so many.
SLICE_ROWS = 512
#: Fixed: the white space of the contracts.
SPACE = r"[\x20\x09-\x0D]+"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % F.lit(modulus)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy() -> None:
    """Gives freed memory back to the system: Python workers stay for later tasks, beside an executor's
    heap that does not shrink."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    """mapInArrow; f takes an iterator of record batches. Memory is given back after each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        tidy()

    return df.mapInArrow(run, schema)


#: Bits of a filter's bitmap; all its pages are 8 MB.
FILTER_BITS = 1 << 26
#: Fixed: bits in one of Spark's bitmaps.
PAGE_BITS = 32768
#: A group with at least this share of the rows (and LEAST_HOT rows) is hot; so there are at most
#: MOST_HOT hot groups, which bounds their broadcast.
MOST_HOT, LEAST_HOT = 4096, 64


def filter_bit(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))


def with_filter(rows: DataFrame, keys: DataFrame, columns: list[str], name: str = "_maybe") -> DataFrame:
    """rows with a boolean column: false where no row of keys has the same values in columns. A
    bitmap of hashes is broadcast, bounded whatever the input; true may be wrong."""
    bit = filter_bit(columns)
    pages = (
        keys.select((bit / PAGE_BITS).cast("int").alias("_page"), (bit % PAGE_BITS).alias("_at"))
        .groupBy("_page")
        .agg(F.bitmap_construct_agg("_at").alias("_bits"))
    )
    rows = rows.withColumn("_bit", bit).withColumn("_page", (F.col("_bit") / PAGE_BITS).cast("int"))
    rows = rows.join(F.broadcast(pages), "_page", "left")
    at = F.col("_bit") % PAGE_BITS
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    return rows.withColumn(name, hit).drop("_bit", "_page", "_bits")


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with groups (one row for each value of on, with its number of rows in size). The
    few groups that hold a large share of total rows are broadcast, the others shuffled, so no large
    group meets in one task."""
    limit = max(LEAST_HOT, total / MOST_HOT)
    hot = F.broadcast(groups.where(F.col(size) >= limit))
    cold = groups.where(F.col(size) < limit)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(cold, on, how))


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
