"""What the operators share: reading tables, shared tables, row batches, bitmaps."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

#: The six ASCII white-space characters: space, tab, \n, \v, \f, \r.
SPACE = " \t\n\x0b\x0c\r"
#: Java pattern of a word: a run without those characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; reached through Spark's readers only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    Cuts the lineage, pins non-deterministic columns, and survives lost
    executors, as no block lives on one machine only.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.parquet(path, compression="zstd")
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Empties tables of materialise() that no later plan reads.

    Through Spark's writer, as only that reaches every store; what a returned
    plan still reads is left for the cluster to expire.
    """
    for df in stored:
        spark = df.sparkSession
        spark.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(df._stored_at)
    gc.collect()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done.

    Its cleaner works when the driver collects garbage, which an idle driver
    heap may not do for long; until then finished stages fill the disks. A
    remote session has no such call and waits for the driver's own collections.
    """
    gc.collect()
    jvm = getattr(getattr(spark, "_sc", None), "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    """Tasks that a wide step should have at least."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The batch function, handing free memory back to the system when a task ends.

    Python workers are reused; what one operator's tables took would otherwise
    stay with them beside the next operator's.
    """

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return trimmed


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# --- Fixed-size bitmaps (Bloom filters with one hash) -----------------------

_BLOCK = 32768  # bits of one bitmap_construct_agg buffer


def bitmap_bits(rows: int, per_row: int = 16, least: int = 1 << 20, most: int = 1 << 29) -> int:
    """Bits of a filter for so many rows: a power of two, 64 MB at most.

    Beyond that size the filter only lets more rows through; results stay whole.
    """
    return min(most, max(least, 1 << (max(1, rows) * per_row - 1).bit_length()))


def bitmap_rows(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """(block long, bits_set binary): the filter as rows of 4 KB, bits / 32768 of them at most."""
    at = key.bitwiseAND(F.lit(bits - 1))
    return (
        keys.select(F.floor(at / _BLOCK).cast("long").alias("block"), (at % _BLOCK).cast("long").alias("bit"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bits_set"))
    )


def with_mark(df: DataFrame, key: Column, marks: DataFrame, bits: int, name: str) -> DataFrame:
    """Adds name: whether the key may be in the filter that marks (bitmap_rows) holds.

    marks has bits / 32768 rows of 4 KB at most, which bounds the broadcast.
    """
    at = free_name(df.columns, "_at")
    block, found = free_name(df.columns, "_block"), free_name(df.columns, "_bits_set")
    df = df.withColumn(at, key.bitwiseAND(F.lit(bits - 1)))
    df = df.join(F.broadcast(marks.toDF(block, found)), F.floor(df[at] / _BLOCK) == F.col(block), "left")
    byte = F.conv(F.hex(F.substring(found, ((F.col(at) % _BLOCK) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, (F.col(at) % 8).cast("int")) == 1
    return df.withColumn(name, F.coalesce(bit, F.lit(False))).drop(at, block, found)


def split_by_mark(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not among keys, rows whose key may be); neither is shuffled. keys: a stored table."""
    bits, name = bitmap_bits(keys.count()), free_name(df.columns, "_marked")
    marked = with_mark(df, key, bitmap_rows(keys, keys_key, bits), bits, name)
    return marked.where(~F.col(name)).drop(name), marked.where(F.col(name)).drop(name)


def free_name(taken: list[str], wish: str) -> str:
    """wish, with underscores before it until no column has that name."""
    used = {name.lower() for name in taken}
    while wish.lower() in used:
        wish = f"_{wish}"
    return wish


def bitmap_bytes(keys: DataFrame, key: Column, bits: int) -> bytes:
    """The filter in one byte string of bits / 8 bytes, for Python workers."""
    out = bytearray(bits // 8)
    for block, part in bitmap_rows(keys, key, bits).collect():  # of fixed size, whatever the input's
        out[block * (_BLOCK // 8) : (block + 1) * (_BLOCK // 8)] = part
    return bytes(out)


def bitmap_has(filter_bytes: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be in the filter; filter_bytes is its uint8 view."""
    at = keys.view(np.uint64) & np.uint64(bits - 1)
    return (filter_bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
