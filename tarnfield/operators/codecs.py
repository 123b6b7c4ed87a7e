"""Codecs: which compression suits the data, and which one an option means."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT = "brotli"
NAMES = ("brotli", "gzip", "identity", "zstd", "hybrid", "auto")
#: Spark's own names for a Parquet or text writer.
WRITER = {"gzip": "gzip", "identity": "none", "zstd": "zstd", "brotli": "zstd", "hybrid": "zstd", "auto": "zstd"}
BROTLI_QUALITY = 6
WINDOW_BYTES = 64 * 1024
PROBE_BYTES = 4 * 1024
MAJORITY = 0.9
CONF = "spark.tarnfield.codec"


def resolve(spark: SparkSession, explicit: str | None = None) -> str:
    """Explicit option, else the session's CONF if it's a codec, else DEFAULT."""
    if explicit is not None:
        if explicit not in NAMES:
            raise ValueError(f"codec must be one of {', '.join(NAMES)}")
        return explicit
    named = spark.conf.get(CONF, None)
    return named if named in NAMES else DEFAULT


def compress(data: bytes, codec: str) -> bytes:
    if codec == "identity":
        return bytes(data)
    if codec == "gzip":
        c = zlib.compressobj(wbits=31)
        return c.compress(data) + c.flush()
    level = BROTLI_QUALITY if codec == "brotli" else None
    return pa.Codec(codec, compression_level=level).compress(data, asbytes=True)


def decompress(data: bytes, codec: str) -> bytes:
    if codec == "identity":
        return bytes(data)
    if not data:
        return b""
    with pa.CompressedInputStream(pa.BufferReader(data), codec) as f:
        return f.read()


def choose_auto(data: bytes) -> str:
    """brotli or gzip, by a probe's size; a tie goes to brotli."""
    probe = data[:PROBE_BYTES]
    return "brotli" if len(compress(probe, "brotli")) <= len(compress(probe, "gzip")) else "gzip"


def byte_windows(df: DataFrame, text: str, *by: str, order: str = "line_no", size: int = WINDOW_BYTES) -> DataFrame:
    """Adds byte_window: which window of size bytes a line starts in, of its group's running byte count."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length(text) + 1).over(w), F.lit(0))
    return df.withColumn("byte_window", F.floor(before / size).cast("long"))


def window_sizes(df: DataFrame, text: str, *by: str, order: str = "line_no", codecs: tuple[str, ...] = ("brotli", "gzip", "zstd")) -> DataFrame:
    """by..., byte_window, codec, n_bytes, raw_bytes: compressed size of each window under each codec."""

    @F.pandas_udf("array<long>")
    def sizes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in parts:
            yield series.map(lambda s: [len(compress(s.encode(), c)) for c in codecs])

    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    windows = df.groupBy(*by, "byte_window").agg(F.array_join(lines, "\n").alias("_text"))
    each = windows.select(*by, "byte_window", F.octet_length("_text").cast("long").alias("raw_bytes"), sizes("_text").alias("_sizes"))
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in codecs]).alias("codec"), F.col("_sizes").alias("n_bytes"))
    return each.select(*by, "byte_window", "raw_bytes", F.explode(pairs).alias("_p")).select(*by, "byte_window", F.col("_p.codec").alias("codec"), F.col("_p.n_bytes").alias("n_bytes"), "raw_bytes")


def smallest(sizes: DataFrame, *by: str) -> DataFrame:
    """by..., codec, n_bytes: the codec of least size; ties go to the first in name order."""
    best = F.min(F.struct("n_bytes", "codec")).alias("_b")
    return sizes.groupBy(*by).agg(best).select(*by, F.col("_b.codec").alias("codec"), F.col("_b.n_bytes").alias("n_bytes"))


def majority(choices: DataFrame, *by: str, share: float = MAJORITY) -> DataFrame:
    """by..., codec, n, share, coalesce: the most frequent choice and whether it's frequent enough for one stream."""
    counts = choices.groupBy(*by, "codec").agg(F.count("*").alias("n"))
    top = counts.groupBy(*by).agg(F.max(F.struct("n", "codec")).alias("_t"), F.sum("n").alias("_all"))
    part: Column = F.col("_t.n") / F.col("_all")
    return top.select(*by, F.col("_t.codec").alias("codec"), F.col("_t.n").alias("n"), part.alias("share"), (part >= share).alias("coalesce"))
