"""The line model: text to numbered, classified lines.

A file is split on \\n or \\r\\n after dropping a byte-order mark; empty lines
are rows, also the one after a final line end. Each line is a record, blank,
malformed, or another JSON value; only records are queried, the rest keep
their text so that output can restore every line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import is_blank, is_record, parsed

LINE_END = "\\r?\\n"


def split_text(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per line of a text column: keep..., line_no (from 0), raw."""
    lines = F.split(F.regexp_replace(F.col(text), "^\\uFEFF", ""), LINE_END, -1)
    return df.select(*keep, F.posexplode(lines).alias("line_no", "raw"))


def classified(df: DataFrame, raw: str = "raw", keep_blank_text: bool = True) -> DataFrame:
    """Adds v (VARIANT), is_record, line_kind: record, blank, malformed or other.

    Row-wise reading keeps a blank line's own white space; columnar reading
    (keep_blank_text=False) makes it empty.
    """
    text = F.col(raw)
    out = df.withColumn("v", parsed(text))
    out = out.withColumn("is_record", is_record(F.col("v")))
    line_kind = F.when(is_blank(text), "blank").when(F.col("v").isNull(), "malformed").when(F.col("is_record"), "record").otherwise("other")
    out = out.withColumn("line_kind", line_kind)
    return out if keep_blank_text else out.withColumn(raw, F.when(F.col("line_kind") == "blank", "").otherwise(text))


def strict(df: DataFrame, raw: str = "raw") -> DataFrame:
    """As classified(), but malformed lines raise."""
    return df.withColumn("v", F.when(~is_blank(F.col(raw)), F.parse_json(raw))).withColumn("is_record", is_record(F.col("v")))


def read_whole(spark: SparkSession, path: str, ignore_bad: bool = False) -> DataFrame:
    """(file, content): one row per file, for single JSON documents and exact line numbers of small files."""
    reader = spark.read.option("ignoreCorruptFiles", str(ignore_bad).lower())
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\\uFEFF", "").alias("content"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) with exact line numbers; a file is read in one task, so keep files below the block size."""
    return split_text(read_whole(spark, path), "content", "file")


def read_lines_split(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) for files of any size: large ones are split.

    line_no orders a file's lines but has gaps: it is the split's start byte
    and the row's place in the task. The empty line after a final line end
    isn't a row here.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    order = F.struct(meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_no")
    raw: Column = F.regexp_replace(F.col("value"), "\\r$", "")
    return rows.select(meta["file_path"].alias("file"), order, raw.alias("raw"))


def read_json_documents(spark: SparkSession, glob: str) -> DataFrame:
    """(file, raw): per line for .ndjson files, else the whole file; unreadable files and bad JSON give no row."""
    whole = read_whole(spark, glob, ignore_bad=True)
    per_line = F.split(F.col("content"), LINE_END)
    units = F.when(F.col("file").endswith(".ndjson"), F.filter(per_line, lambda x: x != "")).otherwise(F.array("content"))
    rows = whole.select("file", F.explode(units).alias("raw"))
    return rows.where(parsed(F.col("raw")).isNotNull())


def read_any(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Dispatch by suffix: Parquet stores, containers, else line text."""
    from .container import SUFFIX, read_containers

    if path.endswith(SUFFIX):
        return read_containers(spark, path, **options)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return classified(read_lines(spark, path))
