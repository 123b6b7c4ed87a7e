"""Shapes: records grouped by their sorted key lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.json import as_map

BATCH_ROWS = 4096
SEPARATOR = "\x01"


def shape_of(v: Column) -> Column:
    """Sorted keys, joined; a map cast from VARIANT has them in order."""
    return F.array_join(F.array_sort(F.map_keys(as_map(v))), SEPARATOR)


def with_shape(df: DataFrame, v: str = "v") -> DataFrame:
    return df.withColumn("shape", shape_of(F.col(v))).withColumn("shape_id", F.xxhash64("shape"))


def groups(df: DataFrame, *by: str) -> DataFrame:
    """Per shape (and by...): rows, first line, windows of BATCH_ROWS rows."""
    out = df.groupBy(*by, "shape").agg(F.count("*").alias("n_rows"), F.min("line_no").alias("first_line"))
    return out.withColumn("n_windows", F.ceil(F.col("n_rows") / BATCH_ROWS).cast("long"))


def key_union(df: DataFrame, *by: str, v: str = "v") -> DataFrame:
    """All keys with the number of rows that have them. Counted per shape first, so each row's keys aren't exploded."""
    shapes = df.groupBy(*by, "shape").agg(F.count("*").alias("n"))
    keys = F.explode(F.filter(F.split("shape", SEPARATOR), lambda k: k != "")).alias("key")
    return shapes.select(*by, keys, "n").groupBy(*by, "key").agg(F.sum("n").alias("n_rows"))


#: Lines of a file whose rows are sorted together.
BUCKET_LINES = 1 << 16


def _bucketed(df: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """df with _bucket, a range of line numbers, and _inside, the place among its shape's rows there; and the buckets' counts.

    So no sort holds more than BUCKET_LINES rows, however large a file is.
    line_no is a number, or the (block, row) of a split file.
    """
    line = df.schema["line_no"].dataType
    if isinstance(line, StructType):
        bucket = F.struct(F.col("line_no.block"), F.floor(F.col("line_no.row") / BUCKET_LINES).alias("part"))
    else:
        bucket = F.floor(F.col("line_no") / BUCKET_LINES)
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(file, "shape", "_bucket").agg(F.count("*").alias("_n"), F.min("line_no").alias("_first"))
    inside = F.row_number().over(Window.partitionBy(file, "shape", "_bucket").orderBy("line_no")) - 1
    return df.withColumn("_inside", inside), counts


def _with_start(df: DataFrame, starts: DataFrame, file: str) -> DataFrame:
    """df joined to its buckets' starts; file may be null."""
    starts = starts.toDF("_file", "_shape", "_in", "_start")
    same = df[file].eqNullSafe(starts["_file"]) & df["shape"].eqNullSafe(starts["_shape"]) & (df["_bucket"] == starts["_in"])
    return df.join(starts, same).drop("_file", "_shape", "_in", "_bucket")


def numbered(df: DataFrame, file: str = "file") -> DataFrame:
    """Adds window and window_row: place of a row among its file's rows of the shape.

    The numbering is per file, as windows never span files. Rows are sorted
    inside ranges of lines; the ranges' counts give where each starts.
    """
    rows, counts = _bucketed(df, file)
    earlier = Window.partitionBy(file, "shape").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(file, "shape", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_inside")
    out = _with_start(rows, starts, file)
    return out.withColumns({"window": F.floor(place / BATCH_ROWS).cast("long"), "window_row": (place % BATCH_ROWS).cast("long")}).drop("_start", "_inside")


def shape_major(df: DataFrame, file: str = "file") -> DataFrame:
    """Adds out_no: place in the order shapes first appear, then lines. Original order is line_no."""
    rows, counts = _bucketed(df, file)
    first = F.min("_first").over(Window.partitionBy(file, "shape"))
    # A row per shape and range of lines, in output order
    earlier = Window.partitionBy(file).orderBy("_shape_first", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_shape_first", first).select(file, "shape", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    out = _with_start(rows, starts, file)
    return out.withColumn("out_no", F.col("_start") + F.col("_inside")).drop("_start", "_inside")
