"""The columnar store: Parquet with typed hot fields and the whole record beside them.

A store keeps file, line_no, is_record, raw (of lines that aren't records),
the record as VARIANT, its time in milliseconds, and for each hot field a typed
column and its presence.
Reading a field means a plain column reference, so the scan prunes all others
and takes filters on them; other keys are looked up in the VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import as_map, has_key
from ..operators.codecs import WRITER, resolve
from ..operators.filters import record_time
from ..operators.project import path_of, project_text

HAS = "has__"
FIELD = "f__"
TIME = "time__ms"


def shredded(df: DataFrame, fields: dict[str, str], v: str = "v") -> DataFrame:
    """Adds time__ms, and f__name (typed) and has__name for each hot field."""
    m = as_map(F.col(v))
    df = df.withColumn(TIME, record_time(m))
    typed = {f"{FIELD}{f}": F.try_variant_get(F.col(v), path_of(f), t) for f, t in fields.items()}
    return df.withColumns(typed | {f"{HAS}{f}": has_key(m, f) for f in fields})


def write(df: DataFrame, path: str, fields: dict[str, str], codec: str | None = None, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Writes classified lines (file, line_no, raw, is_record, v) as a store.

    partition_by: low-cardinality columns only, such as a date or few shapes.
    """
    out = shredded(df, fields).withColumn("raw", F.when(~F.col("is_record"), F.col("raw")))
    keep = [c for c in ("file", "line_no", "is_record", "line_kind", "raw", "v", *partition_by) if c in out.columns]
    keep += [c for c in out.columns if c.startswith((FIELD, HAS)) or c == TIME]
    out.select(*dict.fromkeys(keep)).write.mode(mode).partitionBy(*partition_by).parquet(path, compression=WRITER[resolve(df.sparkSession, codec)])


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def field(df: DataFrame, name: str, kind: str | None = None) -> Column:
    """A field of a store: its typed column if it has one, else a lookup."""
    return F.col(f"{FIELD}{name}") if f"{FIELD}{name}" in df.columns else F.try_variant_get(F.col("v"), path_of(name), kind or "string")


def select(df: DataFrame, fields: dict[str, str | None], *keep: str) -> DataFrame:
    """Typed projection of records."""
    return df.where("is_record").select(*keep, *[field(df, f, t).alias(f) for f, t in fields.items()])


def to_lines(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """file, line_no, line: every line again in its place; records projected, other lines as they were."""
    line = F.when(F.col("is_record"), project_text(F.col("v"), fields or [])).otherwise(F.coalesce("raw", F.lit("")))
    return df.select("file", "line_no", line.alias("line"))


def write_text(lines: DataFrame, path: str, mode: str = "errorifexists", codec: str = "identity") -> None:
    """Text files of lines in order: each input file's lines are sorted within their partition."""
    lines.repartition("file").sortWithinPartitions("file", "line_no").select("line").write.mode(mode).option("compression", WRITER[codec]).text(path)


def sizes(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row: n_lines, n_fields, raw_bytes, projected_bytes, ratio."""
    line, full = project_text(F.col("v"), fields), F.to_json(F.col("v"))
    sums = df.where("is_record").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length(full)).alias("raw_bytes"), F.sum(F.octet_length(line)).alias("projected_bytes"))
    return sums.withColumns({"n_fields": F.lit(len(fields)).cast("long"), "ratio": F.col("projected_bytes") / F.col("raw_bytes")})
