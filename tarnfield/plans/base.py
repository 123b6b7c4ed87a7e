"""Inputs of the query catalogue: tables, and event records as JSON lines of varying shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import as_map
from ..operators.shapes import with_shape
from ..session import prepared
from ..sources.lines import classified

#: Keys of an event record.
FIELDS = {"event_id": "long", "ts": "string", "event_type": "string", "user_id": "long", "value": "double", "active": "boolean"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, raw): each event as a line of JSON text.

    By event_id: every 11th is blank, every 13th malformed; ts is absent from
    every 7th and null in every 5th, user_id absent from every 3rd.
    """
    e = F.col("event_id")
    parts = F.array_compact(F.array(
        F.concat(F.lit('"event_id":'), e),
        F.when(e % 7 == 0, None).when(e % 5 == 0, F.lit('"ts":null')).otherwise(F.concat(F.lit('"ts":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"'))),
        F.concat(F.lit('"event_type":"'), "event_type", F.lit('"')),
        F.when(e % 3 != 0, F.concat(F.lit('"user_id":'), "user_id")),
        F.concat(F.lit('"value":'), F.col("value").cast("string")),
        F.concat(F.lit('"active":'), (F.col("value") > 100).cast("string")),
        F.concat(F.lit('"props":'), "props"),
    ))
    record = F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
    raw = F.when(e % 22 == 0, "  ").when(e % 11 == 0, "").when(e % 13 == 0, F.lit('{"event_id": 1, "ts"')).otherwise(record)
    return table(spark, sf_dir, "events").select(F.lit("events").alias("file"), e.alias("line_no"), raw.alias("raw"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(event_text(spark, sf_dir))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records only, with their map m."""
    return event_lines(spark, sf_dir).where("is_record").withColumn("m", as_map(F.col("v")))


def shaped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_shape(event_lines(spark, sf_dir).where("is_record"))


#: The same records for SQL.
REC = """rec AS (
  SELECT event_id AS line_no, event_id, event_type, value, props, value > 100 AS active,
    event_id % 7 <> 0 AS has_ts, event_id % 3 <> 0 AS has_user_id,
    CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN NULL ELSE epoch_us(ts) // 1000 END AS ts_ms,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id
  FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0
)"""
SHAPE = """concat('active', chr(1), 'event_id', chr(1), 'event_type', chr(1), 'props', CASE WHEN has_ts THEN concat(chr(1), 'ts') ELSE '' END,
    CASE WHEN has_user_id THEN concat(chr(1), 'user_id') ELSE '' END, chr(1), 'value')"""
