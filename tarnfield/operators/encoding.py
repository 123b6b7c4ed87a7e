"""Column encodings as analysis queries: profile, choice, and the encodings themselves.

Physical storage is Parquet, whose writer encodes. These queries show what a
window's columns look like and yield each encoding's values, exact over BIGINT.
Ordered encodings run inside groups (a file's window of a shape), so no sort
spans the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import is_integer_value, kind, text_of
from ..functions.values import unzigzag, varint_bytes, zigzag

#: Enum candidates: longest value in characters, most distinct values.
ENUM_CHARS = 16
ENUM_VALUES = 16
ENCODINGS = ("INT_VARINT", "DELTA_ZIGZAG", "TIME_DOD", "BOOL_RLE", "ENUM_IDS", "RAW_JSON")

#: Key names that the logs profile treats as times, levels and services. Fixed values.
TIME_KEYS = ("ts", "timestamp", "time")
TIME_ENDINGS = ("_ts", "_time")
LEVEL_KEYS = ("level", "severity", "loglevel")
SERVICE_KEYS = ("service", "app", "application", "service_name")


def cells(df: DataFrame, *by: str, m: str = "m") -> DataFrame:
    """One row per present (row, key): by..., line_no, key, value."""
    return df.select(*by, "line_no", F.explode(m).alias("key", "value"))


def profile(long: DataFrame, *by: str) -> DataFrame:
    """Statistics of each key of cells(): counts, integer range, type tests, distinct short strings.

    All combine map-side; of distinct strings only those short enough for an
    enum are counted, so long values never travel.
    """
    v = F.col("value")
    # Each value's type and forms are worked out once, then aggregated
    typed = long.select(*by, "key", v.alias("_v"), kind(v).alias("_kind"), is_integer_value(v).alias("_integer"))
    typed = typed.select(
        *by, "key", "_integer", "_kind",
        (~F.coalesce(F.is_variant_null("_v"), F.lit(True))).alias("_present"),
        F.when(F.col("_integer"), F.coalesce(F.try_variant_get("_v", "$", "long"), F.floor(F.try_variant_get("_v", "$", "double")).cast("long"))).alias("_whole"),
        F.when(F.col("_kind") == "STRING", text_of(F.col("_v"))).alias("_text"),
    )
    typed = typed.withColumn("_short", F.coalesce(F.length("_text").between(1, ENUM_CHARS), F.lit(False)))
    present = lambda test: F.coalesce(F.bool_and(F.when(F.col("_present"), test)), F.lit(False))
    return typed.groupBy(*by, "key").agg(
        F.count("*").alias("n_present"),
        F.count(F.when(F.col("_present"), 1)).alias("n_values"),
        F.min(F.when(F.col("_present"), F.col("_whole"))).alias("min_int"),
        F.max(F.when(F.col("_present"), F.col("_whole"))).alias("max_int"),
        present(F.col("_integer")).alias("all_int"),
        present(F.col("_kind") == "BOOLEAN").alias("all_bool"),
        present(F.col("_short")).alias("all_short"),
        present(~F.col("_kind").isin("BOOLEAN", "OBJECT", "ARRAY")).alias("all_timelike"),
        F.count_distinct(F.when(F.col("_present") & F.col("_short"), F.col("_text"))).alias("n_distinct"),
    )


def choose_default() -> Column:
    """The encoding of a profiled column."""
    span = F.col("max_int") - F.col("min_int")
    return (
        F.when(F.col("n_values") == 0, "RAW_JSON")
        .when(F.col("all_int") & (span < 2 * F.col("n_values")), "DELTA_ZIGZAG")
        .when(F.col("all_int"), "INT_VARINT")
        .when(F.col("all_bool"), "BOOL_RLE")
        .when(F.col("all_short") & (F.col("n_distinct") <= ENUM_VALUES), "ENUM_IDS")
        .otherwise("RAW_JSON")
    )


def choose_logs() -> Column:
    """As choose_default(), with key names considered first."""
    name = F.lower("key")
    timed = name.isin(*TIME_KEYS)
    for ending in TIME_ENDINGS:
        timed = timed | name.endswith(ending)
    named = name.isin(*LEVEL_KEYS, *SERVICE_KEYS)
    return F.when(timed & F.col("all_timelike") & (F.col("n_values") > 0), "TIME_DOD").when(named, "ENUM_IDS").otherwise(choose_default())


def int_code(x: Column) -> Column:
    """Null 0, else zigzag + 1."""
    return F.when(x.isNull(), F.lit(0)).otherwise(zigzag(x) + 1).cast("long")


def int_decode(code: Column) -> Column:
    return F.when(code != 0, unzigzag(code - 1))


def code_bytes(code: Column) -> Column:
    return varint_bytes(code)


def _ordered(by: tuple[str, ...], order: str):
    return Window.partitionBy(*by).orderBy(order)


def delta(df: DataFrame, x: str, *by: str, order: str = "line_no") -> DataFrame:
    """Adds delta: difference to the previous non-null value, of the first to 0; null stays null."""
    w = _ordered(by, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("delta", F.col(x) - F.coalesce(F.last(x, ignorenulls=True).over(w), F.lit(0)))


def undelta(df: DataFrame, *by: str, order: str = "line_no") -> DataFrame:
    """Adds value: the running sum of delta."""
    w = _ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value", F.when(F.col("delta").isNotNull(), F.sum("delta").over(w)))


def delta_of_delta(df: DataFrame, t: str, *by: str, order: str = "line_no") -> DataFrame:
    """Adds dod: the first two values as they are, then second differences."""
    w = _ordered(by, order)
    one, two = F.lag(t, 1).over(w), F.lag(t, 2).over(w)
    return df.withColumn("dod", F.when(F.row_number().over(w) <= 2, F.col(t)).otherwise(F.col(t) - 2 * one + two))


def undelta_of_delta(df: DataFrame, *by: str, order: str = "line_no") -> DataFrame:
    """Adds value: with first differences d_i = d_2 + sums of dod, a double running sum."""
    w = _ordered(by, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(w)
    first = F.first("dod").over(upto)
    step = F.when(place == 1, F.lit(0)).when(place == 2, F.col("dod") - F.lag("dod").over(w)).otherwise(F.col("dod"))
    out = df.withColumn("_first", first).withColumn("_step", step)
    out = out.withColumn("_d", F.sum("_step").over(upto))
    return out.withColumn("value", F.col("_first") + F.sum("_d").over(upto)).drop("_first", "_step", "_d")


def run_lengths(df: DataFrame, x: str, *by: str, order: str = "line_no") -> DataFrame:
    """by..., run (from 0), value, length, first: runs of equal values, null being one."""
    w = _ordered(by, order)
    starts = F.row_number().over(w) == 1
    changed = starts | ~F.col(x).eqNullSafe(F.lag(x).over(w))
    marked = df.withColumn("_new", changed.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return marked.groupBy(*by, "run").agg(F.first(x).alias("value"), F.count("*").alias("length"), F.min(order).alias("first"))


def expand_runs(runs: DataFrame, *by: str) -> DataFrame:
    """by..., place, value: the values again, by place in the order."""
    w = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("length").over(w), F.lit(0))
    placed = runs.withColumn("_start", start)
    return placed.select(*by, F.explode(F.sequence("_start", F.col("_start") + F.col("length") - 1)).alias("place"), "value")


#: Splitters of an ungrouped dictionary's values.
SPLITTERS = 64


def dictionary(df: DataFrame, x: str, *by: str, splitters: int = SPLITTERS) -> DataFrame:
    """by..., value, id: distinct values in binary order, numbered from 0. Distinct before the sort.

    A group's values are sorted in one task. Without groups, a hash picks some
    values as splitters, and each range between them is sorted by itself and
    numbered from the counts of the ranges before; a column of fewer values
    than splitters is one range.
    """
    values = df.where(F.col(x).isNotNull()).select(*by, F.col(x).alias("value")).distinct()
    inside = Window.partitionBy(*by).orderBy("value")
    if by or df.isStreaming:
        return values.withColumn("id", F.row_number().over(inside) - 1)
    picked = sorted((r[0] for r in values.orderBy(F.xxhash64("value"), "value").limit(splitters).collect()), key=lambda s: s.encode() if isinstance(s, str) else s)
    if len(picked) < splitters:
        return values.withColumn("id", F.row_number().over(inside) - 1)
    ranged = values.withColumn("range", F.size(F.filter(F.array(*map(F.lit, picked)), lambda s: s <= F.col("value"))))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    starts = F.broadcast(sizes.select("range", before.alias("before")))
    place = F.row_number().over(Window.partitionBy("range").orderBy("value")) - 1
    return ranged.withColumn("place", place).join(starts, "range").select("value", (F.col("before") + F.col("place")).alias("id"))


def enum_encode(df: DataFrame, x: str, *by: str) -> DataFrame:
    """Adds id, null for null. Spark broadcasts the dictionary if its measured size allows, else joins by shuffle."""
    d = dictionary(df, x, *by).withColumnRenamed("value", x)
    return df.join(d, [*by, x], "left")


def enum_decode(df: DataFrame, d: DataFrame, *by: str) -> DataFrame:
    """Adds value from id."""
    return df.join(d, [*by, "id"], "left")
