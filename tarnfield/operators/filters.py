"""Predicates: time range, records only, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import lookup, or_else
from ..functions.values import epoch_ms, time_of


def record_time(m: Column) -> Column:
    """Milliseconds of ts, or of timestamp if ts isn't truthy."""
    return time_of(or_else(lookup(m, "ts"), lookup(m, "timestamp")))


def bound_ms(bound: str | int | None) -> Column | None:
    """A bound in milliseconds: a number as it is, an ISO text parsed; None if there is none."""
    if bound is None or bound == "":
        return None
    return F.lit(bound) if isinstance(bound, int) else epoch_ms(F.lit(bound))


def in_range(ms: Column, since: str | int | None = None, until: str | int | None = None) -> Column:
    """since <= ms <= until; rows without a time stay; a bound that isn't a time is no bound.

    With numbers as bounds over a BIGINT column this is IS NULL OR BETWEEN,
    which a Parquet scan takes; constant folding makes texts numbers, too.
    """
    test = F.lit(True)
    for limit, within in ((bound_ms(since), ms.__ge__), (bound_ms(until), ms.__le__)):
        if limit is not None:
            test = test & (ms.isNull() | limit.isNull() | within(limit))
    return test


def records(df: DataFrame) -> DataFrame:
    return df.where("is_record")


def without_seen(df: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key isn't in a set of keys seen before."""
    return df.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def dedup(df: DataFrame, *keys: str, order: str = "line_no") -> DataFrame:
    """The first row of each key by order. One shuffle; partial minima combine before it, so a frequent key is one row per task."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), order).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(df.columns)
