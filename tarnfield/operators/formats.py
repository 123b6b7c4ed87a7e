"""Output formats of records: elastic, datadog, ndjson.

Derived keys come first and the record's own keys override them; then the
source's time and level keys go.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.json import is_truthy, lookup, or_else
from ..functions.values import time_of

FORMATS = ("ndjson", "elastic", "datadog")


def overlaid(derived: dict[str, Column], m: Column, dropped: tuple[str, ...]) -> Column:
    """The derived keys that m hasn't and that have a value, then m, without the dropped keys."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in derived.items()])
    own = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull() & ~F.map_contains_key(m, p["key"])))
    return F.map_filter(F.map_concat(own, m), lambda k, _: ~k.isin(*dropped))


def elastic(m: Column) -> Column:
    derived = {
        "@timestamp": or_else(lookup(m, "ts"), lookup(m, "timestamp")),
        "message": or_else(lookup(m, "message"), lookup(m, "msg")),
        "level": lookup(m, "level"),
        "service": lookup(m, "service"),
    }
    return overlaid(derived, m, ("ts", "timestamp"))


def datadog(m: Column, now_ms: Column | None = None) -> Column:
    """now_ms: the time of records without ts; by default the query's start. A ts that is no time gives an explicit null."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    ts = lookup(m, "ts")
    derived = {
        "timestamp": F.when(is_truthy(ts), F.coalesce(time_of(ts).cast("variant"), F.parse_json(F.lit("null")))).otherwise(now.cast("variant")),
        "status": lookup(m, "level"),
        "service": lookup(m, "service"),
        "message": or_else(lookup(m, "message"), lookup(m, "msg")),
    }
    return overlaid(derived, m, ("ts", "level"))


def formatted(m: Column, name: str = "ndjson", now_ms: Column | None = None) -> Column:
    """JSON text of a record map in one of FORMATS."""
    if name not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    return F.to_json(elastic(m) if name == "elastic" else datadog(m, now_ms) if name == "datadog" else m)
