"""The log-shipping plan: time range, projection, format, optional dedup; one plan for batch and stream.

Over a store the time range is a test of its time column, which the scan takes
for skipping row groups, and a projection reads only the fields it names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json import as_map
from ..operators.filters import in_range, record_time
from ..operators.formats import formatted
from ..operators.project import pick, pick_from
from ..sources.store import TIME


@dataclass
class Options:
    """fields: requested keys, none for all. since, until: inclusive ISO times. dedup: drop equal output lines; a stream forgets old ones, see follow.dedup_all."""

    fields: list[str] = field(default_factory=list)
    since: str | None = None
    until: str | None = None
    format: str = "ndjson"
    dedup: bool = False


def ship(lines: DataFrame, options: Options, *keep: str) -> DataFrame:
    """keep..., line: classified lines filtered, projected and formatted. The filter sees the whole record."""
    out = lines.where("is_record")
    if stored := TIME in lines.columns:
        m = pick_from(F.col("v"), options.fields) if options.fields else as_map(F.col("v"))
    else:
        out = out.withColumn("m", as_map(F.col("v")))
        m = pick(F.col("m"), options.fields) if options.fields else F.col("m")
    if options.since or options.until:
        out = out.where(in_range(F.col(TIME) if stored else record_time(F.col("m")), options.since, options.until))
    out = out.select(*keep, formatted(m, options.format).alias("line"))
    if options.dedup:
        if out.isStreaming:
            from ..streaming.follow import dedup_recent

            return dedup_recent(out)
        out = out.dropDuplicates(["line"])
    return out
