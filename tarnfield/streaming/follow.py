"""Follow mode: growing folders of line files, and growing files, with the batch plan's functions.

The checkpoint holds offsets and state after every micro-batch; file sinks are
exactly-once, other sinks should be idempotent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.lines import classified
from . import tail

#: Recent hashes that are remembered at most, and after trimming, by all buckets together.
RECENT_MOST = 10_000
RECENT_KEPT = 5_000
BUCKETS = 64


def follow_lines(spark: SparkSession, path: str, files_per_batch: int | None = None, bytes_per_batch: str | None = None) -> DataFrame:
    """A stream of classified lines: file, raw, v, is_record, line_kind.

    The limits are admission control per micro-batch. The source takes each
    file once, by path; for text appended to known files see follow_growing.
    """
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace(F.regexp_replace("value", "\\r$", ""), "^\\uFEFF", "").alias("raw"))
    return classified(rows)


def follow_growing(spark: SparkSession, path: str, lines_per_batch: int | None = None) -> DataFrame:
    """A stream of classified lines: file, position, raw, v, is_record, line_kind, of files that grow, are renamed or truncated.

    lines_per_batch with a trigger each second limits lines per second; such
    lines are read by the driver, others by the executors.
    """
    spark.dataSource.register(tail.GrowingLines)
    reader = spark.readStream.format(tail.FORMAT).option("path", path)
    if lines_per_batch:
        reader = reader.option("linesPerTrigger", lines_per_batch)
    return classified(reader.load())


def dedup_within(df: DataFrame, event_time: str, delay: str, *keys: str) -> DataFrame:
    """Drops duplicates whose event times lie within the delay; state goes as the watermark passes.

    Rows without an event time don't move the watermark.
    """
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def dedup_recent(df: DataFrame, text: str = "line", buckets: int = BUCKETS, most: int = RECENT_MOST, kept: int = RECENT_KEPT) -> DataFrame:
    """Drops lines whose hash is among the recent ones; a stream of (bucket, line).

    State is bounded by count: each of the hash buckets has an even share of
    `most` hashes, trimmed to its share of the latest `kept`, so an old line
    can pass again; dedup_all behind it drops those, too.
    """
    most, kept = max(1, most // buckets), max(1, kept // buckets)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = dict.fromkeys(state.get[0]) if state.exists else {}
        for part in parts:
            keep = []
            for h in part["hash"]:
                keep.append(h not in seen)
                seen[h] = None
                if len(seen) > most:
                    seen = dict.fromkeys(list(seen)[-kept:])
            yield part.loc[keep, ["bucket", "line"]]
        state.update((list(seen),))

    rows = df.select(F.xxhash64(text).alias("hash"), F.col(text).alias("line")).withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("long"))
    return rows.groupBy("bucket").applyInPandasWithState(step, "bucket long, line string", "hashes array<long>", "append", GroupStateTimeout.NoTimeout)


def dedup_all(df: DataFrame, text: str = "line") -> DataFrame:
    """Drops rows whose text any earlier row of the stream had, by the text's SHA-256.

    State is 32 bytes for each distinct text and is never dropped. It is kept
    in RocksDB on the executors' disks (see session.RUNTIME), so memory stays
    bounded and disk grows with the distinct texts.
    """
    # The digest is also the projection without which Spark 4.1 can't shuffle the rows of dedup_recent
    return df.withColumn("_digest", F.unhex(F.sha2(text, 256))).dropDuplicates(["_digest"]).drop("_digest")


def start(df: DataFrame, sink: str, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts an append query to a file sink; without an interval it takes what is there and ends."""
    writer = df.writeStream.format(sink).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def start_each(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """As start(), with a function of (batch, id), which must be idempotent."""
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def health(query: StreamingQuery) -> dict:
    """State of a running query: active, message, lines so far in the last batch, batch id."""
    last = query.lastProgress
    return {"active": query.isActive, "message": query.status["message"], "lines": last["numInputRows"] if last else 0, "batch": last["batchId"] if last else None}


class LineCounter(StreamingQueryListener):
    """Lines and batches so far, by query name or id; add it to spark.streams."""

    def __init__(self) -> None:
        self.lines: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.lines.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        key = p.name or str(p.id)
        self.lines[key] = self.lines.get(key, 0) + p.numInputRows
        self.batches[key] = p.batchId + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
