"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a ramp: its weight at training time t in [0, 1]
is weight * (ramp + 2 * (1 - ramp) * t), whose mean is the weight. Its demand
up to t is the integral, target * (ramp * t + (1 - ramp) * t^2). A document
copy that starts after c words of its source is due when the demand reaches c,
so the integral's inverse at c / target is its position; documents sorted by
position (range partitions, sorted inside) are the training order.

The running word counts never need a source in one task: documents lie in hash
order, cut into buckets of bounded size; bucket totals are summed up per
source, and only a bucket's own rows are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, parallelism

#: Weights and ramps of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
RAMPS = (1.5, 1.0, 0.5)
#: No source is repeated more often than this.
MAX_REPEATS = 3
#: Rows of one (source, bucket) at most, about; there are more buckets than tasks in any case.
BUCKET_ROWS = 50_000
HASH_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), ((rank - 1) % len(values) + 1).cast("int"))


def source_targets(sums: DataFrame, weights: tuple[float, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> also weight, ramp, target.

    Targets share all words by weight; what exceeds max_repeats times a
    source's size is shared again by weight until no target is above. That is
    filling to one level per weight: with sources sorted by cap / weight, the
    level is the first at which the next source isn't full. One row per
    source, so one task suffices.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("rank", F.row_number().over(by_name))
    ranked = ranked.select("source", "source_size", _cycle(weights, F.col("rank")).alias("weight"), _cycle(ramps, F.col("rank")).alias("ramp"), "rank")
    cap = F.col("source_size") * F.lit(float(max_repeats))
    by_fill = Window.orderBy("ratio", "rank")
    everything = Window.partitionBy()
    filled = (
        ranked.withColumns({"cap": cap, "ratio": cap / F.col("weight")})
        .withColumns({
            "total": F.sum("source_size").over(everything).cast("double"),
            "below": F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open_weight": F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        })
        .withColumn("level", (F.col("total") - F.col("below")) / F.col("open_weight"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    )
    return filled.select("source", "source_size", "weight", "ramp", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def position(start: Column, target: Column, ramp: Column) -> Column:
    """Training time in [0, 1] at which a source's demand reaches start words."""
    q = start / target
    return 2 * q / (ramp + F.sqrt(ramp * ramp + 4 * (1 - ramp) * q))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, max_repeats: int = MAX_REPEATS, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, start, position, source_start, ramp.

    Passes over a source repeat it in the same order; the last one stops at
    the target, cutting one document per source. taken counts the words of all
    passes; position is that of the first copy, null if the mix takes nothing.

    Edge cases: null text has no words and is never taken; null sources form
    one source, the last; repeated rows count as rows of their own; ties of the
    hash order are settled by id and size; very long texts count whole; without
    any words all targets are 0; an empty table gives an empty result; other
    columns, whatever their names, are ignored.
    """
    order = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")
    sized = materialise(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order.alias("order"), *[c.alias(n) for n, c in (carry or {}).items()]),
        "mix-sizes",
    )
    buckets = 1 << max(sized.count() // BUCKET_ROWS, parallelism(docs.sparkSession)).bit_length()
    sized = sized.withColumn("bucket", F.shiftright("order", HASH_BITS - buckets.bit_length() + 1))

    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, ramps, max_repeats)
    starts = starts.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select("s.source", "bucket", "before", "source_size", "target", "ramp")

    inside = Window.partitionBy("source", "bucket").orderBy("order", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.alias("d").join(starts.alias("b"), F.expr("d.source <=> b.source and d.bucket = b.bucket"))
    start = F.col("before") + F.col("inside")
    whole = F.floor("target")
    passes = [F.greatest(F.lit(0), F.least(F.col("d.size"), whole - F.lit(p) * F.col("source_size") - start)) for p in range(max_repeats)]
    taken = sum(passes[1:], passes[0]).cast("long")
    return placed.select(
        F.col("d.id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), start.alias("start"), "ramp",
        F.when(taken > 0, position(start.cast("double"), F.col("target"), F.col("ramp"))).alias("position"),
        *(carry or {}),
    )


def copies(mixed: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """mix()'s rows, one per copy that the mix takes: also copy (0, 1, ...) and that copy's own position and words."""
    left = F.floor("target") - F.col("copy") * F.col("source_size") - F.col("start")
    words = F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")
    at = position((F.col("copy") * F.col("source_size") + F.col("start")).cast("double"), F.col("target"), F.col("ramp"))
    each = mixed.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    return each.withColumns({"copy_words": words, "position": at}).where("copy_words > 0")


def in_training_order(df: DataFrame) -> DataFrame:
    """Range partitions by position, sorted inside; rows that aren't taken last.

    The latter share a null position; their place in the source spreads them
    over partitions of their own.
    """
    keys = [F.col("position").asc_nulls_last(), *[F.col(c) for c in ("start",) if c in df.columns]]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
