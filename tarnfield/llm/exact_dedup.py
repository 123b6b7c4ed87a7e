"""Exact deduplication by progressive refinement, in DataFrame operations only.

Rows are grouped by normalised length and prefix hash; only rows whose group
has a second member get a hash of their full content, and only these are
grouped again. No text is ever shuffled: the surviving groups travel as a
bitmap of fixed size, and rows are (id, length, hash) triples from then on.

Hot groups: every grouping combines map-side before its shuffle; the join that
hands a group's verdict to its members is an ordinary equi-join that adaptive
execution splits when one group holds a large share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bitmap_bits, bitmap_rows, materialise, with_mark


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and the carried columns.

    Texts are equal when their normalised forms are. The row with the longest
    original text stays, among these the one with the smallest id.

    prefix: characters of the prefix hash. carry: extra columns over docs that
    the result takes along (narrow ones; they are stored).

    Edge cases: null text is empty, and empty texts are one group; a null id
    comes last among ties; of repeated rows (same id and text) exactly one
    stays; very long texts are hashed whole; an empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    norm = normalised(F.col(text_col))
    keys = docs.select(F.length(norm).alias("norm_len"), F.xxhash64(F.left(norm, F.lit(prefix))).alias("prefix_hash"))
    shared = materialise(keys.groupBy("norm_len", "prefix_hash").count().where("count > 1").drop("count"), "dedup-groups")
    bits = bitmap_bits(shared.count())
    marks = bitmap_rows(shared, F.xxhash64("norm_len", "prefix_hash"), bits)

    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars"),
        norm.alias("norm"),
        *[c.alias(f"carry_{name}") for name, c in (carry or {}).items()],
    )
    rows = rows.withColumn("norm_len", F.length("norm"))
    rows = with_mark(rows, F.xxhash64("norm_len", F.xxhash64(F.left("norm", F.lit(prefix)))), marks, bits, "survives")
    rows = rows.select(
        "id",
        "n_chars",
        "norm_len",
        F.when(F.col("survives"), F.sha2("norm", 256)).alias("full_hash"),
        F.monotonically_increasing_id().alias("row"),
        *[f"carry_{name}" for name in carry or {}],
    )
    rows = materialise(rows, "dedup-rows")

    best = F.max(F.struct("n_chars", F.bitwise_not("id").alias("not_id"), F.bitwise_not("row").alias("not_row")))
    groups = rows.where("full_hash is not null").groupBy("norm_len", "full_hash").agg(best.alias("best"), F.count("*").alias("size")).where("size > 1")
    groups = groups.select("norm_len", "full_hash", "size", F.bitwise_not("best.not_id").alias("best_id"), F.bitwise_not("best.not_row").alias("best_row"))
    # Stored, so that the join below has plain shuffles on both sides, whose hot partitions can be split
    groups = materialise(groups, "dedup-verdicts")
    out = rows.join(groups, ["norm_len", "full_hash"], "left")
    alone = F.col("size").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"),
        *[F.col(f"carry_{name}").alias(name) for name in carry or {}],
    )
