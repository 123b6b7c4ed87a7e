"""Key dictionaries: how often each key occurs at any depth, short codes, renaming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import canonical
from ..functions.values import base26

MAX_KEYS = 2048
#: Codes of up to four letters.
MAX_CODES = 26 + 26**2 + 26**3 + 26**4
#: A JSON string, and whether it's a key: in compact text only keys have a colon right behind.
_STRINGS = r'("(?:[^"\\]|\\.)*+":?)'


def key_frequency(df: DataFrame, v: str = "v", order: str = "line_no") -> DataFrame:
    """key, n, first_seen (least order): occurrences at every depth, through arrays.

    One pass in the JVM, whatever the depth: the keys are those strings of the
    value's compact text that a colon follows. They're counted before the
    shuffle.
    """
    strings = F.regexp_extract_all(F.to_json(v), F.lit(_STRINGS), F.lit(1))
    quoted = F.transform(F.filter(strings, lambda s: s.endswith(":")), lambda s: F.left(s, F.length(s) - 1))
    rows = df.select(F.col(order).alias("order"), F.explode(quoted).alias("quoted"))
    counts = rows.groupBy("quoted").agg(F.count("*").alias("n"), F.min("order").alias("first_seen"))
    key = F.try_variant_get(F.try_parse_json("quoted"), "$", "string")
    return counts.groupBy(key.alias("key")).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))


def train(frequency: DataFrame, max_keys: int = MAX_KEYS) -> DataFrame:
    """key, code, n: the most frequent keys (ties: first seen, then key) with codes a..z, aa..., in that order.

    Codes that are themselves keys of the data are left out, so renaming can
    be undone; there are enough others, as each key is a clash once at most.
    """
    if not 0 < max_keys <= 26**3:
        raise ValueError(f"max_keys must be 1 to {26**3}")
    first = (F.desc("n"), "first_seen", "key")
    ranked = frequency.orderBy(*first).limit(max_keys).withColumn("place", F.row_number().over(Window.orderBy(*first)))  # max_keys rows
    clashes = frequency.where(F.col("key").rlike("^[a-z]{1,4}$")).select(F.col("key").alias("code"))
    codes = frequency.sparkSession.range(MAX_CODES).select("id", base26(F.col("id")).alias("code")).join(clashes, "code", "left_anti")
    codes = codes.orderBy("id").limit(max_keys).withColumn("place", F.row_number().over(Window.orderBy("id")))
    return ranked.join(codes, "place", "left").select("key", F.coalesce("code", F.raise_error(F.lit("the data's own keys leave too few codes")).cast("string")).alias("code"), "n")


def rename_top(m: Column, mapping: Column) -> Column:
    """A record map with its top-level keys renamed; unknown keys stay."""
    return F.transform_keys(m, lambda k, _: F.coalesce(F.try_element_at(mapping, k), k))


def mapping_of(pairs: dict[str, str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*[F.lit(c) for c in pairs.values()])) if pairs else F.expr("map_from_arrays(array(cast(null as string)), array(cast(null as string)))")


def inverted(pairs: dict[str, str]) -> dict[str, str]:
    return {code: key for key, code in pairs.items()}


def rename_all(df: DataFrame, text: str, pairs: dict[str, str], out: str = "renamed") -> DataFrame:
    """Adds compact JSON text with keys renamed at every depth; NULL for malformed text.

    Nesting of any depth has no built-in expression, so this is an Arrow-batched
    UDF; the pairs (at most MAX_KEYS) go with it.
    """

    @F.pandas_udf("string")
    def rename(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def hook(items: list[tuple[str, object]]) -> dict:
            return {pairs.get(k, k): x for k, x in items}

        def one(s: str | None) -> str | None:
            try:
                return None if s is None else json.dumps(json.loads(s, object_pairs_hook=hook), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        for series in batches:
            yield series.map(one)

    return df.withColumn(out, rename(F.col(text)))


def encode_text(df: DataFrame, text: str, pairs: dict[str, str] | None = None, out: str = "encoded") -> DataFrame:
    """Parse, sort keys, rename, print compactly."""
    df = df.withColumn(out, canonical(F.col(text)))
    return rename_all(df, out, pairs, out) if pairs else df


def decode_text(df: DataFrame, text: str, pairs: dict[str, str] | None = None, out: str = "decoded") -> DataFrame:
    return rename_all(df, text, inverted(pairs or {}), out) if pairs else df.withColumn(out, F.to_json(F.try_parse_json(text)))

