"""Selective projection of records, in requested order, presence-aware."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import as_map, has_key


def parse_fields(text: str | None) -> list[str]:
    """A comma-separated list, trimmed, without empty names."""
    return [f for part in (text or "").split(",") if (f := part.strip())]


def pick(m: Column, fields: list[str]) -> Column:
    """A map's requested keys in requested order: absent ones left out, nulls kept."""
    wanted = F.filter(F.array(*[F.lit(f) for f in dict.fromkeys(fields)]), lambda f: F.map_contains_key(m, f))
    return F.map_from_entries(F.transform(wanted, lambda f: F.struct(f.alias("key"), F.try_element_at(m, f).alias("value"))))


def pick_from(v: Column, fields: list[str]) -> Column:
    """As pick(), from the record itself by plain lookups, which a Parquet scan narrows to these fields."""
    each = [F.struct(F.lit(f).alias("key"), F.try_variant_get(v, path_of(f), "variant").alias("value")) for f in dict.fromkeys(fields)]
    return F.map_from_entries(F.filter(F.array(*each), lambda p: p["value"].isNotNull()))


def project_text(v: Column, fields: list[str]) -> Column:
    """JSON text of the projection; no fields means all of them; {} if none is there."""
    m = as_map(v)
    return F.to_json(pick(m, fields)) if fields else F.to_json(v)


def project_columns(df: DataFrame, fields: dict[str, str], *keep: str, v: str = "v") -> DataFrame:
    """Typed columns name -> Spark type; NULL for absent, null and values of another type.

    Plain variant_get on a Parquet column, so the scan reads these fields only.
    """
    columns = [F.try_variant_get(F.col(v), path_of(f), kind).alias(f) for f, kind in fields.items()]
    return df.select(*keep, *columns)


def path_of(field: str) -> str:
    """The lookup path of a top-level key."""
    if field.isidentifier():
        return f"$.{field}"
    return f"$[\"{field}\"]" if "'" in field else f"$['{field}']"


def presence(m: Column, fields: list[str]) -> list[Column]:
    return [has_key(m, f).alias(f"has_{f}") for f in fields]


def available(fields: list[str], keys: Column) -> Column:
    """Requested fields that exist, in requested order."""
    return F.array_intersect(F.array(*[F.lit(f) for f in fields]), keys)
