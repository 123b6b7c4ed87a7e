"""Scalar functions on numbers, times and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json import is_truthy, kind, let, text_of


def zigzag(n: Column) -> Column:
    """Signed to unsigned with small magnitudes first; exact over BIGINT up to 2^62."""
    return F.when(n >= 0, n * 2).otherwise(n * -2 - 1)


def unzigzag(n: Column) -> Column:
    return F.when(n % 2 == 0, F.shiftright(n, 1)).otherwise(-F.shiftright(n + 1, 1))


def varint_bytes(n: Column) -> Column:
    """Bytes of an unsigned base-128 number."""
    out = F.lit(1)
    for k in range(1, 9):
        out = F.when(n >= F.lit(1 << (7 * k)), F.lit(k + 1)).otherwise(out)
    return out


def epoch_ms(text: Column) -> Column:
    """Milliseconds of an ISO-8601 text, zone-less ones as UTC; NULL if it isn't one."""
    return F.unix_millis(F.try_to_timestamp(text))


def time_of(v: Column) -> Column:
    """Milliseconds of a value: ISO text or a number of milliseconds; else NULL."""

    def of(x: Column) -> Column:
        number = F.floor(F.try_variant_get(x, "$", "double")).cast("long")
        return F.when(kind(x) == "STRING", epoch_ms(text_of(x))).when(is_truthy(x) & ~kind(x).isin("BOOLEAN", "OBJECT", "ARRAY", "VOID"), number)

    return let(v, of)


def iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def hash31(text: Column) -> Column:
    """The 31-multiplier hash of UTF-16 units in 32 unsigned bits; a stable fingerprint, not for joins at scale (use xxhash64)."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    return F.aggregate(units, F.lit(0).cast("long"), lambda h, u: (h * 31 + F.conv(u, 16, 10).cast("long")).bitwiseAND(F.lit(4294967295)))


def base26(n: Column) -> Column:
    """Codes a..z, aa..zz, ... for 0, 1, ...; up to four letters."""
    steps = [26, 26**2, 26**3, 26**4]
    out, before = F.lit(None).cast("string"), 0
    branches = []
    for letters, count in enumerate(steps, 1):
        i = n - before
        digits = [F.chr(F.lit(97) + F.pmod(F.floor(i / 26 ** (letters - 1 - p)), F.lit(26))) for p in range(letters)]
        branches.append((n < before + count, F.concat(*digits)))
        before += count
    for test, code in reversed(branches):
        out = F.when(test, code).otherwise(out)
    return out
