"""Sizes, numbers, extension lists and compression levels."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def humanize_bytes(n: Column) -> Column:
    """One digit behind the point, rounded from the exact quotient, ties to the even digit."""
    whole = n.cast("decimal(20,0)")
    out = None
    for unit in "TGMK":
        size = F.lit(UNITS[unit]).cast("decimal(14,0)")
        tenths = (whole * 10).cast("decimal(22,0)")
        rest = tenths % size
        low = ((tenths - rest) / size).cast("decimal(22,0)")
        up = (rest * 2 > size) | ((rest * 2 == size) & (low % 2 == 1))
        digits = (low + F.when(up, 1).otherwise(0)).cast("decimal(22,0)")
        last = (digits % 10).cast("int")
        text = F.concat(((digits - last) / 10).cast("decimal(21,0)").cast("string"), F.lit("."), last.cast("string"), F.lit(f" {unit}B"))
        out = F.when(n >= UNITS[unit], text) if out is None else out.when(n >= UNITS[unit], text)
    return out.otherwise(F.concat(n.cast("string"), F.lit(" B")))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def parse_byte_size(text: Column) -> Column:
    """'12K' to 12288; null for what isn't a size or doesn't fit in 64 bits unsigned."""
    trimmed = F.upper(F.trim(text))
    number = F.regexp_extract(trimmed, r"^(\d{1,20})([KMGT]?)$", 1)
    unit = F.regexp_extract(trimmed, r"^(\d{1,20})([KMGT]?)$", 2)
    factor = F.lit(1).cast("decimal(13,0)")
    for u, f in UNITS.items():
        factor = F.when(unit == u, F.lit(f).cast("decimal(13,0)")).otherwise(factor)
    value = F.when(number != "", number).cast("decimal(20,0)") * factor
    return F.when(value <= F.lit(Decimal(2**64 - 1)).cast("decimal(20,0)"), value.cast("decimal(20,0)"))


def parse_extensions(text: Column) -> Column:
    """'.TXT, md,,' to [txt, md]."""
    parts = F.transform(F.split(text, ","), lambda x: F.lower(F.regexp_replace(F.trim(x), r"^\.+", "")))
    return F.filter(parts, lambda x: x != "")


def gzip_level(level: int | None) -> int:
    return {None: 6, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}.get(level, 9)


def bzip2_level(level: int | None) -> int:
    return {None: 6, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}.get(level, 9)


def xz_level(level: int | None) -> int:
    return 6 if level is None else level


def zstd_level(level: int | None) -> int:
    return {None: 3, 1: 1, 2: 2, 7: 10, 8: 15, 9: 19}.get(level, 3)
