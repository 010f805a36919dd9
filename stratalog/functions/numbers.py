"""Shares, means and their text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole; 0 where the whole is 0 or null."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def half_even(number: Column) -> Column:
    return F.bround(number, 0).cast("bigint")


def fixed_point(value: float, digits: int = 1) -> str:
    """Driver-side text of a share: rounds the exact binary value."""
    return f"{value:.{digits}f}"


SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]


def size_text(n: int) -> str:
    """Bytes in the greatest unit of 1024 that they reach, to two decimals, in columns of seven."""
    unit = min(max(int(n).bit_length() - 1, 0) // 10, len(SIZE_UNITS) - 1)
    return f"{n / (1 << 10 * unit):7.2f} {SIZE_UNITS[unit]}"


#: Bytes of the suffixes with which disk usage is told.
DISK_UNITS = {"": 1, "B": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def disk_bytes(shown: Column) -> Column:
    """Bytes of a size as disk usage tells it (``4.0K``, ``12M``); null if it is none."""
    number, unit = F.regexp_extract(shown, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([BKMGT]?)", 1), F.regexp_extract(shown, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([BKMGT]?)", 2)
    factor = F.element_at(F.create_map(*[F.lit(v) for pair in DISK_UNITS.items() for v in pair]), unit)
    return F.when(number != "", F.round(number.try_cast("double") * factor).cast("bigint"))


def disk_text(n: Column) -> Column:
    """Bytes as disk usage tells them: in the greatest unit, rounded up, with a decimal below ten."""
    unit = F.when(n < 1024, 0).otherwise(F.least(F.floor(F.log2(n.cast("double")) / 10), F.lit(4))).cast("int")
    value = n / F.pow(F.lit(1024.0), unit)
    shown = F.when(unit == 0, n.cast("string")).when(value <= 9.9, F.format_string("%.1f", F.ceil(value * 10) / 10)).otherwise(F.ceil(value).cast("string"))
    return F.concat(shown, F.element_at(F.array(*map(F.lit, ("", "K", "M", "G", "T"))), unit + 1))


def tex_size(shown: Column) -> Column:
    """Disk usage (``1.2G``) as TeX (``1.2\\,GB``); null if it is none."""
    pattern = r"^([0-9.]+)([KMGT]?)"
    return F.when(shown.rlike(pattern), F.concat(F.regexp_extract(shown, pattern, 1), F.lit("\\,"), F.regexp_extract(shown, pattern, 2), F.lit("B")))


def duration_text(seconds: float) -> str:
    """Seconds, minutes or hours to one decimal; nothing below zero."""
    if seconds < 0:
        return "0 s"
    for limit, divisor, unit in ((60, 1, "s"), (3600, 60, "m"), (float("inf"), 3600, "hr")):
        if seconds < limit:
            return f"{seconds / divisor:.1f} {unit}"
    raise ValueError("not a duration")
