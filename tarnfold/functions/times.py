"""Dates, retry windows and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def export_time(c: Column) -> Column:
    """yyyyMMddTHHmmssZ to ISO; anything else, out-of-range dates too, to null."""
    at = F.try_to_timestamp(F.when(c.rlike("^[0-9]{8}T[0-9]{6}Z$"), F.regexp_replace(c, "[TZ]", "")), F.lit("yyyyMMddHHmmss"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def month_key(saved: Column, published: Column) -> Column:
    """yyyy-MM of the saved, else the published date; a month that isn't 01 to 12 is unknown."""
    when = F.coalesce(saved, published, F.lit(""))
    return F.when(when.rlike("^[0-9]{4}-(0[1-9]|1[0-2])"), F.substring(when, 1, 7)).otherwise("unknown")


def wall_time(c: Column) -> Column:
    """yyyy-MM-dd HH:mm as written, UTC marked only for Z; other text as it is."""
    pattern = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2})(.*)$"
    told = F.concat(F.regexp_extract(c, pattern, 1), F.lit(" "), F.regexp_extract(c, pattern, 2), F.when(F.regexp_extract(c, pattern, 3).rlike("^Z$|:[0-9]{2}Z$") & (F.regexp_extract(c, pattern, 3) == "Z"), " UTC").otherwise(""))
    return F.when(c.rlike(pattern), told).otherwise(c)


def parseable_time(c: Column) -> Column:
    """The text if it is a time, else null ("2 hours ago")."""
    return F.when(F.try_to_timestamp(c).isNotNull(), c)


def updated_or_created(updated: Column, created: Column) -> Column:
    return F.coalesce(updated, created)


def retry_window(failed_at: Column, n: Column, ladder_ms: tuple[int, ...] = (900_000, 1_800_000, 2_700_000), ratio: float = 0.5) -> tuple[Column, Column]:
    """Earliest and latest moment of try n + 1 after the n-th failure, in epoch milliseconds; null beyond the ladder."""
    base = F.try_element_at(F.array(*map(F.lit, ladder_ms)), n.cast("int"))
    at = F.unix_millis(failed_at)
    return F.when(base.isNotNull(), at + F.greatest(F.lit(0), F.round(base * (1 - ratio)).cast("long"))), at + F.round(base * (1 + ratio)).cast("long")


def human_bytes(n: Column) -> Column:
    """B, KB, MB or GB with one decimal."""
    out = F.when(n < 1024, F.format_string("%d B", n))
    for unit, size in (("KB", 1024.0), ("MB", 1024.0**2)):
        out = out.when(n < size * 1024, F.format_string(f"%.1f {unit}", n / size))
    return out.otherwise(F.format_string("%.1f GB", n / 1024.0**3))


def over_limit(base64_length: Column, most: int) -> Column:
    """The decoded size can't be below the limit: three bytes for each whole four characters."""
    return F.floor(base64_length / 4) * 3 > most
