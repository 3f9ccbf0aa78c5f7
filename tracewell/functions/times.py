"""Nanosecond times and their US/Eastern names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "US/Eastern"
SECOND = 1_000_000_000


def eastern(t: Column) -> Column:
    """ns -> 'yyyy-MM-dd HH:mm:ss.nnnnnnnnn' in US/Eastern. The session's time zone must be UTC."""
    local = F.from_utc_timestamp(F.timestamp_seconds(F.floor(t / SECOND)), ZONE)
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad((t % SECOND).cast("string"), 9, "0"))


def eastern_seconds(t: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(t), ZONE), "yyyy-MM-dd HH:mm:ss")


def from_eastern(s: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss[.fraction]' in US/Eastern -> ns; the fraction is read to nine digits."""
    whole = F.unix_micros(F.to_utc_timestamp(F.to_timestamp(F.substring_index(s, ".", 1), "yyyy-MM-dd HH:mm:ss"), ZONE)) * 1000
    part = F.when(F.instr(s, ".") > 0, F.substring_index(s, ".", -1)).otherwise("0")
    return whole + F.rpad(part, 9, "0").cast("long")


def from_gmt_minus_4(s: Column) -> Column:
    """'yyyy-MM-ddTHH:mm:ss[.f]-04:00' -> ns. The digits after the point are milliseconds, however many there are."""
    plain = F.regexp_replace(s, r"(-04:00|Z)$", "")
    whole = F.unix_micros(F.to_timestamp(F.regexp_replace(F.substring_index(plain, ".", 1), "T", " "), "yyyy-MM-dd HH:mm:ss")) * 1000 + 4 * 3600 * SECOND
    return whole + F.when(F.instr(plain, ".") > 0, F.substring_index(plain, ".", -1).cast("long")).otherwise(0) * 1_000_000
