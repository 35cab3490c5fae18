"""Timestamps that may carry an offset, as struct(ts_local TIMESTAMP_NTZ, tz_offset_s INT, ts_us BIGINT).

Spark's TIMESTAMP forgets the offset, but two equal instants with different offsets are different values
here.  ``ts_us`` counts microseconds since 1970 of the local time less the offset (none: no offset), and
is what comparisons use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.functions.patterns import Pattern

DAY_US, STAMP = 86_400_000_000, "struct<ts_local:timestamp_ntz,tz_offset_s:int,ts_us:bigint>"
_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2}:\d{2})?$"
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def local_us(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session's time zone."""
    seconds = F.extract(F.lit("SECOND"), ts).cast("decimal(18,6)") * 1_000_000
    return F.unix_date(ts.cast("date")).cast("long") * DAY_US + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + seconds.cast("long")


def from_us(us: Column) -> Column:
    """The TIMESTAMP_NTZ of microseconds since 1970."""
    return F.expr(_EPOCH) + F.make_dt_interval(secs=(us.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))


def parsed(text: Column) -> Column:
    """A stamp from strict ISO text, T or space between date and time; null where that is no time.

    Digits past the microsecond are cut off.  Offsets reach to 23:59.
    """
    # One pattern decides the form; then all parts stand at fixed places, the offset at the end.
    tail = F.substring(text, 20, 1 << 20)
    with_offset = F.substring(tail, -6, 1).isin("+", "-")
    offset = F.when(with_offset, F.substring(tail, -6, 6))
    seconds = F.when(offset.startswith("-"), -1).otherwise(1) * (F.substring(offset, 2, 2).try_cast("int") * 3600 + F.substring(offset, 5, 2).try_cast("int") * 60)
    good = text.rlike(_ISO) & (~with_offset | ((F.substring(tail, -5, 2) < "24") & (F.substring(tail, -2, 2) < "60")))
    digits = F.substring(F.when(with_offset, F.left(tail, F.length(tail) - 6)).otherwise(tail), 2, 6)
    whole = F.when(good, F.concat(F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 8))).try_cast("timestamp_ntz")
    local = F.when(digits == "", whole).otherwise(F.concat(F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 8), F.lit("."), digits).try_cast("timestamp_ntz"))
    part = lambda at: F.substring(text, at, 2).try_cast("int").cast("long")
    us = F.unix_date(whole.cast("date")).cast("long") * DAY_US + part(12) * 3_600_000_000 + part(15) * 60_000_000 + part(18) * 1_000_000 + F.rpad(digits, 6, "0").try_cast("int")
    stamp = F.struct(local.alias("ts_local"), seconds.cast("int").alias("tz_offset_s"), (us - F.coalesce(seconds, F.lit(0)).cast("long") * 1_000_000).alias("ts_us"))
    return F.when(whole.isNotNull(), stamp)


def parsed_loose(text: Column) -> Column:
    """Like ``parsed``, for text in which Z may stand for +00:00."""
    return parsed(F.regexp_replace(text, "Z$", "+00:00"))


def extracted(line: Column, pattern: Pattern) -> Column:
    """All stamps of a line in order: each match's first group and its second, the offset, if there is one."""
    whole = F.regexp_extract_all(line, F.lit(pattern.java), F.lit(0))
    # The parts are cut out of each whole match again, as all matches of one group lose absent ones.
    texts = F.transform(whole, lambda m: F.concat(F.regexp_extract(m, pattern.java, 1), F.regexp_extract(m, pattern.java, 2)))
    return F.filter(F.transform(texts, parsed), lambda s: s.isNotNull())


def first_stamp(line: Column, pattern: Pattern) -> Column:
    """The first stamp of a line.  All matches are looked at only where the first one is no real time."""
    first = F.concat(F.regexp_extract(line, pattern.java, 1), F.regexp_extract(line, pattern.java, 2))
    return F.coalesce(parsed(first), F.when(first != "", F.try_element_at(extracted(line, pattern), F.lit(1))))


def filled(stamp: Column, offset_s: Column) -> Column:
    """A stamp without an offset takes ``offset_s`` over; its local time stays (replaced, not converted)."""
    offset = F.coalesce(stamp["tz_offset_s"], offset_s)
    us = stamp["ts_us"] - F.when(stamp["tz_offset_s"].isNull(), F.coalesce(offset_s, F.lit(0)).cast("long") * 1_000_000).otherwise(0)
    return F.when(stamp.isNotNull(), F.struct(stamp["ts_local"].alias("ts_local"), offset.cast("int").alias("tz_offset_s"), us.alias("ts_us")))


def _digits(ts: Column) -> Column:
    return F.lpad((local_us(ts) % 1_000_000).cast("string"), 6, "0")


def _offset_text(offset: Column) -> Column:
    minutes = F.abs(offset)
    return F.when(offset.isNull(), "").otherwise(F.concat(F.when(offset < 0, "-").otherwise("+"), F.lpad(F.floor(minutes / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(minutes % 3600 / 60).cast("string"), 2, "0")))


def iso(ts: Column, offset: Column | None = None) -> Column:
    """ISO text with a fraction of six digits, or of none if it is zero."""
    text = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(_digits(ts) == "000000", "").otherwise(F.concat(F.lit("."), _digits(ts))))
    return text if offset is None else F.concat(text, _offset_text(offset))


def iso_us(ts: Column, offset: Column | None = None) -> Column:
    """ISO text with always six digits."""
    text = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), _digits(ts))
    return text if offset is None else F.concat(text, _offset_text(offset))


def wall_clock(text: Column) -> Column:
    return F.substring(text, 1, 19)


def cycle_dir(start: Column, end: Column, separator: str = "") -> Column:
    """The folder name of a cycle; with separator T that of correlated ones.  ``unknown`` if a bound is missing."""
    form = f"yyyyMMdd'{separator}'HHmmss" if separator else "yyyyMMddHHmmss"
    return F.coalesce(F.concat(F.date_format(start, form), F.lit("-"), F.date_format(end, form)), F.lit("unknown"))


def dump_time(name: Column, pattern: Pattern) -> Column:
    """The time in a file's name: group 1 must be 14 digits of a real time, else null."""
    digits = pattern.at_start().group(name, 1)
    return F.when(digits.rlike(r"^\d{14}$"), F.regexp_replace(digits, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3 $4:$5:$6")).try_cast("timestamp_ntz")


def midpoint_us(a: Column, b: Column) -> Column:
    """The middle of two instants; a half microsecond goes to the even one, as halving a duration does."""
    half = F.floor((b - a) / F.lit(2)).cast("long")
    return a + half + F.when((b - a) % 2 == 0, 0).otherwise(F.pmod(half, F.lit(2)))


def contains(start: Column, end: Column, at: Column) -> Column:
    """Whether an interval with at most one open side contains a time."""
    return (start.isNotNull() | end.isNotNull()) & F.coalesce(at >= start, F.lit(True)) & F.coalesce(at <= end, F.lit(True))


def contains_closed(start: Column, end: Column, at: Column) -> Column:
    """The same for intervals that must have both bounds."""
    return F.coalesce(at.between(start, end), F.lit(False))


def distance_us(start: Column, end: Column, at: Column) -> Column:
    """0 inside, else the distance to the nearer known bound; null for an interval without bounds."""
    return F.when(contains(start, end, at), F.lit(0).cast("long")).otherwise(F.least(F.abs(at - start), F.abs(at - end)))


def distance_closed_us(start: Column, end: Column, at: Column) -> Column:
    """Distance to an interval with both bounds; null (infinitely far) if one is open."""
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(start - at, at - end, F.lit(0).cast("long")))
