"""Scalar expressions whose results differ from Spark's own functions of like name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_REGEX = 200


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(value: str | Column, digits: int = 2) -> Column:
    """Rounds halves towards plus infinity, as 2.5 to 3 and -2.5 to -2."""
    scale = 10.0**digits
    return F.floor(col(value) * scale + 0.5) / scale


def round_half_even(value: str | Column, digits: int = 2) -> Column:
    return F.bround(col(value), digits)


def nan_to_null(value: str | Column) -> Column:
    return F.when(~F.isnan(col(value)), col(value))


def finite(value: str | Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    v = col(value)
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def percent_change(before: str | Column, after: str | Column) -> Column:
    """(after - before) / |before| * 100; from 0 it is 0 where nothing changed, else 100."""
    b, a = col(before), col(after)
    return F.when(b == 0, F.when(a == 0, 0.0).otherwise(100.0)).otherwise((a - b) / F.nullif(F.abs(b), F.lit(0.0)) * 100)


def anchored(pattern: str) -> str:
    """``pattern`` for rlike, matching whole strings only (a final newline counts)."""
    checked(pattern)
    return rf"\A(?:{pattern})\z"


def checked(pattern: str) -> str:
    if len(pattern) > MAX_REGEX:
        raise ValueError(f"a regular expression has at most {MAX_REGEX} characters")
    re.compile(pattern)
    return pattern


def safe_pattern(pattern: str) -> bool:
    """False for overlong patterns and for a repeated group that itself ends in a repeat, which can take exponential time."""
    return len(pattern) <= MAX_REGEX and not re.search(r"\([^()]*[+*}]\)[+*{]", pattern)


def canonical_key(labels: str | Column) -> Column:
    """The labels as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(labels)))))


def nearest_rank(value: str | Column, fraction: float) -> Column:
    """The value of rank ceil(fraction * n) in its group."""
    name = value if isinstance(value, str) else None
    if name is None:
        raise TypeError("nearest_rank takes a column name")
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY `{name}`)")


def epoch_ns(timestamp: str | Column) -> Column:
    """Nanoseconds since the epoch of a timestamp without time zone."""
    c = timestamp if isinstance(timestamp, str) else None
    if c is None:
        raise TypeError("epoch_ns takes a column name")
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{c}` as timestamp_ntz)) * 1000L")


def floor_bucket(ts: str | Column, step: int, anchor: int | Column = 0) -> Column:
    """The start of the bucket of ``ts``; times before the anchor fall in buckets before it."""
    t = col(ts)
    a = anchor if isinstance(anchor, Column) else F.lit(anchor)
    return t - F.pmod(t - a, F.lit(step))


def iso_text(ns: str | Column) -> Column:
    """ISO 8601 text, to the millisecond, of nanoseconds since the epoch."""
    n = col(ns).cast("long")
    # whole numbers all the way: a double is off by up to 128 ns at today's times
    at = F.timestamp_micros(F.call_function("div", n - F.pmod(n, F.lit(1000)), F.lit(1000)))
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def hex_text(data: str | Column) -> Column:
    """Bytes as lower-case hex."""
    return F.lower(F.hex(col(data)))


def hex_bytes(text: str | Column) -> Column:
    """The bytes of hex text; null where it is not."""
    return F.try_to_binary(col(text), F.lit("hex"))


def uuid_bytes(text: str | Column) -> Column:
    """The 16 bytes of a UUID's text; null where it is not one."""
    plain = F.replace(col(text), F.lit("-"), F.lit(""))
    return F.when(col(text).rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.try_to_binary(plain, F.lit("hex")))


def uuid_text(data: str | Column) -> Column:
    """The text of a UUID's 16 bytes."""
    return F.regexp_replace(hex_text(data), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def json_equal(a: str | Column, b: str | Column) -> Column:
    """Whether two JSON texts hold the same value, whatever the order of keys."""
    same = lambda c: F.schema_of_variant(F.try_parse_json(col(c)))
    return F.coalesce(F.to_json(F.try_parse_json(col(a))) == F.to_json(F.try_parse_json(col(b))), same(a).isNull() & same(b).isNull())
