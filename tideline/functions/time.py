"""Durations and time buckets. Times are 64-bit integers since the epoch; the unit is in every name."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tideline.errors import InvalidDuration, InvalidInterval

# Microseconds of each unit (fixed values).
UNIT_US = {"us": 1, "µs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
_PATTERN = r"^\s*([0-9]+)(us|µs|ms|s|m|h|d|w)\s*$"
_MAX = 2**63 - 1


def parse_duration_us(text: str) -> int:
    """Microseconds of a duration such as 5m; at least one unit, within 64 bits."""
    found = re.match(_PATTERN, text or "", re.ASCII)
    if not found or int(found[1]) < 1:
        raise InvalidDuration(f"not a duration: {text!r}")
    value = int(found[1]) * UNIT_US[found[2]]
    if value > _MAX:
        raise InvalidDuration(f"duration overflows: {text!r}")
    return value


def minutes(n: int) -> int:
    return n * UNIT_US["m"]


def days(n: int) -> int:
    return n * UNIT_US["d"]


def duration_us(text: Column) -> Column:
    """Column form of parse_duration_us; null where the text is not a duration."""
    amount = F.regexp_extract(text, _PATTERN, 1).try_cast("long")
    unit = F.regexp_extract(text, _PATTERN, 2)
    scale = F.element_at(F.create_map(*[F.lit(x) for pair in UNIT_US.items() for x in pair]), F.when(unit != "", unit))
    return F.when(amount >= 1, F.try_multiply(amount, scale.cast("long")))


def width_us(width: str | int) -> int:
    value = parse_duration_us(width) if isinstance(width, str) else int(width)
    if value <= 0:
        raise InvalidInterval(f"width must be positive: {width!r}")
    return value


def bucket(ts: Column, width: int) -> Column:
    """Start of the bucket that holds ts, in ts's unit; floors towards minus infinity, origin at the epoch."""
    if width <= 0:
        raise InvalidInterval(f"width must be positive: {width!r}")
    return ts - F.pmod(ts, F.lit(width).cast("long"))


def time_bucket(width: str | int, ts_us: Column) -> Column:
    """Bucket of a time in microseconds; the width is a duration text or microseconds."""
    return bucket(ts_us, width_us(width))


def time_bucket_ms(ts_ms: Column, width_ms: int) -> Column:
    return bucket(ts_ms, width_ms)


def time_bucket_ns(ts_ns: Column, width_ns: int) -> Column:
    return bucket(ts_ns, width_ns)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp column, with or without a zone (then UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def register(spark: SparkSession) -> None:
    """SQL functions of the session: null for a missing argument or a width that is not positive."""
    for unit in ("us", "ms", "ns"):
        spark.sql(f"create or replace temporary function time_bucket_{unit}(ts bigint, width bigint) returns bigint return case when width > 0 then ts - pmod(ts, width) end")
    cases = " ".join(f"when '{u}' then {n}" for u, n in UNIT_US.items())
    spark.sql(
        "create or replace temporary function parse_duration_micros(text string) returns bigint return "
        r"case when try_cast(regexp_extract(text, '^\\s*([0-9]+)(us|µs|ms|s|m|h|d|w)\\s*$', 1) as bigint) >= 1 then "
        r"try_multiply(try_cast(regexp_extract(text, '^\\s*([0-9]+)(us|µs|ms|s|m|h|d|w)\\s*$', 1) as bigint), "
        rf"case regexp_extract(text, '^\\s*([0-9]+)(us|µs|ms|s|m|h|d|w)\\s*$', 2) {cases} end) end"
    )
    spark.sql("create or replace temporary function time_bucket(width string, ts bigint) returns bigint return ts - pmod(ts, parse_duration_micros(width))")
    spark.sql("create or replace temporary function extension_loaded() returns int return 1")
    spark.sql("create or replace temporary function engine_version() returns string return '1.0'")
