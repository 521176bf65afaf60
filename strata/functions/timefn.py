"""Durations, timestamps and time buckets, as Python values and as columns.

Time is epoch microseconds, UTC.  The column forms use built-in functions only and
are registered as SQL functions, so that Catalyst sees through them.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
#: fixed values: duration units, largest first
UNITS = {"y": 365 * 86400 * SECOND, "w": 7 * 86400 * SECOND, "d": 86400 * SECOND, "h": 3600 * SECOND, "m": 60 * SECOND, "s": SECOND}
LIMIT = 2**63 - 1
#: fixed values: the accepted form of a timestamp
FORM = r"^-?\d{4,6}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?Z?$"
EPOCH = dt.datetime(1970, 1, 1)


def parse_duration(text: str) -> int:
    """``<n><s|m|h|d|w|y>`` in microseconds; positive, checked for overflow."""
    found = re.fullmatch(r"\s*(\d+)([smhdwy])\s*", text)
    us = int(found[1]) * UNITS[found[2]] if found else 0
    if not 0 < us <= LIMIT:
        raise ValueError(f"bad duration {text!r}")
    return us


def format_duration(us: int) -> str:
    """The largest unit that divides exactly."""
    for unit, size in UNITS.items():
        if us > 0 and us % size == 0:
            return f"{us // size}{unit}"
    raise ValueError(f"{us} microseconds is not a whole number of seconds")


#: the Gregorian calendar repeats after so many years, of so many days
CYCLE, CYCLE_DAYS = 400, 146_097


def parse_timestamp(text: str) -> int | None:
    """Microseconds, or None for what is not a timestamp; fractions are truncated."""
    found = re.fullmatch(r"(-?\d{1,6})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?)?Z?", text.strip())
    if not found:
        return None
    year, *rest = (int(x or 0) for x in found.groups()[:6])
    cycles, of_cycle = divmod(year, CYCLE)
    try:  # the same date in years that datetime has
        stamp = dt.datetime(2000 + of_cycle, *rest)
    except ValueError:
        return None
    days = stamp.toordinal() - EPOCH.toordinal() + (cycles - 2000 // CYCLE) * CYCLE_DAYS
    us = (days * 86400 + stamp.hour * 3600 + stamp.minute * 60 + stamp.second) * SECOND + int((found[7] or "")[:6].ljust(6, "0"))
    return us if -LIMIT - 1 <= us <= LIMIT else None


def format_timestamp(us: int) -> str:
    """``YYYY-MM-DDTHH:MM:SSZ``, with six digits of fraction where there is one."""
    cycles, rest = divmod(us, CYCLE_DAYS * 86400 * SECOND)
    stamp = EPOCH + dt.timedelta(microseconds=rest)
    year = stamp.year + cycles * CYCLE
    fraction = f".{stamp.microsecond:06d}" if stamp.microsecond else ""
    return f"{'-' if year < 0 else ''}{abs(year):04d}{stamp:-%m-%dT%H:%M:%S}{fraction}Z"


def floor_bucket(us: int, width: int, origin: int = 0) -> int:
    """The start of the bucket, a Euclidean floor on a grid through ``origin``."""
    if width <= 0:
        raise ValueError("bucket width must be positive")
    return us - (us - origin) % width


def to_micros(stamp: Column) -> Column:
    """Microseconds of a timestamp of either kind."""
    return F.unix_micros(stamp.cast("timestamp"))


def to_timestamp(us: int) -> Column:
    """A literal timestamp, which pushes down to a scan."""
    return F.timestamp_micros(F.lit(us))


def bucket(us: Column, width: int | str, origin: int | str = 0) -> Column:
    """:func:`floor_bucket` of a column of microseconds."""
    width = parse_duration(width) if isinstance(width, str) else width
    origin = parse_timestamp(origin) if isinstance(origin, str) else origin
    if width <= 0 or origin is None:
        raise ValueError("bucket width must be positive and the origin a timestamp")
    return us - F.pmod(us - F.lit(origin), F.lit(width).cast("long"))


def register(spark: SparkSession) -> None:
    """SQL functions strata_ts, strata_datetime, strata_duration, strata_bucket and strata_bucket_us for this session."""
    form = FORM.replace("\\", "\\\\")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION strata_ts(x STRING) RETURNS BIGINT RETURN
        CASE WHEN x RLIKE '^-?[0-9]+$' THEN CAST(x AS BIGINT)
             WHEN x RLIKE '{form}' AND try_cast(rtrim('Z', x) AS TIMESTAMP) IS NOT NULL THEN unix_micros(try_cast(rtrim('Z', x) AS TIMESTAMP))
             ELSE raise_error(concat('not a timestamp: ', coalesce(x, 'NULL'))) END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION strata_datetime(us BIGINT) RETURNS STRING RETURN
        CASE WHEN pmod(us, 1000000) = 0 THEN date_format(timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss'Z'")
             ELSE date_format(timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") END""")
    units = " ".join(f"WHEN '{u}' THEN {us}" for u, us in UNITS.items())
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION strata_duration(x STRING) RETURNS BIGINT RETURN
        CASE WHEN x RLIKE '^[0-9]*[1-9][0-9]*$' THEN CAST(x AS BIGINT)
             WHEN x RLIKE '^[0-9]*[1-9][0-9]*[smhdwy]$' THEN CAST(substring(x, 1, length(x) - 1) AS BIGINT) * CASE right(x, 1) {units} END
             ELSE raise_error(concat('bad duration: ', coalesce(x, 'NULL'))) END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION strata_bucket(width STRING, us STRING, origin STRING DEFAULT '0') RETURNS BIGINT RETURN
        strata_ts(us) - pmod(strata_ts(us) - strata_ts(origin), strata_duration(width))""")
    # the form for columns: numbers stay numbers, and a literal width and origin are folded once
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION strata_bucket_us(width STRING, us BIGINT, origin BIGINT DEFAULT 0) RETURNS BIGINT RETURN
        us - pmod(us - origin, strata_duration(width))""")
