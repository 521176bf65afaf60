"""Declarations, durations, timestamps and buckets."""

import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.errors import AxisError, BadSchema, SchemaDrift
from strata.functions import schema as S
from strata.functions import timefn as T


def test_type_classes_follow_the_first_match():
    kinds = {c.name: c.storage for c in S.parse_schema("a TIMESTAMP, b BIGINT, c VARCHAR(3), d BLOB, e, f DOUBLE, g POINT, h CHARINT")}
    assert kinds == {"a": "INTEGER", "b": "INTEGER", "c": "TEXT", "d": "BLOB", "e": "BLOB", "f": "REAL", "g": "INTEGER", "h": "INTEGER"}
    for bad in ("a NUMERIC", "a DECIMAL(3)", "a BOOLEAN", "a DATE"):
        with pytest.raises(BadSchema):
            S.parse_schema(bad)


def test_axis_is_named_or_unique():
    assert S.axis_of(S.parse_schema("ts INTEGER, v REAL")) == "ts"
    assert S.axis_of(S.parse_schema("at TIMESTAMP, ts INTEGER")) == "at"
    assert S.axis_of(S.parse_schema("a TIMESTAMP, b TIMESTAMP"), "b") == "b"
    for text, explicit in (("a TIMESTAMP, b TIMESTAMP", None), ("v REAL", None), ("ts REAL", "ts"), ("ts INTEGER", "nope")):
        with pytest.raises(AxisError):
            S.axis_of(S.parse_schema(text), explicit)


def test_drift_allows_a_prefix_only():
    stored = S.parse_schema("ts TIMESTAMP, v REAL")
    S.check_drift(stored, S.parse_schema("ts TIMESTAMP"))
    with pytest.raises(SchemaDrift):
        S.check_drift(stored, S.parse_schema("ts TIMESTAMP, v TEXT"))
    with pytest.raises(SchemaDrift):
        S.check_drift(stored, S.parse_schema("ts TIMESTAMP, v REAL, w REAL"))


def test_durations():
    assert T.parse_duration("1h") == 3_600_000_000 and T.parse_duration("1y") == 365 * 86_400_000_000
    assert T.format_duration(T.parse_duration("60m")) == "1h" and T.format_duration(T.parse_duration("14d")) == "2w"
    for bad in ("", "0s", "-1h", "1.5h", "1x", "99999999999999y"):
        with pytest.raises(ValueError):
            T.parse_duration(bad)


def _us(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp()) * T.SECOND


STAMPS = {
    "1987-06-05": _us(1987, 6, 5), "2031-12-31T08:09:10Z": _us(2031, 12, 31, 8, 9, 10), "1999-04-30 23:15:59": _us(1999, 4, 30, 23, 15, 59), "2012-02-29 00:00": _us(2012, 2, 29),
    "2004-10-10T01:02:03.25Z": _us(2004, 10, 10, 1, 2, 3) + 250_000, "1955-03-03T03:03:03.9876549": _us(1955, 3, 3, 3, 3, 3) + 987_654,
}
BAD = ("tomorrow", "1987-6-5", "1987-00-10", "2011-02-29", "1900-02-29", "1999-04-30 24:15:59", "1999-04-30T10:60:00", "1999-04-30T10:00:00.", "1999-04-30T10:00:00-05:00", "1999/04/30", "19990430T10")


def test_timestamps():
    for text, us in STAMPS.items():
        assert T.parse_timestamp(text) == us
    for text in BAD:
        assert T.parse_timestamp(text) is None
    assert T.format_timestamp(_us(1987, 6, 5, 4, 3, 2)) == "1987-06-05T04:03:02Z"
    assert T.format_timestamp(_us(1955, 3, 3) + 42) == "1955-03-03T00:00:00.000042Z"
    assert T.parse_timestamp("-0004-02-29") == T.parse_timestamp("0396-02-29") - 146_097 * 86400 * T.SECOND


@given(st.integers(-9_000_000_000_000_000_000, 9_000_000_000_000_000_000))
def test_format_then_parse_is_exact(us):
    assert T.parse_timestamp(T.format_timestamp(us)) == us


@given(st.integers(-(2**60), 2**60), st.integers(1, 2**50), st.integers(-(2**50), 2**50))
def test_bucket_holds_its_value(us, width, origin):
    start = T.floor_bucket(us, width, origin)
    assert start <= us < start + width and (start - origin) % width == 0


def test_sql_functions(spark):
    T.register(spark)
    for text, us in STAMPS.items():
        assert spark.sql("SELECT strata_ts(:x)", args={"x": text}).first()[0] == us
    for text in BAD:
        with pytest.raises(Exception, match="not a timestamp"):
            spark.sql("SELECT strata_ts(:x)", args={"x": text}).collect()
    assert spark.sql("SELECT strata_ts(42)").first()[0] == 42
    assert spark.sql(f"SELECT strata_datetime({_us(2004, 10, 10) + 250_000}), strata_datetime(1000000)").first()[:] == ("2004-10-10T00:00:00.250000Z", "1970-01-01T00:00:01Z")
    for name in ("strata_bucket", "strata_bucket_us"):
        assert spark.sql(f"SELECT {name}('30m', 5400000001), {name}('1d', -5), {name}('5s', 13000000, 2000000)").first()[:] == (5_400_000_000, -86_400_000_000, 12_000_000)
    # Wednesdays from 2020-05-06 on, and before it
    assert spark.sql("SELECT strata_bucket('1w', '2020-05-05T10:00:00', '2020-05-06')").first()[0] == T.parse_timestamp("2020-04-29")
    with pytest.raises(Exception, match="bad duration"):
        spark.sql("SELECT strata_bucket('0h', 5)").collect()
    got = spark.range(-5, 5).select(T.bucket(F.col("id"), 4, 1).alias("b")).collect()
    assert [r.b for r in got] == [T.floor_bucket(i, 4, 1) for i in range(-5, 5)]
