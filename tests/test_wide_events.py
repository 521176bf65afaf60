"""The lifecycle queries with every column of the events, against their SQL."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import duckdb
import pytest

from strata.plans import catalogue

WIDE = ["wide_view_equals_raw", "wide_after_late_rows", "wide_cold_only", "wide_hot_only", "wide_retention_view", "wide_alter_null_history", "wide_show_field_keys", "wide_join_theta"]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rng, start, rows = random.Random(5), datetime(2024, 1, 1), []
    for i in range(400):
        at = start + timedelta(seconds=rng.randrange(30 * 86400))
        rows.append((i, at, rng.randrange(9), rng.choice(["click", "view", "purchase"]), rng.random() * 200, rng.choice([None, "{}", '{"a": 1}'])))
    # rows that only their ids or props tell apart, and a null id
    rows += [(1000 + k, start, 1, "click", 99.0, "{}") for k in range(3)] + [(2000, start, None, "click", None, None), (2000, start, 2, "click", 99.0, "x")]
    where = tmp_path_factory.mktemp("events")
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.coalesce(1).write.parquet(f"{where}/events.parquet")
    return str(where)


@pytest.mark.parametrize("name", WIDE)
def test_equals_its_sql(spark, events, name):
    got = catalogue.QUERIES[name](spark, events)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{events}/events.parquet/*.parquet')")
        found = db.execute(catalogue.ORACLES[name])
        columns, want = [c[0] for c in found.description], [tuple(float(x) if isinstance(x, Decimal) else x for x in r) for r in found.fetchall()]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))
    assert want
