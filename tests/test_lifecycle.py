"""Tables through their life: tiers, late rows, retention, pruning, rollups, new columns."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strata.errors import BadSchema, CompactError, ImmutableHistory, MissingFile, NoPolicy, SchemaDrift, StrataError
from strata.functions.timefn import SECOND
from strata.operators import catalog, rollup, stats
from strata.operators.table import TieredTable

HOUR, DAY = 3600 * SECOND, 86400 * SECOND
TDV = "ts TIMESTAMP, device TEXT, value REAL"


def frame(spark, rows, schema="ts long, device string, value double"):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("ts"))


def hourly(days, device="a"):
    return [(d * DAY + h * HOUR, device, float(h)) for d in days for h in range(24)]


def content(df):
    return sorted((r.us, r.device, r.value) for r in df.select(F.unix_micros("ts").alias("us"), "device", "value").collect())


@pytest.fixture
def table(spark, tmp_path):
    return TieredTable.create(spark, "readings", TDV, str(tmp_path), "1d,7d")


def spans(t):
    return [(e["start"] // DAY, e["end"] // DAY) for e in catalog.active(t.state)]


def test_compaction_keeps_the_one_name_equal(spark, table):
    rows = hourly(range(3))
    table.insert(frame(spark, rows))
    before = content(table.df())
    actions = table.maintain(now=2 * DAY + 3 * HOUR)
    assert [(a.kind, a.rows) for a in actions] == [("compact", 24), ("compact", 24)]
    assert content(table.df()) == before == sorted(rows)
    assert table.hot().count() == 24 and table.cold().count() == 48
    assert table.maintain(now=2 * DAY + 3 * HOUR) == []


def test_margin_keeps_a_bucket_open(spark, table):
    table.insert(frame(spark, hourly([0])))
    assert table.maintain(now=DAY + 2 * HOUR - 1) == []
    assert [a.kind for a in table.maintain(now=DAY + 2 * HOUR)] == ["compact"]


def test_late_rows_make_a_follow_up_file(spark, table):
    table.insert(frame(spark, hourly([0])))
    table.maintain(now=2 * DAY)
    table.insert(frame(spark, [(5, "late", 9.0)]))
    table.maintain(now=2 * DAY)
    files = catalog.active(table.state)
    assert [e["seq"] for e in files] == [0, 1] and [e["rows"] for e in files] == [24, 1]
    assert table.df().count() == 25


def test_promotion_merges_and_collects(spark, table):
    table.insert(frame(spark, hourly(range(8))))
    actions = table.maintain(now=8 * DAY + 3 * HOUR, grace=0)
    merges = [a for a in actions if a.kind == "merge"]
    assert [(a.start, a.end, a.rows) for a in merges] == [(0, 7 * DAY, 168)]
    assert len(next(a for a in actions if a.kind == "collect").paths) == 7
    assert spans(table) == [(0, 7), (7, 8)] and table.df().count() == 192
    table.insert(frame(spark, [(1, "late", 1.0)]))
    table.maintain(now=8 * DAY + 3 * HOUR)
    assert spans(table) == [(0, 7), (7, 8)] and table.df().count() == 193


def test_three_tiers(spark, tmp_path):
    t = TieredTable.create(spark, "t", TDV, str(tmp_path), "1d,7d,28d")
    t.insert(frame(spark, [(d * DAY, "a", 1.0) for d in range(30)]))
    t.maintain(now=30 * DAY + 3 * HOUR)
    assert spans(t) == [(0, 28), (28, 29), (29, 30)]


def test_retention_is_whole_file(spark, table):
    table.set_retention("7d")
    with pytest.raises(BadSchema):
        table.set_retention("1d")
    table.insert(frame(spark, hourly(range(10))))
    table.maintain(now=10 * DAY + 3 * HOUR, grace=0)
    assert min(content(table.df()))[0] == 3 * DAY
    assert {e["status"] for e in table.state["files"]} == {"active", "purged"}


def test_unaligned_compaction(spark, table):
    table.insert(frame(spark, hourly([0, 1])))
    before = content(table.df())
    assert table.compact_bucket(5 * HOUR, 30 * HOUR).rows == 25
    assert table.compact_bucket(5 * HOUR, 30 * HOUR) is None
    assert content(table.df()) == before


def test_scan_prunes_by_range_series_and_column(spark, table):
    rows = hourly(range(6), "common") + [(2 * DAY + h * HOUR, "rare", 1.0) for h in range(24)]
    table.insert(frame(spark, rows))
    table.maintain(now=6 * DAY + 3 * HOUR)
    got, said = table.scan(eq={"device": "rare"})
    assert got.count() == 24 and said.series_pruned_files == 5 and said.scanned_files == 1
    got, said = table.scan(DAY, DAY + HOUR)
    assert got.count() == 2 and (said.total_files, said.candidate_files) == (6, 1)
    table.add_column("humidity REAL")
    got, said = table.scan(eq={"humidity": 3.0})
    assert got.count() == 0 and said.column_pruned_files == 6
    groups = table.row_groups(said, DAY, DAY + HOUR)
    assert groups.total_row_groups == 6 and groups.scanned_row_groups == 1


def test_filters_reach_the_files(spark, table):
    table.insert(frame(spark, hourly([0])))
    table.maintain(now=2 * DAY)
    plan = table.df().filter(table.between(0, HOUR)).select("value")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "ReadSchema: struct<ts:timestamp,value:double>" in plan


def test_missing_and_stray_files(spark, table):
    table.insert(frame(spark, hourly([0])))
    table.maintain(now=2 * DAY)
    frame(spark, hourly([5])).write.parquet(table.store.at("bucket-9-10-0.parquet"))
    assert table.df().count() == 24
    table.store.delete(catalog.active(table.state)[0]["path"])
    with pytest.raises(MissingFile):
        table.df()


def test_two_writers_cannot_both_publish(spark, table, tmp_path):
    other = TieredTable.open(spark, "readings", str(tmp_path))
    table.insert(frame(spark, hourly([0])))
    with pytest.raises(StrataError):
        other.insert(frame(spark, hourly([1])))
    assert other.refresh().insert(frame(spark, hourly([1]))) == 24
    assert table.refresh().df().count() == 48


def test_compaction_of_one_bucket_by_two_writers_loses_nothing(spark, table, tmp_path):
    table.insert(frame(spark, hourly([0])))
    late = TieredTable.open(spark, "readings", str(tmp_path))
    table.insert(frame(spark, [(7, "late", 1.0), (8, "late", 2.0)]))
    table.maintain(now=2 * DAY)
    with pytest.raises(StrataError, match="another writer"):
        late.maintain(now=2 * DAY)
    rows = sorted(hourly([0]) + [(7, "late", 1.0), (8, "late", 2.0)])
    assert content(table.refresh().df()) == rows
    assert [e["rows"] for e in catalog.active(table.state)] == [26] and table.cold().count() == 26
    late.refresh().maintain(now=2 * DAY)
    assert content(late.df()) == rows


def test_a_held_dataframe_reads_through_upkeep(spark, table):
    table.insert(frame(spark, hourly(range(8))))
    held = table.df()
    table.maintain(now=8 * DAY + 3 * HOUR)
    cold = table.cold()
    table.insert(frame(spark, [(1, "late", 1.0)]))
    table.maintain(now=8 * DAY + 3 * HOUR)
    assert held.count() == 192 and cold.count() == 168 + 24 and table.df().count() == 193
    table.maintain(now=8 * DAY + 3 * HOUR, grace=0)
    assert {e["status"] for e in table.state["files"]} == {"active", "purged"} and table.state["retired"] == []
    assert {n for n in table.store.children(table.store.folder) if n.startswith("bucket")} == {e["path"].rsplit("/", 1)[-1] for e in catalog.active(table.state)}
    assert table.df().count() == 193


def test_unpublished_leftovers_are_swept(spark, table):
    table.insert(frame(spark, hourly([0])))
    stray = table.store.at(f"bucket-0-{DAY}-{'0' * 32}.parquet")
    frame(spark, hourly([5])).write.parquet(stray)
    table.maintain(now=2 * DAY, grace=0)
    assert not table.store.exists(stray) and table.df().count() == 24


def test_a_file_of_other_columns_is_an_error(spark, table):
    table.insert(frame(spark, hourly([0, 1])))
    table.maintain(now=3 * DAY)
    assert table.verify_files() == 2
    path = catalog.active(table.state)[0]["path"]
    for select in ("ts, device, value as valeu", "ts, device, cast(value as string) as value"):
        table.store.delete(path)
        frame(spark, hourly([0])).selectExpr(*select.split(", ")).write.parquet(path)
        with pytest.raises(SchemaDrift):
            table.verify_files()


def test_many_deltas_and_statistics_are_merged(spark, table, monkeypatch):
    monkeypatch.setattr("strata.operators.table.FOLDERS", 2)
    rollup.create_rollup(table, "1h")
    rows = hourly([0])
    table.insert(frame(spark, rows))
    table.maintain(now=2 * DAY)
    for k in range(3):
        late = [(k * HOUR + 1, "late", float(k)), (k * HOUR + 2, None, None)]
        table.insert(frame(spark, late))
        table.maintain(now=2 * DAY)
        rows += late
    assert len(table.state["stats"]) <= 3 and len(table.state["rollups"][str(HOUR)]["segments"]) <= 3
    assert rolled(rollup.rollup_view(table, "1h")) == expected(rows, HOUR)
    assert table.file_stats().agg(F.sum("value_count")).first()[0] == 27


def test_tiered_rollup_follows_its_table(spark, table):
    rows = hourly(range(3))
    table.insert(frame(spark, rows))
    rollup.create_rollup(table, "1h")
    table.maintain(now=DAY + 3 * HOUR)
    target = rollup.tiered_rollup(table, "1h", "7d")
    assert target.df().count() == 24
    table.maintain(now=3 * DAY + 3 * HOUR)
    late = [(7, "a", 100.0), (2 * DAY + 9, "c", None)]
    table.insert(frame(spark, late))
    table.maintain(now=3 * DAY + 3 * HOUR)
    target.refresh().maintain(now=20 * DAY)
    assert target.cold().count() == 72 + 2 and target.hot().count() == 0
    fresh = [(4 * DAY, "a", 5.0)]
    table.insert(frame(spark, fresh))
    assert rolled(rollup.rollup_view(table, "1h")) == expected(rows + late + fresh, HOUR)
    # a run that stopped between its publish and the target's
    state = target.manifest.edit()
    state["batches"]["readings"] -= 1
    table.maintain(now=5 * DAY + 3 * HOUR)
    assert rolled(rollup.rollup_view(table, "1h")) == expected(rows + late + fresh, HOUR)


def test_batches_keep_the_last_number_only(spark, table):
    for n in range(3):
        assert table.insert(frame(spark, [(n, "a", 1.0)]), batch=f"s:{n}") == 1
    assert table.insert(frame(spark, [(9, "a", 1.0)]), batch="s:1") == 0 and table.insert(frame(spark, [(9, "a", 1.0)]), batch="once") == 1
    assert table.insert(frame(spark, [(9, "a", 1.0)]), batch="once") == 0 and table.state["batches"] == {"s": 2, "once": 0}


def test_refusals(spark, table, tmp_path):
    with pytest.raises(ImmutableHistory):
        table.update()
    with pytest.raises(NoPolicy):
        TieredTable.open(spark, "nope", str(tmp_path))
    with pytest.raises(SchemaDrift):
        TieredTable.create(spark, "readings", "ts TIMESTAMP, device REAL", str(tmp_path))
    with pytest.raises(BadSchema):
        TieredTable.create(spark, "readings", TDV, str(tmp_path), "1d,7d,origin=5")
    with pytest.raises(CompactError):
        table.insert(spark.createDataFrame([(1, "a", "x")], "ts long, device string, value string"))
    with pytest.raises(SchemaDrift):
        table.insert(spark.createDataFrame([(1,)], "other long"))
    with pytest.raises(Exception, match="ts is null"):
        table.insert(spark.createDataFrame([(None, "a", 1.0)], "ts long, device string, value double"))
    for bad in ("a REAL, b REAL", "a", "device TEXT"):
        with pytest.raises(BadSchema):
            table.add_column(bad)
    for tiers in ("", "7d,1d", "1d,36h", "1d,retain=3d"):
        with pytest.raises(BadSchema):
            TieredTable.create(spark, "x", TDV, str(tmp_path), tiers)


def expected(rows, grain):
    cells = defaultdict(list)
    for us, device, value in rows:
        cells[us - us % grain, device].append(value)
    out = {}
    for k, vs in cells.items():
        vs = [v for v in vs if v is not None]
        out[k] = (len(vs), sum(vs), sum(v * v for v in vs), min(vs, default=None), max(vs, default=None), sum(vs) / len(vs) if vs else None)
    return out


def rolled(df):
    return {(r.us, r.device): (r.value_count, r.value_sum, r.value_sumsq, r.value_min, r.value_max, r.value_avg) for r in df.withColumn("us", F.unix_micros("ts")).collect()}


def test_rollup_equals_raw_through_compaction_late_rows_and_merges(spark, table):
    rows = [(d * DAY + s * 20 * 60 * SECOND, dev, None if s % 7 == 3 else float((72 * d + s) * 0.25 % 50)) for d in range(3) for s in range(72) for dev in "ab"]
    rows += [(DAY, None, None)]
    table.insert(frame(spark, rows))
    table.compact_bucket(0, DAY)
    rollup.create_rollup(table, "1h")
    rollup.create_rollup(table, "4h")
    view = lambda g: rolled(rollup.rollup_view(table, g))
    assert view("1h") == expected(rows, HOUR) and view("4h") == expected(rows, 4 * HOUR)
    table.maintain(now=3 * DAY + 3 * HOUR)
    assert view("1h") == expected(rows, HOUR)
    late = [(7, "a", 100.0), (8, "c", None)]
    table.insert(frame(spark, late))
    assert view("1h") == expected(rows + late, HOUR)
    table.maintain(now=30 * DAY)
    assert view("4h") == expected(rows + late, 4 * HOUR)
    tiered = rollup.tiered_rollup(table, "1h")
    assert view("1h") == expected(rows + late, HOUR)
    assert tiered.df().select("ts", "device").distinct().count() == len(expected(rows + late, HOUR))
    rollup.drop_rollup(table, "4h")
    with pytest.raises(BadSchema):
        rollup.rollup_view(table, "4h")
    with pytest.raises(BadSchema):
        rollup.create_rollup(table, "7h")


def test_statistics_equal_raw_and_heal(spark, table):
    table.insert(frame(spark, hourly([0, 1], "a") + hourly([1], "b")))
    table.maintain(now=3 * DAY)
    total = table.file_stats().groupBy("device").agg(*stats.merged(["value"])).select("device", "value_count", "value_sum", stats.variance("value").alias("var"))
    assert {r.device: (r.value_count, r.value_sum, round(r["var"], 6)) for r in total.collect()} == {"a": (48, 552.0, 47.916667), "b": (24, 276.0, 47.916667)}
    state = table.manifest.edit()
    state["stats"] = []
    table.manifest = table.manifest.publish(state)
    assert [a.kind for a in table.maintain(now=3 * DAY)] == ["heal"]
    assert table.file_stats().count() == 3


def test_added_columns_read_null_in_old_rows(spark, table):
    table.insert(frame(spark, hourly([0])))
    rollup.create_rollup(table, "1h")
    table.maintain(now=2 * DAY)
    table.add_column("humidity REAL")
    wide = frame(spark, [(DAY + h * HOUR, "a", 1.0, float(h)) for h in range(24)], "ts long, device string, value double, humidity double")
    table.insert(wide)
    table.maintain(now=3 * DAY)
    assert table.df().filter("humidity is null").count() == 24
    cells = rollup.rollup_view(table, "1h").collect()
    assert {(r.humidity_count, r.humidity_sum) for r in cells if r.humidity_count} == {(1, float(h)) for h in range(24)}


def test_adopts_a_plain_table_and_detaches(spark, tmp_path):
    plain = spark.createDataFrame([(i * HOUR, i, 0.5 * i, "x", b"\x01") for i in range(30)], "ts long, id long, v double, s string, b binary")
    t = TieredTable.from_dataframe(plain, "adopted", str(tmp_path))
    t.view()
    assert spark.sql("SELECT count(*) FROM adopted WHERE id >= 3").first()[0] == 27
    t.maintain(now=3 * DAY)
    t.detach()
    assert TieredTable.open(spark, "adopted", str(tmp_path)).df().count() == 30


@pytest.mark.parametrize("seed", range(3))
def test_model(spark, tmp_path, seed):
    """Random inserts, upkeep and queries against a list."""
    rng = random.Random(seed)
    t = TieredTable.create(spark, f"m{seed}", TDV, str(tmp_path), "1d,7d")
    rollup.create_rollup(t, "1h")
    model, now = [], 0
    for _ in range(7):
        step = rng.choice(("insert", "insert", "maintain", "query"))
        if step == "insert":
            rows = [(rng.randrange(0, 20 * 24) * HOUR + 17, rng.choice("abc"), rng.choice((None, float(rng.randrange(50))))) for _ in range(rng.randrange(1, 30))]
            t.insert(frame(spark, rows))
            model += rows
        elif step == "maintain":
            now = max(now, rng.randrange(0, 25) * DAY)
            t.maintain(now=now)
        else:
            low = rng.randrange(0, 20 * 24) * HOUR
            high = low + rng.randrange(1, 200) * HOUR
            device = rng.choice("abc")
            got, _ = t.scan(low, high, {"device": device})
            assert got.count() == sum(low <= us <= high and d == device for us, d, _ in model)
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0)
    got = [(r.us, r.device, r.value) for r in t.df().select(F.unix_micros("ts").alias("us"), "device", "value").collect()]
    assert sorted(got, key=key) == sorted(model, key=key)
    assert rolled(rollup.rollup_view(t, "1h")) == expected(model, HOUR)
