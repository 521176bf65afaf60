"""Registered queries for upkeep, pruning, administration, refusals and the wire forms.

Each builds the table it needs once for each session and input, over all events, and
returns what it found as rows that its SQL can say as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.engine import Engine, Session
from strata.errors import StrataError
from strata.functions import schema as S
from strata.operators import catalog, rollup, stats
from strata.operators.table import TieredTable
from strata.plans.catalogue import CELLS, COLUMNS, DAY, FILES, HOUR, MID, NOW, ONE, RAW, SCHEMA, _cells, _cells_sql, _raw, averaged, events, floor_sql, query, read, rounded, table, work_dir
from strata.sources import influx_exec, influxql, lineproto

CUTOFF = NOW - 7_200_000_000
_made: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def fresh(spark: SparkSession, schema: str = SCHEMA, tiers: str = "1d,7d") -> TieredTable:
    return TieredTable.create(spark, "events", schema, work_dir(spark), tiers)


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(*COLUMNS)


def values_sql(columns: str, rows: list[tuple]) -> str:
    say = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::BIGINT" if isinstance(v, int) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) t({columns})"


# -- scans and pruning


@query("SELECT epoch_us(ts) AS us, event_type, value FROM events WHERE ts >= TIMESTAMP '2100-01-01'")
def empty_scan(spark, sf_dir):
    return _raw(table(spark, sf_dir).scan(low=NOW + 40_000 * DAY)[0])


@query("SELECT 0::BIGINT AS n, 0::BIGINT AS files")
def empty_table(spark, sf_dir):
    made = fresh(spark)
    return made.df().agg(F.count(F.lit(1)).alias("n")).withColumn("files", F.lit(len(made.maintain(NOW))).cast("long"))


@query(f"""{FILES}, g AS (SELECT DISTINCT range_start, CASE WHEN {floor_sql(7 * DAY).replace('epoch_us(ts)', 'range_start')} = range_start AND range_start + {7 * DAY} <= {CUTOFF} THEN range_start + {7 * DAY} ELSE range_start + {DAY} END AS range_end, event_type FROM f)
SELECT count(DISTINCT range_start) AS total_files, count(DISTINCT range_start) FILTER (range_start <= {MID + 3 * DAY} AND range_end > {MID}) AS candidate_files,
count(DISTINCT range_start) FILTER (range_start <= {MID + 3 * DAY} AND range_end > {MID} AND event_type = '{ONE}') AS scanned_files, true AS groups_pruned FROM g""")
def scan_metrics(spark, sf_dir):
    t = table(spark, sf_dir)
    said = t.scan(MID, MID + 3 * DAY, {"event_type": ONE})[1]
    groups = t.row_groups(said, MID, MID + HOUR)
    row = (said.total_files, said.candidate_files, said.scanned_files, 0 < groups.scanned_row_groups < groups.total_row_groups)
    return spark.createDataFrame([row], "total_files long, candidate_files long, scanned_files long, groups_pruned boolean")


@query("SELECT count(*) AS n, true AS files_pruned FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND value = (SELECT max(value) FROM events WHERE ts >= TIMESTAMP '2024-01-10')")
def absent_column_pruning(spark, sf_dir):
    t = table(spark, sf_dir, "altered")
    most = t.df().agg(F.max("doubled")).first()[0]
    rows, said = t.scan(eq={"doubled": most})
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("files_pruned", F.lit(said.column_pruned_files > 0))


@query(f"SELECT count(*) AS n, 0::BIGINT AS scanned_files FROM events WHERE event_type = 'nobody' AND epoch_us(ts) < {MID}")
def series_pruning_of_all_files(spark, sf_dir):
    rows, said = table(spark, sf_dir).scan(high=MID - 1, eq={"event_type": "nobody"})
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("scanned_files", F.lit(said.scanned_files).cast("long"))


@query(f"{FILES} SELECT count(DISTINCT range_start) AS files FROM f")
def verified_files(spark, sf_dir):
    """The footers of all active files have the table's columns."""
    return spark.createDataFrame([(table(spark, sf_dir).verify_files(),)], "files long")


# -- null keys

NULLED = "(SELECT ts, value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type FROM events)"


def nulls(spark: SparkSession, sf_dir: str) -> TieredTable:
    def make():
        made = fresh(spark)
        rows = read(spark, sf_dir, "events").withColumn("event_type", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("event_type")))
        made.insert(rows.select(*COLUMNS))
        rollup.create_rollup(made, "4h")
        made.maintain(NOW)
        return made

    return once(spark, sf_dir, "nulls", make)


@query(f"{FILES.replace('FROM events', f'FROM {NULLED}')} SELECT event_type, {CELLS} FROM f GROUP BY ALL")
def statistics_with_null_series(spark, sf_dir):
    return rounded(nulls(spark, sf_dir).file_stats().groupBy("event_type").agg(*stats.merged(["value"])))


@query(_cells_sql(4 * HOUR).replace("FROM events", f"FROM {NULLED}"))
def rollup_with_null_series(spark, sf_dir):
    return _cells(nulls(spark, sf_dir), "4h")


ANTI = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 1000 = 0 THEN NULL ELSE o_custkey END FROM orders{})"


@query(ANTI.format(" WHERE o_orderkey % 1000 <> 0 AND o_custkey % 5 <> 0") + " UNION ALL " + ANTI.format(""))
def anti_join_null_key(spark, sf_dir):
    """NOT IN knows no row where the list holds a null."""
    for n in ("customer", "orders"):
        read(spark, sf_dir, n).createOrReplaceTempView(f"strata_{n}")
    text = ANTI.replace("FROM customer", "FROM strata_customer").replace("FROM orders", "FROM strata_orders")
    return spark.sql(text.format(" WHERE o_orderkey % 1000 <> 0 AND o_custkey % 5 <> 0")).unionByName(spark.sql(text.format("")))


# -- windows


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY value RANGE BETWEEN 5 PRECEDING AND CURRENT ROW), 4) AS near FROM events")
def window_range_frame(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("value").rangeBetween(-5, 0)
    return read(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("near"))


@query("SELECT event_id, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)")
def window_distribution(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("value")
    return read(spark, sf_dir, "events").select("event_id", F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


# -- upkeep


@query(f"""WITH d AS (SELECT {floor_sql(DAY)} AS s, count(*) AS n FROM events GROUP BY 1), c AS (SELECT * FROM d WHERE s + {DAY} <= {CUTOFF})
SELECT 'compact' AS kind, s AS range_start, s + {DAY} AS range_end, n AS row_count FROM c
UNION ALL SELECT 'merge', w, w + {7 * DAY}, sum(n)::BIGINT FROM (SELECT {floor_sql(7 * DAY).replace('epoch_us(ts)', 's')} AS w, n FROM c) GROUP BY w HAVING w + {7 * DAY} <= {CUTOFF}""")
def maintain_report(spark, sf_dir):
    """What one call of upkeep over all events says it did."""

    def make():
        made = fresh(spark)
        made.insert(plain(spark, sf_dir))
        return [(a.kind, a.start, a.end, a.rows) for a in made.maintain(NOW)]

    return spark.createDataFrame(once(spark, sf_dir, "report", make), "kind string, range_start long, range_end long, row_count long")


@query(f"{FILES} SELECT 'hot' AS before, 'compacted' AS after, 'empty' AS far, count(*) FILTER (range_start >= 0) > 0 AS any_file FROM f")
def compact_outcomes(spark, sf_dir):
    made = fresh(spark)
    made.insert(plain(spark, sf_dir))
    before = made.bucket_state(MID, MID + DAY)
    done = made.compact_bucket(MID, MID + DAY)
    assert made.compact_bucket(MID, MID + DAY) is None
    row = (before, made.bucket_state(MID, MID + DAY), made.bucket_state(NOW + 99 * DAY, NOW + 100 * DAY), done is not None and done.rows > 0)
    return spark.createDataFrame([row], "before string, after string, far string, any_file boolean")


@query(f"{RAW} UNION ALL SELECT {MID}, 'late', 1.0 UNION ALL SELECT {MID} + 1, 'late', 2.0")
def concurrent_compaction(spark, sf_dir):
    """Two writers compact the same buckets, one of them from an older version; its publish is refused and no row is lost."""

    def make():
        first = fresh(spark)
        first.insert(plain(spark, sf_dir))
        other = TieredTable.open(spark, "events", first.state["policy"]["base_dir"])
        first.insert(spark.createDataFrame([(MID, "late", 1.0), (MID + 1, "late", 2.0)], "ts long, event_type string, value double").withColumn("ts", F.timestamp_micros("ts")))
        first.maintain(NOW)
        try:
            other.maintain(NOW)
            raise AssertionError("a writer of an older version published")
        except StrataError:
            return first.refresh()

    return _raw(once(spark, sf_dir, "concurrent", make).df())


@query(RAW)
def held_version(spark, sf_dir):
    """A DataFrame taken before upkeep reads the version it was taken from."""

    def make():
        made = fresh(spark)
        made.insert(plain(spark, sf_dir))
        rows = made.df()
        made.maintain(NOW)
        return rows

    return _raw(once(spark, sf_dir, "held", make))


@query(f"{FILES} SELECT event_type, {CELLS} FROM f GROUP BY ALL")
def statistics_healed(spark, sf_dir):
    """Statistics that went missing are taken again by the next upkeep."""

    def make():
        made = fresh(spark)
        made.insert(plain(spark, sf_dir))
        made.maintain(NOW)
        state = made.manifest.edit()
        state["stats"] = []
        made.manifest = made.manifest.publish(state)
        made.maintain(NOW)
        return made

    return rounded(once(spark, sf_dir, "healed", make).file_stats().groupBy("event_type").agg(*stats.merged(["value"])))


@query(f"{FILES} SELECT count(DISTINCT range_start) AS files, count(*) AS row_count, min(range_start) AS first_start FROM f")
def catalog_totals(spark, sf_dir):
    said = catalog.summary(table(spark, sf_dir).state)
    return spark.createDataFrame([(said["files"], said["rows"], said["start"])], "files long, row_count long, first_start long")


@query(f"SELECT {14 * DAY}::BIGINT AS retain_us, 'ts' AS ts_column")
def retention_policy(spark, sf_dir):
    return table(spark, sf_dir, "retained").policy_df().select("retain_us", "ts_column")


# -- rollups


def backfilled(spark: SparkSession, sf_dir: str) -> TieredTable:
    def make():
        made = fresh(spark)
        made.insert(plain(spark, sf_dir))
        made.maintain(NOW)
        rollup.create_rollup(made, "1h")
        rollup.create_rollup(made, "4h")
        rollup.drop_rollup(made, "4h")
        return made

    return once(spark, sf_dir, "backfilled", make)


@query(_cells_sql(HOUR))
def rollup_backfill(spark, sf_dir):
    return _cells(backfilled(spark, sf_dir), "1h")


@query("SELECT 'events_rollup_1h' AS name")
def rollup_dropped(spark, sf_dir):
    return spark.createDataFrame([(r["name"],) for r in backfilled(spark, sf_dir).state["rollups"].values()], "name string")


@query(_cells_sql(HOUR).replace("GROUP BY", f"WHERE {floor_sql(HOUR)} + {HOUR} > {NOW - 14 * DAY} GROUP BY"))
def rollup_retention(spark, sf_dir):
    """Cells go by their own end, not with the file that their rows were in."""

    def make():
        made = fresh(spark)
        made.set_retention("14d")
        made.insert(plain(spark, sf_dir))
        rollup.create_rollup(made, "1h")
        made.maintain(NOW)
        return made

    return _cells(once(spark, sf_dir, "rollup_retention", make), "1h")


@query(f"SELECT {floor_sql(HOUR)} AS bucket, event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-10' AND value IS NOT NULL) AS doubled_count, round(coalesce(sum(value * 2) FILTER (ts >= TIMESTAMP '2024-01-10'), 0), 4) AS doubled_sum FROM events GROUP BY 1, 2")
def rollup_added_column(spark, sf_dir):
    def make():
        rows, early = plain(spark, sf_dir), F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")
        made = fresh(spark)
        rollup.create_rollup(made, "1h")
        made.insert(rows.filter(early))
        made.maintain(NOW)
        made.add_column("doubled REAL")
        made.insert(rows.filter(~early).withColumn("doubled", F.col("value") * 2))
        made.maintain(NOW)
        return made

    view = rollup.rollup_view(once(spark, sf_dir, "rollup_added", make), "1h", register=False)
    return view.select(F.unix_micros("ts").alias("bucket"), "event_type", "doubled_count", F.round("doubled_sum", 4).alias("doubled_sum"))


def tiered(spark: SparkSession, sf_dir: str) -> TieredTable:
    def make():
        source = read(spark, sf_dir, "events")
        made = fresh(spark)
        rollup.create_rollup(made, "1h")
        made.insert(source.filter("event_id % 10 <> 0").select(*COLUMNS))
        made.maintain(MID)
        target = rollup.tiered_rollup(made, "1h", "7d")
        made.maintain(NOW)
        made.insert(source.filter("event_id % 10 = 0").select(*COLUMNS))
        made.maintain(NOW)
        target.refresh().maintain(NOW)
        return made

    return once(spark, sf_dir, "tiered", make)


@query(_cells_sql(HOUR))
def tiered_rollup(spark, sf_dir):
    """A rollup with tiers of its own, through upkeep of both tables and late rows."""
    return _cells(tiered(spark, sf_dir), "1h")


@query(_cells_sql(DAY).replace("FROM events", f"FROM events WHERE {floor_sql(DAY)} + {DAY} <= {CUTOFF}"))
def tiered_rollup_cells(spark, sf_dir):
    """The tiered target alone, merged by day: all compacted rows and no live one."""
    made = tiered(spark, sf_dir)
    target = TieredTable.open(spark, "events_rollup_1h", made.state["policy"]["base_dir"])
    out = target.df().groupBy(F.unix_micros(F.date_trunc("day", "ts")).alias("bucket"), "event_type").agg(*stats.merged(["value"]))
    return averaged(out)


# -- the engine (W10, O5, L2, L4, L14, L15, X3, Z)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    def make():
        read(spark, sf_dir, "events").select(*COLUMNS, "event_id").createOrReplaceTempView("adopted")
        made = Engine(spark, work_dir(spark), "1d,7d", max_rows=5)
        made.sql("SELECT strata_create_table('adopted', 'ts', '1d,7d')")
        made.sql("SELECT strata_set_retention('adopted', '90d')")
        made.sql("SELECT strata_add_column('adopted', 'extra REAL')")
        made.maintain("adopted", now=NOW)
        made.create_key("reader", "readonly", ["adopted"])
        made.set_config("owner", "plant")
        made.create_key("gone")
        made.revoke_key("gone")
        return made

    return once(spark, sf_dir, "engine", make)


@query("SELECT event_id, true AS truncated FROM events ORDER BY event_id LIMIT 5")
def capped_result(spark, sf_dir):
    """A result on the wire has at most ``max_rows`` rows and says so."""
    got = engine(spark, sf_dir).rows("SELECT event_id FROM adopted ORDER BY event_id")
    return spark.createDataFrame([(*r, got["truncated"]) for r in got["rows"]], "event_id long, truncated boolean")


PRUNED = f"FROM {{}} WHERE event_type = '{ONE}' AND ts >= TIMESTAMP '2024-01-15 12:00:00' AND ts < TIMESTAMP '2024-01-15 13:00:00'"


@query(f"SELECT count(*) AS n, round(avg(value), 6) AS avg_value, true AS fewer_files {PRUNED.format('events')}")
def sql_prunes_files(spark, sf_dir):
    """SQL over a tiered table reads the files that its conditions leave, as ``scan`` does."""
    made = engine(spark, sf_dir)
    rows = made.sql(f"SELECT count(*) AS n, round(avg(value), 6) AS avg_value {PRUNED.format('adopted')}")
    return rows.withColumn("fewer_files", F.lit(len(rows.inputFiles()) < len(made.sql("SELECT * FROM adopted").inputFiles()) / 2))


@query("SELECT event_type, count(*) AS n, count(CASE WHEN false THEN 1 END) AS extras, round(sum(value), 4) AS total FROM events GROUP BY 1")
def converted_table(spark, sf_dir):
    """A plain table adopted, kept up, dropped and taken up again by another engine."""
    made = engine(spark, sf_dir)
    again = Engine(spark, made.home)
    return again.sql("SELECT event_type, count(*) AS n, count(extra) AS extras, round(sum(value), 4) AS total FROM adopted GROUP BY 1")


@query(f"SELECT count(*) FILTER ({floor_sql(DAY)} + {DAY} <= {CUTOFF}) AS cold_rows, count(*) FILTER ({floor_sql(DAY)} + {DAY} > {CUTOFF}) AS hot_rows FROM events")
def engine_health(spark, sf_dir):
    return engine(spark, sf_dir).health().select("cold_rows", "hot_rows")


@query(values_sql("name, role, scope, revoked", [("gone", "readonly", None, True), ("reader", "readonly", "adopted", False)]))
def kept_keys(spark, sf_dir):
    """Keys as another engine finds them in the same folder."""
    return Engine(spark, engine(spark, sf_dir).home).list_keys().withColumn("scope", F.array_join("scope", ","))


@query(values_sql("name, value", [("owner", "plant")]))
def kept_settings(spark, sf_dir):
    return Engine(spark, engine(spark, sf_dir).home).config().filter("name <> 'default_dir'")


@query(values_sql("logical_table, grain_us, rollup_table", [("events", HOUR, "events_rollup_1h"), ("events", 4 * HOUR, "events_rollup_4h")]))
def rollup_registry(spark, sf_dir):
    return table(spark, sf_dir).rollups_df()


def told(run: Callable) -> str:
    """The name of the error that ``run`` raises."""
    try:
        run()
    except StrataError as e:
        return type(e).__name__
    return "none"


SCOPED = [
    ("SELECT count(*) FROM adopted", "none"),
    ("WITH x AS (SELECT * FROM adopted) SELECT count(*) FROM x", "none"),
    ("SELECT count(*) FROM adopted__catalog", "none"),
    ("SELECT count(*) FROM secret", "Denied"),
    ("WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", "Denied"),
    ("SELECT (SELECT count(*) FROM secret) FROM adopted", "Denied"),
    ("EXPLAIN SELECT * FROM secret", "Denied"),
    ("DROP TABLE adopted", "Denied"),
    ("SELECT strata_maintain('adopted')", "Denied"),
]


@query(values_sql("statement, error", SCOPED))
def scoped_statements(spark, sf_dir):
    """What a key that may read one table is told."""
    made = engine(spark, sf_dir)
    spark.range(1).createOrReplaceTempView("secret")
    session = Session("readonly", frozenset(("adopted",)))
    return spark.createDataFrame([(text, told(lambda: made.sql(text, session=session))) for text, _ in SCOPED], "statement string, error string")


REFUSED = [
    ("column of an unsupported type", "BadSchema"),
    ("tiers that do not ascend", "BadSchema"),
    ("another origin", "BadSchema"),
    ("grain that does not divide the tier", "BadSchema"),
    ("retention below the largest tier", "BadSchema"),
    ("two columns at once", "BadSchema"),
    ("a column that is there", "BadSchema"),
    ("other columns than stored", "SchemaDrift"),
    ("a row of unknown columns", "SchemaDrift"),
    ("a file of other columns", "SchemaDrift"),
    ("a value of another class", "CompactError"),
    ("no axis", "AxisError"),
    ("two axes", "AxisError"),
    ("a nested type", "UnsupportedType"),
    ("a table that is not there", "NoPolicy"),
    ("an update", "ImmutableHistory"),
    ("a delete", "ImmutableHistory"),
    ("a file that is gone", "MissingFile"),
    ("InfluxQL outside the subset", "QueryError"),
    ("a regular expression outside the subset", "QueryError"),
    ("a line without fields", "LineError"),
    ("a measurement of two words", "LineError"),
    ("a line that writes the axis", "LineError"),
    ("a key's name twice", "StrataError"),
    ("a role that is not there", "StrataError"),
    ("a secret that is not there", "Denied"),
    ("a write by a reader", "Denied"),
]


@query(values_sql("what, error", REFUSED))
def refused_operations(spark, sf_dir):
    """Each error of the engine, by the operation that raises it; none changes anything."""

    def make():
        t, made = fresh(spark), engine(spark, sf_dir)
        base = t.state["policy"]["base_dir"]
        day = spark.createDataFrame([(MID, "a", 1.0)], "ts long, event_type string, value double").withColumn("ts", F.timestamp_micros("ts"))
        t.insert(day)
        rollup.create_rollup(t, "1h")
        new = lambda schema, tiers="1d,7d", name="other": TieredTable.create(spark, name, schema, base, tiers)

        def odd_file(gone: bool):
            hurt = TieredTable.create(spark, f"hurt{int(gone)}", SCHEMA, base)
            hurt.insert(day)
            hurt.maintain(MID + 3 * DAY)
            path = catalog.active(hurt.state)[0]["path"]
            hurt.store.delete(path)
            if not gone:
                day.withColumnRenamed("value", "worth").write.parquet(path)
            return hurt

        runs = [
            lambda: new("ts TIMESTAMP, a DECIMAL(3)"),
            lambda: new("ts TIMESTAMP, a REAL", "7d,1d"),
            lambda: new(SCHEMA, "1d,7d,origin=5", "events"),
            lambda: rollup.create_rollup(t, "7h"),
            lambda: t.set_retention("1d"),
            lambda: t.add_column("a REAL, b REAL"),
            lambda: t.add_column("value REAL"),
            lambda: new("ts TIMESTAMP, event_type REAL", name="events"),
            lambda: t.insert(day.withColumn("more", F.lit(1))),
            lambda: odd_file(False).verify_files(),
            lambda: t.insert(day.withColumn("value", F.lit("x"))),
            lambda: new("value REAL"),
            lambda: new("a TIMESTAMP, b TIMESTAMP"),
            lambda: S.storage_of(read(spark, sf_dir, "embeddings").schema["embedding"].dataType),
            lambda: TieredTable.open(spark, "nowhere", base),
            t.update,
            t.delete,
            lambda: odd_file(True).df(),
            lambda: influxql.parse("SELECT derivative(value) FROM events", NOW),
            lambda: influxql.parse("SELECT value FROM events WHERE event_type =~ /c.+k/", NOW),
            lambda: lineproto.parse("events,event_type=a"),
            lambda: lineproto.parse("two words v=1"),
            lambda: lineproto.parse("events ts=5i"),
            lambda: made.create_key("reader"),
            lambda: made.create_key("x", "owner"),
            lambda: made.authenticate("nothing"),
            lambda: made.write_lines("adopted value=1 5", session=Session("readonly")),
        ]
        return [(what, told(run)) for (what, _), run in zip(REFUSED, runs, strict=True)]

    return spark.createDataFrame(once(spark, sf_dir, "refused", make), "what string, error string")


# -- InfluxQL and lines


def influx(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return influx_exec.query(spark, {"events": table(spark, sf_dir)}, text, NOW)


@query(f"SELECT 0::BIGINT + {NOW - 9 * DAY} AS time, count(value) AS count FROM events WHERE epoch_us(ts) >= {NOW - 9 * DAY} AND epoch_us(ts) <= {NOW - 36 * HOUR}")
def influx_now_minus(spark, sf_dir):
    return influx(spark, sf_dir, "SELECT count(value) FROM events WHERE time >= now() - 9d AND time <= now() - 1d - 12h")


@query(f"SELECT {floor_sql(DAY)} AS time, round(max(value), 6) AS max_value FROM events GROUP BY 1")
def influx_star(spark, sf_dir):
    out = influx(spark, sf_dir, "SELECT max(*) FROM events GROUP BY time(1d)")
    name = next(c for c in out.columns if c != "time")
    return out.select("time", F.round(name, 6).alias("max_value"))


@query(f"SELECT {floor_sql(HOUR)} AS time, event_type, round(coalesce(sum(CASE WHEN event_type = '{ONE}' THEN value END), 0), 4) AS total FROM (SELECT ts, event_type, value FROM events) GROUP BY 1, 2")
def influx_fill_zero(spark, sf_dir):
    """A bucket whose values are all null is filled with zero; only clicks have values here."""

    def make():
        made = fresh(spark)
        made.insert(plain(spark, sf_dir).withColumn("value", F.when(F.col("event_type") == ONE, F.col("value"))))
        made.maintain(NOW)
        return made

    out = influx_exec.query(spark, {"events": once(spark, sf_dir, "clicks", make)}, "SELECT sum(value) AS total FROM events GROUP BY time(1h), event_type fill(0)", NOW)
    return out.withColumn("total", F.round("total", 4))


@query("SELECT count(value) AS count FROM events")
def influx_match_all(spark, sf_dir):
    """The empty choice of a dashboard's variable matches everything."""
    return influx(spark, sf_dir, "SELECT count(value) FROM events WHERE event_type =~ /^()$/").select("count")


@query("SELECT event_type, epoch_us(max(ts)) // 1000000 AS s, epoch_us(max(ts)) // 1000 AS ms, epoch_us(max(ts)) AS us, epoch_us(max(ts)) * 1000 AS ns FROM events GROUP BY 1")
def influx_epochs(spark, sf_dir):
    """The wire form: one series a tag value, its time in each unit."""
    found: dict[str, list[int]] = {}
    for unit in ("s", "ms", "us", "ns"):
        said = influx_exec.series_json(spark, {"events": table(spark, sf_dir)}, "SELECT last(value) FROM events GROUP BY event_type", NOW, unit)
        for series in said["results"][0]["series"]:
            found.setdefault(series["tags"]["event_type"], []).append(series["values"][0][0])
    return spark.createDataFrame([(k, *v) for k, v in found.items()], "event_type string, s long, ms long, us long, ns long")


STATEMENTS = [("SHOW DATABASES", 1, False), ("SHOW RETENTION POLICIES", 1, False), ("SHOW MEASUREMENTS", 1, False), ("SHOW TAG KEYS", 1, False), ("SELECT value FROM nowhere", 0, False), ("SELECT nothing FROM events", 0, True), ("SELECT ';' FROM", 0, True)]


@query(values_sql("statement, series, failed", STATEMENTS))
def influx_statements(spark, sf_dir):
    """Several statements in one text: each has its own result, an unknown name an empty one, an error its own."""
    said = influx_exec.series_json(spark, {"events": table(spark, sf_dir)}, ";".join(text for text, *_ in STATEMENTS), NOW)["results"]
    rows = [(text, len(r.get("series", [])), "error" in r) for (text, *_), r in zip(STATEMENTS, said, strict=True)]
    return spark.createDataFrame(rows, "statement string, series long, failed boolean")


@query("SELECT event_id, (epoch_us(ts) // 1000) * 1000 AS us FROM events")
def line_precision(spark, sf_dir):
    """Every event as a line with a time in milliseconds."""
    path = work_dir(spark)
    line = F.concat(F.lit("events id="), F.col("event_id").cast("string"), F.lit("i "), F.floor(F.col("us") / 1000).cast("string"))
    events(spark, sf_dir).select(line.alias("value")).write.text(path)
    return lineproto.read_lines(spark, path, "ms").select(F.col("integers")["id"].alias("event_id"), F.col("ts_us").alias("us"))


LINES = 'pump,hall=a speed=1.5,n=2i 1000\npump,hall=b speed=2i,note="x" 2000\ntank level=7 3000'
COLUMNS_OF_LINES = [("pump", "ts", "INTEGER"), ("pump", "hall", "TEXT"), ("pump", "speed", "REAL"), ("pump", "n", "INTEGER"), ("pump", "note", "TEXT"), ("tank", "ts", "INTEGER"), ("tank", "level", "REAL")]


@query(values_sql("name, col, class, row_count", [(*r, 2 if r[0] == "pump" else 1) for r in COLUMNS_OF_LINES]))
def lines_make_tables(spark, sf_dir):
    """Tables as the lines declare them; a batch that fails on its second table leaves no row in the first."""

    def make():
        made = Engine(spark, work_dir(spark))
        made.write_lines(LINES)
        assert told(lambda: made.write_lines('pump,hall=c speed=9 4000\ntank level="x" 4000')) == "BadSchema"
        return [(n, c.name, c.storage, t.df().count()) for n, t in made.tables.items() for c in t.columns]

    return spark.createDataFrame(once(spark, sf_dir, "lines", make), "name string, col string, class string, row_count long")
