"""The engine's registered queries and the SQL that checks them.

Events play the readings: axis ``ts``, series ``event_type``, measure ``value``.
Lifecycle queries build a tiered table once for each session and input, in the shared
folder of the session, and read it; nothing is cut off or sampled.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import timefn
from strata.functions.timefn import bucket, parse_timestamp, to_micros
from strata.operators import rollup, stats
from strata.operators.table import TieredTable
from strata.sources import influx_exec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOUR, DAY = 3600 * timefn.SECOND, 86400 * timefn.SECOND
#: the middle of the events: a day boundary and noon of that day
MID = parse_timestamp("2024-01-15")
NOON = MID + 12 * HOUR
#: when the upkeep of the lifecycle queries runs; later events stay hot
NOW = parse_timestamp("2024-01-25T03:00:00")
ONE = "click"


def query(sql: str | None = None):
    def add(run: Query) -> Query:
        def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, sf_dir)

        QUERIES[run.__name__] = settled
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("us", to_micros(F.col("ts")))


def work_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        told = tempfile.gettempdir() if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{told}/strata-{uuid.uuid4().hex}"


_built: dict[tuple, TieredTable] = {}
SCHEMA = "ts TIMESTAMP, event_type TEXT, value REAL"
COLUMNS = ["ts", "event_type", "value"]
#: every column of the events, without rollups: each row is a series of its own there
WIDE_SCHEMA = "ts TIMESTAMP, event_id INTEGER, user_id INTEGER, event_type TEXT, value REAL, props TEXT"
WIDE_COLUMNS = ["ts", "event_id", "user_id", "event_type", "value", "props"]


def table(spark: SparkSession, sf_dir: str, kind: str = "plain", wide: bool = False) -> TieredTable:
    """The events as a tiered table at one of several points of its life."""
    key = (spark.sparkContext.applicationId, sf_dir, kind, wide)
    if key in _built:
        return _built[key]
    source = read(spark, sf_dir, "events")
    columns = WIDE_COLUMNS if wide else COLUMNS
    rows = source.select(*columns)
    tiers = "1d,7d,origin=2024-01-01" if kind == "monday" else "1d,7d"
    made = TieredTable.create(spark, "events", WIDE_SCHEMA if wide else SCHEMA, work_dir(spark), tiers)
    if kind == "late":
        made.insert(source.filter("event_id % 10 <> 0").select(*columns))
        if not wide:
            rollup.create_rollup(made, "1h")
        made.maintain(NOW)
        made.insert(source.filter("event_id % 10 = 0").select(*columns))
        made.maintain(NOW)
    elif kind == "altered":
        early = F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")
        made.insert(rows.filter(early))
        made.maintain(NOW)
        made.add_column("doubled REAL")
        made.insert(rows.filter(~early).withColumn("doubled", F.col("value") * 2))
        made.maintain(NOW)
    else:
        made.insert(rows)
        if kind == "retained":
            made.set_retention("14d")
        elif not wide:
            rollup.create_rollup(made, "1h")
            rollup.create_rollup(made, "4h")
        made.maintain(NOW)
    _built[key] = made
    return made


CELLS = "count(value) AS value_count, round(coalesce(sum(value), 0), 4) AS value_sum, round(coalesce(sum(value * value), 0), 4) AS value_sumsq, min(value) AS value_min, max(value) AS value_max"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"value_sum": F.round("value_sum", 4), "value_sumsq": F.round("value_sumsq", 4)})


def averaged(df: DataFrame) -> DataFrame:
    """Rounded sums and the averages that follow from them, the same in any engine."""
    return rounded(df).withColumn("value_avg", stats.average("value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly continuous aggregate, straight from the events."""
    rows = events(spark, sf_dir).withColumn("bucket", bucket(F.col("us"), "1h"))
    return rows.groupBy("bucket", "event_type").agg(*stats.cells(["value"])).withColumn("value_avg", stats.average("value"))


# -- the reference benchmark's ranges

RANGES = {"hour": (NOON, NOON + HOUR), "day": (MID, MID + DAY), "week": (MID, MID + 7 * DAY)}


def _in_range(low: int, high: int) -> str:
    return f"epoch_us(ts) >= {low} AND epoch_us(ts) < {high}"


@query(f"SELECT count(*) AS n, round(avg(value), 6) AS avg_value FROM events WHERE {_in_range(*RANGES['hour'])} AND event_type = '{ONE}'")
def range_hour_one_series(spark, sf_dir):
    low, high = RANGES["hour"]
    rows, _ = table(spark, sf_dir).scan(low, high - 1, {"event_type": ONE})
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


@query(f"SELECT count(*) AS n, round(avg(value), 6) AS avg_value FROM events WHERE {_in_range(*RANGES['day'])}")
def range_day_all_series(spark, sf_dir):
    low, high = RANGES["day"]
    return table(spark, sf_dir).scan(low, high - 1)[0].agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


@query(f"SELECT count(*) AS n, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value FROM events WHERE {_in_range(*RANGES['week'])} AND event_type = '{ONE}'")
def range_week_one_series(spark, sf_dir):
    low, high = RANGES["week"]
    rows, _ = table(spark, sf_dir).scan(low, high - 1, {"event_type": ONE})
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


@query(f"SELECT count(*) AS n, round(avg(value), 6) AS avg_value FROM events WHERE {_in_range(*RANGES['week'])}")
def range_week_all_series(spark, sf_dir):
    low, high = RANGES["week"]
    return table(spark, sf_dir).scan(low, high - 1)[0].agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


@query("SELECT count(*) AS n, round(avg(value), 6) AS avg_value FROM events")
def full_aggregate(spark, sf_dir):
    return table(spark, sf_dir).df().agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


# -- scalars and buckets


def floor_sql(width: int, origin: int = 0) -> str:
    x = f"(epoch_us(ts) - {origin})"
    return f"(epoch_us(ts) - ((({x} % {width}) + {width}) % {width}))"


@query(f"SELECT {floor_sql(HOUR)} AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def bucket_hour(spark, sf_dir):
    return events(spark, sf_dir).groupBy(bucket(F.col("us"), "1h").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"SELECT {floor_sql(7 * DAY, parse_timestamp('2024-01-01'))} AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def bucket_week_monday_origin(spark, sf_dir):
    return events(spark, sf_dir).groupBy(bucket(F.col("us"), "7d", "2024-01-01").alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {floor_sql(5 * DAY, parse_timestamp('2030-06-01'))} AS bucket, count(*) AS n FROM events GROUP BY ALL")
def bucket_before_origin(spark, sf_dir):
    timefn.register(spark)
    events(spark, sf_dir).createOrReplaceTempView("strata_events")
    return spark.sql("SELECT strata_bucket('5d', us, '2030-06-01') AS bucket, count(*) AS n FROM strata_events GROUP BY 1")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN 'Z' ELSE strftime(ts, '.%fZ') END AS iso, epoch_us(ts) AS us FROM events")
def timestamp_round_trip(spark, sf_dir):
    timefn.register(spark)
    events(spark, sf_dir).createOrReplaceTempView("strata_events")
    return spark.sql("SELECT event_id, iso, strata_ts(iso) AS us FROM (SELECT event_id, strata_datetime(us) AS iso FROM strata_events)")


@query(f"SELECT {floor_sql(DAY)} AS bucket, count(*) AS n FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("bucket"), "n")


# -- tiers and lifecycle (S, W, L)

RAW = "SELECT epoch_us(ts) AS us, event_type, value FROM events"


def _raw(rows: DataFrame) -> DataFrame:
    return rows.select(F.unix_micros("ts").alias("us"), "event_type", "value")


@query(RAW)
def tier_view_equals_raw(spark, sf_dir):
    return _raw(table(spark, sf_dir).df())


@query(RAW)
def tier_after_late_rows(spark, sf_dir):
    return _raw(table(spark, sf_dir, "late").df())


@query(f"{RAW} WHERE epoch_us(ts) < {parse_timestamp('2024-01-25')}")
def cold_only(spark, sf_dir):
    return _raw(table(spark, sf_dir).cold())


@query(f"{RAW} WHERE epoch_us(ts) >= {parse_timestamp('2024-01-25')}")
def hot_only(spark, sf_dir):
    return _raw(table(spark, sf_dir).hot())


# the same with every column of the events, rows told apart by their ids

WIDE = "SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, props FROM events"


def _wide(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", F.unix_micros("ts").alias("us"), "user_id", "event_type", "value", "props")


@query(WIDE)
def wide_view_equals_raw(spark, sf_dir):
    return _wide(table(spark, sf_dir, wide=True).df())


@query(WIDE)
def wide_after_late_rows(spark, sf_dir):
    return _wide(table(spark, sf_dir, "late", wide=True).df())


@query(f"{WIDE} WHERE epoch_us(ts) < {parse_timestamp('2024-01-25')}")
def wide_cold_only(spark, sf_dir):
    return _wide(table(spark, sf_dir, wide=True).cold())


@query(f"{WIDE} WHERE epoch_us(ts) >= {parse_timestamp('2024-01-25')}")
def wide_hot_only(spark, sf_dir):
    return _wide(table(spark, sf_dir, wide=True).hot())


@query(f"{WIDE} WHERE {floor_sql(DAY)} + {DAY} > {NOW - 14 * DAY}")
def wide_retention_view(spark, sf_dir):
    return _wide(table(spark, sf_dir, "retained", wide=True).df())


@query("SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN value * 2 END AS doubled FROM events")
def wide_alter_null_history(spark, sf_dir):
    return table(spark, sf_dir, "altered", wide=True).df().select("event_id", "doubled")


# the tier grid starts at the epoch, a Thursday; on a retained table weeks go when their end is 14 days old
@query(f"""WITH f AS (SELECT epoch_us(ts) AS us, event_type, value, {floor_sql(DAY)} + {DAY} AS day_end FROM events)
SELECT us, event_type, value FROM f WHERE day_end > {NOW - 14 * DAY}""")
def retention_view(spark, sf_dir):
    return _raw(table(spark, sf_dir, "retained").df())


@query(f"""WITH f AS (SELECT {floor_sql(DAY)} AS d, {floor_sql(7 * DAY)} AS w FROM events),
g AS (SELECT CASE WHEN w + {7 * DAY} <= {NOW} - 7200000000 THEN w ELSE d END AS range_start, CASE WHEN w + {7 * DAY} <= {NOW} - 7200000000 THEN w + {7 * DAY} ELSE d + {DAY} END AS range_end FROM f WHERE d + {DAY} <= {NOW} - 7200000000)
SELECT range_start, range_end, count(*) AS row_count FROM g GROUP BY ALL""")
def catalog_active_files(spark, sf_dir):
    found = table(spark, sf_dir).catalog_df().filter("status = 'active'")
    return found.select("range_start", "range_end", "row_count")


@query("SELECT '86400000000,604800000000' AS tiers_us, 7200000000::BIGINT AS safety_margin_us, 0::BIGINT AS origin_us, 'ts' AS ts_column")
def policy_table(spark, sf_dir):
    return table(spark, sf_dir).policy_df().select("tiers_us", "safety_margin_us", "origin_us", "ts_column")


@query("SELECT epoch_us(ts) AS us, CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN value * 2 END AS doubled FROM events")
def alter_null_history(spark, sf_dir):
    return table(spark, sf_dir, "altered").df().select(F.unix_micros("ts").alias("us"), "doubled")


@query(f"SELECT {floor_sql(7 * DAY, parse_timestamp('2024-01-01'))} AS range_start, count(*) AS n FROM events WHERE {floor_sql(7 * DAY, parse_timestamp('2024-01-01'))} + {7 * DAY} <= {NOW} - 7200000000 GROUP BY 1")
def merged_windows_on_origin(spark, sf_dir):
    found = table(spark, sf_dir, "monday").catalog_df().filter("status = 'active'").filter(F.col("range_end") - F.col("range_start") == 7 * DAY)
    return found.select("range_start", F.col("row_count").alias("n"))


# -- statistics and rollups (A, R, L12)

FILES = f"""WITH f AS (SELECT event_type, value, CASE WHEN {floor_sql(7 * DAY)} + {7 * DAY} <= {NOW} - 7200000000 THEN {floor_sql(7 * DAY)} ELSE {floor_sql(DAY)} END AS range_start FROM events WHERE {floor_sql(DAY)} + {DAY} <= {NOW} - 7200000000)"""


@query(f"{FILES} SELECT range_start, event_type, {CELLS} FROM f GROUP BY ALL")
def file_statistics(spark, sf_dir):
    t = table(spark, sf_dir)
    cells = t.file_stats().join(t.catalog_df().select("path", "range_start"), "path")
    return rounded(cells.groupBy("range_start", "event_type").agg(*stats.merged(["value"])))


@query(f"{FILES} SELECT event_type, {CELLS} FROM f GROUP BY ALL")
def statistics_total(spark, sf_dir):
    return rounded(table(spark, sf_dir).file_stats().groupBy("event_type").agg(*stats.merged(["value"])))


@query("SELECT event_type, round(stddev_pop(value), 4) AS sd, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stddev_from_statistics(spark, sf_dir):
    cells = events(spark, sf_dir).groupBy("event_type").agg(*stats.cells(["value"]))
    return cells.select("event_type", F.round(stats.deviation("value"), 4).alias("sd"), F.round(stats.average("value"), 6).alias("mean"))


def _cells_sql(grain: int) -> str:
    return f"SELECT {floor_sql(grain)} AS bucket, event_type, {CELLS}, round(sum(value), 4) / nullif(count(value), 0) AS value_avg FROM events GROUP BY 1, 2"


def _cells(t: TieredTable, grain: str) -> DataFrame:
    view = rollup.rollup_view(t, grain, register=False)
    return averaged(view.withColumn("bucket", F.unix_micros("ts")).drop("ts"))


@query(_cells_sql(HOUR))
def rollup_1h(spark, sf_dir):
    return _cells(table(spark, sf_dir), "1h")


@query(_cells_sql(4 * HOUR))
def rollup_4h(spark, sf_dir):
    return _cells(table(spark, sf_dir), "4h")


@query(_cells_sql(HOUR))
def rollup_late(spark, sf_dir):
    return _cells(table(spark, sf_dir, "late"), "1h")


@query(_cells_sql(DAY))
def rollup_from_rollup(spark, sf_dir):
    view = rollup.rollup_view(table(spark, sf_dir), "1h", register=False)
    out = view.groupBy(bucket(F.unix_micros("ts"), "1d").alias("bucket"), "event_type").agg(*stats.merged(["value"]))
    return averaged(out)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1 HAVING count(*) > 10")
def group_having(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))
    return rows.filter("n > 10")


# -- InfluxQL (I, P8, A6-A8, O3-O4)


def influx(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return influx_exec.query(spark, {"events": table(spark, sf_dir)}, text, NOW)


@query(f"SELECT {floor_sql(2 * HOUR)} AS time, event_type, round(avg(value), 6) AS mean FROM events WHERE epoch_us(ts) >= {MID} AND epoch_us(ts) <= {MID + 7 * DAY} GROUP BY 1, 2")
def influx_mean_by_time_tag(spark, sf_dir):
    out = influx(spark, sf_dir, f'SELECT mean("value") FROM "events" WHERE time >= {MID // 1000}ms AND time <= {(MID + 7 * DAY) // 1000}ms GROUP BY time(2h), "event_type" fill(null)')
    return out.withColumn("mean", F.round("mean", 6))


def _edge_sql(agg: str) -> str:
    return f"SELECT epoch_us({'min' if agg == 'first' else 'max'}(ts)) AS time, event_type, {'arg_min' if agg == 'first' else 'arg_max'}(value, ts) AS {agg} FROM events GROUP BY event_type"


@query(_edge_sql("first"))
def influx_first(spark, sf_dir):
    return influx(spark, sf_dir, 'SELECT first("value") FROM "events" GROUP BY "event_type"')


@query(_edge_sql("last"))
def influx_last(spark, sf_dir):
    return influx(spark, sf_dir, 'SELECT last("value") FROM "events" GROUP BY *')


@query(f"SELECT {floor_sql(DAY)} AS time, round(max(value) - min(value), 6) AS spread, count(value) AS count FROM events GROUP BY 1")
def influx_spread(spark, sf_dir):
    return influx(spark, sf_dir, 'SELECT spread("value"), count("value") FROM "events" GROUP BY time(1d)').withColumn("spread", F.round("spread", 6))


@query(f"SELECT {floor_sql(6 * HOUR)} AS time, round(sum(value), 4) AS sum FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def influx_in_regex(spark, sf_dir):
    return influx(spark, sf_dir, 'SELECT sum("value") FROM "events" WHERE "event_type" =~ /^(click|view)$/ GROUP BY time(6h)').withColumn("sum", F.round("sum", 4))


@query(f"SELECT epoch_us(ts) AS time, value FROM events WHERE event_type = '{ONE}' ORDER BY ts DESC LIMIT 25")
def influx_raw_desc_limit(spark, sf_dir):
    return influx(spark, sf_dir, f"SELECT value FROM events WHERE event_type = '{ONE}' ORDER BY time DESC LIMIT 25")


@query("SELECT 0::BIGINT AS time, round(avg(value), 6) AS mean, count(value) AS count FROM events WHERE event_type <> 'view'")
def influx_whole_range(spark, sf_dir):
    return influx(spark, sf_dir, "SELECT mean(value), count(value) FROM events WHERE event_type != 'view'").withColumn("mean", F.round("mean", 6))


@query("SELECT 'events' AS measurement, 'event_type' AS key, event_type AS value FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def show_tag_values(spark, sf_dir):
    return influx(spark, sf_dir, 'SHOW TAG VALUES FROM "events" WITH KEY = "event_type"')


@query("SELECT 'events' AS measurement, 'value' AS \"fieldKey\", 'float' AS \"fieldType\"")
def show_field_keys(spark, sf_dir):
    return influx(spark, sf_dir, "SHOW FIELD KEYS")


@query("SELECT * FROM (VALUES ('events', 'event_id', 'integer'), ('events', 'user_id', 'integer'), ('events', 'value', 'float')) t(measurement, \"fieldKey\", \"fieldType\")")
def wide_show_field_keys(spark, sf_dir):
    return influx_exec.query(spark, {"events": table(spark, sf_dir, wide=True)}, "SHOW FIELD KEYS", NOW)


@query("SELECT event_type, epoch_us(ts) AS ts_us, value FROM events")
def lineproto_round_trip(spark, sf_dir):
    """Every event as a line of text files, read back by the line-protocol source."""
    from strata.sources.lineproto import read_lines

    rows = events(spark, sf_dir)
    line = F.concat(F.lit("events,event_type="), F.regexp_replace("event_type", r"([ ,=])", r"\\$1"), F.lit(" value="), F.col("value").cast("string"), F.lit(" "), (F.col("us") * 1000).cast("string"))
    path = work_dir(spark)
    rows.select(line.alias("value")).write.text(path)
    return read_lines(spark, path).select(F.col("tags")["event_type"].alias("event_type"), "ts_us", F.col("reals")["value"].alias("value"))


# -- what the host engine gives (J, N, O, U, P)


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_dimensions(spark, sf_dir):
    orders, customer, nation = (read(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


DIMENSION = "(VALUES ('click', 60.0), ('view', 90.0), ('purchase', 120.0))"


@query(f"SELECT epoch_us(ts) AS us, e.event_type, value, alarm FROM events e JOIN {DIMENSION} d(event_type, alarm) ON e.event_type = d.event_type WHERE value > alarm")
def join_theta(spark, sf_dir):
    """A tiered table joined to a plain one, with a condition between them."""
    t = table(spark, sf_dir).df()
    d = spark.createDataFrame([("click", 60.0), ("view", 90.0), ("purchase", 120.0)], "event_type string, alarm double")
    return t.join(d, "event_type").filter(F.col("value") > F.col("alarm")).select(F.unix_micros("ts").alias("us"), "event_type", "value", "alarm")


@query(f"SELECT event_id, e.event_type, value, alarm FROM events e JOIN {DIMENSION} d(event_type, alarm) ON e.event_type = d.event_type WHERE value > alarm")
def wide_join_theta(spark, sf_dir):
    t = table(spark, sf_dir, wide=True).df()
    d = spark.createDataFrame([("click", 60.0), ("view", 90.0), ("purchase", 120.0)], "event_type string, alarm double")
    return t.join(d, "event_type").filter(F.col("value") > F.col("alarm")).select("event_id", "event_type", "value", "alarm")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, sf_dir):
    customer, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(spark, sf_dir):
    customer, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT n_name, s_name FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey")
def outer_join(spark, sf_dir):
    nation, supplier = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    return nation.join(supplier, nation.n_nationkey == supplier.s_nationkey, "full").select("n_name", "s_name")


@query("SELECT r_name, n_name FROM region, nation WHERE r_regionkey < 2 AND n_regionkey <> r_regionkey")
def comma_join(spark, sf_dir):
    for n in ("region", "nation"):
        read(spark, sf_dir, n).createOrReplaceTempView(f"strata_{n}")
    return spark.sql("SELECT r_name, n_name FROM strata_region, strata_nation WHERE r_regionkey < 2 AND n_regionkey <> r_regionkey")


@query("SELECT event_id, event_type, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS tile FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value DESC, event_id)")
def window_rank(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.col("value").desc(), "event_id")
    return read(spark, sf_dir, "events").select("event_id", "event_type", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(w).cast("long").alias("tile"))


@query("SELECT event_id, value - lag(value) OVER w AS step, lead(event_type) OVER w AS next_type, first_value(value) OVER w AS first_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_lag(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", (F.col("value") - F.lag("value").over(w)).alias("step"), F.lead("event_type").over(w).alias("next_type"), F.first("value").over(w).alias("first_value"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving FROM events")
def window_moving_average(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return read(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("moving"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).unionByName(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def intersection(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(read(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def difference(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(read(spark, sf_dir, "orders").select("o_custkey"))


@query("WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 50) SELECT i, i * i AS square FROM n")
def recursive_series(spark, sf_dir):
    return spark.sql("WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 50) SELECT i, i * i AS square FROM n")


@query("WITH top AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1) SELECT event_id, e.event_type FROM events e WHERE value > 2 * (SELECT m FROM top WHERE top.event_type = e.event_type)")
def correlated_subquery(spark, sf_dir):
    read(spark, sf_dir, "events").createOrReplaceTempView("strata_events")
    return spark.sql("WITH top AS (SELECT event_type, avg(value) AS m FROM strata_events GROUP BY 1) SELECT event_id, e.event_type FROM strata_events e WHERE value > 2 * (SELECT m FROM top WHERE top.event_type = e.event_type)")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20 OFFSET 5")
def order_limit_offset(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "value").orderBy(F.col("value").desc(), "event_id").offset(5).limit(20)


@query("SELECT event_id, upper(event_type) || '-' || user_id AS label, round(value, 1) AS v, CASE WHEN value IS NULL THEN 'none' WHEN value > 50 THEN 'high' ELSE 'low' END AS level FROM events WHERE event_type LIKE '%i%' AND value BETWEEN 10 AND 90 AND NOT user_id IN (1, 2, 3)")
def expressions(spark, sf_dir):
    rows = read(spark, sf_dir, "events").filter(F.col("event_type").like("%i%") & F.col("value").between(10, 90) & ~F.col("user_id").isin(1, 2, 3))
    level = F.when(F.col("value").isNull(), "none").when(F.col("value") > 50, "high").otherwise("low")
    return rows.select("event_id", F.concat(F.upper("event_type"), F.lit("-"), F.col("user_id")).alias("label"), F.round("value", 1).alias("v"), level.alias("level"))


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id > 5 AND event_type <> 'view' GROUP BY 1")
def bound_parameters(spark, sf_dir):
    from strata.engine import Engine

    read(spark, sf_dir, "events").createOrReplaceTempView("strata_events")
    return Engine(spark, work_dir(spark)).sql("SELECT event_type, count(*) AS n FROM strata_events WHERE user_id > ?1 AND event_type <> ?2 GROUP BY 1", [5, "view"])


@query("SELECT count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events")
def streaming_ingest(spark, sf_dir):
    """The events as a stream of files into a tiered table, then its aggregate."""
    from strata.streaming.ingest import ingest

    base = work_dir(spark)
    t = TieredTable.create(spark, "streamed", SCHEMA, base, "1d")
    stream = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").select(*COLUMNS)
    ingest(stream, t, f"{base}/checkpoint").awaitTermination()
    return t.refresh().df().agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))
