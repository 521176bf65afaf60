"""InfluxQL over tiered tables: the syntax tree lowered to DataFrame calls.

Time bounds and tag equalities go into ``scan``, so files are pruned by the manifest;
results stay tidy DataFrames (time, tags, values) and are shaped into series only for
:func:`series_json`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.errors import QueryError, StrataError
from strata.functions import schema as S
from strata.functions.timefn import bucket, format_timestamp
from strata.operators.table import TieredTable
from strata.sources import influxql as Q

DATABASE, POLICY = "strata", "autogen"
MAX_ROWS = 10_000
#: fixed values: divisors of a time in microseconds
EPOCHS = {"s": 1_000_000, "ms": 1000, "us": 1, "u": 1, "µ": 1}


def tags_of(table: TieredTable) -> list[str]:
    return [c.name for c in table.columns if c.name != table.axis and c.storage == S.TEXT]


def fields_of(table: TieredTable) -> list[str]:
    return [c.name for c in table.columns if c.name != table.axis and c.storage in (S.REAL, S.INTEGER)]


_AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "spread": lambda c: F.max(c) - F.min(c)}


def _condition(c: Q.Condition, table: TieredTable) -> Column | None:
    if c.kind == "true":
        return None
    if c.column not in {x.name for x in table.columns}:
        raise QueryError(f"unknown column {c.column}")
    column = F.col(f"`{c.column}`")
    if c.kind in ("in", "not_in"):
        return column.isin(c.value) if c.kind == "in" else ~column.isin(c.value)
    value = F.lit(c.value)
    return {"eq": column == value, "ne": column != value, "lt": column < value, "le": column <= value, "gt": column > value, "ge": column >= value}[c.kind]


def select(table: TieredTable, q: Q.Select, max_rows: int | None = MAX_ROWS) -> tuple[DataFrame, list[str]]:
    """(time in microseconds, tags..., values...) and the names of the tags grouped by."""
    tags, fields = tags_of(table), fields_of(table)
    equal = {c.column: c.value for c in q.conditions if c.kind == "eq" and c.column in tags and isinstance(c.value, str)}
    rows, _ = table.scan(q.time_lo, q.time_hi, equal)
    for c in q.conditions:
        if c.kind == "eq" and c.column in equal:
            continue
        told = _condition(c, table)
        rows = rows if told is None else rows.filter(told)
    by = tags if q.all_tags else [t for t in q.group_tags if t in tags]

    wanted: list[Q.Field] = []
    for f in q.fields:
        if f.column == "*":
            wanted += [Q.Field(f.aggregate, c, f"{f.aggregate}_{c}" if f.aggregate else c) for c in fields]
        elif f.column in fields or f.column in tags and f.aggregate in (None, "count", "first", "last"):
            wanted.append(f)
        else:
            raise QueryError(f"unknown field {f.column}")
    kinds = {f.aggregate is not None for f in wanted}
    if len(kinds) > 1:
        raise QueryError("aggregates and bare fields cannot be mixed")
    selectors = [f for f in wanted if f.aggregate in ("first", "last")]
    if selectors and len(wanted) > 1:
        raise QueryError(f"{selectors[0].aggregate}() must be the only field")

    names, taken = [], {}
    for f in wanted:
        name = f.alias or f.aggregate or f.column
        taken[name] = taken.get(name, -1) + 1
        names.append(f"{name}_{taken[name]}" if taken[name] else name)
    at = table.axis_micros()
    keys = [F.col(f"`{t}`").alias(t) for t in by]
    if q.group_time:
        # the grid of GROUP BY time starts at the epoch, whatever the table's origin
        keys = [bucket(at, q.group_time).alias("time"), *keys]
    if kinds == {False}:
        out = rows.select(at.alias("time"), *[F.col(f"`{t}`").alias(t) for t in by], *[F.col(f"`{f.column}`").alias(n) for f, n in zip(wanted, names)])
    elif selectors:
        f, name = wanted[0], names[0]
        pick = F.min_by if f.aggregate == "first" else F.max_by
        # the whole row's value counts, a null one too
        chosen = pick(F.struct(at.alias("time"), F.col(f"`{f.column}`").alias("v")), at)
        out = rows.groupBy(*keys).agg(chosen.alias("_row")) if keys else rows.agg(chosen.alias("_row")).filter("_row is not null")
        stamp = [] if q.group_time else [F.col("_row.time").alias("time")]
        out = out.select(*stamp, *[F.col(f"`{k}`") for k in (["time"] if q.group_time else []) + by], F.col("_row.v").alias(name))
    else:
        cells = [_AGGREGATES[f.aggregate](F.col(f"`{f.column}`")).alias(n) for f, n in zip(wanted, names)]
        out = rows.groupBy(*keys).agg(*cells) if keys else rows.agg(*cells)
        if not q.group_time:
            out = out.withColumn("time", F.lit(q.time_lo or 0).cast("long"))
    if q.fill == "0" and kinds == {True}:
        out = out.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) if c in names else F.col(f"`{c}`") for c in out.columns])
    out = out.select("time", *[F.coalesce(F.col(f"`{t}`"), F.lit("")).alias(t) for t in by], *[f"`{n}`" for n in names])
    order = F.col("time").desc() if q.descending else F.col("time").asc()
    limits = [n for n in (q.limit, max_rows) if n is not None]
    out = out.orderBy(order, *by)
    return (out.limit(min(limits)) if limits else out), by


def show(spark: SparkSession, tables: dict[str, TieredTable], q: Q.Show) -> DataFrame:
    if q.what == "databases":
        return spark.createDataFrame([(DATABASE,)], "name string")
    if q.what == "policies":
        return spark.createDataFrame([(POLICY, "0s", "0s", 1, True)], "name string, duration string, shardGroupDuration string, replicaN int, default boolean")
    if q.what == "measurements":
        names = sorted(tables)[: q.limit]
        return spark.createDataFrame([(n,) for n in names], "name string")
    chosen = {n: t for n, t in sorted(tables.items()) if q.measurement in (None, n)}
    if q.what == "tag_keys":
        return spark.createDataFrame([(n, k) for n, t in chosen.items() for k in sorted(tags_of(t))], "measurement string, tagKey string")
    if q.what == "field_keys":
        kinds = {S.REAL: "float", S.INTEGER: "integer"}
        rows = [(n, c.name, kinds[c.storage]) for n, t in chosen.items() for c in sorted(t.columns, key=lambda c: c.name) if c.name in fields_of(t)]
        return spark.createDataFrame(rows, "measurement string, fieldKey string, fieldType string")
    out = None
    for n, t in chosen.items():
        if q.key in tags_of(t):
            found = t.df().select(F.lit(n).alias("measurement"), F.lit(q.key).alias("key"), F.col(f"`{q.key}`").alias("value")).filter(F.col("value").isNotNull()).distinct()
            out = found if out is None else out.unionByName(found)
    return out.orderBy("measurement", "value") if out is not None else spark.createDataFrame([], "measurement string, key string, value string")


def query(spark: SparkSession, tables: dict[str, TieredTable], text: str, now: int, max_rows: int | None = None) -> DataFrame | None:
    """One statement as a DataFrame, capped if asked; None for an unknown measurement."""
    q = Q.parse(text, now)
    if isinstance(q, Q.Show):
        return show(spark, tables, q)
    if q.measurement not in tables:
        return None
    return select(tables[q.measurement], q, max_rows)[0]


def _stamp(us: int, epoch: str | None):
    if epoch is None:
        return format_timestamp(us)
    if epoch == "ns":
        return us * 1000
    size = EPOCHS[epoch]
    return us // size if us >= 0 else -(-us // size)


def series_json(spark: SparkSession, tables: dict[str, TieredTable], text: str, now: int, epoch: str | None = None, max_rows: int = MAX_ROWS) -> dict:
    """All statements of ``text`` in the wire form; an error is its statement's own."""
    results = []
    for i, statement in enumerate(Q.split_statements(text)):
        said: dict = {"statement_id": i}
        try:
            q = Q.parse(statement, now)
            if isinstance(q, Q.Show):
                rows = show(spark, tables, q)
                names = [c for c in rows.columns if c != "measurement"]
                grouped: dict = {}
                for r in rows.collect():
                    grouped.setdefault(r["measurement"] if "measurement" in rows.columns else q.what, []).append([r[c] for c in names])
                series = [{"name": k, "columns": names, "values": v} for k, v in grouped.items()]
            elif q.measurement not in tables:
                series = []
            else:
                rows, by = select(tables[q.measurement], q, max_rows)
                names = [c for c in rows.columns if c not in by or c == "time"]
                grouped = {}
                for r in rows.collect():  # at most max_rows
                    grouped.setdefault(tuple(r[t] for t in by), []).append([_stamp(r["time"], epoch), *(r[c] for c in names[1:])])
                series = [{"name": q.measurement, **({"tags": dict(zip(by, k))} if by else {}), "columns": names, "values": grouped[k]} for k in sorted(grouped)]
            if series:
                said["series"] = series
        except StrataError as e:
            said["error"] = str(e)
        results.append(said)
    return {"results": results}
