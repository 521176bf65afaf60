"""Continuous aggregates: sufficient statistics by (bucket, series), kept as deltas.

A delta is written with every compaction, from the same pass over the rows and in the
same publish; late rows add another delta for a bucket.  A view aggregates deltas and the live hot
rows again, so it equals the aggregate of the raw rows at any moment.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import BadSchema, NoPolicy
from strata.functions import schema as S
from strata.functions.timefn import bucket, format_duration, parse_duration
from strata.operators import catalog, stats
from strata.operators.table import Action, TieredTable, empty


def _bucketed(table: TieredTable, rows: DataFrame, grain: int) -> DataFrame:
    at = bucket(table.axis_micros(), grain, table.origin)
    return rows.withColumn("_at", F.timestamp_micros(at) if table._axis_stamps() else at)


def aggregate(table: TieredTable, rows: DataFrame, grain: int) -> DataFrame:
    """(axis, series..., cells...) of raw rows."""
    return _bucketed(table, rows, grain).drop(table.axis).withColumnRenamed("_at", table.axis).groupBy(table.axis, *table.series).agg(*stats.cells(table.measures))


def cell_schema(table: TieredTable) -> T.StructType:
    own = table.schema
    fields = [own[table.axis], *(own[c] for c in table.series)]
    fields += [T.StructField(n, T.LongType() if n.endswith("_count") else T.DoubleType()) for m in table.measures for n in stats.names(m)]
    return T.StructType(fields)


def write_delta(table: TieredTable, rows: DataFrame, grain: int) -> str:
    name = uuid.uuid4().hex
    aggregate(table, rows, grain).write.parquet(table.store.at("rollups", name))
    return name


def write_cells(table: TieredTable, rows: DataFrame, grains: list[int]) -> DataFrame:
    """Cells of raw rows by (path, axis at the widest width that divides every grain, series).

    The one pass over the rows of a compaction: statistics of files and deltas of all
    grains are merged from these.  Without grains the axis is left out.
    """
    if not grains or not table.measures:
        return stats.by_series(rows, ["path", *table.series], table.measures)
    staged = table.store.at("_staging", uuid.uuid4().hex)
    fine = _bucketed(table, rows, math.gcd(*grains)).drop(table.axis).withColumnRenamed("_at", table.axis)
    fine.groupBy("path", table.axis, *table.series).agg(*stats.cells(table.measures)).write.parquet(staged)
    return table.spark.read.schema(T.StructType([T.StructField("path", T.StringType()), *cell_schema(table).fields])).parquet(staged)


def cells_by_file(table: TieredTable, cells: DataFrame) -> DataFrame:
    """Statistics of files from :func:`write_cells`."""
    if table.axis not in cells.columns:
        return cells
    return cells.groupBy("path", *table.series).agg(*stats.merged(table.measures))


def add_delta(table: TieredTable, grain: dict, cells: DataFrame) -> None:
    """One more delta of a grain, from :func:`write_cells`."""
    name = uuid.uuid4().hex
    at = _bucketed(table, cells, grain["grain"]).drop(table.axis).withColumnRenamed("_at", table.axis)
    at.groupBy(table.axis, *table.series).agg(*stats.merged(table.measures)).write.parquet(table.store.at("rollups", name))
    _append(grain, name)


def _append(grain: dict, name: str) -> None:
    grain["serial"] = grain.get("serial", 0) + 1
    grain["segments"].append([grain["serial"], name])


def create_rollup(table: TieredTable, grain: str) -> str:
    """Register a grain and fill it from the cold files; returns the rollup's name."""
    us = parse_duration(grain)
    if table.tier0 % us:
        raise BadSchema(f"grain {grain} must divide the smallest tier, {format_duration(table.tier0)}")
    if not table.measures:
        raise BadSchema(f"{table.name} has no REAL column to roll up")
    name = f"{table.name}_rollup_{grain}"
    if str(us) in table.state["rollups"]:
        return table.state["rollups"][str(us)]["name"]
    made = {"name": name, "grain": us, "text": grain, "segments": [], "trim": None, "tiered": None}
    if catalog.active(table.state):
        _append(made, write_delta(table, table.cold(), us))
    target = _target(table, name)
    if target:  # a tiered table of that name and of the cells' columns holds the rollup
        made["tiered"] = target.state["policy"]["base_dir"]
    state = table.manifest.edit()
    state["rollups"][str(us)] = made
    table.manifest = table.manifest.publish(state)
    feed(table)
    return name


def _target(table: TieredTable, name: str, base_dir: str | None = None) -> TieredTable | None:
    try:
        found = TieredTable.open(table.spark, name, base_dir or table.state["policy"]["base_dir"])
    except NoPolicy:
        return None
    want = [(f.name, S.storage_of(f.dataType)) for f in cell_schema(table).fields]
    if [(c.name, c.storage) for c in found.columns] != want:
        raise BadSchema(f"{name} exists and does not have the columns of a rollup of {table.name}")
    return found


def _pending(table: TieredTable, grain: dict, target: TieredTable) -> list:
    """Deltas that a target does not have yet."""
    fed = target.state["batches"].get(table.name) or 0
    return sorted(s for s in grain["segments"] if s[0] > fed)


def feed(table: TieredTable) -> None:
    """Publish to tiered targets the deltas they do not have yet, in order, each once.

    A delta's serial number is its batch id, so a run that stopped half way is taken up
    where it was.  Only deltas of compacted rows are fed: live rows stay with the source.
    """
    for grain in table.state["rollups"].values():
        if grain["tiered"]:
            target = _target(table, grain["name"], grain["tiered"])
            for serial, name in _pending(table, grain, target):
                target.insert(_read(table, [name]), batch=f"{table.name}:{serial}")


def condense(table: TieredTable, grain: dict, limit: int) -> list[str]:
    """Merge more than ``limit`` deltas into one, or let go of what a target has; returns the folders to retire."""
    segments = sorted(grain["segments"])
    if grain["tiered"]:
        grain["segments"] = _pending(table, grain, _target(table, grain["name"], grain["tiered"]))
    elif len(segments) > limit:
        name = uuid.uuid4().hex
        materialized(table, grain["grain"]).groupBy(table.axis, *table.series).agg(*stats.merged(table.measures)).write.parquet(table.store.at("rollups", name))
        grain["segments"] = []
        _append(grain, name)
    return [n for s, n in segments if [s, n] not in grain["segments"]]


def _read(table: TieredTable, names: list[str]) -> DataFrame:
    kind = cell_schema(table)
    return table.spark.read.schema(kind).parquet(*[table.store.at("rollups", n) for n in names]) if names else empty(table.spark, kind)


def drop_rollup(table: TieredTable, grain: str) -> None:
    state = table.manifest.edit()
    gone = state["rollups"].pop(str(parse_duration(grain)), None)
    if gone is None:
        raise BadSchema(f"{table.name} has no rollup {grain}")
    now = time.time_ns() // 1000
    state["retired"] += [{"path": f"rollups/{name}", "gone": now} for _, name in gone["segments"]]
    table.manifest = table.manifest.publish(state)


def materialized(table: TieredTable, grain: str | int) -> DataFrame:
    """The deltas of a grain, not yet merged; columns added later read null."""
    us = parse_duration(grain) if isinstance(grain, str) else grain
    found = table.state["rollups"].get(str(us))
    if found is None:
        raise BadSchema(f"{table.name} has no rollup {grain}")
    if found["tiered"]:
        target = _target(table, found["name"], found["tiered"])
        return target.df().unionByName(_read(table, [n for _, n in _pending(table, found, target)]))
    rows = _read(table, [n for _, n in found["segments"]])
    if found["trim"] is not None:
        rows = rows.filter(table.axis_micros() + us > found["trim"])
    return rows


def rollup_view(table: TieredTable, grain: str, register: bool = True) -> DataFrame:
    """(axis, series..., cells..., averages...) of all rows, as ``<table>_<grain>``."""
    us = parse_duration(grain)
    live = aggregate(table, table.hot(), us)
    both = materialized(table, us).unionByName(live)
    out = both.groupBy(table.axis, *table.series).agg(*stats.merged(table.measures))
    out = out.select("*", *[stats.average(m).alias(f"{m}_avg") for m in table.measures])
    if register:
        out.createOrReplaceTempView(f"{table.name}_{grain}")
    return out


def tiered_rollup(table: TieredTable, grain: str, tiers: str = "7d") -> TieredTable:
    """Hold a rollup in a tiered table of its own, with its own tiers and retention, which can be rolled up again.

    It gets the deltas so far and, from then on, each new one; :func:`rollup_view` reads it.
    """
    us = parse_duration(grain)
    found = table.state["rollups"].get(str(us))
    if found is None:
        raise BadSchema(f"{table.name} has no rollup {grain}")
    kind = {S.INTEGER: "INTEGER", S.REAL: "REAL", S.TEXT: "TEXT", S.BLOB: "BLOB"}
    parts = []
    for f in cell_schema(table).fields:
        parts.append(f"{f.name} TIMESTAMP" if isinstance(f.dataType, T.TimestampType) else f"{f.name} {kind[S.storage_of(f.dataType)]}")
    base = table.state["policy"]["base_dir"]
    TieredTable.create(table.spark, found["name"], ", ".join(parts), base, tiers, table.axis)
    state = table.manifest.edit()
    state["rollups"][str(us)]["tiered"] = base
    table.manifest = table.manifest.publish(state)
    feed(table)
    return TieredTable.open(table.spark, found["name"], base)


def trim(table: TieredTable, cutoff: int) -> list[Action]:
    """Retention of plain rollups: cells whose bucket ended by the cutoff are no longer read."""
    state, done = table.manifest.edit(), []
    for r in state["rollups"].values():
        if not r["tiered"] and (r["trim"] is None or r["trim"] < cutoff):
            r["trim"] = cutoff
            done.append(Action("trim", end=cutoff, paths=[r["name"]]))
    if done:
        table.manifest = table.manifest.publish(state)
    return done
