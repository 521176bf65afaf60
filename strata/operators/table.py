"""Tiered tables: an append-only hot tier, compacted cold files, one name for both.

Hot rows lie in segments partitioned by tier-0 bucket, so that compacting a bucket only
takes names off a list.  A cold file is a folder of Parquet parts sorted by time, as
many as its size needs; all closed buckets of a ``maintain`` call are written by one
job, ranged by (bucket, time), so a large bucket is spread over tasks.

A DataFrame taken from a table reads the files of its version.  What a newer version no
longer names stays on disk for ``grace`` (an hour unless told otherwise), then the next
``maintain`` collects it.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import BadSchema, CompactError, ImmutableHistory, MissingFile, NoPolicy, SchemaDrift
from strata.functions import schema as S
from strata.functions.timefn import SECOND, bucket, floor_bucket, format_duration, parse_duration, to_micros, to_timestamp
from strata.operators import catalog, policy, stats
from strata.operators.store import Manifest, Store

ROW_GROUP_ROWS = 16384
BUCKET = "_bucket"
#: how long files that are no longer named stay for readers of older versions
GRACE = 3600 * SECOND
#: folders of statistics, and of each rollup's deltas, before ``maintain`` merges them into one
FOLDERS = 16
#: lists of files whose index is kept
FRAMES = 32


@dataclass
class ScanStats:
    """What a scan looked at; counted by the manifest, before anything is read."""

    total_files: int = 0
    candidate_files: int = 0
    scanned_files: int = 0
    series_pruned_files: int = 0
    column_pruned_files: int = 0
    hot_buckets: int = 0
    total_row_groups: int = 0
    scanned_row_groups: int = 0


@dataclass
class Action:
    """One thing ``maintain`` did: compact, evict, trim, merge, heal or collect."""

    kind: str
    start: int | None = None
    end: int | None = None
    rows: int = 0
    paths: list[str] = field(default_factory=list)


def _now() -> int:
    return time.time_ns() // 1000


def _batch(batch: str) -> tuple[str, int | None]:
    """The stream and the number of a batch id; an id without a number is a stream of its own."""
    stream, _, number = batch.rpartition(":")
    return (stream, int(number)) if stream and number.isdigit() else (batch, None)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, in a form that the optimizer takes out of unions."""
    return spark.range(0).filter(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


class TieredTable:
    """``create`` or ``open`` one; ``df()`` and ``scan()`` read it, ``insert`` adds rows."""

    def __init__(self, spark: SparkSession, name: str, store: Store, manifest: Manifest):
        self.spark, self.name, self.store, self.manifest = spark, name, store, manifest
        self._frames: dict[tuple, DataFrame] = {}
        self._holding: dict[tuple, tuple[set[str], set[str]]] = {}
        _settings(spark)

    # -- life ---------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, name: str, schema: str, base_dir: str, tiers: str = policy.DEFAULT_TIERS, axis: str | None = None, margin: str | int = policy.MARGIN) -> TieredTable:
        """Create, or take up what is there if its columns are the same or continue these."""
        columns = S.parse_schema(schema)
        axis_name = S.axis_of(columns, axis)
        store = Store(spark, f"{base_dir.rstrip('/')}/{name}")
        found = Manifest.newest(store)
        made = policy.make(tiers, base_dir, axis_name, parse_duration(margin) if isinstance(margin, str) else margin)
        if found:
            stored = [S.Column(*c) for c in found.state["columns"]]
            S.check_drift(stored, columns)
            if found.state["policy"]["origin"] != made["origin"]:
                raise BadSchema("the origin cannot change")
            if found.state["policy"]["tiers"] != made["tiers"]:
                state = found.edit()
                state["policy"]["tiers"] = made["tiers"]
                found = found.publish(state)
            return cls(spark, name, store, found)
        state = {"columns": [[c.name, c.declared] for c in columns], "policy": made, "files": [], "hot": [], "rollups": {}, "stats": [], "batches": {}, "retired": []}
        return cls(spark, name, store, Manifest.first(store, state))

    @classmethod
    def open(cls, spark: SparkSession, name: str, base_dir: str) -> TieredTable:
        store = Store(spark, f"{base_dir.rstrip('/')}/{name}")
        found = Manifest.newest(store)
        if not found:
            raise NoPolicy(f"no table {name} in {base_dir}")
        return cls(spark, name, store, found)

    @classmethod
    def from_dataframe(cls, rows: DataFrame, name: str, base_dir: str, tiers: str = policy.DEFAULT_TIERS, axis: str | None = None) -> TieredTable:
        """Adopt a populated plain table; everything is checked before anything is written."""
        columns = S.declare(rows.schema)
        table = cls.create(rows.sparkSession, name, ", ".join(f"{c.name} {c.declared}" for c in columns), base_dir, tiers, axis)
        table.insert(rows)
        return table

    def refresh(self) -> TieredTable:
        self.manifest = Manifest.newest(self.store)
        return self

    def detach(self) -> None:
        """Drop the name; the data stays and ``open`` takes it up again."""
        self.spark.catalog.dropTempView(self.name)

    # -- what it is ----------------------------------------------------------

    @property
    def state(self) -> dict:
        return self.manifest.state

    @property
    def columns(self) -> list[S.Column]:
        return [S.Column(*c) for c in self.state["columns"]]

    @property
    def schema(self) -> T.StructType:
        return S.struct_of(self.columns)

    @property
    def axis(self) -> str:
        return self.state["policy"]["axis"]

    @property
    def series(self) -> list[str]:
        return S.series_columns(self.columns, self.axis)

    @property
    def measures(self) -> list[str]:
        return S.real_columns(self.columns, self.axis)

    @property
    def tier0(self) -> int:
        return self.state["policy"]["tiers"][0]

    @property
    def origin(self) -> int:
        return self.state["policy"]["origin"]

    def _axis_stamps(self) -> bool:
        return next(c for c in self.columns if c.name == self.axis).is_timestamp

    def axis_micros(self, name: str | None = None) -> Column:
        column = F.col(f"`{name or self.axis}`")
        return to_micros(column) if self._axis_stamps() else column

    def between(self, start: int | None, end: int | None, closed: bool = False) -> Column:
        """start <= axis < end (<= if closed), on the stored column, so that it reaches the scan."""
        of = (lambda us: to_timestamp(us)) if self._axis_stamps() else (lambda us: F.lit(us).cast("long"))
        axis, out = F.col(f"`{self.axis}`"), F.lit(True)
        if start is not None:
            out = out & (axis >= of(start))
        if end is not None:
            out = out & ((axis <= of(end)) if closed else (axis < of(end)))
        return out

    # -- reading -------------------------------------------------------------

    def _read(self, paths: list[str]) -> DataFrame:
        """Rows of files; as files never change, the last lists of them keep their file index."""
        if not paths:
            return empty(self.spark, self.schema)
        key = (len(self.columns), *paths)
        if key not in self._frames:
            if len(self._frames) >= FRAMES:
                self._frames.pop(next(iter(self._frames)))
            self._frames[key] = self.spark.read.schema(self.schema).parquet(*paths)
        return self._frames[key]

    def _landed(self, segment: dict) -> bool:
        """Whether the batch over several tables that a segment belongs to was committed."""
        return "txn" not in segment or self.store.exists(segment["txn"])

    def segments(self) -> list[dict]:
        """The hot segments that count; those of a batch that did not land do not."""
        return [s for s in self.state["hot"] if self._landed(s)]

    def _hot_paths(self, low: int | None = None, high: int | None = None) -> list[str]:
        found = []
        for segment in self.segments():
            for b in segment["buckets"]:
                if (high is None or int(b) <= high) and (low is None or int(b) + self.tier0 > low):
                    found.append(self.store.at("hot", segment["id"], f"{BUCKET}={b}"))
        return found

    def hot(self) -> DataFrame:
        return self._read(self._hot_paths())

    def cold(self) -> DataFrame:
        return self._read(self._present([e["path"] for e in catalog.active(self.state)]))

    def _present(self, paths: list[str]) -> list[str]:
        """The paths, if the table's folder, listed once, has them all."""
        names = set(self.store.children(self.store.folder)) if paths else set()
        for p in paths:
            if p.rsplit("/", 1)[-1] not in names:
                raise MissingFile(f"{p} is in the catalog of {self.name} but gone: possible data loss")
        return paths

    def verify_files(self) -> int:
        """Read the footers of all active files, as one job a column count; a file of other columns is an error."""
        by: dict[int, list[str]] = {}
        for e in catalog.active(self.state):
            by.setdefault(e["columns"], []).append(e["path"])
        for width, paths in by.items():
            try:
                found = self.spark.read.option("mergeSchema", "true").parquet(*self._present(paths)).schema
            except Exception as e:
                if "CANNOT_MERGE" in str(e):
                    raise SchemaDrift(f"files of {self.name} have different types") from e
                raise
            want = {c.name: c for c in self.columns[:width]}
            odd = [f.name for f in found.fields if f.name not in want or f.dataType != want[f.name].spark_type] + sorted(set(want) - set(found.fieldNames()))
            if odd:
                raise SchemaDrift(f"files of {self.name} do not have its columns: {', '.join(odd)}")
        return sum(map(len, by.values()))

    def df(self) -> DataFrame:
        """All rows, hot and cold, of the version this object holds."""
        return self.hot().unionByName(self.cold())

    def view(self, name: str | None = None) -> DataFrame:
        rows = self.df()
        rows.createOrReplaceTempView(name or self.name)
        return rows

    def scan(self, low: int | None = None, high: int | None = None, eq: dict | None = None) -> tuple[DataFrame, ScanStats]:
        """Rows with low <= axis <= high and the given equalities, and what was pruned.

        Files are chosen by their range, then by the series statistics; the filter is
        applied again to every row.
        """
        files = catalog.active(self.state)
        said = ScanStats(total_files=len(files))
        chosen = catalog.overlapping(self.state, low, high)
        said.candidate_files = len(chosen)
        places = {c.name: i for i, c in enumerate(self.columns)}
        if eq:
            fits = [e for e in chosen if all(v is None or places[c] < e["columns"] for c, v in eq.items())]
            said.column_pruned_files = len(chosen) - len(fits)
            chosen = fits
            texts = {c: v for c, v in eq.items() if c in self.series and v is not None}
            if texts and self.state["stats"] and chosen:
                known, holds = self._files_with(texts)
                fits = [e for e in chosen if e["path"] not in known or e["path"] in holds]
                said.series_pruned_files = len(chosen) - len(fits)
                chosen = fits
        said.scanned_files = len(chosen)
        hot = self._hot_paths(low, high)
        said.hot_buckets = len(hot)
        rows = self._read(hot).unionByName(self._read(self._present([e["path"] for e in chosen])))
        rows = rows.filter(self.between(low, high, closed=True))
        for c, v in (eq or {}).items():
            rows = rows.filter(F.col(f"`{c}`").eqNullSafe(F.lit(v)) if v is None else F.col(f"`{c}`") == F.lit(v))
        return rows, said

    def _files_with(self, values: dict) -> tuple[set[str], set[str]]:
        """Files that have statistics, and those with a series of all these values; one job for each version and values."""
        key = (self.manifest.version, tuple(sorted(values.items())))
        if key not in self._holding:
            fits = F.lit(True)
            for c, v in values.items():
                fits = fits & F.coalesce(F.col(f"`{c}`") == F.lit(v), F.lit(False))
            found = self.file_stats().groupBy("path").agg(F.max(fits).alias("fits")).collect()
            self._holding = {k: v for k, v in self._holding.items() if k[0] == key[0]}
            self._holding[key] = {r.path for r in found}, {r.path for r in found if r.fits}
        return self._holding[key]

    def row_groups(self, said: ScanStats, low: int | None, high: int | None) -> ScanStats:
        """Count, from the footers, the row groups of all files and those that [low, high] needs."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        reader, source = jvm.org.apache.parquet.hadoop.ParquetFileReader, jvm.org.apache.parquet.hadoop.util.HadoopInputFile
        for e in catalog.active(self.state):
            inside = (high is None or e["start"] <= high) and (low is None or e["end"] > low)
            for part in self.store.children(e["path"]):
                if not part.endswith(".parquet"):
                    continue
                opened = reader.open(source.fromPath(self.store._path(f"{e['path']}/{part}"), conf))
                try:
                    for group in opened.getFooter().getBlocks():
                        said.total_row_groups += 1
                        if inside:
                            least = most = None
                            for c in group.getColumns():
                                if c.getPath().toDotString() == self.axis and c.getStatistics().hasNonNullValue():
                                    least, most = c.getStatistics().genericGetMin(), c.getStatistics().genericGetMax()
                            said.scanned_row_groups += least is None or (high is None or least <= high) and (low is None or most >= low)
                finally:
                    opened.close()
        return said

    def catalog_df(self) -> DataFrame:
        rows = [(self.name, e["path"], e["start"], e["end"], e["rows"], e["created"], e["status"]) for e in self.state["files"]]
        return self.spark.createDataFrame(rows, "logical_table string, path string, range_start long, range_end long, row_count long, created_at long, status string")

    def policy_df(self) -> DataFrame:
        p = self.state["policy"]
        row = (self.name, ",".join(map(str, p["tiers"])), p["margin"], p["retain"], p["origin"], p["base_dir"], p["axis"])
        return self.spark.createDataFrame([row], "logical_table string, tiers_us string, safety_margin_us long, retain_us long, origin_us long, base_dir string, ts_column string")

    def rollups_df(self) -> DataFrame:
        rows = [(self.name, r["grain"], r["name"]) for r in self.state["rollups"].values()]
        return self.spark.createDataFrame(rows, "logical_table string, grain_us long, rollup_table string")

    # -- writing -------------------------------------------------------------

    def _fitted(self, rows: DataFrame) -> DataFrame:
        """Rows in the table's columns and types; widening only, NaN becomes null."""
        given = {f.name: f.dataType for f in rows.schema.fields}
        unknown = set(given) - {c.name for c in self.columns}
        if unknown:
            raise SchemaDrift(f"{self.name} has no column {', '.join(sorted(unknown))}")
        out = []
        for c in self.columns:
            if c.name not in given:
                out.append(F.lit(None).cast(c.spark_type).alias(c.name))
                continue
            kind, column = S.storage_of(given[c.name]), F.col(f"`{c.name}`")
            if kind != c.storage and not (kind == S.INTEGER and c.storage == S.REAL):
                raise CompactError(f"{self.name}.{c.name} is {c.storage}, got {kind}")
            if c.is_timestamp:
                stamp = isinstance(given[c.name], T.TimestampType | T.TimestampNTZType | T.DateType)
                column = column.cast("timestamp") if stamp else F.timestamp_micros(column.cast("long"))
            else:
                column = column.cast(c.spark_type)
                if c.storage == S.REAL:
                    column = F.when(F.isnan(column), None).otherwise(column)
            out.append(column.alias(c.name))
        return rows.select(*out)

    def _seen(self, batch: str) -> bool:
        stream, number = _batch(batch)
        last = self.state["batches"].get(stream)
        return last is not None and (number is None or number <= last)

    def insert(self, rows: DataFrame, batch: str | None = None) -> int:
        """Append rows in one publish; a batch id that was seen is not written again.

        Ids ``<stream>:<number>`` ascend within a stream, and only the last one is kept.
        """
        if batch is not None and self._seen(batch):
            return 0
        segment = self.stage(rows)
        if segment is None and batch is None:
            return 0
        self.land(segment, batch)
        return sum(segment["buckets"].values()) if segment else 0

    def stage(self, rows: DataFrame) -> dict | None:
        """Write rows that no version names yet."""
        return self._stage_hot(self._fitted(rows))

    def land(self, segment: dict | None, batch: str | None = None) -> None:
        state = self.manifest.edit()
        if segment:
            state["hot"].append(segment)
        if batch is not None:
            stream, number = _batch(batch)
            state["batches"][stream] = 0 if number is None else number
        self.manifest = self.manifest.publish(state)

    def _stage_hot(self, rows: DataFrame) -> dict | None:
        name = uuid.uuid4().hex
        path = self.store.at("hot", name)
        axis = self.axis_micros()
        told = F.when(axis.isNull(), F.raise_error(F.lit(f"{self.axis} is null"))).otherwise(bucket(axis, self.tier0, self.origin))
        # adaptive execution splits the partitions of a large bucket and joins those of small ones
        rows.withColumn(BUCKET, told).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)
        counts = self._counts(path)
        if not counts:
            self.store.delete(path)
            return None
        return {"id": name, "buckets": {str(r[BUCKET]): r["count"] for r in counts}}

    def _counts(self, path: str) -> list:
        """Rows of each bucket of what was just written, from the footers."""
        if not any(n.startswith(BUCKET) for n in self.store.children(path)):
            return []
        kind = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.LongType())])
        return self.spark.read.schema(kind).parquet(path).groupBy(BUCKET).count().collect()

    def update(self, *_, **__):
        raise ImmutableHistory("rows are never updated; insert a correction")

    delete = update

    # -- compaction ----------------------------------------------------------

    def compact_bucket(self, start: int, end: int) -> Action | None:
        """Move the hot rows of [start, end) into a cold file; None if there are none, for :meth:`bucket_state` to tell why.

        Bounds need not be aligned: rows of the touched buckets outside the range go to
        a new hot segment in the same publish.
        """
        touched = [(s, b) for s in self.segments() for b in s["buckets"] if int(b) < end and int(b) + self.tier0 > start]
        if not touched:
            return None
        paths = [self.store.at("hot", s["id"], f"{BUCKET}={b}") for s, b in touched]
        rows = self._read(paths)
        taken = self._stage_cold(rows.filter(self.between(start, end)), F.lit(start).cast("long"))
        if not taken:
            return None
        state = self.manifest.edit()
        for s, b in touched:
            next(x for x in state["hot"] if x["id"] == s["id"])["buckets"].pop(b)
        inside = all(int(b) >= start and int(b) + self.tier0 <= end for _, b in touched)
        if not inside:
            rest = self._stage_hot(rows.filter(~self.between(start, end)))
            if rest:
                state["hot"].append(rest)
        action = self._publish_cold(state, {start: (start, end)}, taken)
        return action[0]

    def bucket_state(self, start: int, end: int) -> str:
        """What :meth:`compact_bucket` would find: ``hot`` rows, a bucket already ``compacted``, or an ``empty`` one."""
        if any(int(b) < end and int(b) + self.tier0 > start for s in self.segments() for b in s["buckets"]):
            return "hot"
        return "compacted" if any(e["start"] < end and e["end"] > start for e in catalog.active(self.state)) else "empty"

    def _stage_cold(self, rows: DataFrame, by: Column) -> dict[int, tuple[str, int]]:
        """Write rows sorted by time into one staged folder for each value of ``by``."""
        staging = self.store.at("_staging", uuid.uuid4().hex)
        ready = rows.withColumn(BUCKET, by).repartitionByRange(F.col(BUCKET), F.col(f"`{self.axis}`")).sortWithinPartitions(BUCKET, f"`{self.axis}`")
        ready.write.option("parquet.block.row.count.limit", ROW_GROUP_ROWS).partitionBy(BUCKET).parquet(staging)
        counts = self._counts(staging)
        if not counts:
            self.store.delete(staging)
        return {r[BUCKET]: (f"{staging}/{BUCKET}={r[BUCKET]}", r["count"]) for r in counts}

    def _publish_cold(self, state: dict, ranges: dict[int, tuple[int, int]], staged: dict[int, tuple[str, int]], kind: str = "compact", superseded: dict[int, list[str]] | None = None) -> list[Action]:
        """Name the staged folders, take their statistics and rollup deltas, publish once.

        Every name has a random id, so nothing of another writer's is touched; what a
        refused publish leaves behind is deleted again.
        """
        from strata.operators import rollup

        actions, moved, numbers, now = [], [], catalog.sequences(state), _now()
        try:
            for b, (path, rows) in sorted(staged.items()):
                start, end = ranges[b]
                target = self.store.at(f"bucket-{start}-{end}-{uuid.uuid4().hex}.parquet")
                self.store.rename(path, target)
                catalog.insert(state, target, start, end, rows, numbers[start, end], len(self.columns), now)
                moved.append(target)
                actions.append(Action(kind, start, end, rows, [target]))
            catalog.set_status(state, [p for b in staged for p in (superseded or {}).get(b, [])], catalog.SUPERSEDED, now)
            self._retire_empty(state, now)
            grains = [g["grain"] for g in state["rollups"].values()] if kind == "compact" else []
            cells = rollup.write_cells(self, self._with_path(moved), grains)
            self._add_stats(state, rollup.cells_by_file(self, cells), moved)
            for grain in state["rollups"].values() if kind == "compact" else ():
                rollup.add_delta(self, grain, cells)
            self.manifest = self.manifest.publish(state)
        except Exception:
            for target in moved:
                self.store.delete(target)
            raise
        rollup.feed(self)
        return actions

    def _with_path(self, paths: list[str]) -> DataFrame:
        """Rows of cold files with their file's path."""
        rows = self._read(paths).withColumn("_path", F.input_file_name())
        path = F.regexp_extract("_path", r"(bucket-[^/]*\.parquet)/[^/]*$", 1)
        return rows.withColumn("path", F.concat(F.lit(self.store.folder + "/"), path)).drop("_path")

    def _add_stats(self, state: dict, rows: DataFrame, paths: list[str]) -> None:
        name, told = uuid.uuid4().hex, set(paths)
        rows.write.parquet(self.store.at("stats", name))
        state["stats"].append({"id": name, "columns": len(self.columns)})
        for e in state["files"]:
            if e["path"] in told:
                e["stats"] = name

    @staticmethod
    def _retire_empty(state: dict, now: int) -> None:
        """Segments without buckets leave the manifest; their folders wait for their readers."""
        for s in state["hot"]:
            if not s["buckets"]:
                state["retired"].append({"path": f"hot/{s['id']}", "gone": now})
        state["hot"] = [s for s in state["hot"] if s["buckets"]]

    def file_stats(self) -> DataFrame:
        """Cells for each (active file, series)."""
        parts = [("path", T.StringType()), *((c, S.struct_of(self.columns)[c].dataType) for c in self.series)]
        if self.measures:
            parts += [(n, T.LongType() if n.endswith("_count") else T.DoubleType()) for m in self.measures for n in stats.names(m)]
        else:
            parts.append(("rows", T.LongType()))
        kind = T.StructType([T.StructField(n, t) for n, t in parts])
        paths = [self.store.at("stats", s["id"]) for s in self.state["stats"]]
        if not paths:
            return empty(self.spark, kind)
        live = self.spark.createDataFrame([(e["path"],) for e in catalog.active(self.state)], "path string")
        return self.spark.read.schema(kind).parquet(*paths).join(live, "path", "left_semi")

    # -- upkeep --------------------------------------------------------------

    def maintain(self, now: int | None = None, grace: int = GRACE) -> list[Action]:
        """Compact closed buckets, evict, trim rollups, promote, heal and merge statistics, collect."""
        from strata.operators import rollup

        p = self.state["policy"]
        now = _now() if now is None else now
        cutoff = now - p["margin"]
        self._settle(grace)
        actions = self._compact_closed(cutoff)
        if p["retain"] is not None:
            state = self.manifest.edit()
            gone = catalog.evict_older_than(state, now - p["retain"], _now())
            if gone:
                self.manifest = self.manifest.publish(state)
                actions.append(Action("evict", paths=gone))
            actions += rollup.trim(self, now - p["retain"])
        for width in p["tiers"][1:]:
            actions += self._promote(width, cutoff)
        healed = self.backfill_stats()
        if healed:
            actions.append(Action("heal", paths=healed))
        rollup.feed(self)
        self._condense()
        return actions + self._collect(grace)

    def _settle(self, grace: int) -> None:
        """Segments of batches over several tables: landed ones become plain, old ones that never landed go."""
        if not any("txn" in s for s in self.state["hot"]):
            return
        state, now = self.manifest.edit(), _now()
        for s in state["hot"]:
            if "txn" in s and self.store.exists(s["txn"]):
                del s["txn"]
            elif "txn" in s and now - s["since"] > grace:
                s["buckets"] = {}
        self._retire_empty(state, now)
        if state != self.state:
            self.manifest = self.manifest.publish(state)

    def _condense(self) -> None:
        """Many folders of statistics or deltas become one; retired ones wait for their readers."""
        from strata.operators import rollup

        state, now = self.manifest.edit(), _now()
        if len(state["stats"]) > FOLDERS:
            old, files = state["stats"], [e["path"] for e in catalog.active(state)]
            rows = self.file_stats()
            state["stats"] = []
            self._add_stats(state, rows, files)
            state["retired"] += [{"path": f"stats/{s['id']}", "gone": now} for s in old]
        for grain in state["rollups"].values():
            state["retired"] += [{"path": f"rollups/{n}", "gone": now} for n in rollup.condense(self, grain, FOLDERS)]
        if state != self.state:
            self.manifest = self.manifest.publish(state)

    def _compact_closed(self, cutoff: int) -> list[Action]:
        """All closed tier-0 buckets by one job and one publish."""
        mine = self.segments()
        closed = sorted({int(b) for s in mine for b in s["buckets"] if int(b) + self.tier0 <= cutoff})
        if not closed:
            return []
        wanted = set(map(str, closed))
        paths = [self.store.at("hot", s["id"], f"{BUCKET}={b}") for s in mine for b in s["buckets"] if b in wanted]
        staged = self._stage_cold(self._read(paths), bucket(self.axis_micros(), self.tier0, self.origin))
        state, ids = self.manifest.edit(), {s["id"] for s in mine}
        for s in state["hot"]:
            if s["id"] in ids:
                s["buckets"] = {b: n for b, n in s["buckets"].items() if b not in wanted}
        return self._publish_cold(state, {b: (b, b + self.tier0) for b in closed}, staged)

    def merge_window(self, start: int, end: int) -> Action | None:
        """Merge the active files inside [start, end) into one; rollups are not touched."""
        found = self._merge([(start, end)])
        return found[0] if found else None

    def _promote(self, width: int, cutoff: int) -> list[Action]:
        return self._merge(catalog.windows_to_merge(self.state, width, self.origin, cutoff))

    def _merge(self, windows: list[tuple[int, int]]) -> list[Action]:
        children = {s: [e["path"] for e in catalog.within(self.state, s, e_)] for s, e_ in windows}
        for s, e_ in windows:
            inside = catalog.within(self.state, s, e_)
            if not inside or len(inside) == 1 and (inside[0]["start"], inside[0]["end"]) == (s, e_):
                children.pop(s)
        if not children:
            return []
        ends = dict(windows)
        axis, widths = self.axis_micros(), {ends[s] - s for s in children}
        if len(children) == 1:
            by = F.lit(next(iter(children))).cast("long")
        else:  # windows of one tier lie on its grid
            by = bucket(axis, widths.pop(), self.origin)
        staged = self._stage_cold(self._read(self._present([p for ps in children.values() for p in ps])), by)
        return self._publish_cold(self.manifest.edit(), {s: (s, ends[s]) for s in children}, staged, "merge", children)

    def backfill_stats(self) -> list[str]:
        """Statistics for active files that have none; the manifest knows which."""
        from strata.operators import rollup

        have = {s["id"] for s in self.state["stats"]}
        lacking = [e["path"] for e in catalog.active(self.state) if e.get("stats") not in have and e["rows"]]
        if lacking:
            state = self.manifest.edit()
            self._add_stats(state, rollup.write_cells(self, self._with_path(lacking), []), lacking)
            self.manifest = self.manifest.publish(state)
        return lacking

    def _collect(self, grace: int = GRACE) -> list[Action]:
        """Unlink what no version younger than ``grace`` names, after the publish that said so; names stay as tombstones."""
        before = _now() - grace
        gone = catalog.to_collect(self.state, before)
        retired = [r["path"] for r in self.state["retired"] if r["gone"] <= before]
        if not gone and not retired:
            return []
        state = self.manifest.edit()
        catalog.set_status(state, gone, catalog.PURGED)
        state["retired"] = [r for r in state["retired"] if r["gone"] > before]
        self.manifest = self.manifest.publish(state)
        for path in gone + [self.store.at(r) for r in retired]:
            self.store.delete(path)
        self._sweep(before)
        self.manifest.forget(before)
        return [Action("collect", paths=gone)] if gone else []

    def _sweep(self, before: int) -> None:
        """Delete files that a writer left unpublished, if they are older than ``before`` and no version names them."""
        known = {e["path"].rsplit("/", 1)[-1] for e in self.state["files"]}
        names = self.store.ages(self.store.folder) | {f"_staging/{n}": t for n, t in self.store.ages(self.store.at("_staging")).items()}
        for name, changed in names.items():
            if changed < before and name not in known and (name.startswith("_staging/") or re.fullmatch(r"bucket--?\d+--?\d+-[0-9a-f]{32}\.parquet", name)):
                self.store.delete(self.store.at(name))

    def set_retention(self, retain: str | int | None) -> None:
        us = policy.check_retention(self.state["policy"], retain)
        state = self.manifest.edit()
        state["policy"]["retain"] = us
        self.manifest = self.manifest.publish(state)

    # -- evolution -----------------------------------------------------------

    def add_column(self, declaration: str) -> None:
        """``"name TYPE"``; older rows read null.  Checked before the first change."""
        if "," in declaration:
            raise BadSchema("one column at a time")
        added = S.parse_schema(declaration)[0]
        if not added.declared:
            raise BadSchema(f"{added.name} needs a type")
        if any(c.name.lower() == added.name.lower() for c in self.columns):
            raise BadSchema(f"{self.name} has a column {added.name}")
        if any(r.get("tiered") for r in self.state["rollups"].values()):
            raise BadSchema("a rollup of this table is tiered; its columns are its own")
        state = self.manifest.edit()
        state["columns"].append([added.name, added.declared])
        self.manifest = self.manifest.publish(state)

    def describe(self) -> dict:
        p = self.state["policy"]
        return {"name": self.name, "tiers": [format_duration(t) for t in p["tiers"]], "retain": p["retain"], "origin": p["origin"], **catalog.summary(self.state)}


def _settings(spark: SparkSession) -> None:
    """INT64 timestamps carry statistics that the scan can prune by; INT96 ones do not."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")


__all__ = ["Action", "ScanStats", "TieredTable", "floor_bucket"]
