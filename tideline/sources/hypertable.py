"""Hypertables: narrow samples in Parquet, partitioned by coarse time chunks, with summaries of each series and chunk.

A chunk is a partition folder; series are sorted inside its files, so that row groups can be skipped by series. Rollups
and statistics read the summaries, not the samples.

Every write has a number, which is the second partition level of all that it leaves (samples, summaries, series). A
number is open until one change of a small catalog table commits it: readers leave out open numbers, so that a write of
several tables is seen whole or not at all, and a write that fails leaves nothing. A rewrite (delete, update, compact)
writes the touched chunks anew and in the same commit declares their older numbers dead.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.errors import InvalidPoint, MissingHypertable, TidelineError
from tideline.functions.tags import identifier, table_name
from tideline.functions.time import bucket, width_us
from tideline.operators import catalog
from tideline.operators.aggregate import SERIES, bucketed, encode_names, finite, finished, merge, summarise
from tideline.operators.window import last_values
from tideline.sources import line_protocol
from tideline.sources.storage import Catalog, Files, fresh_path, write_back

POINTS = ("metric_name", "tags_json", "ts_us", "value_real", "quality", "seq")
DEFAULT_CHUNK_US = 3_600_000_000
DAY_US = 86_400_000_000
_POINTS = "metric_name string, tags_json string, ts_us long, value_real double, quality int, seq long"
_PLACE = "chunk_start_us long, write_id long"
_SEGMENTS = (
    "metric_name string, tags_json string, count long, n_finite long, sum double, min double, max double, first_ts_us long, first_seq long, first double, "
    "last_ts_us long, last_seq long, last double, row_count long, segment_start_us long, segment_end_us long"
)
_SERIES = "series_id long, metric_name string, tags_json string"
_SCHEMAS = {"points": f"{_POINTS}, {_PLACE}", "segments": f"{_SEGMENTS}, {_PLACE}", "series": f"{_SERIES}, write_id long"}
_ROLLUPS = "rollup_name string, table_name string, bucket_us long, aggregates string, refresh_lag_us long, enabled boolean, watermark_us long"
_STATISTICS = "table_name string, row_count long, chunk_count long, series_count long, min_time_us long, max_time_us long"
JOB_KINDS = ("compact", "downsample", "retention", "stats", "rollup_refresh")
#: Series that a tag filter may list in a scan; beyond that they are joined.
MAX_LISTED = 512
#: Ranges that wait for a table's rollups, beyond which those that touch are joined; chunks that one rewrite commits at once.
MAX_RANGES, CHUNKS_AT_ONCE = 256, 256


@dataclass
class WriteStats:
    points: int
    segments: int
    chunks: int


def points_of(df: DataFrame, metric: Column, tags: Column, ts_us: Column, value: Column, seq: Column, quality: Column | None = None) -> DataFrame:
    """Narrow samples of any table."""
    return df.select(metric.alias("metric_name"), tags.alias("tags_json"), ts_us.alias("ts_us"), value.cast("double").alias("value_real"), (F.lit(0) if quality is None else quality).cast("int").alias("quality"), seq.cast("long").alias("seq"))


def problem() -> Column:
    """Why a point cannot be written, or null."""
    v = F.col("value_real")
    return F.when(F.coalesce(F.trim("metric_name"), F.lit("")) == "", "blank measurement").when(F.col("ts_us").isNull(), "no time").when(v.isNotNull() & finite(v).isNull(), "value is not finite")


def validated(points: DataFrame) -> DataFrame:
    """Adds `error`: why a point cannot be written, or null."""
    return points.withColumn("error", problem())


def chunk_range(width: int, start_us: int | None, end_us: int | None, column: str = "chunk_start_us") -> Column:
    """The partition filter that follows from a half-open time range; Catalyst cannot derive it from the time column."""
    out = F.lit(True)
    if start_us is not None:
        out = out & (F.col(column) >= start_us - start_us % width)
    if end_us is not None:
        out = out & (F.col(column) < end_us)
    return out


def time_range(start_us: int | None, end_us: int | None, column: str = "ts_us") -> Column:
    out = F.lit(True)
    if start_us is not None:
        out = out & (F.col(column) >= start_us)
    if end_us is not None:
        out = out & (F.col(column) < end_us)
    return out


def united(ranges: Sequence[tuple[int, int]], reach: int = 0) -> list[tuple[int, int]]:
    """Closed ranges, sorted; those that overlap, or lie within `reach` of each other, are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1] + reach:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


class Timeseries:
    """A store of hypertables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.catalog, self.files = Catalog(spark, self.root), Files(spark)

    # -- tables

    def install(self) -> None:
        """Idempotent: catalog tables that are missing are made."""
        for name in ("hypertables", "retention", "rollups", "invalidations", "jobs", "statistics", "writes"):
            if not self.catalog.exists(name):
                self.catalog.replace(name, [])

    def create_hypertable(self, name: str, time_column: str = "ts_us", chunk: str | int = DEFAULT_CHUNK_US) -> None:
        self.catalog.upsert("hypertables", {"table_name": identifier(name), "time_column": identifier(time_column), "chunk_us": width_us(chunk)}, "table_name")

    def hypertable(self, name: str) -> dict:
        for row in self.catalog.rows("hypertables"):
            if row["table_name"] == name:
                return row
        raise MissingHypertable(name)

    def ensure(self, name: str) -> dict:
        """The table, made with the default chunk if it is missing; a chunk width that was set is never changed."""
        try:
            return self.hypertable(name)
        except MissingHypertable:
            self.create_hypertable(name)
            return self.hypertable(name)

    def path(self, name: str, what: str = "points") -> str:
        return f"{self.root}/{identifier(name)}/{what}"

    # -- writes

    @contextmanager
    def _transaction(self, name: str) -> Iterator[int]:
        """A number for a write; whatever it has left goes if the block fails before it commits."""
        rows = self.catalog.rows("writes")
        write_id = max((r["write_id"] for r in rows), default=0) + 1
        kept = [r for r in rows if r["state"] != "last"]
        self.catalog.replace("writes", [*kept, {"state": "last", "write_id": write_id}, {"state": "open", "write_id": write_id, "table_name": name}])
        try:
            yield write_id
        except BaseException:
            self._discard(name, write_id)
            raise

    def _commit(self, name: str, write_id: int, dead: Sequence[int] = (), batch: tuple[str, int] | None = None) -> None:
        """One change of the catalog: the write is seen, older rows of its `dead` chunks are not, and a stream's batch is done."""
        rows = [r for r in self.catalog.rows("writes") if not (r["state"] == "open" and r["write_id"] == write_id)]
        rows += [{"state": "dead", "write_id": write_id, "table_name": name, "chunk": c} for c in dead]
        if batch:
            rows = [r for r in rows if not (r["state"] == "batch" and r["table_name"] == name and r["source"] == batch[0])]
            rows.append({"state": "batch", "write_id": write_id, "table_name": name, "source": batch[0], "batch_id": batch[1]})
        self.catalog.replace("writes", rows)

    def _discard(self, name: str, write_id: int) -> None:
        for what in _SCHEMAS:
            for folder in self.files.matching(f"{self.path(name, what)}/chunk_start_us=*/write_id={write_id}") + self.files.matching(f"{self.path(name, what)}/write_id={write_id}"):
                self.files.delete(folder)
        self._commit(name, write_id)

    def recover(self) -> int:
        """Undo writes that were neither committed nor undone, and finish rewrites; for when no writer is running."""
        rows = self.catalog.rows("writes")
        for r in rows:
            if r["state"] == "open":
                self._discard(r["table_name"], r["write_id"])
        for name in {r["table_name"] for r in rows if r["state"] == "dead"}:
            self._purge(name)
        return sum(r["state"] == "open" for r in rows)

    def _purge(self, name: str) -> None:
        """Delete the folders of dead numbers, then forget them."""
        dead = [r for r in self.catalog.rows("writes") if r["state"] == "dead" and r["table_name"] == name]
        for r in dead:
            for what in ("points", "segments"):
                folder = f"{self.path(name, what)}/chunk_start_us={r['chunk']}"
                left = self.files.names(folder)
                old = [w for w in left if int(w.partition("=")[2]) < r["write_id"]]
                for w in [""] if left and len(old) == len(left) else old:
                    self.files.delete(f"{folder}/{w}" if w else folder)
        self.catalog.replace("writes", [r for r in self.catalog.rows("writes") if r not in dead])

    def _read(self, name: str, what: str, write_id: int | None = None) -> DataFrame:
        """What is committed of a table's samples, segments or series; or what one write has left."""
        path, schema = self.path(name, what), _SCHEMAS[what]
        files = (self.files.matching(f"{path}/chunk_start_us=*/write_id={write_id}") + self.files.matching(f"{path}/write_id={write_id}")) if write_id else [path] if self.files.exists(path) else []
        if not files:
            self.hypertable(name)
            return self.spark.createDataFrame([], schema)
        out = self.spark.read.schema(schema).option("basePath", path).parquet(*files)
        if write_id:
            return out
        rows = [r for r in self.catalog.rows("writes") if r.get("table_name") == name]
        hidden = [r["write_id"] for r in rows if r["state"] == "open"]
        if hidden:
            out = out.where(~F.col("write_id").isin(hidden))
        dead: dict[int, list[int]] = {}
        for r in rows:
            if r["state"] == "dead" and what in ("points", "segments"):
                dead.setdefault(r["write_id"], []).append(r["chunk"])
        for number, chunks in dead.items():
            out = out.where(~(F.col("chunk_start_us").isin(chunks) & (F.col("write_id") < number)))
        return out

    def _append(self, df: DataFrame, name: str, what: str, write_id: int) -> None:
        """Rebalancing splits a large chunk over tasks and joins small ones, by measured size."""
        numbered = df.withColumn("write_id", F.lit(write_id).cast("long"))
        order = [c for c in ("ts_us", "seq") if c in df.columns]
        if "chunk_start_us" in df.columns:
            numbered.hint("rebalance", "chunk_start_us").sortWithinPartitions("chunk_start_us", *SERIES, *order).write.mode("append").partitionBy("chunk_start_us", "write_id").parquet(self.path(name, what))
        else:
            numbered.write.mode("append").partitionBy("write_id").parquet(self.path(name, what))

    def _write(self, name: str, points: DataFrame, width: int, write_id: int) -> DataFrame:
        """Samples, checked on their way, and the segments of what has been written; the input is evaluated once."""
        wrong = problem()
        checked = F.when(wrong.isNull(), F.col("value_real")).otherwise(F.raise_error(F.concat(F.lit("invalid point: "), wrong)).cast("double"))
        placed = points.select(*[checked.alias(c) if c == "value_real" else F.col(c) for c in POINTS], bucket(F.col("ts_us"), width).alias("chunk_start_us"))
        try:
            self._append(placed, name, "points", write_id)
        except Exception as error:
            if found := re.search(r"invalid point: ([a-z ]+)", str(error)):
                raise InvalidPoint(found[1].strip()) from error
            raise
        self._append(catalog.segments(self._read(name, "points", write_id).drop("chunk_start_us", "write_id"), width), name, "segments", write_id)
        return self._read(name, "segments", write_id)

    def write_points(self, name: str, points: DataFrame, reason: str = "write", batch: tuple[str, int] | None = None) -> WriteStats:
        """Append valid samples; the first invalid one fails the write, and then nothing is visible.

        With the source and number of a stream's batch, a batch that has been written before is left out.
        """
        width = self.ensure(name)["chunk_us"]
        if batch and any(r["state"] == "batch" and r["table_name"] == name and r["source"] == batch[0] and r["batch_id"] >= batch[1] for r in self.catalog.rows("writes")):
            return WriteStats(0, 0, 0)
        with self._transaction(name) as write_id:
            found = self._write(name, points, width, write_id)
            stats = found.agg(F.coalesce(F.sum("row_count"), F.lit(0)), F.count(F.lit(1)), F.countDistinct("chunk_start_us"), F.min("segment_start_us"), F.max("segment_end_us")).first()
            if stats[0]:
                new = catalog.new_series(found, self.series(name)).select(*(c.split()[0] for c in _SERIES.split(", ")))
                self._append(new, name, "series", write_id)
                self.invalidate(name, [(stats[3], stats[4])], reason)
            self._commit(name, write_id, batch=batch)
        return WriteStats(*stats[:3])

    def write_line_protocol(self, lines: DataFrame, table: str | None = None, column: str = "value", seq: Column | None = None, batch: tuple[str, int] | None = None) -> dict[str, WriteStats]:
        """Parse, then write each measurement to its own table (`table_name` of it), or all to the one named, which then
        is the measurement of all. A bad line fails the batch before anything is written."""
        parsed = line_protocol.strict(line_protocol.parse(lines, column))
        narrow = line_protocol.samples(parsed, F.monotonically_increasing_id() if seq is None else seq, table)
        staged = fresh_path(self.spark, "lines")
        narrow.write.partitionBy("measurement").parquet(staged)
        try:
            rows = self.spark.read.schema(f"{_POINTS}, measurement string").parquet(staged)
            found = [table] if table else sorted(r[0] for r in rows.select("measurement").distinct().collect())  # one row for each table
            return {m: self.write_points(table_name(m), rows if table else rows.where(F.col("measurement") == m), batch=batch) for m in found}
        finally:
            self.files.delete(staged)

    def delete_rows(self, name: str, condition: Column) -> None:
        """Rewrite the chunks that hold matching rows, without them; rollups and segments follow."""
        self._rewrite(name, lambda df: df.where(~F.coalesce(condition, F.lit(False))), self._touched(name, condition), "delete")

    def update_rows(self, name: str, condition: Column, value: Column) -> None:
        self._rewrite(name, lambda df: df.withColumn("value_real", F.when(condition, value).otherwise(F.col("value_real"))), self._touched(name, condition), "update")

    def _touched(self, name: str, condition: Column) -> list[int]:
        return sorted(r[0] for r in self.points(name).where(condition).select("chunk_start_us").distinct().collect())  # chunks, not rows

    def _rewrite(self, name: str, change: Callable[[DataFrame], DataFrame], chunks: Sequence[int], reason: str | None) -> None:
        """Write the given chunks anew; no other chunk is read."""
        width = self.hypertable(name)["chunk_us"]
        for at in range(0, len(chunks), CHUNKS_AT_ONCE):
            some = list(chunks[at : at + CHUNKS_AT_ONCE])
            with self._transaction(name) as write_id:
                self._write(name, change(self.points(name).where(F.col("chunk_start_us").isin(some))), width, write_id)
                if reason:
                    self.invalidate(name, [(c, c + width - 1) for c in some], reason)
                self._commit(name, write_id, dead=some)
            self._purge(name)

    # -- reads

    def points(self, name: str) -> DataFrame:
        return self._read(name, "points").drop("write_id")

    def series(self, name: str) -> DataFrame:
        """The series of a table, each with the key that its first write gave it."""
        return self._read(name, "series").drop("write_id")

    def tags(self, name: str) -> DataFrame:
        """metric_name, series_id, tag_key and tag_value of every series; made of the table of series, which is small."""
        return catalog.tag_index(self.series(name))

    def scan(self, name: str, start_us: int | None = None, end_us: int | None = None, where: Column | None = None, tags: dict[str, str | list[str]] | None = None) -> DataFrame:
        """Samples of a half-open time range; prunes chunks, then row groups, then rows. Tags are looked up in the table
        of series, so that samples are filtered by their stored key and not by reading each row's tags."""
        width = self.hypertable(name)["chunk_us"]
        out = self.points(name).where(chunk_range(width, start_us, end_us)).where(time_range(start_us, end_us))
        if tags:
            wanted = self.series(name)
            for key, value in tags.items():
                have = F.col("tag_value").isin(value) if isinstance(value, list) else F.col("tag_value") == value
                wanted = wanted.join(self.tags(name).where((F.col("tag_key") == identifier(key)) & have).select("series_id"), "series_id", "left_semi")
            keys = wanted.select("tags_json").distinct()
            some = [r[0] for r in keys.limit(MAX_LISTED + 1).collect()]
            out = out.where(F.col("tags_json").isin(some)) if len(some) <= MAX_LISTED else out.join(keys, "tags_json", "left_semi")
        return (out if where is None else out.where(where)).select(*POINTS)

    def read_points(self, name: str, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
        return self.scan(name, start_us, end_us).orderBy(*SERIES, "ts_us", "seq")

    def aggregate(self, name: str, width: str | int, names: Sequence[str], start_us: int | None = None, end_us: int | None = None) -> DataFrame:
        """Bucketed aggregates in the order of series and bucket."""
        return bucketed(self.scan(name, start_us, end_us), width, names).orderBy(*SERIES, "bucket_us")

    def first_point(self, name: str, where: Column | None = None) -> DataFrame:
        """The earliest sample, one row at most: every task keeps one."""
        return self.scan(name, where=where).orderBy("ts_us", "seq").limit(1)

    def segments(self, name: str) -> DataFrame:
        """One summary for each series and chunk, whatever the number of writes."""
        return catalog.merged_segments(self._read(name, "segments").drop("write_id"), self.hypertable(name)["chunk_us"])

    def overlapping_segments(self, name: str, start_us: int, end_us: int) -> DataFrame:
        return self.segments(name).where((F.col("segment_end_us") >= start_us) & (F.col("segment_start_us") < end_us))

    def register_views(self, name: str, width: str | int = "1h", names: Sequence[str] = ("count", "sum", "avg", "min", "max")) -> list[str]:
        """Temporary views <table>_scan (in the order of time and arrival), _series, _chunks, _segments, _last_value and
        _aggregate, and <rollup>_rollup for each of the table's rollups that has been refreshed."""
        points = self.points(name)
        made = {
            "scan": points.orderBy("ts_us", "seq"), "series": self.series(name), "segments": self.segments(name), "last_value": last_values(points),
            "chunks": self.segments(name).select(*SERIES, "chunk_start_us", (F.col("chunk_start_us") + self.hypertable(name)["chunk_us"]).alias("chunk_end_us")),
            "aggregate": bucketed(points, width, names),
        }
        views = {f"{name}_{suffix}": df for suffix, df in made.items()}
        views |= {f"{r['rollup_name']}_rollup": self.query_rollup(r["rollup_name"]) for r in self.catalog.rows("rollups") if r["table_name"] == name and self.files.exists(self.path(r["rollup_name"], "rollup"))}
        for view, df in views.items():
            df.createOrReplaceTempView(view)
        return sorted(views)

    # -- rollups

    def create_rollup_policy(self, rollup: str, table: str, width: str | int, aggregates: Sequence[str], refresh_lag: int = 0, enabled: bool = True) -> None:
        self.hypertable(table)
        row = {"rollup_name": identifier(rollup), "table_name": table, "bucket_us": width_us(width), "aggregates": encode_names(aggregates), "refresh_lag_us": refresh_lag, "enabled": enabled, "watermark_us": None, "seen": None}
        self.catalog.upsert("rollups", row, "rollup_name")

    def rollup_policy(self, rollup: str) -> dict:
        for row in self.catalog.rows("rollups"):
            if row["rollup_name"] == rollup:
                return row
        raise MissingHypertable(rollup)

    def summaries(self, table: str, width: int, ranges: Sequence[tuple[int, int]] | None = None) -> DataFrame:
        """Summaries by series and bucket, of the given ranges of whole buckets or of all: from segments where buckets are
        made of whole chunks, else from samples. Ranges prune chunks before anything is read."""
        chunk = self.hypertable(table)["chunk_us"]

        def inside(df: DataFrame, column: str | None) -> DataFrame:
            if ranges is None:
                return df
            some = F.lit(False)
            for start, end in ranges:
                here = chunk_range(chunk, start, end + 1)
                some = some | (here & time_range(start, end + 1, column) if column else here)
            return df.where(some)

        if width % chunk == 0:
            return merge(inside(self._read(table, "segments"), None).withColumnRenamed("chunk_start_us", "bucket_us"), width)
        return summarise(inside(self.points(table), "ts_us"), width)

    def refresh_rollup(self, rollup: str, full: bool = False) -> int:
        """Rebuild the parts of a rollup (days, or buckets where those are longer) that changes since its last refresh
        have touched, or all. Returns how many buckets were written."""
        policy = self.rollup_policy(rollup)
        table, path, width = policy["table_name"], self.path(rollup, "rollup"), policy["bucket_us"]
        size = max(width, DAY_US // width * width or width)
        known = [r for r in self.catalog.rows("invalidations") if r["table_name"] == table]
        seen = max((r["id"] for r in known), default=policy["seen"] or 0)
        stale = [r for r in known if policy["seen"] is None or r["id"] > policy["seen"]]
        part = bucket(F.col("bucket_us"), size).alias("part_us")
        if full or policy["seen"] is None or not self.files.exists(path):
            write_back(self.files, self.summaries(table, width).select("*", part), path, "part_us")
            n = self.spark.read.parquet(path).count()
        elif stale:
            parts = united([(r["start_us"] - r["start_us"] % size, r["end_us"] - r["end_us"] % size + size - 1) for r in stale], 1)
            made = self.summaries(table, width, parts).select("*", part)
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part_us").parquet(path)
            touched = F.lit(False)
            for start, end in parts:
                touched = touched | F.col("part_us").between(start, end)
            # Parts that hold nothing any more are not overwritten, so they go.
            left = {r[0]: r[1] for r in made.groupBy("part_us").count().collect()}
            for folder in self.files.names(path):
                key, _, start = folder.partition("=")
                if key == "part_us" and int(start) not in left and any(a <= int(start) <= b for a, b in parts):
                    self.files.delete(f"{path}/{folder}")
            n = sum(left.values())
        else:
            return 0
        top = self._read(table, "segments").agg(F.max("segment_end_us")).first()[0]
        self.catalog.upsert("rollups", policy | {"watermark_us": top, "seen": seen}, "rollup_name")
        # What all of the table's rollups have seen is done.
        all_seen = min((r["seen"] if r["seen"] is not None else -1) for r in self.catalog.rows("rollups") if r["table_name"] == table)
        self.catalog.replace("invalidations", [r for r in self.catalog.rows("invalidations") if r["table_name"] != table or r["id"] > all_seen])
        return n

    def query_rollup(self, rollup: str) -> DataFrame:
        """The rollup's aggregates in the order of series and bucket."""
        names = self.rollup_policy(rollup)["aggregates"].split(",")
        return finished(self.spark.read.parquet(self.path(rollup, "rollup")).drop("part_us"), names).orderBy(*SERIES, "bucket_us")

    def rollup_status(self) -> DataFrame:
        return self.catalog.frame("rollups", _ROLLUPS)

    # -- lifecycle

    def invalidate(self, name: str, ranges: Sequence[tuple[int, int]], reason: str) -> None:
        """Closed time ranges that rollups have to make anew; numbered, as each rollup keeps what it has seen."""
        rows = self.catalog.rows("invalidations")
        number = max([r["id"] for r in rows] + [r["seen"] or 0 for r in self.catalog.rows("rollups")], default=0)
        rows += [{"id": number + 1, "table_name": name, "start_us": a, "end_us": b, "reason": reason} for a, b in united(ranges, 1)]
        mine = [r for r in rows if r["table_name"] == name]
        if len(mine) > MAX_RANGES:
            width = self.hypertable(name)["chunk_us"]
            joined = united([(r["start_us"] - r["start_us"] % width, r["end_us"] - r["end_us"] % width + width - 1) for r in mine], 1)
            joined = joined if len(joined) <= MAX_RANGES else [(joined[0][0], joined[-1][1])]
            rows = [r for r in rows if r["table_name"] != name] + [{"id": number + 1, "table_name": name, "start_us": a, "end_us": b, "reason": "several"} for a, b in joined]
        self.catalog.replace("invalidations", rows)

    def add_retention_policy(self, name: str, interval: str | int) -> None:
        self.hypertable(name)
        self.catalog.upsert("retention", {"table_name": name, "interval_us": width_us(interval)}, "table_name")

    def drop_chunks_before(self, name: str, cutoff_us: int) -> int:
        """Drop whole chunks that end at or before the cutoff, samples and summaries alike, unseen from one commit on.
        Rollups keep what they have. Returns how many."""
        width = self.hypertable(name)["chunk_us"]
        found = [int(folder.partition("=")[2]) for folder in self.files.names(self.path(name)) if folder.startswith("chunk_start_us=")]
        gone = [start for start in found if start + width <= cutoff_us]
        if gone:
            with self._transaction(name) as write_id:
                self._commit(name, write_id, dead=gone)
            self._purge(name)
        return len(gone)

    def run_retention(self, now_us: int, name: str | None = None) -> int:
        return sum(self.drop_chunks_before(r["table_name"], now_us - r["interval_us"]) for r in self.catalog.rows("retention") if name in (None, r["table_name"]))

    def statistics(self, name: str) -> DataFrame:
        """By metric, from the segments."""
        return catalog.segment_statistics(self._read(name, "segments"))

    def refresh_statistics(self, name: str) -> dict:
        """The table's row in the catalog: rows, chunks, series and time bounds."""
        found = self._read(name, "segments").agg(F.coalesce(F.sum("row_count"), F.lit(0)), F.countDistinct("chunk_start_us"), F.countDistinct(*SERIES), F.min("segment_start_us"), F.max("segment_end_us")).first()
        row = dict(zip([c.split()[0] for c in _STATISTICS.split(", ")], [name, *found], strict=True))
        self.catalog.upsert("statistics", row, "table_name")
        return row

    def table_statistics(self) -> DataFrame:
        """Every hypertable with the statistics of its last refresh; zeros where there was none."""
        tables = self.spark.createDataFrame([(r["table_name"], r["chunk_us"]) for r in self.catalog.rows("hypertables")], "table_name string, chunk_us long")
        return catalog.overview(tables, self.catalog.frame("statistics", _STATISTICS).withColumnRenamed("table_name", "metric_name"))

    def compact(self, name: str, all_chunks: bool = False) -> int:
        """Rewrite chunks that several writes have left into few sorted files; rows stay as they are. Returns how many chunks."""
        path = self.path(name)
        chunks = [int(folder.partition("=")[2]) for folder in self.files.names(path) if folder.startswith("chunk_start_us=") and (all_chunks or len(self.files.names(f"{path}/{folder}")) > 1)]
        self._rewrite(name, lambda df: df, sorted(chunks), None)
        return len(chunks)

    def enqueue(self, kind: str, name: str) -> int:
        if kind not in JOB_KINDS:
            raise TidelineError(f"unknown job kind: {kind!r}")
        jobs = self.catalog.rows("jobs")
        job = {"job_id": max((j["job_id"] for j in jobs), default=0) + 1, "kind": kind, "table_name": name, "state": "queued"}
        self.catalog.replace("jobs", [*jobs, job])
        return job["job_id"]

    def _refresh_rollups(self, name: str | None = None) -> int:
        found = [r["rollup_name"] for r in self.catalog.rows("rollups") if r["enabled"] and name in (None, r["table_name"])]
        for rollup in found:
            self.refresh_rollup(rollup)
        return len(found)

    def run_maintenance(self, now_us: int, retention: bool = True, downsample: bool = True, stats: bool = True, compact: bool = False, budget_ms: int | None = None) -> dict[str, int]:
        """Retention, rollups, statistics, compaction and queued jobs, in this order; a budget stops between jobs. A queued
        job is done once it has run, and only then."""
        began, report = time.monotonic(), {"chunks_dropped": 0, "rollups": 0, "tables": 0, "compacted": 0, "jobs": 0, "stopped": 0}
        tables = [r["table_name"] for r in self.catalog.rows("hypertables")]
        kinds: dict[str, tuple[str, Callable[[str], int]]] = {
            "retention": ("chunks_dropped", lambda t: self.run_retention(now_us, t)), "downsample": ("rollups", self._refresh_rollups), "rollup_refresh": ("rollups", self._refresh_rollups),
            "stats": ("tables", lambda t: (self.refresh_statistics(t), 1)[1]), "compact": ("compacted", lambda t: (self.compact(t), 1)[1]),
        }
        wanted = {"retention": retention, "downsample": downsample, "stats": stats, "compact": compact}
        work = [(kind, t, None) for kind, go in wanted.items() if go for t in tables]
        work += [(j["kind"], j["table_name"], j["job_id"]) for j in self.catalog.rows("jobs") if j["state"] == "queued"]
        for kind, table, job in work:
            if budget_ms is not None and (time.monotonic() - began) * 1000 > budget_ms:
                report["stopped"] = 1
                break
            what, run = kinds[kind]
            report[what] += run(table)
            if job is not None:
                report["jobs"] += 1
                self.catalog.replace("jobs", [j | {"state": "done"} if j["job_id"] == job else j for j in self.catalog.rows("jobs")])
        return report
