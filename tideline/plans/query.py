"""From requests to DataFrames: scan and aggregate plans, JSON queries, rollup routing, scan costs."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.errors import TidelineError
from tideline.functions.tags import identifier
from tideline.functions.time import bucket, width_us
from tideline.operators.aggregate import SERIES, SUMMARY, bucketed, finished, merge, summarise
from tideline.operators.window import stepped
from tideline.sources.hypertable import time_range


@dataclass
class ScanPlan:
    hypertable: str
    start_us: int | None = None
    end_us: int | None = None
    tags: dict[str, str | list[str]] = field(default_factory=dict)

    def condition(self) -> Column:
        """Only stored columns are compared, so that the filter reaches the Parquet scan where it can."""
        out = time_range(self.start_us, self.end_us)
        for key, value in self.tags.items():
            have = F.get_json_object("tags_json", f"$.{identifier(key)}")
            out = out & (have.isin(value) if isinstance(value, list) else have == value)
        return out

    def apply(self, points: DataFrame) -> DataFrame:
        return points.where(self.condition())


@dataclass
class AggregatePlan:
    scan: ScanPlan
    bucket: str | int
    aggregates: Sequence[str]
    group_by: Sequence[str] = SERIES

    def apply(self, points: DataFrame) -> DataFrame:
        return bucketed(_with_tags(self.scan.apply(points), self.group_by), self.bucket, self.aggregates, self.group_by)


def _with_tags(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns for tags that are grouped by."""
    missing = [n for n in names if n not in points.columns]
    return points.select("*", *[F.get_json_object("tags_json", f"$.{identifier(n)}").alias(n) for n in missing])


def query_json(points: DataFrame, text: str) -> DataFrame:
    """{"from", "to", "bucket", "group_by", "aggregates": {"value": [...]}, "where": {tag: value or list}}."""
    q = json.loads(text)
    if "bucket" not in q or not q.get("aggregates"):
        raise TidelineError("a query needs a bucket and aggregates")
    names = [n for _, names in q["aggregates"].items() for n in names]
    scan = ScanPlan(q.get("hypertable", ""), q.get("from"), q.get("to"), q.get("where", {}))
    return AggregatePlan(scan, q["bucket"], names, q.get("group_by") or SERIES).apply(points)


def window_json(points: DataFrame, text: str) -> DataFrame:
    """{"from", "to", "partition_by", "window", "step", "functions": {"value": [...]}, "where": {...}}."""
    q = json.loads(text)
    if "window" not in q or not q.get("functions"):
        raise TidelineError("a window query needs a window and functions")
    by = q.get("partition_by") or list(SERIES)
    scan = ScanPlan(q.get("hypertable", ""), q.get("from"), q.get("to"), q.get("where", {}))
    names = [n for _, names in q["functions"].items() for n in names]
    return stepped(_with_tags(scan.apply(points), by), q["window"], q.get("step", q["window"]), names, by)


@dataclass
class Rollup:
    width_us: int
    summaries: DataFrame


def route(points: DataFrame, rollups: Sequence[Rollup], width: str | int, names: Sequence[str], start_us: int | None = None, end_us: int | None = None, by: Sequence[str] = SERIES) -> DataFrame:
    """Bucketed aggregates from the coarsest rollup that can give them; buckets that the range cuts come from samples."""
    size = width_us(width)
    given = {*SUMMARY, "avg", "delta"}
    fit = [r for r in rollups if size % r.width_us == 0 and given.issuperset(names)]
    if not fit:
        return bucketed(points.where(time_range(start_us, end_us)), size, names, by)
    best = max(fit, key=lambda r: r.width_us)
    low = None if start_us is None else -(-start_us // best.width_us) * best.width_us
    high = None if end_us is None else end_us // best.width_us * best.width_us
    whole = best.summaries.where(time_range(low, high, "bucket_us"))
    parts = whole.select(*by, "bucket_us", *SUMMARY)
    edges = []
    if low is not None and high is not None and low > high:
        return bucketed(points.where(time_range(start_us, end_us)), size, names, by)
    if low is not None and low > start_us:
        edges.append((start_us, low if end_us is None else min(low, end_us)))
    if high is not None and high < end_us:
        edges.append((max(high, start_us) if start_us is not None else high, end_us))
    for a, b in edges:
        parts = parts.unionByName(summarise(points.where(time_range(a, b)), best.width_us, by).select(*by, "bucket_us", *SUMMARY))
    return finished(merge(parts, size, by), names)


def scan_cost(row_count: int, min_time_us: int | None, max_time_us: int | None, series_count: int, start_us: int | None = None, end_us: int | None = None, series_eq: int | None = None) -> int:
    """Rows that a scan is thought to read: all rows by the shares of time and series asked for; one at least."""
    width = max_time_us - min_time_us if min_time_us is not None and max_time_us is not None and max_time_us > min_time_us else 1
    time_share = 1.0 if start_us is None or end_us is None else min(1.0, max(1, end_us - start_us) / width)
    series_share = 1.0 if series_eq is None else min(1.0, series_eq / max(1, series_count))
    return int(max(1.0, row_count * time_share * series_share))


def scan_costs(stats: DataFrame, start_us: int, end_us: int, series_eq: int) -> DataFrame:
    """Column form of scan_cost over statistics."""
    width = F.greatest(F.col("max_time_us") - F.col("min_time_us"), F.lit(1))
    time_share = F.least(F.lit(1.0), F.lit(float(max(1, end_us - start_us))) / width)
    series_share = F.least(F.lit(1.0), F.lit(float(series_eq)) / F.greatest("series_count", F.lit(1)))
    return stats.withColumn("estimated_rows", F.greatest(F.lit(1.0), F.col("row_count") * time_share * series_share).cast("long"))


def bucketed_view(points: DataFrame, width: str | int) -> DataFrame:
    return points.withColumn("bucket_us", bucket(F.col("ts_us"), width_us(width)))
