"""Catalog frames that follow from the points themselves: series, tags, chunks, segments, statistics, invalidations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.tags import series_id
from tideline.functions.time import bucket, width_us
from tideline.operators.aggregate import SERIES, finite, merge, summarise


def series(points: DataFrame) -> DataFrame:
    """One row for each series, with its surrogate key."""
    return points.select(*SERIES).distinct().select(series_id(F.col("metric_name"), F.col("tags_json")).alias("series_id"), *SERIES)


def new_series(points: DataFrame, known: DataFrame) -> DataFrame:
    """Series that are not known yet: the first write of a key wins."""
    return series(points).join(known, list(SERIES), "left_anti")


def tag_index(points: DataFrame) -> DataFrame:
    """metric_name, tag_key, tag_value, series_id; distinct before the tags are read."""
    tags = F.explode(F.from_json("tags_json", "map<string,string>")).alias("tag_key", "tag_value")
    return series(points).select("metric_name", "series_id", tags).distinct()


def chunks(points: DataFrame, width: str | int, ts: str = "ts_us") -> DataFrame:
    """metric_name, tags_json, [chunk_start_us, chunk_end_us) of each series' chunks."""
    size = width_us(width)
    start = bucket(F.col(ts), size).alias("chunk_start_us")
    return points.select(*SERIES, start).distinct().withColumn("chunk_end_us", F.col("chunk_start_us") + size)


def segments(points: DataFrame, width: str | int) -> DataFrame:
    """One row for each series and chunk: closed time bounds, rows, min, max and sum; with first and last to merge on."""
    bounds = (F.count(F.lit(1)).alias("row_count"), F.min("ts_us").alias("segment_start_us"), F.max("ts_us").alias("segment_end_us"))
    return summarise(points, width, more=bounds).withColumnRenamed("bucket_us", "chunk_start_us")


def merged_segments(found: DataFrame, width: str | int) -> DataFrame:
    """One row for each series and chunk of segments that several writes have left."""
    bounds = (F.sum("row_count").alias("row_count"), F.min("segment_start_us").alias("segment_start_us"), F.max("segment_end_us").alias("segment_end_us"))
    return merge(found.withColumnRenamed("chunk_start_us", "bucket_us"), width, more=bounds).withColumnRenamed("bucket_us", "chunk_start_us")


def segment_statistics(found: DataFrame) -> DataFrame:
    """As `statistics`, from segments: their rows, chunks, series and time bounds. One row for each metric."""
    return found.groupBy("metric_name").agg(
        F.sum("row_count").alias("row_count"), F.countDistinct("chunk_start_us").alias("chunk_count"), F.countDistinct("tags_json").alias("series_count"),
        F.min("segment_start_us").alias("min_time_us"), F.max("segment_end_us").alias("max_time_us"),
    )


def segment_columns(found: DataFrame) -> DataFrame:
    """Bytes of each packed column of a segment: 8 for a time, 8 for a value, 4 for a quality code, by row."""
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(k).alias("value_type"), F.lit(b).alias("bytes")) for n, k, b in (("quality", "i32-le", 4), ("ts_ns", "i64-le", 8), ("value_real", "f64-le", 8))])).alias("c")
    return found.select(*SERIES, "chunk_start_us", "row_count", kinds).select(*SERIES, "chunk_start_us", "c.column_name", "c.value_type", (F.col("row_count") * F.col("c.bytes")).cast("long").alias("data_bytes"))


def deduplicated(points: DataFrame, order: list[str], key: list[str] | None = None) -> DataFrame:
    """Last write wins: of the rows of one key, that with the greatest order."""
    key = key or [*SERIES, "ts_us"]
    rest = [c for c in points.columns if c not in key]
    best = points.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, "_r.*").select(*points.columns)


def statistics(points: DataFrame, width: str | int) -> DataFrame:
    """By metric: rows, distinct chunks and series, first and last time; recomputed, so that rewrites count once."""
    one = points.groupBy("metric_name", "tags_json", bucket(F.col("ts_us"), width_us(width)).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
    return one.groupBy("metric_name").agg(
        F.sum("n").alias("row_count"), F.countDistinct("chunk").alias("chunk_count"), F.countDistinct("tags_json").alias("series_count"),
        F.min("a").alias("min_time_us"), F.max("b").alias("max_time_us"),
    )


def overview(hypertables: DataFrame, stats: DataFrame) -> DataFrame:
    """Every hypertable with its statistics; zeros where it holds nothing."""
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("row_count", "chunk_count", "series_count")}
    return hypertables.join(stats, hypertables["table_name"] == stats["metric_name"], "left").select(*[hypertables[c] for c in hypertables.columns], *zero.values(), "min_time_us", "max_time_us")


def invalidations(batches: DataFrame, batch: str = "batch") -> DataFrame:
    """The range that each write makes stale: [first, last] time of its points."""
    return batches.groupBy(batch).agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count(F.lit(1)).alias("points"))


def dirty_buckets(ranges: DataFrame, width: str | int, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Buckets that the ranges touch, each once."""
    size = width_us(width)
    grid = F.sequence(bucket(F.col(start), size), bucket(F.col(end), size), F.lit(size).cast("long"))
    return ranges.select(F.explode(grid).alias("bucket_us")).distinct()


def expired(found: DataFrame, cutoff_us: int) -> DataFrame:
    """Chunks that end at or before the cutoff, as a flag."""
    return found.withColumn("expired", F.col("chunk_end_us") <= F.lit(cutoff_us))


def tag_cardinality(points: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct values of each tag key."""
    count = F.countDistinct if exact else F.approx_count_distinct
    return tag_index(points).groupBy("metric_name", "tag_key").agg(count("tag_value").alias("n_values"))


def series_statistics(points: DataFrame) -> DataFrame:
    """By series: rows, finite values, first and last time."""
    return points.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("row_count"), F.count(finite(F.col("value_real"))).alias("n_values"), F.min("ts_us").alias("min_time_us"), F.max("ts_us").alias("max_time_us"))
