"""Registered queries over the test tables, with the SQL that gives the same rows.

`events` is the main hypertable (tags event_type and user_id, arrival order event_id), `lineitem` one with ties.
Sums are rounded to the cents that the data has, so that the order of additions does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import tags as tag_functions
from tideline.functions.time import duration_us, micros, time_bucket, time_bucket_ms, time_bucket_ns
from tideline.operators import catalog, join, window
from tideline.operators.aggregate import bucketed, finished, histogram, merge, percentiles, summarise
from tideline.plans import query as plans
from tideline.session import pin_utc
from tideline.sources import line_protocol, segment
from tideline.sources.hypertable import Timeseries, points_of
from tideline.sources.storage import fresh_path
from tideline.streaming import aggregates as streams

DAY, HOUR = 86_400_000_000, 3_600_000_000
#: 2024-01-10 and 2024-01-12 in microseconds.
FROM_US, TO_US = 1_704_844_800_000_000, 1_705_017_600_000_000
_ALL = ("count", "sum", "avg", "min", "max", "first", "last")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow samples of events, with their columns beside them."""
    raw = pin_utc(spark).read.parquet(f"{sf_dir}/events.parquet")
    ts = micros(F.col("ts"))
    tags = tag_functions.tags_json(tag_functions.tags_of(user_id=F.col("user_id"), event_type=F.col("event_type")))
    return raw.select("event_id", "user_id", "event_type", "ts", ts.alias("ts_us"), F.col("value").alias("value_real"), F.lit("events").alias("metric_name"), tags.alias("tags_json"), F.lit(0).alias("quality"), F.col("event_id").alias("seq"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = pin_utc(spark).read.parquet(f"{sf_dir}/lineitem.parquet")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return raw.select(F.col("l_suppkey").alias("supplier"), micros(F.col("l_shipdate")).alias("ts_us"), F.col("l_quantity").alias("value_real"), order.alias("seq"), "l_extendedprice")


def r(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


# -- scalar functions

for _name, _width, _us in (("time_bucket_5m", "5m", 300_000_000), ("time_bucket_1h", "1h", HOUR), ("time_bucket_1d", "1d", DAY)):
    query(_name, f"select event_id, epoch_us(ts) - epoch_us(ts) % {_us} as bucket_us from events")(lambda spark, d, w=_width: events(spark, d).select("event_id", time_bucket(w, F.col("ts_us")).alias("bucket_us")))


@query("time_bucket_negative", "select event_id, x - ((x % 3600000000 + 3600000000) % 3600000000) as bucket_us from (select event_id, epoch_us(ts) - 1893456000000000 as x from events)")
def _(spark, d):
    return events(spark, d).select("event_id", time_bucket("1h", F.col("ts_us") - F.lit(1_893_456_000_000_000)).alias("bucket_us"))


@query("time_bucket_units", "select event_id, x // 1000 - (x // 1000) % 60000 as bucket_ms, x * 1000 - (x * 1000) % 60000000000 as bucket_ns from (select event_id, epoch_us(ts) as x from events)")
def _(spark, d):
    t = F.col("ts_us")
    return events(spark, d).select("event_id", time_bucket_ms(F.expr("ts_us div 1000"), 60_000).alias("bucket_ms"), time_bucket_ns(t * 1000, 60_000_000_000).alias("bucket_ns"))


@query("duration_parse", """
select event_id, (event_id % 90 + 1) * case event_id % 8 when 0 then 1 when 1 then 1 when 2 then 1000 when 3 then 1000000 when 4 then 60000000
  when 5 then 3600000000 when 6 then 86400000000 else 604800000000 end as micros from events""")
def _(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("us", "µs", "ms", "s", "m", "h", "d", "w")]), (F.col("event_id") % 8 + 1).cast("int"))
    return events(spark, d).select("event_id", duration_us(F.concat((F.col("event_id") % 90 + 1).cast("string"), unit)).alias("micros"))


@query("tags_canonical", """select c_custkey, '{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' as tags_json from customer""")
def _(spark, d):
    tags = tag_functions.tags_of(segment=F.col("c_mktsegment"), name=F.col("c_name"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", tag_functions.tags_json(tags).alias("tags_json"))


@query("crc32_props", """
with crc_table as (select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by n) as crc from (select unnest(range(256)) as n)),
hexed as (select event_id, hex(encode(props)) as h from events)
select event_id, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || h[i:i + 1])::bigint)),
  lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8))) as crc from hexed, crc_table""")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.crc32(F.col("props").cast("binary")).alias("crc"))


# -- aggregates and rollups

_AGG = """count(value)::bigint as count, round(sum(value), 2) as sum, round(avg(value), 6) as avg, min(value) as min, max(value) as max,
  arg_min(value, (ts, event_id)) as first, arg_max(value, (ts, event_id)) as last"""


def _seven(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, "sum", digits=2), "avg")


@query("bucket_agg_all", f"select event_type, epoch_us(ts) - epoch_us(ts) % {DAY} as bucket_us, {_AGG} from events group by 1, 2")
def _(spark, d):
    return _seven(bucketed(events(spark, d), "1d", _ALL, ["event_type"]))


@query("bucket_agg_user_hour", f"select user_id, epoch_us(ts) - epoch_us(ts) % {HOUR} as bucket_us, {_AGG} from events group by 1, 2")
def _(spark, d):
    return _seven(bucketed(events(spark, d), "1h", _ALL, ["user_id"]))


@query("lineitem_agg_month", """
select l_suppkey as supplier, epoch_us(l_shipdate) - epoch_us(l_shipdate) % 2592000000000 as bucket_us, count(l_quantity)::bigint as count, sum(l_quantity) as sum,
  arg_min(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) as first, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) as last
from lineitem group by 1, 2""")
def _(spark, d):
    return bucketed(lines(spark, d), "30d", ("count", "sum", "first", "last"), ["supplier"])


@query("rollup_ties_lineitem", """
select l_suppkey as supplier, epoch_us(l_shipdate) - epoch_us(l_shipdate) % 2592000000000 as bucket_us, count(l_quantity)::bigint as count, sum(l_quantity) as sum, round(avg(l_quantity), 6) as avg,
  arg_min(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) as first, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) as last
from lineitem group by 1, 2""")
def _(spark, d):
    """Months from days: lines of one day are ties, which the days' summaries keep apart by arrival."""
    by = ["supplier"]
    return rounded(finished(merge(summarise(lines(spark, d), "1d", by), "30d", by), ("count", "sum", "avg", "first", "last")), "avg")


@query("adhoc_count_avg", """select '{"event_type":"' || event_type || '","user_id":"' || user_id || '"}' as tags_json, epoch_us(ts) - epoch_us(ts) % 604800000000 as bucket_us,
  count(*)::bigint as count, round(avg(value), 6) as avg from events group by 1, 2""")
def _(spark, d):
    return rounded(bucketed(events(spark, d), "1w", ("count", "avg"), ["tags_json"]), "avg")


def _rollup_sql(width: int) -> str:
    return f"select event_type, epoch_us(ts) - epoch_us(ts) % {width} as bucket_us, {_AGG} from events group by 1, 2"


@query("rollup_from_segments", _rollup_sql(DAY))
def _(spark, d):
    hours = summarise(events(spark, d), "1h", ["event_type"])
    return _seven(finished(merge(hours, "1d", ["event_type"]), _ALL))


@query("rollup_cascade_1m_5m_1h", _rollup_sql(HOUR))
def _(spark, d):
    by = ["event_type"]
    return _seven(finished(merge(merge(summarise(events(spark, d), "1m", by), "5m", by), "1h", by), _ALL))


@query("rollup_incremental_refresh", _rollup_sql(DAY))
def _(spark, d):
    """A rollup that has not seen every tenth event, refreshed in the buckets that those touch."""
    points, by = events(spark, d), ["event_type"]
    old = summarise(points.where("event_id % 10 <> 0"), "1d", by)
    late = points.where("event_id % 10 = 0").withColumn("batch", F.expr("event_id div 500"))
    dirty = catalog.dirty_buckets(catalog.invalidations(late), "1d")
    fresh = summarise(points.withColumn("_b", time_bucket("1d", F.col("ts_us"))).join(dirty, F.col("_b") == F.col("bucket_us"), "left_semi"), "1d", by)
    return _seven(finished(old.join(dirty, "bucket_us", "left_anti").unionByName(fresh), _ALL))


@query("rollup_routed", f"select event_type, epoch_us(ts) - epoch_us(ts) % {DAY} as bucket_us, count(value)::bigint as count, round(sum(value), 2) as sum, round(avg(value), 6) as avg from events where epoch_us(ts) >= {FROM_US + 1_234_567} and epoch_us(ts) < {TO_US + 7_654_321} group by 1, 2")
def _(spark, d):
    points, by = events(spark, d), ["event_type"]
    rollups = [plans.Rollup(60_000_000, summarise(points, "1m", by)), plans.Rollup(HOUR, summarise(points, "1h", by))]
    return rounded(rounded(plans.route(points, rollups, "1d", ("count", "sum", "avg"), FROM_US + 1_234_567, TO_US + 7_654_321, by), "sum", digits=2), "avg")


@query("rollup_query_by_name", f"select epoch_us(ts) - epoch_us(ts) % {DAY} as bucket_us, round(avg(value), 6) as avg from events where event_type = 'click' group by 1")
def _(spark, d):
    rollup = finished(summarise(events(spark, d), "1d", ["event_type"]), ("avg",))
    return rounded(rollup.where("event_type = 'click'").select("bucket_us", "avg"), "avg").orderBy("bucket_us")


@query("stddev_variance", f"select event_type, epoch_us(ts) - epoch_us(ts) % {DAY} as bucket_us, round(stddev_samp(value), 7) as stddev, round(var_samp(value), 7) as variance from events group by 1, 2")
def _(spark, d):
    return rounded(bucketed(events(spark, d), "1d", ("stddev", "variance"), ["event_type"]), "stddev", "variance", digits=7)


@query("median_p95", "select event_type, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def _(spark, d):
    return rounded(percentiles(events(spark, d), {"median": 0.5, "p95": 0.95}, ["event_type"]), "median", "p95")


@query("approx_percentile")
def _(spark, d):
    return bucketed(events(spark, d), "1d", ("approx_p50", "approx_p95"), ["event_type"])


@query("value_histogram", "select event_type, floor(value / 50)::bigint as bin, count(*)::bigint as count from events group by 1, 2")
def _(spark, d):
    return histogram(events(spark, d), 50, ["event_type"])


@query("delta_rate_bucket", f"""
select user_id, bucket_us, round(b - a, 2) + 0.0 as delta, round(case when t1 > t0 then (b - a) / ((t1 - t0) / 1000000.0) end, 6) + 0.0 as rate from (
  select user_id, epoch_us(ts) - epoch_us(ts) % {DAY} as bucket_us, arg_min(value, (ts, event_id)) as a, arg_max(value, (ts, event_id)) as b, min(epoch_us(ts)) as t0, max(epoch_us(ts)) as t1 from events group by 1, 2)""")
def _(spark, d):
    return rounded(bucketed(events(spark, d), "1d", ("delta", "rate"), ["user_id"]), "rate").withColumn("delta", F.round("delta", 2))


# -- catalogs, statistics, lifecycle

_TAGS = """'{"event_type":"' || event_type || '","user_id":"' || user_id || '"}'"""


@query("segment_summary", f"""
select event_type, epoch_us(ts) - epoch_us(ts) % {DAY} as chunk_start_us, count(*)::bigint as row_count, min(epoch_us(ts)) as segment_start_us, max(epoch_us(ts)) as segment_end_us,
  min(value) as min, max(value) as max, round(sum(value), 2) as sum from events group by 1, 2""")
def _(spark, d):
    points = events(spark, d).withColumn("tags_json", F.col("event_type"))
    found = catalog.segments(points, "1d").withColumnRenamed("tags_json", "event_type")
    return rounded(found.select("event_type", "chunk_start_us", "row_count", "segment_start_us", "segment_end_us", "min", "max", "sum"), "sum", digits=2)


@query("segment_column_bytes", f"""
select event_type, chunk_start_us, column_name, n * b as data_bytes from (
  select event_type, epoch_us(ts) - epoch_us(ts) % {DAY} as chunk_start_us, count(*)::bigint as n from events group by 1, 2),
  (values ('ts_ns', 8::bigint), ('value_real', 8::bigint), ('quality', 4::bigint)) as c(column_name, b)""")
def _(spark, d):
    found = catalog.segment_columns(catalog.segments(events(spark, d).withColumn("tags_json", F.col("event_type")), "1d"))
    return found.select(F.col("tags_json").alias("event_type"), "chunk_start_us", "column_name", "data_bytes")


@query("segment_overlap", f"select event_type, chunk_start_us from (select event_type, epoch_us(ts) - epoch_us(ts) % {DAY} as chunk_start_us, min(epoch_us(ts)) as a, max(epoch_us(ts)) as b from events group by 1, 2) where b >= {FROM_US} and a < {TO_US}")
def _(spark, d):
    found = catalog.segments(events(spark, d).withColumn("tags_json", F.col("event_type")), "1d")
    return found.where((F.col("segment_end_us") >= FROM_US) & (F.col("segment_start_us") < TO_US)).select(F.col("tags_json").alias("event_type"), "chunk_start_us")


@query("series_catalog", f"select distinct 'events' as metric_name, {_TAGS} as tags_json from events")
def _(spark, d):
    return catalog.series(events(spark, d)).select("metric_name", "tags_json")


@query("tag_index", "select distinct 'events' as metric_name, k as tag_key, v as tag_value from (select 'event_type' as k, event_type as v from events union all select 'user_id', user_id::varchar from events)")
def _(spark, d):
    return catalog.tag_index(events(spark, d)).select("metric_name", "tag_key", "tag_value").distinct()


@query("tag_cardinality", "select 'events' as metric_name, k as tag_key, count(distinct v)::bigint as n_values from (select 'event_type' as k, event_type as v from events union all select 'user_id', user_id::varchar from events) group by k")
def _(spark, d):
    return catalog.tag_cardinality(events(spark, d))


@query("chunk_catalog", f"select distinct {_TAGS} as tags_json, epoch_us(ts) - epoch_us(ts) % {DAY} as chunk_start_us, epoch_us(ts) - epoch_us(ts) % {DAY} + {DAY} as chunk_end_us from events")
def _(spark, d):
    return catalog.chunks(events(spark, d), "1d").drop("metric_name")


_STATS = f"""count(*)::bigint as row_count, count(distinct epoch_us(ts) - epoch_us(ts) % {DAY})::bigint as chunk_count, count(distinct (user_id, event_type))::bigint as series_count,
  min(epoch_us(ts)) as min_time_us, max(epoch_us(ts)) as max_time_us"""


@query("hypertable_stats", f"select 'events' as metric_name, {_STATS} from events")
def _(spark, d):
    return catalog.statistics(events(spark, d), "1d")


@query("series_stats", f"select {_TAGS} as tags_json, count(*)::bigint as row_count, count(value)::bigint as n_values, min(epoch_us(ts)) as min_time_us, max(epoch_us(ts)) as max_time_us from events group by 1")
def _(spark, d):
    return catalog.series_statistics(events(spark, d)).drop("metric_name")


@query("hypertable_overview", f"""
select t.table_name, t.chunk_us, coalesce(row_count, 0) as row_count, coalesce(chunk_count, 0) as chunk_count, coalesce(series_count, 0) as series_count, min_time_us, max_time_us
from (values ('events', {DAY}), ('empty', {HOUR})) as t(table_name, chunk_us) left join (select 'events' as metric_name, {_STATS} from events) s on t.table_name = s.metric_name""")
def _(spark, d):
    tables = spark.createDataFrame([("events", DAY), ("empty", HOUR)], "table_name string, chunk_us long")
    return catalog.overview(tables, catalog.statistics(events(spark, d), "1d"))


@query("scan_cost_estimate", f"""
select metric_name, floor(greatest(1.0, row_count::double * least(1.0, {float(TO_US - FROM_US)} / greatest(max_time_us - min_time_us, 1)) * least(1.0, 3.0 / greatest(series_count, 1))))::bigint as estimated_rows
from (select 'events' as metric_name, {_STATS} from events)""")
def _(spark, d):
    return plans.scan_costs(catalog.statistics(events(spark, d), "1d"), FROM_US, TO_US, 3).select("metric_name", "estimated_rows")


@query("retention_survivors", f"select event_id from events where epoch_us(ts) - epoch_us(ts) % {DAY} + {DAY} > {TO_US}")
def _(spark, d):
    chunked = events(spark, d).withColumn("chunk_end_us", time_bucket("1d", F.col("ts_us")) + DAY)
    return catalog.expired(chunked, TO_US).where("not expired").select("event_id")


@query("retention_report", f"select count_if(e)::bigint as expired_chunks, count(*)::bigint as chunks from (select distinct user_id, event_type, epoch_us(ts) - epoch_us(ts) % {DAY} + {DAY} <= {TO_US} as e, epoch_us(ts) - epoch_us(ts) % {DAY} as c from events)")
def _(spark, d):
    return catalog.expired(catalog.chunks(events(spark, d), "1d"), TO_US).agg(F.count_if("expired").alias("expired_chunks"), F.count(F.lit(1)).alias("chunks"))


@query("invalidation_ranges", "select event_id // 500 as batch, min(epoch_us(ts)) as start_us, max(epoch_us(ts)) as end_us, count(*)::bigint as points from events group by 1")
def _(spark, d):
    return catalog.invalidations(events(spark, d).withColumn("batch", F.expr("event_id div 500")))


@query("dirty_buckets", f"select distinct unnest(generate_series(a - a % {HOUR}, b - b % {HOUR}, {HOUR})) as bucket_us from (select min(epoch_us(ts)) as a, max(epoch_us(ts)) as b from events group by event_id // 2000)")
def _(spark, d):
    return catalog.dirty_buckets(catalog.invalidations(events(spark, d).withColumn("batch", F.expr("event_id div 2000"))), "1h")


@query("dedupe_last_write_wins", """
select supplier, ts_us, value_real from (select l_suppkey as supplier, epoch_us(l_shipdate) as ts_us, l_quantity as value_real,
  row_number() over (partition by l_suppkey, l_shipdate order by l_orderkey desc, l_linenumber desc, l_partkey desc, l_extendedprice desc) as n from lineitem) where n = 1""")
def _(spark, d):
    return catalog.deduplicated(lines(spark, d).drop("l_extendedprice"), ["seq"], ["supplier", "ts_us"]).drop("seq")


# -- scans and joins

_RANGE = f"epoch_us(ts) >= {FROM_US} and epoch_us(ts) < {TO_US}"


def _stored(df: DataFrame) -> Column:
    """The range on the column as it is stored, which is what Parquet can skip by."""
    low, high = (F.timestamp_micros(F.lit(x)).cast("timestamp_ntz") for x in (FROM_US, TO_US))
    return (df["ts"] >= low) & (df["ts"] < high)


@query("raw_scan_range", f"select event_id, epoch_us(ts) as ts_us, value as value_real from events where {_RANGE}")
def _(spark, d):
    df = events(spark, d)
    return df.where(_stored(df)).select("event_id", "ts_us", "value_real")


@query("raw_scan_series_eq", f"select event_id, value as value_real from events where {_RANGE} and user_id = 7 and event_type = 'click'")
def _(spark, d):
    df = events(spark, d)
    return df.where(_stored(df) & (F.col("user_id") == 7) & (F.col("event_type") == "click")).select("event_id", "value_real")


@query("raw_scan_tag_in", f"select event_id, value as value_real from events where {_RANGE} and event_type in ('click', 'error')")
def _(spark, d):
    scan = plans.ScanPlan("events", FROM_US, TO_US, {"event_type": ["click", "error"]})
    return scan.apply(events(spark, d)).select("event_id", "value_real")


@query("hypertable_scan", f"select {_TAGS} as tags_json, epoch_us(ts) as ts_us, value as value_real from events where {_RANGE}")
def _(spark, d):
    store = _store(spark, d)
    return store.scan("events", FROM_US, TO_US).select("tags_json", "ts_us", "value_real")


def _store(spark: SparkSession, d: str) -> Timeseries:
    """A hypertable with the events, in two writes."""
    store = Timeseries(pin_utc(spark), fresh_path(spark, "store"))
    store.install()
    store.create_hypertable("events", chunk="1d")
    df = events(spark, d)
    points = points_of(df, df["metric_name"], df["tags_json"], df["ts_us"], df["value_real"], df["seq"])
    store.write_points("events", points.where("seq % 2 = 0"))
    store.write_points("events", points.where("seq % 2 = 1"), "late")
    return store


@query("bucketed_samples", f"select event_id, epoch_us(ts) - epoch_us(ts) % {HOUR} as bucket_us, value as value_real from events")
def _(spark, d):
    return plans.bucketed_view(events(spark, d), "1h").select("event_id", "bucket_us", "value_real")


@query("samples_join_series", f"select event_id, 'events' as metric_name, {_TAGS} as tags_json, epoch_us(ts) as ts_us, value as value_real from events")
def _(spark, d):
    points = events(spark, d)
    keyed = points.select("event_id", tag_functions.series_id(F.col("metric_name"), F.col("tags_json")).alias("series_id"), "ts_us", "value_real")
    return join.samples_with_series(keyed, catalog.series(points)).select("event_id", "metric_name", "tags_json", "ts_us", "value_real")


@query("join_dimension_rollup", f"""
select n_name, bucket_us, count(*)::bigint as users, round(sum(s), 2) as sum from (
  select user_id, epoch_us(ts) - epoch_us(ts) % {DAY} as bucket_us, sum(value) as s from events group by 1, 2) join customer on user_id = c_custkey join nation on c_nationkey = n_nationkey
where n_regionkey = 1 group by 1, 2""")
def _(spark, d):
    rollup = bucketed(events(spark, d), "1d", ("sum",), ["user_id"])
    customer, nation = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation"))
    dimension = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    out = join.with_dimension(rollup, dimension, rollup["user_id"] == dimension["c_custkey"], F.col("n_regionkey") == 1)
    return rounded(out.groupBy("n_name", "bucket_us").agg(F.count(F.lit(1)).alias("users"), F.sum("sum").alias("sum")), "sum", digits=2)


@query("semi_join_pushdown", "select event_type, count(*)::bigint as count, round(sum(value), 2) as sum from events where user_id in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by 1")
def _(spark, d):
    wanted = spark.read.parquet(f"{d}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    out = join.only_series(events(spark, d), wanted, ["user_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("count"), F.sum("value_real").alias("sum"))
    return rounded(out, "sum", digits=2)


@query("anti_join_missing", "select c_custkey from customer c where not exists (select 1 from events e where e.user_id = c.c_custkey)")
def _(spark, d):
    customer = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    return join.without_series(customer, events(spark, d).select(F.col("user_id").alias("c_custkey")), ["c_custkey"])


# -- windows

_OVER = f"over (partition by user_id order by epoch_us(ts) range between {HOUR * 24} preceding and current row)"


@query("last_value_by_series", "select user_id, max(epoch_us(ts)) as ts_us, arg_max(value, (ts, event_id)) as value from events group by 1")
def _(spark, d):
    return window.last_values(events(spark, d), ["user_id"])


@query("moving_avg_1d", f"select event_id, round(avg(value) {_OVER}, 6) as moving_avg from events")
def _(spark, d):
    return rounded(window.rolling(events(spark, d), "1d", ["moving_avg"], ["user_id"]).select("event_id", "moving_avg"), "moving_avg")


@query("moving_avg_arrival", """
with t as (select l_suppkey as supplier, epoch_us(l_shipdate) as ts_us, l_quantity as v, (l_orderkey, l_linenumber, l_partkey, l_extendedprice) as seq from lineitem),
w as (select *, sum(v) over a as s, count(v) over a as n, sum(v) over l as sl, count(v) over l as nl from t
  window a as (partition by supplier order by ts_us range between 604800000000 preceding and current row), l as (partition by supplier, ts_us order by seq rows between 1 following and unbounded following))
select supplier, ts_us, v as value_real, round((s - coalesce(sl, 0)) / (n - nl), 6) as moving_avg from w""")
def _(spark, d):
    out = window.moving_avg_by_arrival(lines(spark, d), "7d", ["supplier"])
    return rounded(out.select("supplier", "ts_us", "value_real", "moving_avg"), "moving_avg")


@query("rolling_min_max_1d", f"select event_id, min(value) {_OVER} as rolling_min, max(value) {_OVER} as rolling_max from events")
def _(spark, d):
    return window.rolling(events(spark, d), "1d", ["rolling_min", "rolling_max"], ["user_id"]).select("event_id", "rolling_min", "rolling_max")


@query("rolling_sum_1d", f"select event_id, round(sum(value) {_OVER}, 2) as rolling_sum, (count(value) {_OVER})::bigint as rolling_count from events")
def _(spark, d):
    return rounded(window.rolling(events(spark, d), "1d", ["rolling_sum", "rolling_count"], ["user_id"]).select("event_id", "rolling_sum", "rolling_count"), "rolling_sum", digits=2)


_LAG = "select *, lag(value) over w as p, epoch_us(ts) - lag(epoch_us(ts)) over w as e from events window w as (partition by user_id order by ts, event_id)"


@query("delta_elapsed", f"select event_id, round(value - p, 2) + 0.0 as delta, e as elapsed_us from ({_LAG})")
def _(spark, d):
    return rounded(window.changes(events(spark, d), ["user_id"]).select("event_id", "delta", "elapsed_us"), "delta", digits=2)


@query("derivative", f"select event_id, round(case when e > 0 then (value - p) / (e / 1000000.0) end, 6) + 0.0 as derivative from ({_LAG})")
def _(spark, d):
    return rounded(window.changes(events(spark, d), ["user_id"]).select("event_id", "derivative"), "derivative")


@query("counter_resets", f"select event_id, value < p as reset from ({_LAG})")
def _(spark, d):
    return window.changes(events(spark, d), ["user_id"]).select("event_id", "reset")


@query("increase_counter_reset", f"""
select user_id, epoch_us(ts) - epoch_us(ts) % {DAY} as bucket_us, round(coalesce(sum(case when value >= p then value - p when value < p then value end), 0), 2) as increase,
  coalesce(count_if(value < p), 0)::bigint as resets, round(coalesce(sum(case when value >= p then value - p when value < p then value end), 0) / 86400.0, 6) as rate from ({_LAG}) group by 1, 2""")
def _(spark, d):
    return rounded(rounded(window.counter_rate(events(spark, d), "1d", ["user_id"]), "increase", digits=2), "rate")


_GRID = f"""
b as (select user_id, epoch_us(ts) - epoch_us(ts) % {DAY} as bucket_us, arg_max(value, (ts, event_id)) as value from events group by 1, 2),
g as (select user_id, unnest(generate_series(min(bucket_us), max(bucket_us), {DAY})) as bucket_us from b group by 1),
f as (select g.user_id, g.bucket_us, b.value from g left join b using (user_id, bucket_us))"""


def _filled(spark: SparkSession, d: str) -> DataFrame:
    daily = bucketed(events(spark, d), "1d", ("last",), ["user_id"]).withColumnRenamed("last", "value")
    return window.gap_fill(daily, "1d", ["user_id"])


@query("gapfill_locf", f"with {_GRID} select user_id, bucket_us, value, last_value(value ignore nulls) over (partition by user_id order by bucket_us rows between unbounded preceding and current row) as locf from f")
def _(spark, d):
    return window.locf(_filled(spark, d), ["user_id"])


@query("gapfill_interpolate", f"""
with {_GRID}, p as (select *,
  last_value(case when value is not null then bucket_us end ignore nulls) over a as t0, last_value(value ignore nulls) over a as v0,
  first_value(case when value is not null then bucket_us end ignore nulls) over z as t1, first_value(value ignore nulls) over z as v1 from f
  window a as (partition by user_id order by bucket_us rows between unbounded preceding and current row), z as (partition by user_id order by bucket_us rows between current row and unbounded following))
select user_id, bucket_us, value, round(coalesce(value, v0 + (v1 - v0) * (bucket_us - t0) / (t1 - t0)), 6) as interpolated from p""")
def _(spark, d):
    return rounded(window.interpolate(_filled(spark, d), ["user_id"]), "interpolated")


@query("state_duration", "select user_id, event_type, coalesce(sum(l), 0)::bigint as duration_us from (select user_id, event_type, lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) - epoch_us(ts) as l from events) group by 1, 2")
def _(spark, d):
    return window.state_duration(events(spark, d), "event_type", ["user_id"])


_STEP = f"""select user_id, step_us, ts_us, m as moving_avg, lo as rolling_min, hi as rolling_max from (
  select user_id, epoch_us(ts) - epoch_us(ts) % {HOUR * 12} as step_us, epoch_us(ts) as ts_us, round(avg(value) {_OVER}, 6) as m, min(value) {_OVER} as lo, max(value) {_OVER} as hi,
    row_number() over (partition by user_id, epoch_us(ts) - epoch_us(ts) % {HOUR * 12} order by ts desc, event_id desc) as n from events where true) where n = 1"""


@query("window_step_sampled", _STEP)
def _(spark, d):
    return rounded(window.stepped(events(spark, d), "1d", "12h", ["moving_avg", "rolling_min", "rolling_max"], ["user_id"]), "moving_avg")


@query("window_json", _STEP.replace("user_id,", "user_id::varchar as user_id,", 1).replace("where true", f"where {_RANGE}"))
def _(spark, d):
    text = f'{{"hypertable": "events", "from": {FROM_US}, "to": {TO_US}, "partition_by": ["user_id"], "window": "1d", "step": "12h", "functions": {{"value": ["moving_avg", "rolling_min", "rolling_max"]}}}}'
    return rounded(plans.window_json(events(spark, d).drop("user_id", "event_type"), text), "moving_avg")


@query("query_json", f"select event_type, epoch_us(ts) - epoch_us(ts) % {HOUR} as bucket_us, round(avg(value), 6) as avg, min(value) as min, max(value) as max, count(value)::bigint as count from events where {_RANGE} and event_type in ('click', 'view') group by 1, 2")
def _(spark, d):
    text = f'{{"hypertable": "events", "from": {FROM_US}, "to": {TO_US}, "bucket": "1h", "group_by": ["event_type"], "where": {{"event_type": ["click", "view"]}}, "aggregates": {{"value": ["avg", "min", "max", "count"]}}}}'
    return rounded(plans.query_json(events(spark, d).drop("user_id", "event_type"), text), "avg")


# -- sources and sinks

@query("line_protocol_roundtrip", """
select event_id, 'ev ents' as measurement, '{"event_type":"' || event_type || '","note":"a, b=c"}' as tags_json, epoch_us(ts) as ts_us, value, user_id as n, true as ok, 'say "hi", x=1' as note from events""")
def _(spark, d):
    df = events(spark, d)
    tags = tag_functions.tags_of(event_type=F.col("event_type"), note=F.lit("a, b=c"))
    field = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    fields = F.array(field("value", F.col("value_real").cast("string")), field("n", F.concat(F.col("user_id").cast("string"), F.lit("i"))), field("ok", F.lit("true")), field("note", F.lit('"say \\"hi\\", x=1"')))
    text = df.select("event_id", line_protocol.render(F.lit("ev ents"), tags, fields, F.col("ts_us") * 1000).alias("value"))
    v = lambda i, kind: F.element_at("fields", i)["value"][kind]
    return line_protocol.strict(line_protocol.parse(text)).select("event_id", "measurement", "tags_json", "ts_us", v(1, "f64").alias("value"), v(2, "i64").alias("n"), v(3, "b").alias("ok"), v(4, "s").alias("note"))


@query("segment_payload_roundtrip", f"select event_type, epoch_us(ts) as ts_us, value as value_real, (event_id % 3)::int as quality from events")
def _(spark, d):
    def packed(pdf):
        import pandas as pd

        pdf = pdf.sort_values("ts_us")
        return pd.DataFrame({"event_type": [pdf.event_type.iloc[0]], "payload": [segment.encode(1, pdf.ts_us.to_numpy(), pdf.value_real.to_numpy(), pdf.quality.to_numpy())]})

    df = events(spark, d).select("event_type", "ts_us", "value_real", (F.col("event_id") % 3).cast("int").alias("quality"), time_bucket("1d", F.col("ts_us")).alias("chunk"))
    return segment.read_payloads(df.groupBy("event_type", "chunk").applyInPandas(packed, "event_type string, payload binary"))


@query("rollup_store", f"select {_TAGS} as tags_json, epoch_us(ts) - epoch_us(ts) % {7 * DAY} as bucket_us, round(avg(value), 6) as avg, count(value)::bigint as count, max(value) as max from events group by 1, 2")
def _(spark, d):
    """Written, rolled up from segments, refreshed after a late write, and read by name."""
    store = _store(spark, d)
    store.create_rollup_policy("weekly", "events", "1w", ["avg", "count", "max", "avg"])
    store.refresh_rollup("weekly")
    return rounded(store.query_rollup("weekly").select("tags_json", "bucket_us", "avg", "count", "max"), "avg")


@query("compaction_equivalence", f"select {_TAGS} as tags_json, epoch_us(ts) as ts_us, value as value_real, event_id as seq from events")
def _(spark, d):
    store = _store(spark, d)
    store.compact("events")
    return store.scan("events").select("tags_json", "ts_us", "value_real", "seq")


# -- through the store

_LEFT = "(select event_id, event_type, user_id, ts, case when value > 100 then value + 1 else value end as value from events where value >= 5)"


@query("rollup_after_delete", " union all ".join(f"select '{n}' as rollup, {_TAGS} as tags_json, epoch_us(ts) - epoch_us(ts) % {w} as bucket_us, {_AGG} from {_LEFT} group by 1, 2, 3" for n, w in (("daily", DAY), ("weekly", 7 * DAY))))
def _(spark, d):
    """Two rollups of one table, refreshed at different times while rows are deleted and changed."""
    store = _store(spark, d)
    for name, width in (("daily", "1d"), ("weekly", "1w")):
        store.create_rollup_policy(name, "events", width, _ALL)
        store.refresh_rollup(name)
    store.delete_rows("events", F.col("value_real") < 5)
    store.refresh_rollup("daily")
    store.update_rows("events", F.col("value_real") > 100, F.col("value_real") + 1)
    found = []
    for name in ("daily", "weekly"):
        store.refresh_rollup(name)
        found.append(store.query_rollup(name).select(F.lit(name).alias("rollup"), "tags_json", "bucket_us", *_ALL))
    return _seven(found[0].unionByName(found[1]))


@query("retention_store", f"select {_TAGS} as tags_json, epoch_us(ts) as ts_us, value as value_real from events where epoch_us(ts) - epoch_us(ts) % {DAY} + {DAY} > {TO_US - 3 * DAY}")
def _(spark, d):
    store = _store(spark, d)
    store.add_retention_policy("events", "3d")
    store.run_retention(TO_US)
    return store.scan("events").select("tags_json", "ts_us", "value_real")


@query("segments_store_overlap", f"""
select {_TAGS} as tags_json, epoch_us(ts) - epoch_us(ts) % {DAY} as chunk_start_us, count(*)::bigint as row_count, min(value) as min, max(value) as max,
  arg_min(value, (ts, event_id)) as first, arg_max(value, (ts, event_id)) as last from events group by 1, 2 having max(epoch_us(ts)) >= {FROM_US} and min(epoch_us(ts)) < {TO_US}""")
def _(spark, d):
    return _store(spark, d).overlapping_segments("events", FROM_US, TO_US).select("tags_json", "chunk_start_us", "row_count", "min", "max", "first", "last")


@query("store_scan_tags", f"select {_TAGS} as tags_json, epoch_us(ts) as ts_us, value as value_real from events where {_RANGE} and event_type in ('click', 'error')")
def _(spark, d):
    return _store(spark, d).scan("events", FROM_US, TO_US, tags={"event_type": ["click", "error"]}).select("tags_json", "ts_us", "value_real")


@query("store_first_point", f"select {_TAGS} as tags_json, epoch_us(ts) as ts_us, value as value_real from events order by ts, event_id limit 1")
def _(spark, d):
    return _store(spark, d).first_point("events").select("tags_json", "ts_us", "value_real")


@query("store_series_tags", f"select distinct {_TAGS} as tags_json, k as tag_key, v as tag_value from (select event_type, user_id, unnest(['event_type', 'user_id']) as k, unnest([event_type, user_id::varchar]) as v from events)")
def _(spark, d):
    """The tables of series and tags after two writes that share most series."""
    store = _store(spark, d)
    return store.series("events").join(store.tags("events"), ["series_id", "metric_name"]).select("tags_json", "tag_key", "tag_value")


@query("store_statistics", f"select 'events' as table_name, {_STATS} from events")
def _(spark, d):
    store = _store(spark, d)
    store.enqueue("stats", "events")
    store.run_maintenance(TO_US, retention=False, downsample=False, stats=False)
    return store.table_statistics().drop("chunk_us")


@query("view_aggregate", f"select 'aggregate' as view, {_TAGS} as tags_json, epoch_us(ts) - epoch_us(ts) % {DAY} as bucket_us, count(value)::bigint as count, max(value) as max from events group by 1, 2, 3 union all select 'rollup', {_TAGS}, epoch_us(ts) - epoch_us(ts) % {DAY}, count(value)::bigint, max(value) from events group by 1, 2, 3")
def _(spark, d):
    store = _store(spark, d)
    store.create_rollup_policy("daily", "events", "1d", ("count", "max"))
    store.refresh_rollup("daily")
    store.register_views("events", "1d", ("count", "max"))
    return spark.sql("select 'aggregate' as view, tags_json, bucket_us, count, max from events_aggregate union all select 'rollup', tags_json, bucket_us, count, max from daily_rollup")


_METRIC = "cpu load.a"


def _event_lines(df: DataFrame) -> DataFrame:
    field = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    fields = F.array(field("value", F.col("value").cast("string")), field("n", F.concat(F.col("user_id").cast("string"), F.lit("i"))), field("ok", F.lit("true")))
    return df.select(line_protocol.render(F.lit(_METRIC), tag_functions.tags_of(event_type=F.col("event_type")), fields, micros(F.col("ts")) * 1000).alias("value"))


_LINES = f"""
select m as metric_name, '{{"event_type":"' || event_type || '"}}' as tags_json, epoch_us(ts) as ts_us, v as value_real from (
  select *, unnest(['{_METRIC}', '{_METRIC}.n']) as m, unnest([value, user_id::double]) as v from events)"""


@query("line_protocol_store", f"select 'own' as route, * from ({_LINES}) union all select 'forced', replace(metric_name, '{_METRIC}', 'other'), tags_json, ts_us, value_real from ({_LINES})")
def _(spark, d):
    """Lines of a measurement with a space and a dot and of several fields, to its own table and to one that is named; read back."""
    text = _event_lines(pin_utc(spark).read.parquet(f"{d}/events.parquet"))
    store = Timeseries(spark, fresh_path(spark, "store"))
    store.install()
    store.write_line_protocol(text)
    store.write_line_protocol(text, table="other")
    own, forced = (store.scan(t).select(F.lit(n).alias("route"), "metric_name", "tags_json", "ts_us", "value_real") for n, t in (("own", tag_functions.table_name(_METRIC)), ("forced", "other")))
    return own.unionByName(forced)


@query("line_protocol_units", "select event_id, epoch_us(ts) // 1000000 * 1000000 as ts_s, epoch_us(ts) // 1000 * 1000 as ts_ms, epoch_us(ts) as ts_us, epoch_us(ts) as ts_ns, round(value, 6) as value from events")
def _(spark, d):
    """Times of 10, 13, 16 and 19 digits; the value is the first field."""
    raw = pin_utc(spark).read.parquet(f"{d}/events.parquet")
    t = micros(F.col("ts"))
    times = {"ts_s": F.expr("unix_micros(timestamp(ts)) div 1000000"), "ts_ms": F.expr("unix_micros(timestamp(ts)) div 1000"), "ts_us": t, "ts_ns": t * 1000}
    units = F.explode(F.array(*[F.struct(F.lit(n).alias("unit"), F.concat_ws(" ", F.lit("m"), F.concat(F.lit("v="), F.col("value").cast("string"), F.lit(",n=1i")), v.cast("string")).alias("line")) for n, v in times.items()])).alias("x")
    parsed = line_protocol.first_field(line_protocol.parse(raw.select("event_id", units).select("event_id", "x.unit", "x.line"), "line"))
    wide = parsed.groupBy("event_id").agg(*[F.max(F.when(F.col("unit") == n, F.col("ts_us"))).alias(n) for n in times], F.max("first_field.value.f64").alias("value"))
    return rounded(wide, "value")


# -- streams

def _source(spark: SparkSession, d: str) -> DataFrame:
    return pin_utc(spark).readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/[e]vents.parquet")


def _narrow(df: DataFrame) -> DataFrame:
    tags = tag_functions.tags_json(tag_functions.tags_of(user_id=F.col("user_id"), event_type=F.col("event_type")))
    return points_of(df, F.lit("events"), tags, micros(F.col("ts")), F.col("value"), F.col("event_id"))


@query("streaming_ingest", f"select {_TAGS} as tags_json, epoch_us(ts) as ts_us, value as value_real, event_id as seq from events")
def _(spark, d):
    """A stream appended to a hypertable, and its last batch once more, as after a failure: stored once."""
    store, state = Timeseries(pin_utc(spark), fresh_path(spark, "store")), fresh_path(spark, "state")
    store.install()
    store.create_hypertable("events", chunk="1d")
    streams.ingest(_narrow(_source(spark, d)), store, "events", state).awaitTermination()
    store.write_points("events", _narrow(spark.read.parquet(f"{d}/events.parquet")), "stream", batch=(state, 0))
    return store.scan("events").select("tags_json", "ts_us", "value_real", "seq")


@query("streaming_ingest_lines", _LINES)
def _(spark, d):
    store = Timeseries(pin_utc(spark), fresh_path(spark, "store"))
    store.install()
    streams.ingest_lines(_event_lines(_source(spark, d)), store, fresh_path(spark, "state")).awaitTermination()
    return store.scan(tag_functions.table_name(_METRIC)).select("metric_name", "tags_json", "ts_us", "value_real")


@query("streaming_session", f"""
select user_id, min(epoch_us(ts)) as bucket_us, count(value)::bigint as count, round(sum(value), 2) as sum, min(value) as min, max(value) as max, round(avg(value), 6) as avg from (
  select *, sum(s) over (partition by user_id order by ts, event_id) as n from (
    select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) <= {6 * HOUR} then 0 else 1 end as s from events)) group by user_id, n""")
def _(spark, d):
    return _seven(_streamed(spark, d, lambda s: streams.sessions(s, "6 hours", "1 hour", ["user_id"])))


@query("streaming_moving_avg", f"select event_id, round(avg(value) {_OVER}, 6) as moving_avg from events")
def _(spark, d):
    shape = lambda s: streams.moving_average(s.select("user_id", micros(F.col("ts")).alias("ts_us"), "value", "event_id"), "1d", ["user_id"], value="value", seq="event_id")
    return rounded(_streamed(spark, d, shape, "append").select("event_id", "moving_avg"), "moving_avg")


def _streamed(spark: SparkSession, d: str, shape: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    source, out, state = _source(spark, d), fresh_path(spark, "stream"), fresh_path(spark, "state")
    write = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    running = shape(source).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(out)


@query("streaming_tumbling", f"select event_type, epoch_us(ts) - epoch_us(ts) % {DAY} as bucket_us, count(value)::bigint as count, round(sum(value), 2) as sum, min(value) as min, max(value) as max, round(avg(value), 6) as avg from events group by 1, 2")
def _(spark, d):
    return _seven(_streamed(spark, d, lambda s: streams.tumbling(s, "1 day", "1 hour", ["event_type"])))


@query("streaming_sliding", f"""select event_type, b as bucket_us, count(value)::bigint as count, round(sum(value), 2) as sum, min(value) as min, max(value) as max, round(avg(value), 6) as avg from (
  select *, unnest([epoch_us(ts) - epoch_us(ts) % {DAY // 2}, epoch_us(ts) - epoch_us(ts) % {DAY // 2} - {DAY // 2}]) as b from events) group by 1, 2""")
def _(spark, d):
    return _seven(_streamed(spark, d, lambda s: streams.sliding(s, "1 day", "12 hours", "1 hour", ["event_type"])))
