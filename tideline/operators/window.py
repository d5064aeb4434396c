"""Window operators over points of a series. Each needs one shuffle and sort on (series, time).

Trailing windows of a bounded length are computed by spans of time, so that a hot series is split over tasks: a span is
SPAN windows long, and points of its last window go to the next span too, where they are seen but not returned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions.time import bucket, width_us
from tideline.operators.aggregate import SERIES, arrival, finite

_FUNCTIONS = {"moving_avg": F.avg, "rolling_min": F.min, "rolling_max": F.max, "rolling_sum": F.sum, "rolling_count": F.count}


def _ordered(by: Sequence[str], ts: str, seq: str):
    return Window.partitionBy(*by).orderBy(ts, seq)


#: Windows in a span; a share of 1 / SPAN of the points goes to two spans.
SPAN = 16


def _over_spans(points: DataFrame, window: int, ts: str, add: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Columns that `add` computes by the given span column, over all points of the span and the window before it."""
    span, here = (c + "_" * sum(x.startswith(c) for x in points.columns) for c in ("_span", "_here"))
    size = SPAN * window
    start = bucket(F.col(ts), size)
    spans = F.when(F.col(ts) >= start + (size - window), F.array(start, start + size)).otherwise(F.array(start))
    dealt = points.select("*", F.posexplode(spans).alias(here, span))
    return add(dealt, span).where(F.col(here) == 0).drop(here, span)


def rolling(points: DataFrame, window: str | int, functions: Sequence[str], by: Sequence[str] = SERIES, value: str = "value_real", ts: str = "ts_us") -> DataFrame:
    """Trailing windows [t - window, t] by event time; points of an equal time see each other."""
    size = width_us(window)

    def add(dealt: DataFrame, span: str) -> DataFrame:
        w = Window.partitionBy(*by, span).orderBy(ts).rangeBetween(-size, 0)
        return dealt.select("*", *[_FUNCTIONS[f](finite(F.col(value))).over(w).alias(f) for f in functions])

    return _over_spans(points, size, ts, add)


def moving_avg_by_arrival(points: DataFrame, window: str | int, by: Sequence[str] = SERIES, value: str = "value_real", ts: str = "ts_us", seq: str = "seq") -> DataFrame:
    """As rolling's moving_avg, but of points with an equal time only those that arrived so far count."""
    size, v = width_us(window), finite(F.col(value))

    def add(dealt: DataFrame, span: str) -> DataFrame:
        range_ = Window.partitionBy(*by, span).orderBy(ts).rangeBetween(-size, 0)
        later = Window.partitionBy(*by, span, ts).orderBy(seq).rowsBetween(1, Window.unboundedFollowing)
        total = F.sum(v).over(range_) - F.coalesce(F.sum(v).over(later), F.lit(0.0))
        count = F.count(v).over(range_) - F.count(v).over(later)
        return dealt.select("*", F.when(count > 0, total / count).alias("moving_avg"))

    return _over_spans(points, size, ts, add)


def changes(points: DataFrame, by: Sequence[str] = SERIES, value: str = "value_real", ts: str = "ts_us", seq: str = "seq") -> DataFrame:
    """Against the point before, null for the first: delta, elapsed_us, derivative (by second), reset (value fell), and
    increase (delta, or the value itself after a reset)."""
    w = _ordered(by, ts, seq)
    v = finite(F.col(value))
    before = F.lag(v).over(w)
    elapsed = F.col(ts) - F.lag(ts).over(w)
    return points.select(
        "*", (v - before).alias("delta"), elapsed.alias("elapsed_us"), F.when(elapsed > 0, (v - before) / (elapsed / 1e6)).alias("derivative"),
        (v < before).alias("reset"), F.when(v >= before, v - before).when(v < before, v).alias("increase"),
    )


def counter_rate(points: DataFrame, width: str | int, by: Sequence[str] = SERIES, **columns: str) -> DataFrame:
    """by + bucket_us + increase, resets and rate (increase by second of the bucket) of counters that may start anew."""
    size = width_us(width)
    ts = columns.get("ts", "ts_us")
    found = changes(points, by, **columns).groupBy(*by, bucket(F.col(ts), size).alias("bucket_us"))
    increase = F.coalesce(F.sum("increase"), F.lit(0.0))
    return found.agg(increase.alias("increase"), F.count_if("reset").alias("resets"), (increase / (size / 1e6)).alias("rate"))


def last_values(points: DataFrame, by: Sequence[str] = SERIES, value: str = "value_real", ts: str = "ts_us", seq: str = "seq") -> DataFrame:
    """The latest value of each series, null included; on equal times the later arrival. Pre-aggregated; hashed where
    times, arrivals and values are numbers."""
    return points.groupBy(*by).agg(F.max(ts).alias("ts_us"), F.max_by(value, arrival(points, ts, seq)).alias("value"))


def gap_fill(buckets: DataFrame, width: str | int, by: Sequence[str] = SERIES, value: str = "value", at: str = "bucket_us") -> DataFrame:
    """Every bucket between a series' first and last; value is null where there was none."""
    size = width_us(width)
    grid = buckets.groupBy(*by).agg(F.min(at).alias("_a"), F.max(at).alias("_b")).select(*by, F.explode(F.sequence("_a", "_b", F.lit(size).cast("long"))).alias(at))
    return grid.join(buckets.select(*by, at, value), [*by, at], "left")


def locf(buckets: DataFrame, by: Sequence[str] = SERIES, value: str = "value", at: str = "bucket_us") -> DataFrame:
    """`locf`: the last value that is not null, up to here."""
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return buckets.withColumn("locf", F.last(value, ignorenulls=True).over(w))


def interpolate(buckets: DataFrame, by: Sequence[str] = SERIES, value: str = "value", at: str = "bucket_us") -> DataFrame:
    """`interpolated`: linear between the neighbours that are not null; null outside of them."""
    back = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(at).rowsBetween(0, Window.unboundedFollowing)
    some = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    p, n = F.last(some, ignorenulls=True).over(back), F.first(some, ignorenulls=True).over(ahead)
    out = buckets.withColumn("_p", p).withColumn("_n", n)
    between = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col(at) - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    return out.withColumn("interpolated", F.when(F.col(value).isNotNull(), F.col(value)).otherwise(between)).drop("_p", "_n")


def state_duration(points: DataFrame, state: str, by: Sequence[str] = SERIES, ts: str = "ts_us", seq: str = "seq") -> DataFrame:
    """by + state + duration_us: time from each point to the next one, by the point's state; the last has none."""
    w = _ordered(by, ts, seq)
    lasted = points.withColumn("_d", F.lead(ts).over(w) - F.col(ts))
    return lasted.groupBy(*by, state).agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("duration_us"))


def stepped(points: DataFrame, window: str | int, step: str | int, functions: Sequence[str], by: Sequence[str] = SERIES, value: str = "value_real", ts: str = "ts_us", seq: str = "seq") -> DataFrame:
    """Rolling functions, sampled: the last point of each step."""
    out = rolling(points, window, functions, by, value, ts).withColumn("step_us", bucket(F.col(ts), width_us(step)))
    order = arrival(out, ts, seq)
    return out.groupBy(*by, "step_us").agg(F.max(ts).alias("ts_us"), *[F.max_by(f, order).alias(f) for f in functions])
