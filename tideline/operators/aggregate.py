"""Bucketed aggregates per series, as declarative Catalyst aggregates with partial aggregation.

Numeric aggregates skip null, NaN and infinite values and are null when nothing is left; count counts every non-null
value. first and last go by time; on equal times first takes the earliest arrival (seq), last the latest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tideline.errors import TidelineError, UnknownAggregate
from tideline.functions.time import bucket, width_us

SERIES = ("metric_name", "tags_json")


def finite(value: Column) -> Column:
    """The value as a double, or null where it is not a finite number."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def arrival(df: DataFrame, ts: str, seq: str) -> Column:
    """A sortable key of (time, arrival). One number where both are integers, so that groups are hashed and not sorted."""
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for c in (ts, seq))
    return F.col(ts).cast("decimal(38,0)") * F.lit(str(_STEP)).cast("decimal(20,0)") + F.col(seq) if whole else F.struct(ts, seq)


#: More than the span of 64-bit arrival numbers; times it, microseconds of 160,000 years fit 38 digits.
_STEP = 2 * 10**19


def _at(value: Column, order: Column, last: bool) -> Column:
    v = finite(value)
    return (F.max_by if last else F.min_by)(v, F.when(v.isNotNull(), order))


def _states(value: Column, ts: Column, order: Column) -> dict[str, Column]:
    v = finite(value)
    first, last = _at(value, order, False), _at(value, order, True)
    span = (F.max(F.when(v.isNotNull(), ts)) - F.min(F.when(v.isNotNull(), ts))) / 1e6
    return {
        "count": F.count(value), "sum": F.sum(v), "avg": F.avg(v), "min": F.min(v), "max": F.max(v), "first": first, "last": last,
        "stddev": F.stddev_samp(v), "variance": F.var_samp(v), "median": F.percentile(v, F.lit(0.5)), "p95": F.percentile(v, F.lit(0.95)),
        "approx_p50": F.percentile_approx(v, 0.5, 10_000), "approx_p95": F.percentile_approx(v, 0.95, 10_000),
        "delta": last - first, "rate": F.when(span > 0, (last - first) / span),
    }


NAMES = ("count", "sum", "avg", "min", "max", "first", "last", "stddev", "variance", "median", "p95", "approx_p50", "approx_p95", "delta", "rate")


def aggregate(name: str, value: Column, ts: Column, order: Column) -> Column:
    """The aggregate of that name; an unknown name is an error. `order` is a key of time, then arrival."""
    key = name.strip().lower()
    if key not in NAMES:
        raise UnknownAggregate(f"unknown aggregate: {name!r}")
    return _states(value, ts, order)[key]


def encode_names(names: Sequence[str]) -> str:
    """A policy's list: distinct, sorted, joined by commas."""
    found = sorted({n.strip().lower() for n in names})
    if not found:
        raise TidelineError("a policy needs an aggregate")
    for n in found:
        if n not in NAMES:
            raise UnknownAggregate(f"unknown aggregate: {n!r}")
    return ",".join(found)


def bucketed(points: DataFrame, width: str | int, names: Sequence[str], by: Sequence[str] = SERIES, value: str = "value_real", ts: str = "ts_us", seq: str = "seq") -> DataFrame:
    """by + bucket_us + one column for each aggregate. One shuffle, on the group's keys, after partial aggregation."""
    keys = [*by, bucket(F.col(ts), width_us(width)).alias("bucket_us")]
    order = arrival(points, ts, seq)
    return points.groupBy(*keys).agg(*[aggregate(n, F.col(value), F.col(ts), order).alias(n) for n in names])


#: What a summary stores so that coarser ones can be made of it. `count` counts values, `n_finite` those that are finite;
#: first and last keep their arrival, so that ties of time are resolved as they are among samples.
SUMMARY = ("count", "n_finite", "sum", "min", "max", "first_ts_us", "first_seq", "first", "last_ts_us", "last_seq", "last")


def summarise(points: DataFrame, width: str | int, by: Sequence[str] = SERIES, value: str = "value_real", ts: str = "ts_us", seq: str = "seq", more: Sequence[Column] = ()) -> DataFrame:
    """by + bucket_us + SUMMARY, and other aggregates (`more`) made in the same pass."""
    v, t, order = finite(F.col(value)), F.col(ts), arrival(points, ts, seq)
    here, when = F.when(v.isNotNull(), t), F.when(v.isNotNull(), order)
    return points.groupBy(*by, bucket(t, width_us(width)).alias("bucket_us")).agg(
        F.count(value).alias("count"), F.count(v).alias("n_finite"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.min(here).alias("first_ts_us"), F.min_by(seq, when).alias("first_seq"), F.min_by(v, when).alias("first"),
        F.max(here).alias("last_ts_us"), F.max_by(seq, when).alias("last_seq"), F.max_by(v, when).alias("last"), *more,
    )


def merge(summaries: DataFrame, width: str | int, by: Sequence[str] = SERIES, more: Sequence[Column] = ()) -> DataFrame:
    """Summaries of coarser buckets; width must be a multiple of theirs."""
    some = F.col("n_finite") > 0
    early, late = (F.when(some, arrival(summaries, f"{e}_ts_us", f"{e}_seq")) for e in ("first", "last"))
    return summaries.groupBy(*by, bucket(F.col("bucket_us"), width_us(width)).alias("bucket_us")).agg(
        *[F.sum(c).alias(c) for c in ("count", "n_finite", "sum")], F.min("min").alias("min"), F.max("max").alias("max"),
        F.min("first_ts_us").alias("first_ts_us"), F.min_by("first_seq", early).alias("first_seq"), F.min_by("first", early).alias("first"),
        F.max("last_ts_us").alias("last_ts_us"), F.max_by("last_seq", late).alias("last_seq"), F.max_by("last", late).alias("last"), *more,
    )


def finished(summaries: DataFrame, names: Sequence[str]) -> DataFrame:
    """Aggregates that a summary can give: count, sum, avg, min, max, first, last, delta."""
    made: dict[str, Callable[[], Column]] = {
        **{n: (lambda n=n: F.col(n)) for n in ("count", "sum", "min", "max", "first", "last")},
        "avg": lambda: F.col("sum") / F.when(F.col("n_finite") > 0, F.col("n_finite")), "delta": lambda: F.col("last") - F.col("first"),
    }
    for n in names:
        if n not in made:
            raise UnknownAggregate(f"a rollup cannot give {n!r}")
    others = [c for c in summaries.columns if c not in SUMMARY]
    return summaries.select(*others, *[made[n]().alias(n) for n in names])


def percentiles(points: DataFrame, shares: dict[str, float], by: Sequence[str] = (), value: str = "value_real") -> DataFrame:
    """by + one column for each named share: exact percentiles, linear between neighbours. Values are counted first, and
    running counts find the places, so that no group is held in a buffer; a group is sorted, and spills, in one task."""
    v = finite(F.col(value)).alias("_v")
    counts = points.select(*by, v).where("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ends = counts.select("*", F.sum("_n").over(whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)).alias("_e"), F.sum("_n").over(whole).alias("_t"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_e") - F.col("_n") <= place) & (place < F.col("_e")), F.col("_v")))

    out = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("_t") - 1)
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        out.append((low + (high - low) * part).alias(name))
    return ends.groupBy(*by).agg(*out)


def histogram(points: DataFrame, width: float, by: Sequence[str] = (), value: str = "value_real") -> DataFrame:
    """by + bin (floor of value / width) + count of finite values."""
    v = finite(F.col(value))
    return points.where(v.isNotNull()).groupBy(*by, F.floor(v / F.lit(width)).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
