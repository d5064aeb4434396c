"""Structured Streaming: windowed aggregates with watermarks, stateful windows, and exactly-once ingest of micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.time import width_us
from tideline.operators.aggregate import finite


def _aggregates(value: str) -> list:
    v = finite(F.col(value))
    return [F.count(value).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg")]


def tumbling(stream: DataFrame, width: str, late: str, by: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """by + bucket_us + aggregates; points later than `late` behind the newest are dropped by the watermark."""
    return _windowed(stream, F.window("_ts", width), late, by, ts, value)


def sliding(stream: DataFrame, width: str, step: str, late: str, by: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    return _windowed(stream, F.window("_ts", width, step), late, by, ts, value)


def sessions(stream: DataFrame, gap: str, late: str, by: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """by + bucket_us (the session's first point) + aggregates; a session ends once `gap` passes without a point."""
    return _windowed(stream, F.session_window("_ts", gap), late, by, ts, value)


def _windowed(stream: DataFrame, window, late: str, by: Sequence[str], ts: str, value: str) -> DataFrame:
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(*by, window.alias("_w")).agg(*_aggregates(value)).select(*by, F.unix_micros("_w.start").alias("bucket_us"), "count", "sum", "min", "max", "avg")


def moving_average(stream: DataFrame, window: str | int, by: Sequence[str], ts: str = "ts_us", value: str = "value_real", seq: str = "seq") -> DataFrame:
    """by + ts + seq + moving_avg: the mean of the points of the series that are at most `window` older and came no later.

    A custom stateful operator: a series keeps the points that a later one may still need, those within the window behind
    the newest. A batch is taken in the order of (time, arrival); a point that is older than a batch before it is averaged
    with what the state still holds.
    """
    import numpy as np
    import pandas as pd

    size = width_us(window)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, values = (np.array(x) for x in state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0))
        new = pd.concat(list(frames)).sort_values([ts, seq], kind="stable")
        new = new[np.isfinite(new[value].astype(float))]
        n, k = len(times), len(new)
        times, values = np.concatenate((times, new[ts].to_numpy(np.int64))), np.concatenate((values, new[value].to_numpy(float)))
        order = np.lexsort((np.arange(n + k), times))
        sums = np.concatenate(([0.0], np.cumsum(values[order])))
        place = np.empty(n + k, np.int64)
        place[order] = np.arange(n + k)
        stop = place[n:] + 1
        start = np.searchsorted(times[order], times[n:] - size, "left")
        keep = times >= times.max(initial=-(2**62)) - size
        state.update((times[keep].tolist(), values[keep].tolist()))
        yield pd.DataFrame({**dict(zip(by, key, strict=True)), ts: times[n:], seq: new[seq].to_numpy(), "moving_avg": (sums[stop] - sums[start]) / np.maximum(stop - start, 1)})

    columns = [*by, ts, seq]
    out = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", moving_avg double"
    return stream.groupBy(*by).applyInPandasWithState(step, out, "times array<long>, values array<double>", "append", "NoTimeout")


def _each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(stream: DataFrame, store, table: str, checkpoint: str, rollups: Sequence[str] = ()):
    """Append every micro-batch of narrow samples to a hypertable, then refresh the given rollups where it has touched them.

    The batch's number is committed together with its rows, so that a batch that is replayed after a failure is left
    out whole: each sample is stored once, and no stored row is read to find out.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.write_points(table, batch, "stream", batch=(checkpoint, number))
        for rollup in rollups:
            store.refresh_rollup(rollup)

    return _each_batch(stream, write, checkpoint)


def ingest_lines(stream: DataFrame, store, checkpoint: str, table: str | None = None, column: str = "value"):
    """Append every micro-batch of line-protocol text, each measurement to its table or all to the one named; exactly once,
    as `ingest`, for each table. A bad line fails its batch."""
    return _each_batch(stream, lambda batch, number: store.write_line_protocol(batch, table, column, batch=(checkpoint, number)), checkpoint)
