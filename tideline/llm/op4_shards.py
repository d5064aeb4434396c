"""Sharding by minimax contiguous partition.

Documents with equal texts form one group that is never split. Groups lie in the order of their smallest doc_id; the
smallest shard capacity for which a greedy walk needs no more than the wanted shards is found by binary search, and the
groups are cut where that walk cuts.

The walk needs the running total at few places only. The driver holds a coarse picture of the running totals (a fixed
number of cells) and asks for finer cells just where a cut can fall, until the capacity is exact. What it holds does
not depend on the number of groups.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm._dist import Scratch, ranked

#: Cells that one look at the running totals may return.
CELLS = 6000


class Walk:
    """Greedy walks over group ends that are known in part.

    known: sorted ends; open_: for each, whether unknown ends may lie between it and the next one.
    """

    def __init__(self, total: int, look: Callable[[list[tuple[int, int]]], list[tuple[int, int, int]]]):
        self.total, self.look = total, look
        self.known, self.open_ = [0, total], [True, False]

    def step(self, at: int, capacity: int) -> tuple[int, int]:
        """Bounds of the last end at or before at + capacity."""
        x = min(at + capacity, self.total)
        i = bisect.bisect_right(self.known, x) - 1
        return self.known[i], x if self.open_[i] else self.known[i]

    def walk(self, capacity: int, shards: int, high: bool) -> list[int]:
        """Where the shards end, at the most if high, else at the least."""
        at, ends = 0, []
        for _ in range(shards):
            at = self.step(at, capacity)[high]
            ends.append(at)
        return ends

    def search(self, shards: int, high: bool) -> int:
        """The smallest capacity that such a walk finds feasible."""
        low, up = 0, self.total
        while low < up:
            mid = (low + up) // 2
            if self.walk(mid, shards, high)[-1] >= self.total:
                up = mid
            else:
                low = mid + 1
        return low

    def refine(self, spans: list[tuple[int, int]]) -> None:
        """Learn more about the open parts that the spans meet."""
        parts = sorted({i for a, b in spans for i in range(max(0, bisect.bisect_right(self.known, a) - 1), bisect.bisect_right(self.known, b)) if self.open_[i]})
        if not parts:
            return
        each = max(2, CELLS // len(parts))
        cells = []
        for i in parts:
            a, b = self.known[i], self.known[i + 1]
            width = -(-(b - a) // each)
            cells.append((a, b, width))
        found = self.look(cells)
        ends = dict(zip(self.known, self.open_, strict=True))
        for i in parts:
            ends[self.known[i]] = False
        for first, last, count in found:
            ends[first] = count > 2 and last > first
            ends.setdefault(last, False)
        self.known = sorted(ends)
        self.open_ = [ends[k] for k in self.known]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the running totals at which shards end; groups has `before` and `bytes`."""
    end = (F.col("before") + F.col("bytes")).alias("end")
    total = groups.agg(F.max(end)).first()[0] or 0
    if not total:
        return 0, []

    def look(cells: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        low, high, width = (np.array(x, np.int64) for x in zip(*cells, strict=True))

        def sort_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ends = np.asarray(batch.column("end"))
                part = np.maximum(np.searchsorted(low, ends, "left") - 1, 0)
                inside = (ends > low[part]) & (ends < high[part])
                ends, part = ends[inside], part[inside]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array((ends - low[part]) // width[part]), pa.array(ends)], names=["part", "cell", "end"])

        found = groups.select(end).mapInArrow(sort_in, "part long, cell long, end long").groupBy("part", "cell")
        return [(r["first"], r["last"], r["n"]) for r in found.agg(F.min("end").alias("first"), F.max("end").alias("last"), F.count(F.lit(1)).alias("n")).collect()]

    walk = Walk(total, look)
    while True:
        sure, hope = walk.search(shards, False), walk.search(shards, True)
        if sure == hope:
            break
        walk.refine(list(zip(walk.walk(hope, shards, False), walk.walk(sure, shards, True), strict=True)))
    # The capacity is exact; the walk itself may still have to be followed.
    while (low := walk.walk(sure, shards, False)) != (high := walk.walk(sure, shards, True)):
        walk.refine(list(zip(low, high, strict=True)))
    return sure, low


def shard_of(before: Column, cuts: list[int]) -> Column:
    """The shard of a group that begins at a running total."""
    return sum(((before >= F.lit(cut)).cast("int") for cut in cuts[:-1]), F.lit(0))


def assign(docs: DataFrame, shards: int = 24, overhead: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus overhead), text_crc32, shard and slot (from 0 in each shard, no gaps).

    Takes doc_id and text; other columns are not looked at. A null text has no bytes, no CRC and groups with other null
    texts. Rows may repeat; each gets a slot. Within a shard, groups keep their order and rows the order of doc_id. Rows
    without a doc_id are left out. With few groups the last shards stay empty.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    raw = F.col("text").cast("binary")
    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.coalesce(F.unhex(F.sha2(raw, 256)), F.lit(b"")).alias("same"),
    )
    rows = scratch.write(rows)
    groups = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"))
    groups = scratch.write(ranked(groups, scratch, ["first", "same"], [], "bytes").select("same", "first", "bytes", F.col("before_value").alias("before")))
    _, cuts = minimax_cuts(groups, shards)
    placed = rows.join(groups.select("same", "before", shard_of(F.col("before"), cuts).alias("shard")), "same").drop("same")
    return ranked(placed, scratch, ["shard", "before", "doc_id"], ["shard"]).select("doc_id", "size", "text_crc32", "shard", F.col("before_rows").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Write documents as one Parquet folder for each shard, rows in the order of their slots."""
    placed = assign(docs, shards).select("doc_id", "shard", "slot").dropDuplicates(["doc_id"])
    docs.join(placed, "doc_id").repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
