"""What several operators need on the cluster: written intermediate tables, running totals and connected components."""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.session import worker_path
from tideline.sources.storage import shared_dir


def small_batches(spark: SparkSession) -> None:
    """Texts are long, so few of them go to a Python worker at once; what a session has set below that stays."""
    worker_path(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8_000_000)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the frame does not have, in whatever case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Tables that one call writes below the shared folder; reading them back cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tideline-{uuid.uuid4().hex}"
        self.n = 0
        small_batches(spark)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(cleanup, "false")
        self.spark.conf.set(cleanup, "true")  # nothing reads this write's shuffles again
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(cleanup, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.tideline_path = path
        return out

    def release(self) -> None:
        """Let Spark's cleaner delete the shuffle files of what has been written and is no longer referred to."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *written: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in written:
            path = jvm.org.apache.hadoop.fs.Path(df.tideline_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(df: DataFrame) -> int:
    """Bytes of the input: Catalyst's estimate, or those of the texts where there is none. Used only to choose how many
    groups work is dealt into."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 2**50:
        return size
    return df.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 8), F.lit(0))).first()[0]


def deal(df: DataFrame, bytes_each: int, least: int = 24) -> int:
    """A number of groups, a power of two that grows with the input, so that a group stays in a task's memory."""
    return 1 << math.ceil(math.log2(max(least, bytes_of(df) / bytes_each)))


def ranked(df: DataFrame, scratch: Scratch, order: list[str], restart: list[str], value: str | None = None) -> DataFrame:
    """Add `before_rows` and `before_value` (sum of value): what comes earlier in `order` within the `restart` columns, which lead `order`.

    Rows are dealt by range over the whole order, so that a hot restart key is split over tasks; each task adds up its
    own part, and the parts' sums (one row for each part and key in it) are added up apart.
    """
    size = F.col(value).cast("long") if value else F.lit(0).cast("long")
    parts = scratch.write(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_size", F.coalesce(size, F.lit(0))))
    keys = [F.col(c) for c in restart]
    own = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = parts.withColumn("_rows_in", F.count(F.lit(1)).over(own) - 1).withColumn("_value_in", F.sum("_size").over(own) - F.col("_size"))
    sums = parts.groupBy("_part", *restart).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_s"))
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_k_{c}") for c in restart],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows_before"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_value_before"),
    )
    on = F.col("_part") == F.col("_p")
    for c in restart:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return (
        inside.join(starts, on)
        .withColumn("before_rows", F.col("_rows_in") + F.col("_rows_before"))
        .withColumn("before_value", F.col("_value_in") + F.col("_value_before"))
        .drop("_part", "_p", "_size", "_rows_in", "_value_in", "_rows_before", "_value_before", *[f"_k_{c}" for c in restart])
    )


#: Nodes that one task holds while it joins edges.
FOREST_NODES = 1 << 17


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) replaced by others of the same reach: every node with the smallest it reaches within a bounded part."""

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def stars() -> pa.RecordBatch:
        found = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            parent.setdefault(a, a), parent.setdefault(b, b)
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        if len(parent) >= FOREST_NODES:
            yield stars()
            parent = {}
    yield stars()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b).

    A round hands every node's larger neighbours the smallest of its neighbours (large star), then deals edges by the
    larger end and joins what meets there, which includes the small star. Tasks join the edges that they hold before
    they send them, so that a hot node arrives as one edge from each part. Rounds end once all edges form stars.
    """
    contract = lambda e: e.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contracted, "a long, b long")
    now = scratch.write(contract(edges))
    for _ in range(rounds):
        ends = now.unionByName(now.select(F.col("b").alias("a"), "b"))
        if ends.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most")).where("least < most").isEmpty():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = now, scratch.write(contract(contract(large).repartition("a")))
        scratch.drop(old)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
