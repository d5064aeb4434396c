"""Folders that the driver and the executors share, and small versioned catalog tables in them."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. One of our own only where that is unset and all tasks run on this machine:
    on a cluster each executor would write to its own disk, and rows would be missed."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Files:
    """The few file operations the library needs, through the file system of each path."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def move(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        if not fs.rename(p, self._at(target)[1]):
            raise OSError(f"cannot move {source} to {target}")

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def matching(self, pattern: str) -> list[str]:
        fs, p = self._at(pattern)
        return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])

    def write(self, path: str, text: str) -> None:
        """A small file, seen whole or not at all."""
        staged = f"{path}.{uuid.uuid4().hex}.tmp"
        fs, p = self._at(staged)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.exists(path):
            self.delete(staged)
            raise OSError(f"changed by another writer: {path}")
        self.move(staged, path)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


class Catalog:
    """Small tables below <root>/_catalog, held by the driver; each change is a new version in one file, and readers see
    the newest. Whoever changes a version that another writer has changed meanwhile fails."""

    KEEP = 2

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, f"{root.rstrip('/')}/_catalog", Files(spark)

    def _versions(self, name: str) -> list[int]:
        return sorted(int(v[1:-5]) for v in self.files.names(f"{self.root}/{name}") if v[:1] == "v" and v.endswith(".json"))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def rows(self, name: str) -> list[dict]:
        versions = self._versions(name)
        return json.loads(self.files.read(f"{self.root}/{name}/v{versions[-1]}.json")) if versions else []

    def replace(self, name: str, rows: list[dict]) -> None:
        """Rows of a catalog table (hypertables, policies, jobs): a handful, held by the driver."""
        versions = self._versions(name)
        self.files.write(f"{self.root}/{name}/v{(versions[-1] if versions else 0) + 1}.json", json.dumps(rows))
        for old in versions[: -self.KEEP]:
            self.files.delete(f"{self.root}/{name}/v{old}.json")

    def upsert(self, name: str, row: dict, key: str) -> None:
        self.replace(name, [r for r in self.rows(name) if r[key] != row[key]] + [row])

    def frame(self, name: str, schema: str) -> DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(c) for c in columns) for r in self.rows(name)], schema)


def write_back(files: Files, df: DataFrame, path: str, partition: str) -> None:
    """Replace a partitioned table by a frame that may read it: written beside it, then swapped in."""
    staged, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").partitionBy(partition).parquet(staged)
    if files.exists(path):
        files.move(path, old)
    files.move(staged, path)
    files.delete(old)
