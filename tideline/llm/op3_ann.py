"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard of the vectors.

Equal vectors are folded into one class first, so that a vector that a third of all rows share is one node. Classes are
dealt into shards by hash. In a shard, nodes enter the graph in growing batches: a greedy beam search from the medoid
proposes neighbours, and pruning keeps an edge only if no kept neighbour is nearer to its end by the factor alpha.
Queries are searched in every shard in blocks; what a beam finds is scored exactly, and the shards' best are merged.

Nearness is the inner product, which is no distance: long vectors are near to much that they are not close to. So the
pruned graph is that of directions (vectors of length one), and every node gets more edges to what a beam search over
that graph, led by inner products, finds for the node itself; searches start from the medoid and the longest vectors.
Each shard then measures itself: SAMPLE of its nodes are searched and compared with all products, and the beam is
doubled until RECALL of the neighbours are found; beam and recall stand in the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm._dist import Scratch

#: Rows of a shard at most, so that its vectors and graph stay in a task's memory; and shards at least.
SHARD_ROWS, SHARDS = 100_000, 12
#: Queries of a block that is sent to a shard, and of a step of its search.
BLOCK_ROWS, QUERY_ROWS = 32_768, 2048
#: Tasks for each shard, or shard and block, so that few of them meet in one; and tasks at most.
SPREAD, MOST_TASKS = 4, 20_000
#: Nodes that a shard measures its recall with, neighbours of each, and the share of them that its beam has to find.
SAMPLE, NEAREST, RECALL = 128, 20, 0.96


class Graph:
    """Nodes with `degree` edges each (`out`, -1: none), searched from `entries` by nearness: `norm` less twice the product."""

    def __init__(self, x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 3):
        """x: vectors as rows (float32); distances are squared Euclidean ones."""
        self.x, self.degree = np.ascontiguousarray(x, np.float32), degree
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        n = len(x)
        self.out = np.full((n, degree), -1, np.int32)
        self.entries = np.array([np.argmin(((self.x - self.x.mean(0)) ** 2).sum(1))] if n else [], np.int64)
        order = np.random.Generator(np.random.PCG64(seed)).permutation(n)
        for alpha_now in (1.0, alpha):
            at, size = 0, (32 if alpha_now == 1.0 else 1024)
            while at < n:
                batch = order[at : at + size]
                self._insert(batch, alpha_now, beam)
                at += len(batch)
                size = min(2 * size, 1024)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam's nodes (-1: none) and distances for each query, nearest first."""
        step = max(8, min(1024, 48_000_000 // max(1, len(self.x))))
        found = [self._search(q[i : i + step], beam) for i in range(0, len(q), step)]
        if not found:
            return np.zeros((0, beam), np.int64), np.zeros((0, beam), np.float32)
        return tuple(np.concatenate(f) for f in zip(*found, strict=True))

    def _distance(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.norm[ids] - 2 * np.einsum("bcd,bd->bc", self.x[ids], q)

    def _search(self, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        b, n = len(q), len(self.x)
        rows = np.arange(b)[:, None]
        starts = np.broadcast_to(self.entries[:beam], (b, min(beam, len(self.entries))))
        k = starts.shape[1]
        ids = np.full((b, beam), -1, np.int64)
        dist = np.full((b, beam), np.inf, np.float32)
        done = np.ones((b, beam), bool)
        near = self._distance(q, starts)
        order = np.argsort(near, 1, kind="stable")
        ids[:, :k], dist[:, :k], done[:, :k] = np.take_along_axis(starts, order, 1), np.take_along_axis(near, order, 1), False
        seen = np.zeros((b, n), bool)
        seen[:, self.entries[:beam]] = True
        live = np.arange(b)
        while len(live):
            # The nearest few that are not expanded yet.
            pick = np.argsort(done[live], 1, kind="stable")[:, :width]
            fresh = ~np.take_along_axis(done[live], pick, 1)
            go = fresh.any(1)
            live, pick, fresh = live[go], pick[go], fresh[go]
            if not len(live):
                break
            r = rows[: len(live)]
            done[live[:, None], pick] = True
            near = self.out[ids[live[:, None], pick]].astype(np.int64)
            near[~fresh] = -1
            near = near.reshape(len(live), -1)
            new = (near >= 0) & ~seen[live[:, None], near]
            near[~new] = -1
            # One of equals within a row.
            order = np.argsort(near, 1, kind="stable")
            near = np.take_along_axis(near, order, 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            at = np.nonzero(near >= 0)
            seen[live[at[0]], near[at]] = True
            d = np.where(near >= 0, self._distance(q[live], near), np.inf).astype(np.float32)
            all_ids, all_d = np.concatenate((ids[live], near), 1), np.concatenate((dist[live], d), 1)
            all_done = np.concatenate((done[live], near < 0), 1)
            keep = np.argsort(all_d, 1, kind="stable")[:, :beam]
            ids[live], dist[live], done[live] = all_ids[r, keep], all_d[r, keep], all_done[r, keep]
        return ids, dist

    def _prune(self, nodes: np.ndarray, cand: np.ndarray, alpha: float) -> np.ndarray:
        """Neighbours of each node from its candidates (-1: none): diverse ones first, then the nearest of the others."""
        cand = np.sort(np.where(cand == nodes[:, None], -1, cand), 1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        d = np.where(cand >= 0, self._distance(self.x[nodes], cand) + self.norm[nodes][:, None], np.inf)
        order = np.argsort(d, 1, kind="stable")[:, : 3 * self.degree]
        cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
        vectors, norms, alive = self.x[cand], self.norm[cand], np.isfinite(d)
        spare = alive.copy()
        out = np.full((len(nodes), self.degree), -1, np.int32)
        rows = np.arange(len(nodes))
        for k in range(self.degree):
            first = np.argmax(alive, 1)
            has = alive[rows, first]
            if not has.any():
                break
            out[has, k] = cand[rows[has], first[has]]
            p = vectors[rows, first]
            between = norms + norms[rows, first][:, None] - 2 * np.einsum("bcd,bd->bc", vectors, p)
            alive &= ~((alpha * alpha * between <= d) & has[:, None])
            alive[rows, first] = False
            spare[rows[has], first[has]] = False
        kept = (out >= 0).sum(1)
        order = np.argsort(~spare, 1, kind="stable")[:, : self.degree]
        at = np.arange(order.shape[1])[None, :]
        r, c = np.nonzero((at < spare.sum(1)[:, None]) & (at + kept[:, None] < self.degree))
        out[r, kept[r] + c] = cand[r, order[r, c]]
        return out

    def _insert(self, nodes: np.ndarray, alpha: float, beam: int) -> None:
        found, _ = self.search(self.x[nodes], beam)
        cand = np.concatenate((found, self.out[nodes]), 1)
        new = np.concatenate([self._prune(nodes[i : i + 512], cand[i : i + 512], alpha) for i in range(0, len(nodes), 512)])
        self.out[nodes] = new
        # The same edges the other way round.
        ends, starts = new.ravel(), np.repeat(nodes, self.degree)
        starts, ends = starts[ends >= 0], ends[ends >= 0].astype(np.int64)
        order = np.argsort(ends, kind="stable")
        starts, ends = starts[order], ends[order]
        who, first, many = np.unique(ends, return_index=True, return_counts=True)
        most = min(int(many.max()) if len(many) else 0, 4 * self.degree)
        for i in range(0, len(who), 512):
            w, f, m = who[i : i + 512], first[i : i + 512], np.minimum(many[i : i + 512], most)
            extra = np.full((len(w), most), -1, np.int64)
            at = np.arange(most)[None, :] < m[:, None]
            extra[at] = starts[(f[:, None] + np.arange(most)[None, :])[at]]
            both = np.concatenate((self.out[w].astype(np.int64), extra), 1)
            self.out[w] = self._prune(w, both, alpha)


class ProductGraph(Graph):
    """A graph whose beam search finds the largest inner products."""

    def __init__(self, x: np.ndarray, degree: int = 32, more: int = 16, tops: int = 16, beam: int = 64):
        """x: vectors as rows, none of them zero; `more`: edges by product; `tops`: longest vectors to start from."""
        small = x / np.abs(x).max() if len(x) else x
        length = np.sqrt((small.astype(np.float64) ** 2).sum(1))
        top = np.abs(x).max(1, keepdims=True) if len(x) else np.ones((0, 1))
        unit = x / top
        directions = Graph(unit / np.linalg.norm(unit, axis=1, keepdims=True), degree, beam)
        self._hold(small)
        self.degree = degree
        self.entries = np.unique(np.concatenate((directions.entries, np.argsort(-length, kind="stable")[:tops])))
        self.out = np.concatenate((directions.out, np.full((len(x), more), -1, np.int32)), 1)
        found = np.concatenate([self._by_product(np.arange(i, min(i + 1024, len(x))), more, beam) for i in range(0, len(x), 1024)]) if len(x) else self.out[:, degree:]
        self.out[:, degree:] = found
        self.beam, self.recall = self._measured(96)

    def _hold(self, small: np.ndarray) -> None:
        self.x, self.norm = np.ascontiguousarray(small, np.float32), np.zeros(len(small), np.float32)

    @classmethod
    def load(cls, x: np.ndarray, out: np.ndarray, entries: np.ndarray, beam: int) -> ProductGraph:
        g = cls.__new__(cls)
        g._hold(x / np.abs(x).max() if len(x) else x)
        g.out, g.entries, g.beam = out, entries, beam
        return g

    def _by_product(self, nodes: np.ndarray, more: int, beam: int) -> np.ndarray:
        """Of what the search finds for each node the nearest that are not among its edges yet."""
        found, _ = self.search(self.x[nodes], beam)
        known = (found[:, :, None] == self.out[nodes][:, None, :]).any(2) | (found == nodes[:, None]) | (found < 0)
        order = np.argsort(known, 1, kind="stable")[:, :more]
        out = np.full((len(nodes), more), -1, np.int32)
        out[:, : order.shape[1]] = np.where(np.take_along_axis(known, order, 1), -1, np.take_along_axis(found, order, 1))
        return out

    def _measured(self, beam: int) -> tuple[int, float]:
        """The beam that finds RECALL of the sampled nodes' neighbours, and the share that it finds."""
        n = len(self.x)
        sample = np.unique(np.linspace(0, n - 1, min(n, SAMPLE)).astype(np.int64)) if n else np.zeros(0, np.int64)
        k = min(NEAREST, n)
        products = self.x[sample] @ self.x.T
        least = -np.sort(-products, 1)[:, k - 1 : k] if n else products
        while n:
            found, _ = self.search(self.x[sample], min(beam, n))
            got = np.where(found >= 0, np.einsum("bcd,bd->bc", self.x[found], self.x[sample]), -np.inf)
            recall = float((np.sort(got, 1)[:, -k:] >= least - 1e-6 * np.abs(least)).mean())
            if recall >= RECALL or beam >= n:
                return min(beam, n), recall
            beam *= 2
        return beam, 1.0


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(n, -1)


INDEX = "dim int, shard int, beam int, recall double, wide boolean, entries binary, x binary, graph binary, members binary, counts binary"
_INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("beam", pa.int32()), ("recall", pa.float64()), ("wide", pa.bool_()), *((c, pa.binary()) for c in ("entries", "x", "graph", "members", "counts"))])


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("cid")
    x = _matrix(table.column("embedding"), table.num_rows)
    graph = ProductGraph(x)
    members = table.column("members").combine_chunks()
    row = {
        "dim": x.shape[1], "shard": table.column("shard")[0].as_py(), "beam": graph.beam, "recall": graph.recall, "wide": x.dtype == np.float64, "entries": graph.entries.tobytes(), "x": x.tobytes(),
        "graph": graph.out.tobytes(), "members": np.asarray(members.flatten()).astype(np.int64).tobytes(), "counts": np.asarray(members.value_lengths()).astype(np.int32).tobytes(),
    }
    return pa.Table.from_pylist([row], schema=_INDEX)


def _pack(table: pa.Table, block: int) -> pa.Table:
    x = _matrix(table.column("embedding"), table.num_rows)
    return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "block": pa.array([block], pa.int64()), "q": pa.array([x.tobytes()], pa.binary()), "qid": pa.array([np.asarray(table.column("cid")).astype(np.int64).tobytes()], pa.binary())})


def _search(batches: Iterator[pa.RecordBatch], k: int, beam: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query of a block in a shard; of equal products the smaller ids, whatever the beam's order. Rows
    of a shard and rows of a block come together where both are there, side by side and sorted."""
    last: dict = {}
    for batch in batches:
        for row in batch.to_pylist():
            here = (row["dim"], row["shard"], row["block"])
            if row["q"] is None:
                last = row | {"here": here}
                continue
            if last.get("here") != here:
                continue
            row = last | {c: row[c] for c in ("q", "qid")}
            x, q = (np.frombuffer(row[c], np.float64 if row["wide"] else np.float32).reshape(-1, row["dim"]) for c in "xq")
            graph = ProductGraph.load(x, np.frombuffer(row["graph"], np.int32).reshape(len(x), -1), np.frombuffer(row["entries"], np.int64), row["beam"])
            counts = np.frombuffer(row["counts"], np.int32)
            members, firsts = np.frombuffer(row["members"], np.int64), np.concatenate(([0], np.cumsum(counts)))
            names = np.frombuffer(row["qid"], np.int64)
            for at in range(0, len(q), QUERY_ROWS):
                block = q[at : at + QUERY_ROWS].astype(np.float64)
                found, _ = graph.search((block / np.maximum(np.abs(block).max(1, keepdims=True), 1e-300)).astype(np.float32), min(max(beam, graph.beam), len(x)))
                qids, vec, scores = [], [], []
                for qid, one, ids in zip(names[at : at + QUERY_ROWS].tolist(), block, found, strict=True):
                    ids = ids[ids >= 0]
                    s = x[ids].astype(np.float64) @ one
                    if len(ids) > k:  # nodes below the k-th product cannot be among the best
                        best = s >= np.partition(s, len(s) - k)[len(s) - k]
                        ids, s = ids[best], s[best]
                    who = np.concatenate([members[firsts[j] : firsts[j + 1]] for j in ids]) if len(ids) else members[:0]
                    s = np.repeat(s, counts[ids])
                    top = np.lexsort((who, -s))[:k]
                    qids.append(np.full(len(top), qid)), vec.append(who[top]), scores.append(s[top])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (qids, vec, scores)], names=["cid", "vec_id", "score"])


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """cid (smallest vec_id), embedding and members (the k smallest vec_ids) of each distinct vector."""
    salted = vectors.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k).alias("some"))
    folded = salted.groupBy("embedding").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, k).alias("members"))
    return folded.select(F.element_at("members", 1).alias("cid"), "embedding", "members", F.size("embedding").alias("dim"))


def usable(embeddings: DataFrame) -> DataFrame:
    """Vectors that take part: not null, not zero, all components finite; doubles stay doubles, other numbers are floats."""
    kind = embeddings.schema["embedding"].dataType
    wide = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.DoubleType, T.LongType, T.DecimalType))
    e = F.col("embedding").cast("array<double>" if wide else "array<float>")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embeddings.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where((F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda v: v != 0))


def build_index(embeddings: DataFrame, k: int = 21, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """The index, one row for each shard with its beam and measured recall, and the classes of equal vectors; every usable row is in it."""
    scratch = scratch or Scratch(embeddings.sparkSession)
    folded = scratch.write(classes(usable(embeddings), k))
    shards = max(SHARDS, -(-folded.count() // SHARD_ROWS))
    dealt = folded.withColumn("shard", F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int")).repartition(min(SPREAD * shards, MOST_TASKS), "dim", "shard")
    index = dealt.groupBy("dim", "shard").applyInArrow(_build, INDEX)
    return scratch.write(index), folded


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, beam: int = 96, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k vectors with the largest inner product, for the rows whose vec_id
    is divisible by `every`, each against all other rows; nearest first, ties to the smaller vec_id.

    Takes vec_id and embedding; other columns are not looked at. Rows with a null id, or a vector that is null, empty,
    zero or holds null or non-finite components, take no part; vectors of different lengths do not meet; with fewer
    candidates than k all are returned. A row that repeats an id and vector counts once. `beam` is the least beam; a shard
    that needs a wider one to find RECALL of its sample uses that. A block of queries meets each shard once.
    """
    spark = embeddings.sparkSession
    scratch = scratch or Scratch(spark)
    usable_rows = usable(embeddings).distinct()
    index, folded = build_index(usable_rows, k + 1, scratch)
    queries = scratch.write(usable_rows.where(F.col("vec_id") % every == 0).join(folded.select("embedding", "cid", "dim"), "embedding").select("vec_id", "cid", "dim"))
    distinct = folded.join(queries.select("cid").distinct(), "cid", "left_semi")
    n = max(1, -(-distinct.count() // BLOCK_ROWS))
    packed = distinct.groupBy("dim", F.pmod(F.xxhash64("cid"), F.lit(n)).alias("block")).applyInArrow(lambda key, t: _pack(t, key[1].as_py()), "dim int, block long, q binary, qid binary")
    # A shard goes to each block of queries once, and meets it in a task of its own.
    shards = index.agg(F.max("shard")).first()[0] or 0
    both = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    both = both.unionByName(packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards)))), allowMissingColumns=True)
    keys = ["dim", "shard", "block"]
    met = both.repartition(min(SPREAD * (shards + 1) * n, MOST_TASKS), *keys).sortWithinPartitions(*keys, F.col("q").isNotNull())
    found = met.mapInArrow(lambda it: _search(it, k + 1, beam), "cid long, vec_id long, score double")
    best = found.groupBy("cid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k + 1).alias("best"))
    own = queries.select(F.col("vec_id").alias("query_id"), "cid").join(best, "cid")
    top = own.select("query_id", F.posexplode(F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)).alias("at", "b"))
    return top.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
