"""Mixing sources to target weights, on fixed-length token blocks.

The words of each source, in the order of doc_id, are packed into blocks of a fixed length. A source's target, in
blocks, is drawn out over the output shards by multinomial draws, each over what the sources still have to give, so
that totals meet the targets. A source's slots run through its blocks in a pseudorandom order, another one each time
round: slot i takes the block that a keyed permutation gives for i. Slots and blocks meet by a join on that index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm._dist import Scratch, ranked, unused
from tideline.llm._text import U64, mix

#: Share of each source by its place, repeating.
WEIGHTS = (3, 1, 2)


@dataclass
class Source:
    name: str | None
    size: int
    weight: float
    target: float = 0.0


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> list[Source]:
    """Sources by code point, null last, with their targets: shares of budget * all sizes by weight; what goes beyond
    `most` times a source's size is shared out again among the others."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    sources = [Source(name, int(size), weights[i % len(weights)]) for i, (name, size) in enumerate(ordered)]
    left, free = budget * sum(s.size for s in sources), list(sources)
    while free:
        unit = left / sum(s.weight for s in free)
        over = [s for s in free if unit * s.weight > most * s.size]
        for s in over or free:
            s.target = most * s.size if over else unit * s.weight
        if not over:
            break
        left -= sum(s.target for s in over)
        free = [s for s in free if s not in over]
    return sources


def draw(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots of each source (columns) in each output shard (rows): multinomial draws over what is left of each source."""
    rng, left, out = np.random.Generator(np.random.PCG64(seed)), slots.astype(np.int64).copy(), []
    for shard in range(shards):
        want = int(left.sum()) // (shards - shard)
        take = np.zeros_like(left)
        while want and (room := left - take).sum():
            more = np.minimum(rng.multinomial(want, room / room.sum()), room)
            take += more
            want -= int(more.sum())
        left -= take
        out.append(take)
    return np.array(out)


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1, by a Feistel network on the next power of four with cycle walking."""
    half = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(U64)
    half = np.where((U64(1) << (half * U64(2))) < n.astype(U64), half + U64(1), half)
    low = (U64(1) << half) - U64(1)
    x, todo = i.astype(U64), np.arange(len(i))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for turn in range(4):
            left, right = right, left ^ (mix(right + k + U64(turn * 0x9E3779B97F4A7C15 % 2**64)) & m)
        x[todo] = left << h | right
        todo = todo[x[todo] >= n[todo].astype(U64)]
    return x.astype(np.int64)


@dataclass
class Plan:
    sources: list[Source]
    block: int
    counts: np.ndarray  # (output shards, sources)
    seed: int

    @property
    def blocks(self) -> np.ndarray:
        return np.array([-(-s.size // self.block) for s in self.sources], np.int64)


def plan(sizes: list[tuple[str | None, int]], block: int, shards: int, seed: int, **options) -> Plan:
    sources = targets(sizes, **options)
    slots = np.array([round(s.target * -(-s.size // block) / s.size) if s.size else 0 for s in sources], np.int64)  # by the mean block, as the last may be shorter
    return Plan(sources, block, draw(slots, shards, seed) if len(slots) else np.zeros((shards, 0), np.int64), seed)


def slots(spark, p: Plan) -> DataFrame:
    """One row for each slot of the mix: shard, slot (from 0 in each shard, no gaps), sid (the source's place) and block (its
    index in the source). No sources, or none with words, give no rows; the same plan gives the same rows."""
    flat = p.counts.ravel()
    ends = np.cumsum(flat)
    starts_in_source = (np.cumsum(p.counts, 0) - p.counts).ravel()
    total, n_sources, n_blocks, seed = int(ends[-1]) if len(ends) else 0, len(p.sources), p.blocks, p.seed

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column("id"))
            if not len(at):
                continue
            cell = np.searchsorted(ends, at, "right")
            inside = at - (ends - flat)[cell]
            sid, shard = cell % n_sources, cell // n_sources
            i, n = starts_in_source[cell] + inside, n_blocks[sid]
            key = mix((i // n).astype(U64) * U64(1 << 32) + sid.astype(U64) + U64(seed * 0x9E3779B97F4A7C15 % 2**64))
            inside = at - (ends.reshape(p.counts.shape)[:, 0] - p.counts[:, 0])[shard]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard.astype(np.int32), inside, sid.astype(np.int32), permute(i % n, n, key))], names=["shard", "slot", "sid", "block"])

    return spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, -(-total // 500_000))).mapInArrow(place, "shard int, slot long, sid int, block long")


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame, block: int = 32, shards: int = 16, seed: int = 5, scratch: Scratch | None = None) -> tuple[DataFrame, Plan, DataFrame]:
    """What the mix takes of each document, the plan, and the slots.

    The first frame has doc_id, size, source_size, target (its source's), taken and pieces (word ranges of the document
    with the times each is taken). Takes doc_id, text and source; other columns are not looked at.
    Null and empty texts have no words and nothing is taken; null sources are a source of their own, the last; a repeated
    row counts each time; rows without a doc_id are left out. Equal input gives an equal mix.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = scratch.write(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size")))
    sizes = [(r["source"], r["size"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()]  # a row for each source
    p = plan(sizes, block, shards, seed)
    table = spark.createDataFrame([(i, s.name, s.size, float(s.target)) for i, s in enumerate(p.sources)], "sid int, name string, source_size long, target double")
    known = rows.join(table, rows["source"].eqNullSafe(table["name"])).select("doc_id", "sid", "size", "source_size", "target")
    known = scratch.write(ranked(known, scratch, ["sid", "doc_id"], ["sid"], "size").select("doc_id", "sid", "size", "source_size", "target", F.col("before_value").alias("first")))
    mixed = slots(spark, p)
    times = mixed.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    parts = known.where("size > 0").select("doc_id", "sid", "first", "size", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(first + size - 1) div {block}"))).alias("block"))
    # A document's blocks are estimated as large as its one row, and would be broadcast.
    parts = parts.join(times.hint("merge"), ["sid", "block"]).select(
        "doc_id", "sid", "first", "times", (F.greatest(F.col("block") * block, F.col("first")) - F.col("first")).alias("start"),
        (F.least((F.col("block") + 1) * block, F.col("first") + F.col("size")) - F.col("first")).alias("stop"),
    )
    taken = parts.groupBy("sid", "first", "doc_id").agg(F.sum((F.col("stop") - F.col("start")) * F.col("times")).alias("taken"), F.array_sort(F.collect_list(F.struct("start", "stop", "times"))).alias("pieces"))
    out = known.join(taken.hint("merge"), ["sid", "first", "doc_id"], "left")
    taken = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.when(F.col("size") > 0, F.col("pieces")).alias("pieces")), p, mixed


def mixed_texts(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """Documents with the words that the mix takes of them as their text, a piece as often as it is taken; others go.

    `taken` is the first frame of `mix_documents`. All columns of docs stay, whatever their names, but for the text. Of
    rows that repeat a doc_id each gets the words that the mix takes of one of them; rows without a doc_id, and documents
    of which nothing is taken (all that have no words), go; an empty table gives none.
    """
    key, ranges = unused(docs, "_id", "_pieces")
    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            at = columns.index("text")
            for text, pieces in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                words = (text or "").encode().split()
                texts.append(b" ".join(w for x in pieces for w in words[x["start"] : x["stop"]] * x["times"]).decode())
            rest = [batch.column(i) for i in range(len(columns))]
            rest[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(rest, names=columns)

    some = taken.where("taken > 0").select(F.col("doc_id").alias(key), F.col("pieces").alias(ranges)).dropDuplicates([key])
    joined = docs.join(some.hint("merge"), docs["doc_id"] == some[key]).drop(key)  # texts are larger than their files, and are not broadcast
    return joined.mapInArrow(cut, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    out, _, _ = mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
