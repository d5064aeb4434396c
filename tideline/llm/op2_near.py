"""Near-duplicate documents by an LSH forest over MinHash signatures.

A signature is read in several orders (trees): tree t starts at another place of the signature. Signatures sorted in
one order put similar documents next to each other, and the longest common prefix of neighbours tells how similar they
are. A region is the documents of one tree with one common prefix. Links are confirmed on the full shingle sets, in
passes, each of which looks only at documents that the passes before left in different components:

1. every document with the hub of its regions, the one whose full prefixes are the most common (the text that others
were copied from), 2. neighbours in all trees' orders, as deep as their common prefix reaches, 3. regions that still
hold several components. No pair of the third pass becomes a row: the open regions that components tie together are one
job, whose task counts the common shingles of all of its documents at once and returns only the components that it
joins. Larger groups are cut into blocks of a bounded size, a job is then two blocks, and blocks of one component, or
whose sets differ too much in size, do not meet. Nothing is estimated there: what shares a prefix is compared exactly.

A pair of similarity s shares a prefix of depth d in one of l trees with probability 1 - (1 - s**d)**l; the number of
trees follows from the threshold so that a pair just at it is missed with a probability of at most MISS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm._dist import Scratch, components, ranked
from tideline.llm._text import U64, Block, Rolling, blocks, mix

#: Least and greatest length of a common prefix, in signature values.
DEPTH, FULL_DEPTH = 4, 8
#: Probability at most with which a pair just at the threshold shares no prefix.
MISS = 1e-5
#: Shingles of a block at most (or one document), and what a document counts beside its shingles; so 4,096 documents at most.
BLOCK_SHINGLES, DOC_COST = 1 << 21, 512


def trees_for(percent: int) -> int:
    """Trees whose first DEPTH values are disjoint parts of a signature, so many that MISS holds."""
    s = min(percent / 100, 0.99)
    return max(8, math.ceil(math.log(MISS) / math.log(1 - s**DEPTH)))


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and the documents' bounds in them."""
    words = block.words(lower=True)
    counts = words.counts
    at, h = words.windows(size)
    doc = np.searchsorted(words.bounds, at, "right") - 1
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = Rolling(words.hash).hash(words.bounds[short], words.bounds[short + 1])
        h, doc = np.concatenate((h, whole)), np.concatenate((doc, short))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(block.ids) + 1))


def _signatures(h: np.ndarray, bounds: np.ndarray, values: int) -> np.ndarray:
    """One row of 32-bit minima for each document with shingles."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(full), values), np.uint32)
    for j, seed in enumerate(_seeds(values)):
        x = h * seed
        out[:, j] = np.minimum.reduceat((x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9) >> U64(32), bounds[:-1][full]) if len(full) else []
    return out


def _sketch(batches: Iterator[pa.RecordBatch], size: int, values: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch):
            h, bounds = shingle_sets(block, size)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            sig = _signatures(h, bounds, values)
            sums = [np.concatenate(([U64(0)], np.cumsum(mix(h ^ U64(seed))))) for seed in (0x51ED270B, 0x2545F491)]
            keys = [(s[bounds[1:]] - s[bounds[:-1]]).astype(np.int64) for s in sums]
            sigs = [None] * len(n)
            for i, row in zip(full.tolist(), sig.astype(">u4"), strict=True):
                sigs[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(n.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "key1", "key2", "sig"])


def _signature_rows(batch: pa.RecordBatch, trees: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), ">u4").reshape(-1, trees * DEPTH)


def _label(tree: int, trees: int) -> np.ndarray:
    return (np.arange(FULL_DEPTH) + tree * DEPTH) % (trees * DEPTH)


def _forest(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column("doc_id"))
        if not len(ids):
            continue
        sig = _signature_rows(batch, trees)
        for tree in range(trees):
            labels = np.ascontiguousarray(sig[:, _label(tree, trees)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), tree, np.int32)), pa.array([x.tobytes() for x in labels], pa.binary()), pa.array(ids)], names=["tree", "label", "doc_id"])


def common_prefix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of each row of labels with its partner."""
    return np.cumprod(x == y, axis=1).sum(1)


_NEAR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("depth", pa.int32()), ("tree", pa.int32()), ("label", pa.binary()), ("first", pa.bool_())])
_NEAR_DDL = "a long, b long, depth int, tree int, label binary, first boolean"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours in a sorted part with the length of their common prefix, DEPTH at least; and the part's first and last row (b null)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree = np.asarray(batch.column("tree")).astype(np.int64)
        ids = np.asarray(batch.column("doc_id"))
        labels = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u4").reshape(-1, FULL_DEPTH)
        if last is None:
            yield pa.RecordBatch.from_pylist([{"a": int(ids[0]), "tree": int(tree[0]), "label": labels[0].tobytes(), "first": True}], schema=_NEAR)
        else:
            tree, ids, labels = np.concatenate(([last[0]], tree)), np.concatenate(([last[1]], ids)), np.concatenate((last[2][None], labels))
        last = (tree[-1], ids[-1], labels[-1])
        depth = common_prefix(labels[1:], labels[:-1])
        hit = (tree[1:] == tree[:-1]) & (depth >= DEPTH) & (ids[1:] != ids[:-1])
        a, b, n = ids[:-1][hit], ids[1:][hit], int(hit.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(depth[hit].astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.bool_())], schema=_NEAR)
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"a": int(last[1]), "tree": int(last[0]), "label": last[2].tobytes(), "first": False}], schema=_NEAR)


#: Bits of the table that marks documents whose sets are needed, at most; a document marked by chance costs only its set.
MARK_BITS = 1 << 27


def _marks(ids: DataFrame) -> np.ndarray:
    """A bit table of hashed ids, of a bounded size: MARK_BITS / 64 words at most reach the driver."""
    bits = 1 << min(MARK_BITS.bit_length() - 1, max(16, (16 * ids.count()).bit_length()))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = ids.select(F.shiftright(h, 6).alias("word"), F.expr("1").cast("long").alias("one"), (h % 64).cast("int").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.col("one"), F.col("bit"))).alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(rows.column("word"))] = np.asarray(rows.column("mask"))
    return out.view(U64)


def _sets(batches: Iterator[pa.RecordBatch], size: int, marked: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sets of the documents that are marked; `mark` is the hash of the id."""
    bits = U64(len(marked) * 64)
    for batch in batches:
        mark = np.asarray(batch.column("mark")).astype(np.int64) % np.int64(bits)
        hit = (marked[mark >> 6] >> (mark & 63).astype(U64)) & U64(1)
        for block in blocks(batch.filter(pa.array(hit.astype(bool)))):
            h, bounds = shingle_sets(block, size)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array([h[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(block.ids))], pa.binary())], names=["doc_id", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(both) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """Components of documents whose sets of `shingle`-word shingles have a Jaccard similarity of `percent` / 100 or more.

    Takes doc_id and text; other columns are not looked at. Returns doc_id, n_shingles, component_id (the smallest
    doc_id reachable over links, itself included) and kept (doc_id = component_id), one row for each row with a doc_id.
    Words are lower-cased (A-Z) runs without ASCII white space; a text of fewer words is one shingle; null and empty
    texts have no shingles and no links. Documents with equal sets fold into one before any comparison.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    trees = trees_for(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    sketches = scratch.write(docs.mapInArrow(lambda it: _sketch(it, shingle, trees * DEPTH), "doc_id long, n_shingles long, key1 long, key2 long, sig binary"))
    some = sketches.where("sig is not null")
    classes = scratch.write(some.groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")))
    reps = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "sig")

    forest = reps.select("doc_id", "sig").mapInArrow(lambda it: _forest(it, trees), "tree int, label binary, doc_id long")
    ordered = forest.repartitionByRange("tree", "label", "doc_id").sortWithinPartitions("tree", "label", "doc_id")
    near = scratch.write(ordered.mapInArrow(_neighbours, _NEAR_DDL).withColumn("part", F.spark_partition_id()))
    # Neighbours that a cut between two parts has separated: two rows for each part.
    edges = near.where("b is null").orderBy("part", F.col("first").desc()).collect()
    over = []
    for x, y in zip(edges[1::2], edges[2::2], strict=False):
        if x.tree == y.tree and x.a != y.a and x.label[: 4 * DEPTH] == y.label[: 4 * DEPTH]:
            over.append((min(x.a, y.a), max(x.a, y.a)))
    pairs = near.where("b is not null").select("a", "b")
    if over:
        pairs = pairs.unionByName(spark.createDataFrame(over, "a long, b long"))
    pairs = scratch.write(pairs.distinct())

    # Whoever shares a prefix with anybody is the neighbour of somebody: only these need their sets.
    touched = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    marked = _marks(touched)
    sets = docs.withColumn("mark", F.xxhash64("doc_id")).mapInArrow(lambda it: _sets(it, shingle, marked), "doc_id long, shingles binary")
    sets = scratch.write(sets.dropDuplicates(["doc_id"]))
    sigs = scratch.write(reps.join(touched, "doc_id", "left_semi"))

    def links(candidates: DataFrame) -> DataFrame:
        """Candidates that are linked: by size what cannot be is put aside, then the sets decide."""
        x, y = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}"), F.octet_length("shingles").alias(f"n_{c}")) for c in "ab")
        fit = candidates.join(x, "a").join(y, "b").where(F.least("n_a", "n_b").cast("long") * 100 >= F.greatest("n_a", "n_b").cast("long") * percent)
        return fit.select("a", "b", "set_a", "set_b").mapInArrow(lambda it: _confirmed(it, percent), "a long, b long")

    def across(candidates: DataFrame, of: DataFrame) -> DataFrame:
        """Candidates whose ends are still in different components."""
        x, y = (of.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
        both = candidates.join(x, "a", "left").join(y, "b", "left")
        return both.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")

    def grown(of: DataFrame, more: DataFrame) -> DataFrame:
        """Components after more links: the rounds run over the components that these join, not over all documents."""
        if more.isEmpty():
            return of
        x, y = (of.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
        ends = more.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        merged = scratch.write(components(ends, scratch))
        to = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
        old = of.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        return scratch.write(old.unionByName(merged.join(of, "node", "left_anti").select("node", "component")))

    of = scratch.write(components(scratch.write(links(_hubs(sigs, trees, scratch))), scratch))
    of = grown(of, scratch.write(links(across(pairs, of))))
    jobs = _jobs(sigs, of, percent, trees, scratch)
    filled = jobs.join(sets, "doc_id").repartition(*_JOB).sortWithinPartitions(*_JOB, "block")
    of = grown(of, scratch.write(filled.select(*_JOB, "block", "component", "shingles").mapInArrow(lambda it: _joined(it, percent), "a long, b long")))

    members = sketches.select("doc_id", "n_shingles", "key1", "key2").join(classes.drop("sig"), ["key1", "key2", "n_shingles"], "left")
    members = members.withColumn("rep", F.coalesce("rep", "doc_id"))
    out = members.join(of, members["rep"] == of["node"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _prefixes(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    """64-bit keys of each tree's shortest and longest prefix."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _signature_rows(batch, trees).astype(U64)
        rest = [c for c in batch.schema.names if c != "sig"]
        for tree in range(trees):
            x = np.full(len(sig), tree + 1, U64)
            keys = []
            for depth, j in enumerate(_label(tree, trees), 1):
                x = mix(x * U64(0x9E3779B97F4A7C15) + sig[:, j])
                if depth in (DEPTH, FULL_DEPTH):
                    keys.append(x.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *map(pa.array, keys)], names=[*rest, "region", "full"])


def _hubs(sigs: DataFrame, trees: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of every document with the hub of each of its regions."""
    rows = sigs.select("doc_id", "sig").mapInArrow(lambda it: _prefixes(it, trees), "doc_id long, region long, full long")
    common = rows.groupBy("full").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    weighed = rows.join(common, "full", "left").groupBy("doc_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("weight"), F.collect_set("region").alias("regions"))
    rows = scratch.write(weighed).select("doc_id", F.struct("weight", -F.col("doc_id")).alias("rank"), F.explode("regions").alias("region"))
    hubs = rows.groupBy("region").agg((-F.max("rank")["col2"]).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = rows.join(hubs, "region").where("doc_id <> hub")
    return pairs.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()


#: A job is one block, or two, of one group; groups are numbered apart by kind: 0 ties of open regions, 1 single regions.
_JOB = ["kind", "key", "i", "j"]


def _jobs(sigs: DataFrame, of: DataFrame, percent: int, trees: int, scratch: Scratch) -> DataFrame:
    """Documents of regions that hold several components, by job: _JOB, block, doc_id and component.

    Components that share open regions are one group, so that a document goes out once and not once for each tree. A
    group that is larger than a block is cut up, whole or by its regions, whichever sends fewer rows.
    """
    rows = sigs.join(of, sigs["doc_id"] == of["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"), (F.col("n_shingles") + DOC_COST).alias("cost"), "sig")
    rows = rows.mapInArrow(lambda it: _prefixes(it, trees), "doc_id long, component long, cost long, region long, full long").drop("full")
    spans = rows.groupBy("region").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("region", "least")
    open_ = scratch.write(rows.join(spans, "region"))
    tied = scratch.write(components(open_.select(F.col("component").alias("a"), F.col("least").alias("b")).where("a <> b").distinct(), scratch))
    open_ = open_.drop("least").join(tied.select(F.col("node").alias("component"), F.col("component").alias("tie")), "component")

    price = F.ceil(F.col("w") / BLOCK_SHINGLES) * F.col("w")
    docs = scratch.write(open_.select("tie", "doc_id", "component", "cost").distinct())
    whole = docs.groupBy("tie").agg(F.sum("cost").alias("w")).select("tie", F.col("w").alias("weight"), price.alias("whole"))
    single = F.col("weight") <= BLOCK_SHINGLES
    large = whole.where(~single)
    by_region = open_.join(large.select("tie"), "tie").groupBy("tie", "region").agg(F.sum("cost").alias("w")).groupBy("tie").agg(F.sum(price).alias("parts"))
    choice = scratch.write(large.join(by_region, "tie").select("tie", (F.col("whole") <= F.col("parts")).alias("as_whole")))
    none = F.lit(0).cast("long")
    fits = docs.join(whole.where(single).select("tie"), "tie").select(F.lit(0).alias("kind"), F.col("tie").alias("key"), none.alias("i"), none.alias("j"), none.alias("block"), "doc_id", "component")
    if choice.isEmpty():
        return fits

    columns = ["doc_id", "component", "cost"]
    groups = docs.join(choice.where("as_whole"), "tie").select(F.lit(0).alias("kind"), F.col("tie").alias("key"), *columns)
    groups = groups.unionByName(open_.join(choice.where("not as_whole"), "tie").select(F.lit(1).alias("kind"), F.col("region").alias("key"), *columns))
    order = ["kind", "key", "component", "cost", "doc_id"]
    cut = scratch.write(ranked(groups, scratch, order, order[:2], "cost").select("kind", "key", *columns, F.expr(f"before_value div {BLOCK_SHINGLES}").alias("block")))
    size = F.col("cost") - DOC_COST
    stats = cut.groupBy("kind", "key", "block").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min(size).alias("short"), F.max(size).alias("long"))
    x, y = (stats.select("kind", "key", *[F.col(n).alias(f"{n}_{c}") for n in ("block", "least", "most", "short", "long")]) for c in "xy")
    met = x.join(y, ["kind", "key"]).where(
        (F.col("block_x") <= F.col("block_y")) & (F.least("least_x", "least_y") < F.greatest("most_x", "most_y"))
        & (F.col("long_x") * 100 >= F.col("short_y") * percent) & (F.col("long_y") * 100 >= F.col("short_x") * percent)
    )
    met = met.select("kind", "key", F.col("block_x").alias("i"), F.col("block_y").alias("j"), F.explode(F.array_distinct(F.array("block_x", "block_y"))).alias("block"))
    return fits.unionByName(cut.join(met, ["kind", "key", "block"]).select(*_JOB, "block", "doc_id", "component"))


#: Cells of the matrix of common shingles that are judged at once, columns that are multiplied at once, and pairs that
#: rare shingles add at once.
_CELLS, _COLUMNS, _RARE = 1 << 21, 1 << 11, 1 << 21


def common_counts(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
    """How many values each set of x shares with each of y (of x, if None): by matrix product for values that many sets
    hold, by listing their holders for the others."""
    n, sets = len(x), [*x, *(y or [])]
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    order = np.argsort(values, kind="stable")
    values, doc = values[order], doc[order]
    new = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    many = np.bincount(column) if len(column) else np.zeros(0, np.int64)
    left = np.bincount(column[doc < n], minlength=len(many)) if y is not None else many
    right = many - left if y is not None else many
    shared = (many > 1) & (left > 0) & (right > 0)
    width = len(sets) - n if y is not None else n
    out = np.zeros((n, width), np.float32)
    often = shared & (many > max(8, len(sets) // 12))
    place = np.cumsum(often) - 1
    at = often[column]
    rows, columns = doc[at], place[column[at]]
    for low in range(0, int(often.sum()), _COLUMNS):
        a, b = np.searchsorted(columns, (low, low + _COLUMNS))
        part = np.zeros((len(sets), min(_COLUMNS, int(columns[b - 1]) - low + 1)), np.float32)
        part[rows[a:b], columns[a:b] - low] = 1
        out += part[:n] @ (part[n:] if y is not None else part).T
    # Rare values: every holder on the left with every holder on the right.
    rare = np.flatnonzero(shared & ~often)
    first = np.concatenate(([0], np.cumsum(many)))
    ends = np.cumsum(left[rare] * right[rare])
    at = 0
    while at < len(rare):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _RARE)))
        some = rare[at:stop]
        m, l, r = many[some], left[some], right[some]
        pairs = l * r
        of = np.repeat(np.arange(len(some)), pairs)
        inside = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        base = first[some][of]
        u, v = doc[base + inside // r[of]], doc[base + (m - r)[of] + inside % r[of]]
        np.add.at(out, (u, v - (n if y is not None else 0)), 1)
        at = stop
    return out


def joined_components(sets: list[np.ndarray], component: np.ndarray, block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of components that links between the documents of a job join, as few as join them all."""
    cut = int(np.searchsorted(block, block[-1])) if len(block) else 0  # blocks are in order: one, or two that meet
    x, y = (sets[:cut], sets[cut:]) if cut else (sets, None)
    common = common_counts(x, y)
    n_x = np.array([len(s) for s in x], np.int64)
    n_y = np.array([len(s) for s in y], np.int64) if cut else n_x
    ids, label = np.unique(component, return_inverse=True)
    parent = np.arange(len(ids))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    step = max(1, _CELLS // max(1, len(n_y)))
    for at in range(0, len(n_x), step):
        top = parent[label]
        top_x, top_y = (top[:cut], top[cut:]) if cut else (top, top)
        linked = (100 + percent) * common[at : at + step].astype(np.int64) >= percent * (n_x[at : at + step, None] + n_y[None, :])
        linked &= top_x[at : at + step, None] != top_y[None, :]
        u, v = np.nonzero(linked)
        for a, b in np.unique(np.stack((top_x[at + u], top_y[v]), 1), axis=0).tolist():
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[a]), int(ids[b])))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return out


def _joined(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of components (a, b) that the jobs of a sorted part join."""

    def settled() -> pa.RecordBatch:
        pairs = joined_components(sets, np.array(component, np.int64), np.array(block, np.int64), percent)
        return pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], pa.int64()) for c in (0, 1)], names=["a", "b"])

    now, sets, component, block = None, [], [], []
    for batch in batches:
        for *job, b, c, s in zip(*(batch.column(n).to_pylist() for n in (*_JOB, "block", "component", "shingles")), strict=True):
            if job != now:
                if len(set(component)) > 1:
                    yield settled()
                now, sets, component, block = job, [], [], []
            sets.append(np.frombuffer(s, U64)), component.append(c), block.append(b)
    if len(set(component)) > 1:
        yield settled()


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle=3, percent=85)
