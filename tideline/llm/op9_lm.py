"""A hierarchical Pitman-Yor language model over words, seated by Gibbs sampling.

Restaurants: one for each previous word (by its 64-bit hash), all of which share the unigram restaurant as their parent;
its parent is uniform over the vocabulary and one unknown word. A dish's customers in the unigram restaurant are its
tables in the context restaurants.

The corpus is dealt by word: a word's bucket holds its counts in every context, hence all its unigram customers. Words
that make up more than a set share of all tokens are hot: their pairs (previous word, word) are dealt by pair, so that
they are spread over all buckets. The number of hot words is bounded by that share, and so is what the driver keeps of
them: their customers and tables in the unigram restaurant, summed over the buckets; it draws those tables. Of a
context, a bucket knows the totals (customers, tables) only: after a sweep every bucket sends its share of them by part
of the contexts, where they are added up, and is sent back those of its own contexts; they are written and joined by
bucket, and the driver sees counts over all restaurants.

A sweep draws, in every bucket, the tables of each pair from their conditional distribution given the totals of the
sweep before: exactly, by generalised Stirling numbers, up to EXACT customers, and beyond by seating in batches. A sweep
is replayed from its seed and the totals instead of being stored. Predictive probabilities are averaged over the sweeps
after the burn-in.
"""

from __future__ import annotations

import ctypes
import math
import zlib
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm._dist import Scratch, bytes_of
from tideline.llm._text import U64, Block, blocks, by_key, mix

#: Customers of a dish up to which its tables are drawn exactly.
EXACT = 32
_END = U64(0x9D8F3B1C5E7A6421)
#: Bits of a context's hash: of 10 million contexts no two are expected to be one, of a billion some two thousand pairs.
CONTEXT_BITS = 48


#: Bytes of the input, by Catalyst's estimate, that a bucket holds, whatever the input's size; buckets at least.
BUCKET_BYTES, LEAST_BUCKETS = 2_500_000, 32
#: Elements of an array that `seat` works on at once.
SEAT_CELLS = 250_000


#: A word is hot that would fill half a bucket, or that has a share of all tokens of 1 / (2 * MOST_HOT) where that is more.
MOST_HOT = 1 << 16


@dataclass
class Totals:
    """Of one sweep: tables of all context restaurants, and of the unigram restaurant; its customers and tables of hot words."""

    tables: int
    top_tables: int
    hot_customers: np.ndarray
    hot_tables: np.ndarray


@dataclass
class Model:
    train_tokens: int
    vocabulary: int
    discount: float
    top_discount: float
    strength: float
    seed: int
    sweeps: list[Totals]
    #: Training tokens of each hot word.
    hot_count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def bucket_count(size: int) -> int:
    """Buckets of an input of so many bytes: no power of two, so that none is twice as large as another input's."""
    return max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))


def _give_back() -> None:
    """Hand freed memory to the system: a worker keeps all that it ever held otherwise, beside the JVM and other tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def _singly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a row each: rows are large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def held_out(doc_id: int, fold: int = 2, folds: int = 7) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def _tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, context (CONTEXT_BITS of the hash of the word before) and document of each token; every document ends in one end token, which is also its first context."""
    words = block.words(lower=True)
    n = len(block.ids)
    doc = np.concatenate((words.doc(), np.arange(n)))
    order = np.argsort(doc, kind="stable")
    doc, h = doc[order], np.concatenate((words.hash, np.full(n, _END)))[order]
    before = np.concatenate(([_END], h[:-1])) >> U64(64 - CONTEXT_BITS)
    return h, before, doc


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes each as hold them all."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    """The n numbers that `_small` has packed."""
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(n, -1)
    return out.reshape(-1).view(np.int64)


def _common(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Words with a share of 1 / (2 * most) of a block's tokens, and (word 0) all of its tokens."""
    for batch in batches:
        for block in blocks(batch):
            h = _tokens(block)[0]
            total = len(h)
            # Only words in cells that are full enough can be common; few are left to be counted one by one.
            cell = (h >> U64(48)).astype(np.int64)
            h = h[(2 * most * np.bincount(cell, minlength=1 << 16) >= total)[cell]]
            words, n = np.unique(h, return_counts=True)
            some = 2 * most * n >= total
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((words[some].view(np.int64), [0]))), pa.array(np.concatenate((n[some], [total])).astype(np.int64))], names=["word", "n"])


def hot_words(docs: DataFrame, buckets: int, scratch: Scratch) -> np.ndarray:
    """Hashes, sorted, of the words that are hot; twice as many as the share allows at most. A word with the whole share
    has half of it in blocks where it is common, so that counts from there find all."""
    most = min(MOST_HOT, max(1, buckets // 2))
    counts = scratch.write(docs.mapInArrow(lambda it: _common(it, most), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.where("word = 0").first()
    rows = counts.where((F.col("word") != 0) & (2 * most * F.col("n") >= total["n"])).collect() if total else []
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(U64))


_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("n_pairs", pa.int64()), *((c, pa.binary()) for c in ("w", "pairs", "u", "inc", "doc", "times", "docs"))])
_SENT_DDL = "bucket int, block long, kind int, n long, n_pairs long, w binary, pairs binary, u binary, inc binary, doc binary, times binary, docs binary"


def _send(batches: Iterator[pa.RecordBatch], n: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each block and bucket: distinct words, their contexts, and for each of those the documents it occurs in, with
    how often."""
    part, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        for block in blocks(batch):
            uid, count = (part << 32) | count, count + 1
            h, u, doc = _tokens(block)
            train = np.array([not held_out(i) for i in block.ids.tolist()])
            ids = np.stack((block.ids, np.bincount(doc, minlength=len(block.ids)), train), 1).astype(np.int64)
            rows: list[dict] = [{"bucket": uid % n, "block": uid, "kind": 0, "docs": ids.tobytes()}]
            to = (np.where(np.isin(h, hot), mix(h ^ mix(u + U64(0x632BE59BD9B4E019))), h) >> U64(40)).astype(np.int64) % n
            order = np.lexsort((doc, u, h, to))
            h, u, doc, to = h[order], u[order], doc[order], to[order]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (u[1:] != u[:-1]) | (doc[1:] != doc[:-1]))))
            times = np.diff(np.concatenate((first, [len(h)])))
            for bucket, (hh, uu, dd, tt) in by_key(to[first], h[first], u[first], doc[first], times):
                new_w = np.concatenate(([True], hh[1:] != hh[:-1]))
                pair = np.flatnonzero(new_w | np.concatenate(([True], uu[1:] != uu[:-1])))
                per_word = np.bincount((np.cumsum(new_w) - 1)[pair])
                inc = np.diff(np.concatenate((pair, [len(hh)])))
                rows.append({"bucket": bucket, "block": uid, "kind": 1, "w": hh[new_w].tobytes(), "pairs": _small(per_word), "u": _small(uu[pair]), "n_pairs": len(pair), "inc": _small(inc), "doc": _small(dd), "times": _small(tt), "docs": train.astype(np.int8).tobytes(), "n": len(dd)})
            yield pa.RecordBatch.from_pylist(rows, schema=_SENT)


_MERGED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.int64()) for c in ("n", "n_pairs", "n_contexts", "n_docs")), *((c, pa.binary()) for c in ("hot", "pairs", "contexts", "u", "c", "inc", "doc", "times", "blocks", "docs"))])
_MERGED_DDL = "bucket int, kind int, n long, n_pairs long, n_contexts long, n_docs long, hot binary, pairs binary, contexts binary, u binary, c binary, inc binary, doc binary, times binary, blocks binary, docs binary"


def _merge(table: pa.Table, hot: np.ndarray) -> pa.Table:
    """A bucket's blocks as one: words in the order of their hash (`hot`: the place among hot words from 1, or 0), their contexts
    (as places in the sorted `contexts`) with training counts, and where they occur. Rows of blocks pass."""
    kind = np.asarray(table.column("kind"))
    bucket = table.column("bucket")[0].as_py()
    out = [{"bucket": bucket, "kind": 0, "blocks": np.array([row["block"]], np.int64).tobytes(), "docs": row["docs"]} for row in table.filter(pa.array(kind == 0)).to_pylist()]
    at = np.flatnonzero(kind == 1)
    if len(at):
        out.append({"bucket": bucket, "kind": 1, **_body(table, at, hot)})
    merged = pa.Table.from_pylist(out, schema=_MERGED)
    del out
    _give_back()
    return merged


def _body(table: pa.Table, rows: np.ndarray, hot: np.ndarray) -> dict:
    """The given rows of a bucket as one; values are read in place, and arrays are dropped once they are used."""
    uids = np.asarray(table.column("block"))[rows]
    rows, uids = rows[np.argsort(uids)], np.sort(uids)
    raw = lambda name: [table.column(name)[i].as_buffer() for i in rows.tolist()]
    n, n_pairs = (np.asarray(table.column(name).fill_null(0))[rows].tolist() for name in ("n", "n_pairs"))
    train, w = [np.frombuffer(x, np.int8) for x in raw("docs")], [np.frombuffer(x, U64) for x in raw("w")]
    base = np.concatenate(([0], np.cumsum([len(x) for x in train])))
    place = np.int32 if max(sum(n), base[-1]) < 2**31 else np.int64
    narrow = lambda name, sizes, kind: np.concatenate([_wide(x, k).astype(kind) for x, k in zip(raw(name), sizes, strict=True)])
    doc = np.concatenate([(_wide(x, k) + b).astype(place) for x, k, b in zip(raw("doc"), n, base[:-1], strict=True)])
    times, inc = narrow("times", n, place), narrow("inc", n_pairs, place)
    h = np.repeat(np.concatenate(w), narrow("pairs", map(len, w), place))
    u = narrow("u", n_pairs, np.int64)
    order = np.lexsort((u, h))
    h, u, size = h[order], u[order], inc[order]
    start = np.concatenate(([0], np.cumsum(inc, dtype=np.int64)))[:-1][order]
    del order, inc
    cuts = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    at = np.repeat((start - cuts[:-1]).astype(place), size)
    at += np.arange(cuts[-1], dtype=place)
    doc, times = doc[at], times[at]
    del at, start
    new_w = np.concatenate(([True], h[1:] != h[:-1]))
    first = np.flatnonzero(new_w | np.concatenate(([True], u[1:] != u[:-1])))
    words, u = h[new_w], u[first]
    del h
    c = np.add.reduceat(np.concatenate(train)[doc] * times, cuts[:-1][first], dtype=np.int64)
    pairs = np.bincount((np.cumsum(new_w) - 1)[first])
    inc = np.add.reduceat(size, first, dtype=np.int64)
    del new_w, first, size, cuts
    contexts, u = np.unique(u, return_inverse=True)
    where = np.minimum(np.searchsorted(hot, words), max(0, len(hot) - 1))
    is_hot = hot[where] == words if len(hot) else np.zeros(len(words), bool)
    return {
        "hot": _small(np.where(is_hot, where + 1, 0)), "pairs": _small(pairs), "n": len(words), "n_pairs": len(u), "n_contexts": len(contexts), "n_docs": len(doc), "contexts": _small(contexts), "u": _small(u), "c": _small(c),
        "inc": _small(inc), "doc": _small(doc), "times": _small(times), "blocks": np.stack((uids, np.diff(base)), 1).astype(np.int64).tobytes(),
    }


def stirling(discount: float, n: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t): ways to seat c customers at t tables, weighted by discounted sizes."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0
    for c in range(n):
        for t in range(c + 1):
            if s[c, t] > -np.inf:
                s[c + 1, t + 1] = np.logaddexp(s[c + 1, t + 1], s[c, t])
                if t and c - discount * t > 0:
                    s[c + 1, t] = np.logaddexp(s[c + 1, t], s[c, t] + math.log(c - discount * t))
    return s


def seat(c: np.ndarray, tables: np.ndarray, base: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers each, given the restaurant's tables and the parent's probability of the dish."""
    out = np.minimum(c, 1).astype(np.int64)
    log_s = stirling(discount)
    log_base = np.log(base)
    for n in range(2, EXACT + 1):
        at = np.flatnonzero(c == n)
        for at in np.array_split(at, max(1, -(-len(at) * n // SEAT_CELLS))):
            if len(at):
                steps = np.log(strength + discount * (tables[at, None] + np.arange(n)))
                log_w = np.cumsum(steps + log_base[at, None], 1) + log_s[n, 1 : n + 1]
                w = np.cumsum(np.exp(log_w - log_w.max(1, keepdims=True)), 1)
                out[at] = 1 + (w < rng.random(len(at))[:, None] * w[:, -1:]).sum(1)
    at = np.flatnonzero(c > EXACT)
    if len(at):
        big, t, done = c[at].astype(np.int64), np.ones(len(at), np.int64), np.ones(len(at), np.int64)
        while (done < big).any():
            batch = np.minimum(big - done, np.maximum(1, done // 16))
            fresh = (strength + discount * (tables[at] + t)) * base[at]
            t += rng.binomial(batch, np.clip(fresh / (fresh + done - discount * t), 0, 1))
            done += batch
        out[at] = np.minimum(t, big)
    return out


class Bucket:
    """The words of one bucket, with the sweeps replayed over them."""

    def __init__(self, row: dict):
        self.bucket = row["bucket"]
        self.contexts = _wide(row["contexts"], row["n_contexts"])
        # Of each sweep so far the tables, and the customers, of the bucket's contexts; parts are in the order of contexts.
        known: dict[int, list[dict]] = {}
        for x in sorted(row.get("totals") or [], key=lambda x: (x["sweep"], x["part"])):
            known.setdefault(x["sweep"], []).append(x)
        joined = lambda sweep, name: np.concatenate([_wide(x[name], x["n"]) for x in known.get(sweep, [])] or [np.zeros(0, np.int64)])
        self.tables, self.customers = [joined(k, "tables") for k in sorted(known)], joined(0, "customers")
        self.u, self.c = _wide(row["u"], row["n_pairs"]), _wide(row["c"], row["n_pairs"])
        self.pairs, self.hot = _wide(row["pairs"], row["n"]), _wide(row["hot"], row["n"]) - 1
        self.word = np.repeat(np.arange(len(self.pairs)), self.pairs)
        # Hot words and those that are the bucket's own.
        self.far, self.near = np.flatnonzero(self.hot >= 0), self.hot < 0

    def by_word(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, x, len(self.pairs)).astype(np.int64)

    def count(self, model: Model) -> np.ndarray:
        """Training tokens of each word."""
        out = self.by_word(self.c)
        if len(self.far):
            out[self.far] = model.hot_count[self.hot[self.far]]
        return out

    def replay(self, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Tables by pair, unigram tables by word (of its own words), and the unigram probability by word, null after the
        last sweep whose totals are known."""
        t = np.minimum(self.c, 1)
        top_t = np.minimum(self.by_word(self.c), 1)
        uniform = np.full(len(self.pairs), 1 / (model.vocabulary + 1))
        d, s = model.top_discount, model.strength
        for k, totals in enumerate(model.sweeps):
            rng = np.random.Generator(np.random.PCG64([model.seed, k, self.bucket]))
            customers, tables = self.by_word(t), top_t.copy()
            customers[self.far], tables[self.far] = totals.hot_customers[self.hot[self.far]], totals.hot_tables[self.hot[self.far]]
            p = (np.maximum(customers - d * tables, 0) + (s + d * totals.top_tables) * uniform) / (s + totals.tables)
            yield t, top_t, p
            t = seat(self.c, np.maximum(self.tables[k][self.u] - t, 0), p[self.word], model.discount, model.strength, rng)
            top_t = seat(np.where(self.near, self.by_word(t), 0), np.maximum(totals.top_tables - top_t, 0), uniform, d, s, rng)
        yield t, top_t, None

    def probability(self, model: Model, t: np.ndarray, p: np.ndarray, sweep: int) -> np.ndarray:
        """Of each pair's word after its context."""
        d, s = model.discount, model.strength
        return (np.maximum(self.c - d * t, 0) + (s + d * self.tables[sweep][self.u]) * p[self.word]) / (s + self.customers[self.u])


#: kind 0, a bucket's contexts by part: customers, tables. kind 1, the hot words by part, summed over a task's buckets:
#: customers, tokens (as tables). kind 2, counts over all: tokens, words, tables, unigram tables, pairs with one customer
#: and with two, words likewise.
_COUNTS = [f"m{i}" for i in range(8)]
_SUMS_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), *((c, pa.binary()) for c in ("contexts", "customers", "tables")), *((m, pa.int64()) for m in _COUNTS)])
_SUMS = "kind int, part int, bucket int, n long, contexts binary, customers binary, tables binary, " + ", ".join(f"{m} long" for m in _COUNTS)
#: Hot words of a part.
_HOT_PART = 4096


def _totals(batches: Iterator[pa.RecordBatch], model: Model, parts: int, n_hot: int) -> Iterator[pa.RecordBatch]:
    """A bucket's share of the totals of contexts, by part (their high bits); of a task's buckets those of hot words, and counts."""
    edges = np.arange(1, parts, dtype=np.int64) << (CONTEXT_BITS - (parts.bit_length() - 1))
    first = not model.sweeps
    hot, counts = np.zeros((2, n_hot), np.int64), np.zeros(len(_COUNTS), np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            b = Bucket(row)
            for t, top_t, _ in b.replay(model):
                pass
            add = lambda x: np.bincount(b.u, x, len(b.contexts)).astype(np.int64)  # noqa: B023, E731
            count, top, near = b.by_word(b.c), b.by_word(t), b.near
            counts += [count[near].sum(), (count[near] > 0).sum(), t.sum(), top_t[near].sum(), (b.c == 1).sum(), (b.c == 2).sum(), (top[near] == 1).sum(), (top[near] == 2).sum()]
            hot[0, b.hot[b.far]] += top[b.far]
            hot[1, b.hot[b.far]] += count[b.far]
            sums = {"tables": add(t), **({"customers": add(b.c)} if first else {})}
            cuts = [0, *np.searchsorted(b.contexts, edges).tolist(), len(b.contexts)]
            rows: list[dict] = []
            for part, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if i < j:
                    rows.append({"kind": 0, "part": part, "bucket": b.bucket, "n": j - i, "contexts": _small(b.contexts[i:j]), **{c: _small(x[i:j]) for c, x in sums.items()}})
            yield pa.RecordBatch.from_pylist(rows, schema=_SUMS_SCHEMA)
            del b, t, top_t, top, count, near, sums, rows
            _give_back()
    rows = [{"kind": 2, "part": 0, "bucket": -1, **{m: int(x) for m, x in zip(_COUNTS, counts, strict=True)}}]
    rows += [{"kind": 1, "part": i // _HOT_PART, "bucket": -1, "customers": hot[0, i : i + _HOT_PART].tobytes(), "tables": hot[1, i : i + _HOT_PART].tobytes()} for i in range(0, n_hot, _HOT_PART)]
    yield pa.RecordBatch.from_pylist(rows, schema=_SUMS_SCHEMA)


def _add(table: pa.Table) -> pa.Table:
    """The sums of a part over all buckets; of contexts, for each bucket those of its own."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    if kind == 2:
        return pa.Table.from_pylist([{"kind": 2, "part": part, "bucket": -1, **{m: sum(table.column(m).to_pylist()) for m in _COUNTS}}], schema=_SUMS_SCHEMA)
    read = lambda name, as_type: [np.frombuffer(x or b"", as_type) for x in table.column(name).to_pylist()]
    if kind == 1:
        return pa.Table.from_pylist([{"kind": 1, "part": part, "bucket": -1, **{c: np.sum(read(c, np.int64), axis=0).tobytes() for c in ("customers", "tables")}}], schema=_SUMS_SCHEMA)
    n = table.column("n").to_pylist()
    place = np.unique(np.concatenate([_wide(x, k) for x, k in zip(table.column("contexts").to_pylist(), n, strict=True)]), return_inverse=True)[1]
    rows: list[dict] = [{"kind": 0, "part": part, "bucket": b, "n": k} for b, k in zip(table.column("bucket").to_pylist(), n, strict=True)]
    for name in ("customers", "tables"):
        given = table.column(name).to_pylist()
        if given[0] is not None:
            given = np.concatenate([_wide(x, k) for x, k in zip(given, n, strict=True)])
            for row, x in zip(rows, np.split(np.bincount(place, given).astype(np.int64)[place], np.cumsum(n)[:-1]), strict=True):
                row[name] = _small(x)
    return pa.Table.from_pylist(rows, schema=_SUMS_SCHEMA)


def _with_totals(body: DataFrame, written: list[DataFrame]) -> DataFrame:
    """Buckets with the totals of their contexts in each sweep so far."""
    if not written:
        return body
    rows = [x.where("kind = 0").select("bucket", F.struct(F.lit(k).alias("sweep"), "part", "n", "customers", "tables").alias("one")) for k, x in enumerate(written)]
    totals = reduce(DataFrame.unionByName, rows).groupBy("bucket").agg(F.collect_list("one").alias("totals"))
    return body.join(totals.hint("merge"), "bucket", "left")


def advanced(model: Model, rows: list[dict], n_hot: int) -> None:
    """The model after a sweep, from the summed rows of hot words and of counts; draws the tables of hot words."""
    counts = next((r for r in rows if r["kind"] == 2), None)
    tokens, words, tables, top_tables, *seen = [counts[m] if counts else 0 for m in _COUNTS]
    some = sorted((r for r in rows if r["kind"] == 1), key=lambda r: r["part"])
    customers, count = (np.frombuffer(b"".join(r[c] for r in some), np.int64) if some else np.zeros(n_hot, np.int64) for c in ("customers", "tables"))
    if model.sweeps:
        rng = np.random.Generator(np.random.PCG64([model.seed, len(model.sweeps), 2**31]))
        last = model.sweeps[-1]
        hot_tables = seat(customers, np.maximum(last.top_tables - last.hot_tables, 0), np.full(n_hot, 1 / (model.vocabulary + 1)), model.top_discount, model.strength, rng)
    else:
        hot_tables = np.minimum(customers, 1)
        model.hot_count, model.train_tokens, model.vocabulary = count, tokens + int(count.sum()), words + int((count > 0).sum())
        # Discounts from counts of counts, as for absolute discounting.
        ones, twos = (seen[2 + i] + int((customers == i + 1).sum()) for i in (0, 1))
        model.discount, model.top_discount = (float(np.clip(one / max(1, one + 2 * two), 0.05, 0.95)) for one, two in (seen[:2], (ones, twos)))
    model.sweeps.append(Totals(tables, top_tables + int(hot_tables.sum()), customers, hot_tables))


def train(merged: DataFrame, n: int, n_hot: int, sweeps: int, strength: float, seed: int, scratch: Scratch) -> tuple[Model, list[DataFrame]]:
    """The model's counts over all, and the written totals of each sweep."""
    body = merged.where("kind = 1").select("bucket", "n", "n_pairs", "n_contexts", "hot", "pairs", "contexts", "u", "c")
    model, written = Model(0, 0, 0.5, 0.5, strength, seed, []), []
    for _ in range(sweeps + 1):
        sums = _with_totals(body, written).mapInArrow(lambda it: _totals(_singly(it), model, 1 << max(0, n.bit_length() - 2), n_hot), _SUMS)
        written.append(scratch.write(sums.repartition(n, "kind", "part").groupBy("kind", "part").applyInArrow(_add, _SUMS).drop("contexts")))
        # A row of counts, and one for each part of the hot words, whose number is bounded.
        advanced(model, [r.asDict() for r in written[-1].where("kind > 0").collect()], n_hot)
    return model, written


def _score(batches: Iterator[pa.RecordBatch], model: Model, burn_in: int) -> Iterator[pa.RecordBatch]:
    """For each bucket and block: documents (by place in the block) with their sums over the bucket's tokens."""
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                yield pa.RecordBatch.from_pydict({"block": np.frombuffer(row["blocks"], np.int64), "n": pa.array([0], pa.int64()), "place": pa.array([None], pa.binary()), "sums": pa.array([None], pa.binary()), "docs": pa.array([row["docs"]], pa.binary())})
            else:
                yield _scored(row, model, burn_in)
            _give_back()


def _scored(row: dict, model: Model, burn_in: int) -> pa.RecordBatch:
    """Of a bucket's blocks; only documents that the bucket holds take memory."""
    b = Bucket(row)
    mean, n, last = np.zeros(len(b.c)), 0, len(model.sweeps) - 1
    for k, (t, _, p) in enumerate(b.replay(model)):
        if k > burn_in or k == last:
            mean, n = mean + b.probability(model, t, p, k), n + 1
        if k == last:
            break
    count = b.count(model)
    base = np.log10((count + 1) / (model.train_tokens + model.vocabulary + 1))
    each = (np.log10(mean / n), base[b.word], (count > 0)[b.word].astype(float))
    inc, n_docs = _wide(row["inc"], len(b.u)), row["n_docs"]
    info = np.frombuffer(row["blocks"], np.int64).reshape(-1, 2)
    del b, t, p, mean, count, base
    times = _wide(row["times"], n_docs)
    doc, at = np.unique(_wide(row["doc"], n_docs), return_inverse=True)
    sums = [np.bincount(at, np.repeat(x, inc) * times, len(doc)) for x in each]
    edges = np.concatenate(([0], np.cumsum(info[:, 1])))
    cuts = np.searchsorted(doc, edges)
    places, packed = [], []
    for edge, i, j in zip(edges.tolist(), cuts.tolist(), cuts[1:].tolist()):
        places.append(_small(doc[i:j] - edge))
        packed.append(sums[0][i:j].astype(np.float32).tobytes() + sums[1][i:j].tobytes() + _small(np.rint(sums[2][i:j]).astype(np.int64)))
    return pa.RecordBatch.from_pydict({"block": np.ascontiguousarray(info[:, 0]), "n": pa.array(np.diff(cuts), pa.int64()), "place": pa.array(places, pa.binary()), "sums": pa.array(packed, pa.binary()), "docs": pa.nulls(len(info), pa.binary())})


def _finish(table: pa.Table) -> pa.Table:
    docs = next(x for x in table.column("docs").to_pylist() if x is not None)
    docs = np.frombuffer(docs, np.int64).reshape(-1, 3)
    sums = np.zeros((len(docs), 3))
    for place, part, n in zip(*(table.column(c).to_pylist() for c in ("place", "sums", "n")), strict=True):
        if place is None:
            continue
        at = _wide(place, n)
        sums[at, 0] += np.frombuffer(part[: 4 * n], np.float32)
        sums[at, 1] += np.frombuffer(part[4 * n : 12 * n], float)
        sums[at, 2] += _wide(part[12 * n :], n)
    return pa.table({"doc_id": docs[:, 0], "held_out": docs[:, 2] == 0, "n_tokens": docs[:, 1], "n_known": np.rint(sums[:, 2]).astype(np.int64), "base_score": sums[:, 1], "score": sums[:, 0]})


def score(docs: DataFrame, sweeps: int = 3, burn_in: int = 1, strength: float = 1.0, seed: int = 9, scratch: Scratch | None = None) -> DataFrame:
    """Score every document with a model learnt from those that are not held out.

    Takes doc_id and text; other columns are not looked at. Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigram), score (log10 probability of the text) and perplexity (by token).
    Null and empty texts are one end token. Repeated rows are learnt from, and scored, each time; rows without a doc_id
    are left out. With nothing to learn from, every token has the probability 1. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    n = bucket_count(bytes_of(docs))
    hot = hot_words(docs, n, scratch)
    merged = scratch.write(docs.mapInArrow(lambda it: _send(it, n, hot), _SENT_DDL).repartition(n, "bucket").groupBy("bucket").applyInArrow(lambda t: _merge(t, hot), _MERGED_DDL))
    model, written = train(merged, n, len(hot), sweeps, strength, seed, scratch)
    columns = ["bucket", "kind", "n", "n_pairs", "n_contexts", "n_docs", "hot", "pairs", "contexts", "u", "c", "inc", "doc", "times", "blocks", "docs"]
    scored = lambda rows: rows.mapInArrow(lambda it: _score(_singly(it), model, burn_in), "block long, n long, place binary, sums binary, docs binary")
    parts = scored(merged.where("kind = 0").select(*columns)).unionByName(scored(_with_totals(merged.where("kind = 1").select(*columns), written)))
    out = parts.repartition(n, "block").groupBy("block").applyInArrow(_finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", F.expr("power(10, -score / n_tokens)").alias("perplexity"))


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
