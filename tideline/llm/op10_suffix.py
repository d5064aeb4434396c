"""Suffix-array de-duplication: longest-previous-factor arrays over the parts of a corpus that repeat at all.

A byte goes when a string of `length` bytes around it also starts earlier in the corpus. A string starts earlier
exactly where the longest previous factor (LPF) at its start reaches `length`; it is the longer of the prefixes that a
suffix shares with the previous and with the next suffix in suffix order that begin at a smaller position.

One suffix array over a corpus does not fit a cluster's tasks, so suffixes are dealt by content. Each string of
`length` bytes picks its smallest `gram`-byte hash (a minimizer, the leftmost of equals); equal strings pick equal
minimizers at equal places, so a task that holds every fragment around a minimizer sees all copies of its strings, and
the LPF of its suffixes, as far as `length`, is that of the corpus.
First only hashes are dealt: a minimizer that occurs once cannot repeat a string, and of identical fragments all but
the earliest repeat wholly. Only different fragments around one minimizer, where copies begin to differ, then travel
as bytes; suffix order, previous and next smaller positions and LPF are made of them. A minimizer with many different
fragments (a line that many texts share) is dealt once more by the bytes beside it: a string that begins early in its
fragment by those before the minimizer, one that begins late by those after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm._dist import Scratch, deal
from tideline.llm._text import U64, Block, blocks, by_key, covered, ints, mix, runs

#: Different fragments of one minimizer beyond which they are dealt by the bytes beside it.
HOT = 1024
#: Low bits of the key that orders minimizers; they hold the position, so that the leftmost of equals wins.
_PLACE = U64(31)


def suffix_ranks(text: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(k, rank of each suffix by its first k bytes) for k = 1, 2, 4 ... and `length`, by prefix doubling; equal prefixes
    share a rank. Suffixes that are shorter rank as if followed by bytes below all others."""
    padded = np.concatenate((text.astype(np.int64) + 1, np.zeros(length, np.int64)))
    rank, have, out = padded, 1, [(1, padded.astype(np.int32))]
    while have < length:
        step = min(have, length - have)
        low = np.zeros_like(rank)
        low[: len(rank) - step] = rank[step:]
        rank = np.unique(rank * (int(rank.max()) + 1) + low, return_inverse=True)[1].astype(np.int64)
        have += step
        out.append((have, rank.astype(np.int32)))
    return out


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each of different values the place of the nearest smaller one before it, or -1, by jumping over larger ones."""
    out = np.arange(len(x)) - 1
    todo = np.flatnonzero((out >= 0) & (x[out] > x))
    while len(todo):
        out[todo] = out[out[todo]]
        todo = todo[(out[todo] >= 0) & (x[out[todo]] > x[todo])]
    return out


def common_prefix(ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, as far as ranks reach."""
    out = np.zeros(len(a), np.int64)
    most = ranks[-1][0]
    whole = ranks[-1][1][a] == ranks[-1][1][b]
    for k, rank in reversed(ranks[:-1]):
        same = ~whole & (out + k <= most)
        at = np.flatnonzero(same)
        at = at[rank[a[at] + out[at]] == rank[b[at] + out[at]]]
        out[at] += k
    return np.where(whole, most, out)


def longest_previous_factors(ranks: list[tuple[int, np.ndarray]], starts: np.ndarray) -> np.ndarray:
    """The LPF, as far as ranks reach, of the suffixes at `starts`, which are given in the order of their positions in the corpus."""
    order = np.lexsort((np.arange(len(starts)), ranks[-1][1][starts]))
    back = previous_smaller(order)
    ahead = len(order) - 1 - previous_smaller(order[::-1])[::-1]
    out = np.zeros(len(starts), np.int64)
    for near, there in ((back, back >= 0), (ahead, ahead < len(order))):
        at = np.flatnonzero(there)
        mine = order[at]
        out[mine] = np.maximum(out[mine], common_prefix(ranks, starts[mine], starts[order[near[at]]]))
    return out


def _minimizers(block: Block, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, place, first start and number of starts of each minimizer of the block's documents, in buffer positions."""
    n = len(block.buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(U64), none, none, none
    at = np.arange(n - gram + 1)
    h = block.rolling_bytes().hash(at, at + gram)
    key = (h >> _PLACE << _PLACE) | at.astype(U64)
    span = length - gram + 1
    have, least = 1, key
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    place = (least & ((U64(1) << _PLACE) - U64(1))).astype(np.int64)
    starts = np.arange(len(place))
    inside = np.repeat(block.offs[1:], np.diff(block.offs))[: len(place)] - starts >= length
    starts, place = starts[inside], place[inside]
    if not len(starts):
        return none.astype(U64), none, none, none
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (np.diff(starts) != 1))))
    return h[place[new]], place[new], starts[new], np.diff(np.concatenate((new, [len(starts)])))


def _earliest(f: np.ndarray, d: np.ndarray, p: np.ndarray) -> np.ndarray:
    """True for the earliest row, by document and position, of each fragment."""
    order = np.lexsort((p, d, f))
    f = f[order]
    out = np.zeros(len(f), bool)
    out[order] = np.concatenate(([True], f[1:] != f[:-1])) if len(f) else []
    return out


def _once(h: np.ndarray, d: np.ndarray, p: np.ndarray) -> np.ndarray:
    """One row for each minimizer, document and position: a row that repeats an id and text is the same place."""
    order = np.lexsort((p, d, h))
    h, d, p = h[order], d[order], p[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1])
    return np.sort(order[new])


_FRAGMENT = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), *((c, pa.binary()) for c in ("h", "f", "d", "p", "n", "text", "s"))])
_FRAGMENT_DDL = "bucket int, key long, h binary, f binary, d binary, p binary, n binary, text binary, s binary"
_KINDS = {"h": U64, "f": U64, "d": np.int64, "p": np.int32, "n": np.int32}


def _answers(d: np.ndarray, p: np.ndarray, n: np.ndarray) -> list[dict]:
    """For each document its packed (first start, count) pairs: these starts repeat; with a count of 0, the fragment
    at that start is to be compared, with -1 too, after it is dealt by the bytes beside its minimizer."""
    return [{"key": key, "s": np.stack((pp, nn), 1).astype(np.int32).tobytes()} for key, (pp, nn) in by_key(d, p, n)]


def _pairs(parts: list[bytes] | None) -> np.ndarray:
    return ints(parts).reshape(-1, 2).astype(np.int64)


def _send_hashes(batches: Iterator[pa.RecordBatch], length: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Hashes of minimizers and of the fragments around them, one for each different fragment of a block."""
    for batch in batches:
        for block in blocks(batch):
            h, place, start, n = _minimizers(block, length, gram)
            if not len(h):
                continue
            doc = np.searchsorted(block.offs, start, "right") - 1
            d, p = block.ids[doc], start - block.offs[doc]
            f = mix(block.rolling_bytes().hash(start, start + n + length - 1) ^ mix(h + (place - start).astype(U64)))
            h, f, d, p, n = (x[_once(h, d, p)] for x in (h, f, d, p, n))
            first = _earliest(f, d, p)
            rows = [{"bucket": x["key"] % buckets, **x} for x in _answers(d[~first], p[~first], n[~first])]
            h, f, d, p, n = (x[first] for x in (h, f, d, p, n))
            for bucket, packed in by_key((h >> U64(40)).astype(np.int64) % buckets, h, f, d, p.astype(np.int32), n.astype(np.int32)):
                rows.append({"bucket": bucket, **{c: x.tobytes() for c, x in zip(_KINDS, packed, strict=True)}})
            yield pa.RecordBatch.from_pylist(rows, schema=_FRAGMENT)


def _read(table: pa.Table) -> tuple[list[dict], pa.Table]:
    """A bucket's rows: answers that are ready, and the others."""
    ready = table.filter(table.column("h").is_null()).select(["key", "s"]).to_pylist()
    return ready, table.filter(table.column("h").is_valid())


_ANSWER = pa.schema([("key", pa.int64()), ("s", pa.binary())])


def _settle_hashes(table: pa.Table) -> pa.Table:
    out, table = _read(table)
    if table.num_rows:
        h, f, d, p, n = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in _KINDS.items())
        h, f, d, p, n = (x[_once(h, d, p)] for x in (h, f, d, p, n))
        first = _earliest(f, d, p)
        out += _answers(d[~first], p[~first], n[~first])
        h, d, p = h[first], d[first], p[first]
        order = np.argsort(h, kind="stable")
        new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
        copies = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        many = order[copies > 1]
        out += _answers(d[many], p[many], -(copies[copies > 1] > HOT).astype(np.int32))
    return pa.Table.from_pylist(out, schema=_ANSWER)


def _take(offs: np.ndarray, text: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some fragments, one after the other, and their offsets."""
    size = offs[rows + 1] - offs[rows]
    cuts = np.concatenate(([0], np.cumsum(size)))
    return cuts, text[np.repeat(offs[rows] - cuts[:-1], size) + np.arange(cuts[-1])]


def _beside(block: Block, h: np.ndarray, place: np.ndarray, start: np.ndarray, n: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments cut in two, with the hash of their minimizer and of what lies before it (strings that begin early) or
    after it (late ones): hash, first start and number of starts. Equal strings are on the same side of the cut."""
    side = (length - gram) // 2
    cut = np.clip(place - side + 1, start, start + n)  # strings that begin before it hold `side` bytes before the minimizer
    early, late = cut > start, cut < start + n
    rolling = block.rolling_bytes()
    before = rolling.hash(place[early] - side, place[early] + gram)
    after = rolling.hash(place[late], place[late] + gram + (length - gram - side))
    keys = np.concatenate((mix(h[early] ^ before), mix(~h[late] ^ after)))
    return keys, np.concatenate((start[early], cut[late])), np.concatenate(((cut - start)[early], (start + n - cut)[late]))


def _send(batches: Iterator[pa.RecordBatch], length: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The fragments that are to be compared, as bytes, dealt by minimizer, and hot ones by more."""
    for batch in batches:
        hits = batch.column("known")
        for block in blocks(batch):
            h, place, start, n = _minimizers(block, length, gram)
            doc = np.searchsorted(block.offs, start, "right") - 1
            local, kind = start - block.offs[doc], np.ones(len(h), np.int64)
            cuts = np.searchsorted(doc, np.arange(len(block.ids) + 1))
            for i in range(len(block.ids)):
                pairs = _pairs(hits[block.first + i].as_py())
                for k in (0, -1):
                    some = np.isin(local[cuts[i] : cuts[i + 1]], pairs[pairs[:, 1] == k, 0])
                    kind[cuts[i] : cuts[i + 1]][some] = k
            plain, hot = kind == 0, kind == -1
            key, first, many = _beside(block, h[hot], place[hot], start[hot], n[hot], length, gram)
            h, start, n = np.concatenate((h[plain], key)), np.concatenate((start[plain], first)), np.concatenate((n[plain], many))
            if not len(h):
                continue
            doc = np.searchsorted(block.offs, start, "right") - 1
            local = start - block.offs[doc]
            rows = []
            offs, text = _gather(block.buf, start, n + length - 1)
            for bucket, (r,) in by_key((h >> U64(40)).astype(np.int64) % buckets, np.arange(len(h))):
                packed = {"h": h[r], "d": block.ids[doc[r]], "p": local[r].astype(np.int32), "n": n[r].astype(np.int32), "text": _take(offs, text, r)[1]}
                rows.append({"bucket": bucket, **{c: x.tobytes() for c, x in packed.items()}})
            yield pa.RecordBatch.from_pylist(rows, schema=_FRAGMENT)


def _gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.concatenate(([0], np.cumsum(size)))
    return cuts, buf[np.repeat(start - cuts[:-1], size) + np.arange(cuts[-1])]


#: Bytes of fragments whose suffixes are ranked at once; fragments of one minimizer stay together.
_RANK_BYTES = 2_000_000


def _settle(table: pa.Table, length: int) -> pa.Table:
    out, table = _read(table)
    if table.num_rows:
        h, d, p, n = (np.concatenate([np.frombuffer(x, _KINDS[c]) for x in table.column(c).to_pylist()]) for c in ("h", "d", "p", "n"))
        text = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("text").to_pylist()])
        offs = np.concatenate(([0], np.cumsum(n + length - 1, dtype=np.int64)))
        order = _once(h, d, p)
        order = order[np.lexsort((p[order], d[order], h[order]))]
        while len(order):
            many = int(np.searchsorted(np.cumsum(n[order] + length - 1), _RANK_BYTES)) + 1
            if many < len(order):  # to the end of the minimizer's fragments
                many += int(np.argmax(np.concatenate((h[order[many:]] != h[order[many - 1]], [True]))))
            part, order = order[:many], order[many:]
            cuts, piece = _take(offs, text, part)
            ranks = suffix_ranks(piece, length)
            of = np.repeat(np.arange(len(part)), n[part])
            inside = np.arange(len(of)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            # Starts are in the order of (minimizer, document, position); equal strings share their minimizer.
            hit = longest_previous_factors(ranks, cuts[of] + inside) >= length
            a, b = runs(hit)
            ends = np.flatnonzero(np.diff(of)) + 1
            cut = np.unique(np.concatenate((a, ends[hit[ends - 1] & hit[ends]] if len(ends) else ends)))
            stop = np.minimum(np.concatenate((cut[1:], [len(hit)])), b[np.searchsorted(b, cut, "right")]) if len(cut) else cut
            row = part[of[cut]]
            out += _answers(d[row], p[row] + inside[cut], stop - cut)
    return pa.Table.from_pylist(out, schema=_ANSWER)


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
_CUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,stop:long>>"


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in _CUT.names}
        for key, text, known, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "known", "starts")), strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            pair = np.concatenate((_pairs(known), _pairs(starts)))
            pair = pair[pair[:, 1] > 0]
            gone = covered(pair[:, 0], pair[:, 0] + pair[:, 1] + length - 1, len(raw))
            kept = raw[~gone].tobytes()
            a, b = runs(gone)
            for name, x in (("doc_id", key), ("n_bytes", len(raw)), ("n_removed", int(gone.sum())), ("n_spans", len(a)), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept if len(a) else None), ("spans", [{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)])):
                out[name].append(x)
        yield pa.RecordBatch.from_pydict(out, schema=_CUT)


def dedup_bytes(docs: DataFrame, length: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """Cut from every document each byte covered by a string of `length` bytes that starts earlier in the corpus.

    Earlier means a smaller doc_id, or the same document and an earlier start. Takes doc_id and text; other columns are
    not looked at. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null where
    nothing was removed) and spans (removed byte ranges, half-open).
    Null and empty texts have no bytes; texts shorter than `length` lose nothing; the first of equal texts stays whole,
    but for what it repeats itself; doc_id tells documents apart, and rows without one are left out.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    gram = max(1, length * 44 // 100)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    buckets = deal(docs, 16_000_000)
    by_doc = lambda answers, name: answers.groupBy(F.col("key").alias("_doc")).agg(F.collect_list("s").alias(name))
    found = by_doc(docs.mapInArrow(lambda it: _send_hashes(it, length, gram, buckets), _FRAGMENT_DDL).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_settle_hashes, "key long, s binary"), "known")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, texts = batch.column("known"), batch.column("text").to_pylist()
            open_ = np.asarray(hits.is_valid()) if len(hits) else np.zeros(0, bool)
            raw = [b"" if o else (t or "").encode() for t, o in zip(texts, open_, strict=True)]
            sha = [None if o else hashlib.sha256(r).hexdigest() for r, o in zip(raw, open_, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(sha, pa.string()), pa.array([t if o else None for t, o in zip(texts, open_, strict=True)], pa.string()), hits], names=["doc_id", "n_bytes", "sha", "text", "known"])

    known = docs.join(found, docs["doc_id"] == found["_doc"], "left").select("doc_id", "text", "known")
    known = scratch.write(known.mapInArrow(split, "doc_id long, n_bytes long, sha string, text string, known array<binary>"))
    del found
    scratch.release()
    hit = known.where("sha is null")
    sent = hit.select("doc_id", "text", "known").mapInArrow(lambda it: _send(it, length, gram, buckets), _FRAGMENT_DDL)
    starts = by_doc(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _settle(t, length), "key long, s binary"), "starts")
    cut = hit.join(starts, hit["doc_id"] == starts["_doc"], "left").select("doc_id", "text", "known", "starts").mapInArrow(lambda it: _cut(it, length), _CUT_DDL)
    none = F.lit(0).cast("long")
    clean = known.where("sha is not null").select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans"))
    return clean.unionByName(cut)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
