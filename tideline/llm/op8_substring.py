"""Substring de-duplication by difference-cover anchors.

Hashes of short windows are compared only at positions that lie in a difference cover modulo a period. For any two
positions there is a shift below the period that brings both into the cover, so any two equal windows of `window`
words share an anchor at aligned places. Where an anchor occurs twice, the match is extended: every full window around
it is hashed and compared, which makes the result exact and needs no pairs of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm._dist import Scratch, deal
from tideline.llm._shared import answers, repeated
from tideline.llm._text import Block, blocks, covered, ints, runs

# Perfect difference sets by period: every residue is a difference of two members (fixed values).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def period_for(window: int) -> int:
    """The largest period that leaves an anchor at least a third of the window."""
    return max(v for v in COVERS if v == 1 or window - v + 1 >= max(1, window / 3))


def _anchors(block: Block, window: int, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = block.words()
    at, h = words.windows(window - period + 1)
    doc = np.searchsorted(words.bounds, at, "right") - 1
    local = at - words.bounds[doc]
    keep = np.isin(local % period, COVERS[period]) & (words.counts[doc] >= window)
    return h[keep], block.ids[doc[keep]], local[keep]


def _windows(batch: pa.RecordBatch, block: Block, window: int, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full windows that hold a repeated anchor."""
    words = block.words()
    at, h = words.windows(window)
    near = np.zeros(len(words.start) + 1, np.int64)
    anchors = batch.column("anchors")
    for i in range(len(block.ids)):
        p = ints(anchors[block.first + i].as_py())
        near[words.bounds[i] + p[p < words.counts[i]] + 1] = 1
    near = np.cumsum(near)
    keep = near[at + period] > near[at]
    at, h = at[keep], h[keep]
    doc = np.searchsorted(words.bounds, at, "right") - 1
    return h, block.ids[doc], at - words.bounds[doc]


def dedup_substrings(docs: DataFrame, window: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """Cut from every document the words covered by a window that also starts in a document with a smaller doc_id.

    Takes doc_id and text; other columns are not looked at. Words are maximal runs without ASCII white space, compared
    unchanged. Returns doc_id, n_words, n_removed, kept_sha256, kept_text (the kept words joined by one space; null
    where nothing was removed) and spans (removed word ranges, half-open).
    Null and empty texts have no words; documents shorter than the window lose nothing; the first of equal documents
    stays whole; a row that repeats an id and text repeats the result; rows without a doc_id are left out.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    period = period_for(window)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    n = deal(docs, 16_000_000)
    anchors = answers(repeated(docs, lambda _, block: _anchors(block, window, period), n, False), "anchors")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without a repeated anchor are done; the others go on with their text."""
        for batch in batches:
            for block in blocks(batch):
                words = block.words()
                hits = batch.column("anchors").slice(block.first, len(block.ids))
                texts = batch.column("text").slice(block.first, len(block.ids))
                open_ = np.asarray(hits.is_valid())
                sha = [None if open_[i] else hashlib.sha256(b" ".join(block.text(i).split())).hexdigest() for i in range(len(open_))]
                yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(words.counts.astype(np.int64)), pa.array(sha, pa.string()), pa.array([t if o else None for t, o in zip(texts.to_pylist(), open_, strict=True)], pa.string()), hits], names=["doc_id", "n_words", "sha", "text", "anchors"])

    known = docs.join(anchors, docs["doc_id"] == anchors["_doc"], "left").select("doc_id", "text", "anchors")
    known = scratch.write(known.mapInArrow(split, "doc_id long, n_words long, sha string, text string, anchors array<binary>"))
    hit = known.where("sha is null")
    found = answers(repeated(hit.select("doc_id", "text", "anchors"), lambda batch, block: _windows(batch, block, window, period), n, True), "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans")}
            for key, text, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts")), strict=True):
                words = (text or "").encode().split()
                p = ints(starts).astype(np.int64)
                gone = covered(p, p + window, len(words))
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words)
                a, b = runs(gone)
                for name, x in (("doc_id", key), ("n_words", len(words)), ("n_removed", int(gone.sum())), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept_text", kept.decode() if len(a) else None), ("spans", [{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)])):
                    out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=_CUT)

    cut_rows = hit.join(found, hit["doc_id"] == found["_doc"], "left").select("doc_id", "text", "starts").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:long,stop:long>>")
    clean = known.where("sha is not null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans"))
    return clean.unionByName(cut_rows)


_CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
