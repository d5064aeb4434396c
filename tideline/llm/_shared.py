"""Which hashes occur more than once in a corpus, answered per document, without pairs and without a hot hash meeting in one task.

Hashes travel packed: one row for each block of documents and bucket, not one for each hash. A block settles by itself
what repeats inside it and sends on one record for a hash, so that a bucket gets at most one record of a hot hash from
each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm._text import U64, Block, blocks, by_key

#: h: hashes, d: doc ids, p: positions, all of one length; a row whose h is null is an answer that is ready (key: its document).
PACKED = "bucket int, key long, h binary, d binary, p binary"
ANSWER = "key long, p binary"


def _pack(bucket: np.ndarray, h: np.ndarray, d: np.ndarray, p: np.ndarray, rows: dict[str, list]) -> None:
    for b, (hh, dd, pp) in by_key(bucket, h, d, p):
        for name, x in (("bucket", b), ("key", None), ("h", hh.tobytes()), ("d", dd.tobytes()), ("p", pp.astype(np.int32).tobytes())):
            rows[name].append(x)


def _ready(doc: np.ndarray, p: np.ndarray, n: int, rows: dict[str, list]) -> None:
    for key, (pp,) in by_key(doc, p):
        for name, x in (("bucket", key % n), ("key", key), ("h", None), ("d", None), ("p", pp.astype(np.int32).tobytes())):
            rows[name].append(x)


def _batch(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(rows, schema=schema)


_PACKED = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("h", pa.binary()), ("d", pa.binary()), ("p", pa.binary())])


def repeated(df: DataFrame, emit: Callable[[pa.RecordBatch, Block], tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, later_only: bool) -> DataFrame:
    """Rows (key: doc id, p: packed positions) for hashes that occur elsewhere; a document may have several rows.

    emit gives (hash, doc id, position) of a block. With later_only, a position counts when a smaller doc id has its
    hash; otherwise when the hash occurs at two positions at least, in one document or in two.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                rows: dict[str, list] = {name: [] for name in _PACKED.names}
                h, d, p = emit(batch, block)
                if not len(h):
                    continue
                order = np.lexsort((p, d, h))
                h, d, p = h[order], d[order], p[order]
                new = np.concatenate(([True], h[1:] != h[:-1]))
                group = np.cumsum(new) - 1
                first = np.flatnonzero(new)
                if later_only:
                    settled = d > d[first][group]
                    go = ~settled
                else:
                    settled = np.diff(np.concatenate((first, [len(h)])))[group] > 1
                    go = new
                _ready(d[settled], p[settled], n, rows)
                h, d, p = h[go], d[go], p[go]
                _pack((h >> U64(40)).astype(np.int64) % n, h, d, p, rows)
                yield _batch(rows, _PACKED)

    def settle(table: pa.Table) -> pa.Table:
        keys, positions = [], []
        parts: tuple[list, list, list] = ([], [], [])
        for key, h, d, p in zip(*(table.column(c).to_pylist() for c in ("key", "h", "d", "p")), strict=True):
            if h is None:
                keys.append(key)
                positions.append(p)
            else:
                for part, x, kind in zip(parts, (h, d, p), (U64, np.int64, np.int32), strict=True):
                    part.append(np.frombuffer(x, kind))
        if parts[0]:
            h, d, p = (np.concatenate(x) for x in parts)
            order = np.lexsort((d, h)) if later_only else np.argsort(h)
            h, d, p = h[order], d[order], p[order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            hit = d > d[first][group] if later_only else np.diff(np.concatenate((first, [len(h)])))[group] > 1
            for key, (pp,) in by_key(d[hit], p[hit]):
                keys.append(key)
                positions.append(pp.tobytes())
        return pa.table({"key": pa.array(keys, pa.int64()), "p": pa.array(positions, pa.binary())})

    return df.mapInArrow(send, PACKED).repartition(n, "bucket").groupBy("bucket").applyInArrow(settle, ANSWER)


def answers(found: DataFrame, name: str) -> DataFrame:
    """One row for each document: its packed positions as a list of binaries."""
    return found.groupBy(F.col("key").alias("_doc")).agg(F.collect_list("p").alias(name))
