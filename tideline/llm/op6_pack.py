"""Packing into optimal length buckets.

The histogram of lengths over the whole corpus goes to a dynamic programme that chooses the buckets' upper lengths so
that padding every document to its bucket's length wastes as little as possible. Inside each bucket, documents form
batches of as many as a token budget allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm._dist import Scratch, ranked
from tideline.llm.op5_mix import word_count


def best_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets with the least padding; lengths ascend.

    The least padding of the first j lengths in k buckets is L[j] * C[j] - S[j] + min over i < j of
    (best(k - 1, i) + S[i] - L[j] * C[i]), with L the j-th length, C and S running sums of documents and tokens: lines
    with falling slopes asked at rising places, so a layer takes linear time.
    """
    n = len(lengths)
    if not n:
        return []
    docs = [0, *np.cumsum(counts).tolist()]
    tokens = [0, *np.cumsum(lengths * counts).tolist()]
    size = [0, *lengths.tolist()]
    best: list[float] = [0] + [float("inf")] * n
    came: list[list[int]] = []
    for _ in range(min(buckets, n)):
        now, back = [float("inf")] * (n + 1), [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []
        head = 0
        for j in range(1, n + 1):
            if best[j - 1] < float("inf"):
                m, b = -docs[j - 1], int(best[j - 1]) + tokens[j - 1]
                while len(hull) - head >= 2:
                    (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                    if (b - b1) * (m1 - m2) <= (b2 - b1) * (m1 - m):
                        hull.pop()
                    else:
                        break
                hull.append((m, b, j - 1))
            x = size[j]
            while len(hull) - head >= 2 and hull[head][0] * x + hull[head][1] >= hull[head + 1][0] * x + hull[head + 1][1]:
                head += 1
            if head < len(hull):
                m, b, i = hull[head]
                now[j], back[j] = size[j] * docs[j] - tokens[j] + m * x + b, i
        best = now
        came.append(back)
    out, j = [], n
    for back in reversed(came):
        out.append(size[j])
        j = back[j]
    return out[::-1]


def pack(docs: DataFrame, buckets: int = 16, budget: int = 65_536, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_tokens (words), bucket (from 0), bucket_len, batch (from 0 in the bucket), place (in the batch), padding.

    Takes doc_id and text; other columns are not looked at. A batch holds budget // bucket_len documents, or one where
    that is longer than the budget. Null and empty texts have the length 0. Repeated rows take a place each; rows
    without a doc_id are left out; an empty table gives no rows. The driver sees one row for each distinct length.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = scratch.write(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), word_count().alias("n_tokens")))
    histogram = sorted((r["n_tokens"], r["count"]) for r in rows.groupBy("n_tokens").count().collect())
    uppers = best_buckets(np.array([x for x, _ in histogram], np.int64), np.array([c for _, c in histogram], np.int64), buckets)
    bucket = sum(((F.col("n_tokens") > F.lit(u)).cast("int") for u in uppers[:-1]), F.lit(0))
    length = F.element_at(F.array(*[F.lit(int(u)).cast("long") for u in uppers or [0]]), F.col("bucket") + 1)
    rows = rows.withColumn("bucket", bucket).withColumn("bucket_len", length)
    held = F.greatest(F.lit(1), F.expr(f"{budget} div greatest(bucket_len, 1)"))
    out = ranked(rows, scratch, ["bucket", "n_tokens", "doc_id"], ["bucket"]).withColumn("held", held)
    return out.select("doc_id", "n_tokens", "bucket", "bucket_len", F.expr("before_rows div held").alias("batch"), (F.col("before_rows") % F.col("held")).alias("place"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
