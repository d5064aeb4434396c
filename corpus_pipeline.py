"""A training corpus from raw documents: quality, near-duplicates, repeated passages, the mix of sources, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of documents; n_chars follows a text that a stage has cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import op2_near, op5_mix, op6_pack, op7_quality, op8_substring
from tideline.llm._dist import Scratch, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is at least even; short clean documents stay. Rows without a doc_id go, here and
    hence from the whole pipeline."""
    return op7_quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): that with the smallest doc_id.
    Texts without words are linked with nothing and stay. Of rows that repeat a doc_id one stays; rows without one go."""
    (key,) = unused(docs, "_id")
    kept = op2_near.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(key))
    return docs.join(kept, docs["doc_id"] == kept[key], "left_semi").dropDuplicates(["doc_id"])


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where the table has it, of the texts as they are now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages that an earlier document has; a document that is nothing else goes. Null, empty
    and short texts stay as they are."""
    key, new = unused(docs, "_id", "_text")
    cut = op8_substring.dedup_substrings(docs).where("n_removed > 0").select(F.col("doc_id").alias(key), F.col("kept_text").alias(new))
    joined = docs.join(cut, docs["doc_id"] == cut[key], "left").where(F.col(new).isNull() | (F.col(new) != ""))
    changed = F.col(new).isNotNull()
    out = {"text": F.coalesce(new, "text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, as often as it takes them; documents without words go."""
    taken, _, _ = op5_mix.mix_documents(docs)
    return _measured(op5_mix.mixed_texts(docs, taken))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length bucket, batch and place; an empty table gives no rows, in this stage as in all."""
    return op6_pack.pack(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing", mix), ("packing", pack)]

#: Signatures, the fit of the rules and the pseudorandom mix have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
