"""Quality rules by weak supervision.

Every rule votes good, bad or abstains. Expectation-maximisation over the vote patterns of the whole corpus estimates
how often each rule casts each vote on good and on bad documents, with no labels; the posterior probability that a
document is good replaces a filter that asks it to pass every rule. Documents with equal votes have equal posteriors,
so the fit only needs one count for each pattern: at most 3 ** rules rows reach the driver, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm._dist import Scratch, small_batches
from tideline.llm._text import _SPACE, blocks, covered

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_stops")


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each whole text; see `features`."""
    for batch in batches:
        for block in blocks(batch):
            buf, offs = block.buf, block.offs
            words = block.words()

            def total(flags: np.ndarray) -> np.ndarray:
                sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
                return sums[offs[1:]] - sums[offs[:-1]]  # noqa: B023

            at, h = words.windows(3)
            doc = np.searchsorted(words.bounds, at, "right") - 1
            order = np.lexsort((h, doc))
            same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            again = np.concatenate(([0], np.cumsum(covered(at[twice], at[twice] + 3, len(words.start)))))
            last = buf[words.stop - 1] if len(words.stop) else np.zeros(0, np.uint8)
            stops = np.concatenate(([0], np.cumsum(np.isin(last, list(b".!?")))))
            shouts = np.concatenate(([0], np.cumsum(np.isin(last, list(b"!$#%&*|")))))
            lines, dups = [], []
            for i in range(len(block.ids)):
                with_word = [x for x in block.text(i).split(b"\n") if x.strip()]
                lines.append(len(with_word))
                dups.append(len(with_word) - len(set(with_word)))
            per_words = lambda sums: sums[words.bounds[1:]] - sums[words.bounds[:-1]]  # noqa: B023, E731
            upper = (buf >= 65) & (buf <= 90)
            letters = upper | ((buf >= 97) & (buf <= 122))
            columns = [words.counts, total(~_SPACE[buf] & ((buf & 0xC0) != 0x80)), total(_SYMBOLS[buf]), np.array(dups), per_words(again), np.array(lines), total(upper), total(letters), per_words(shouts), per_words(stops)]
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), *[pa.array(np.asarray(c, np.int64)) for c in columns]], names=["doc_id", *_BASE])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and, of each whole text, the counts in _BASE: words, code points in words, symbols, lines equal to an
    earlier line, words in a 3-word window found twice, lines with a word, upper-case and all ASCII letters, words
    that end in a shout or symbol, words that end a sentence."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return docs.mapInArrow(measure, "doc_id long, " + ", ".join(f"{c} long" for c in _BASE))


def _vote(value: Column, bad: Column, good: Column) -> Column:
    """0 abstains, 1 says good, 2 says bad."""
    return F.when(value.isNull(), 0).when(bad, 2).when(good, 1).otherwise(0)


def rules(prefix: str = "") -> dict[str, Column]:
    """The rules: each is a column over `features` that is 0 (abstains), 1 (good) or 2 (bad)."""
    col = lambda name: F.col(prefix + name)
    share = lambda a, b: col(a) / F.when(col(b) > 0, col(b))
    length, symbols = share("word_chars", "n_words"), share("n_symbols", "n_words")
    dups, again = share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")
    upper, shouts, stops = share("n_upper", "n_letters"), share("n_shouts", "n_words"), share("n_stops", "n_words")
    words = col("n_words")
    return {
        "word_length": _vote(length, (length < 2.5) | (length > 10), (length >= 3) & (length <= 8)),
        "symbols": _vote(symbols, symbols > 0.1, symbols <= 0.02),
        "repeated_lines": _vote(dups, dups > 0.3, (dups == 0) & (col("n_lines") >= 3)),
        "repeated_words": _vote(again, again > 0.3, again <= 0.1),
        "capitals": _vote(upper, upper > 0.3, upper <= 0.15),
        "shouting": _vote(shouts, shouts > 0.1, shouts <= 0.02),
        "sentences": _vote(stops, (stops < 0.01) & (words >= 50), (stops >= 0.03) & (stops <= 0.3)),
        "length": _vote(words, words < 20, words >= 50),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, iterations: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM for two classes: patterns (n, rules) with votes 0..2 and their counts. Returns the share of good documents,
    vote probabilities (class, rule, vote) and each pattern's posterior of being good.

    An abstention says nothing of a document, so it takes no part in its posterior. Starts from the votes' majority; a
    document none of whose rules votes has the share of good documents as its posterior.
    """
    n, m = patterns.shape
    weight = counts / max(1, counts.sum())
    good, bad = (patterns == 1).sum(1), (patterns == 2).sum(1)
    posterior = (1.0 + good) / (2.0 + good + 2.0 * bad)
    prior, votes = 0.5, np.full((2, m, 3), 1 / 3)
    onehot = np.stack([np.zeros((n, m), bool), patterns == 1, patterns == 2], 2).astype(float)
    for _ in range(iterations if n else 0):
        each = np.stack((posterior, 1 - posterior)) * weight
        prior = float(np.clip(each[0].sum(), 0.02, 0.98))
        votes = np.einsum("cn,nmv->cmv", each, onehot) + 1e-3
        votes /= votes.sum(2, keepdims=True)
        log = np.einsum("nmv,cmv->cn", onehot, np.log(votes)) + np.log([[prior], [1 - prior]])
        new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -700, 700)))
        done, posterior = np.abs(new - posterior).max() < 1e-9, new
        if done:
            break
    return prior, votes, posterior


def _code(prefix: str = "") -> Column:
    return sum((rule * 3**i for i, rule in enumerate(rules(prefix).values())), F.lit(0)).cast("int")


def posteriors(counted: DataFrame) -> list[tuple[int, float]]:
    """The posterior of each vote pattern, from a frame with `votes` and `count` of at most 3 ** rules rows."""
    seen = sorted((r["votes"], r["count"]) for r in counted.collect())
    codes = np.array([v for v, _ in seen], np.int64)
    m = len(rules())
    patterns = np.stack([codes // 3**i % 3 for i in range(m)], 1) if seen else np.zeros((0, m), np.int64)
    found = fit(patterns, np.array([c for _, c in seen], float))[2]
    return [(int(c), float(p)) for c, p in zip(codes, found, strict=True)]


def judge(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, the counts of `features`, votes (pattern of `rules` in base 3) and quality (posterior of being good).

    Takes doc_id and text; other columns are not looked at. Null and empty texts have counts of 0, and most rules
    abstain on them. Repeated rows repeat the result; rows without a doc_id are left out; an empty table gives none.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    measured = scratch.write(features(docs).withColumn("votes", _code()))
    table = spark.createDataFrame(posteriors(measured.groupBy("votes").count()), "votes int, quality double")
    return measured.join(F.broadcast(table), "votes")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdicts(docs: DataFrame, threshold: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """`judge` with base_failed and kept: not base_failed, and a quality of `threshold` or more."""
    return judge(docs, scratch).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5, repeats: int = 50) -> DataFrame:
    """The rows of documents whose quality is `threshold` or more and of whose words no more than `repeats` percent repeat,
    all columns unchanged and texts not moved: one pass counts votes, another one filters.

    Rows without a doc_id go. Null and empty texts have no words and are judged by the rules that vote on them; rows that
    repeat are kept or go together, as do texts with equal votes; an empty table gives none; columns may have any names.
    """
    counted = features(docs).withColumn("votes", _code()).groupBy("votes").count()
    good = [votes for votes, p in posteriors(counted) if p >= threshold]
    kept, prefix = docs.columns, "_m_"
    while any(c.lower().startswith(prefix) for c in kept):
        prefix = "_" + prefix

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for counts in measure(iter([batch])):
                n = counts.num_rows
                yield pa.RecordBatch.from_arrays([*batch.slice(at, n).columns, *counts.columns[1:]], names=[*kept, *(f"{prefix}{c}" for c in _BASE)])
                at += n

    schema = T.StructType([*docs.schema.fields, *(T.StructField(f"{prefix}{c}", T.LongType()) for c in _BASE)])
    measured = docs.where("doc_id is not null").mapInArrow(beside, schema)
    votes = measured.select("*", _code(prefix).alias(f"{prefix}votes"))
    repeated = 100 * F.col(f"{prefix}n_repeat_words") > repeats * F.col(f"{prefix}n_words")
    return votes.where((F.col(f"{prefix}votes").isin(good) if good else F.lit(False)) & ~repeated).select(*kept)


def query(spark, sf_dir: str) -> DataFrame:
    out = verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
