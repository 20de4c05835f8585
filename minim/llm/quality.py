"""Operators 1 and 8: quality rules and the quality classifier, both boosted trees over document statistics.

The labelled rows a model is fitted on are bounded by `sample_rows`: the rows of smallest xxhash64(doc_id) among the
labelled documents outside the held-out fold. Fitting takes that bounded table on the driver; everything else - statistics and
scores of all documents - is one pass over the scan without a shuffle, the flattened trees travelling with the function.

Defined results: a null text counts as empty; an empty text has zero statistics and is scored like any other; rows with a null
doc_id are scored and keep the null; repeated rows are scored each; labels that are null, not 0 or 1, or of no document are
unused, and of several labels of a document the smallest counts; with no usable labels the score is constant. Other columns of the
inputs are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minim.llm import boosting
from minim.llm.doc_stats import BASE, FEATURES, statistics
from minim.llm.texts import as_bytes, byte_lists, small_batches

# At most this many labelled documents fit a model.
SAMPLE_ROWS = 20_000
FOLDS = 5
KEEP_AT = 0.3
# A growing value of these never raises the verdict of the rules.
FALLING = ("symbol_share", "bang_share", "adjacent_share", "repeat_share", "dup_line_share", "top_word_share")
# The rules decide on the base counts and their ratios; the classifier on all statistics.
RULE_FEATURES = ("log_words", "mean_word_chars", "symbol_share", "upper_share", "bang_share", "distinct_share", "top_word_share",
                 "adjacent_share", "repeat_share", "dup_line_share", "stop_share", "mark_tail_share")
_BASE_SCHEMA = ", ".join(f"{c} long" for c in BASE)


def held_out(doc_id: str = "doc_id"):
    """True for the fold no model learns from; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _statistics_of(df: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, the base counts and all features of each row's text."""
    schema = df.select(*keep).schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    names = [*keep, *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in byte_lists(batches, len(keep)):
            _, features = statistics(texts)
            yield pa.RecordBatch.from_arrays([*rows.columns[:len(keep)], *(pa.array(c) for c in features.T)], names)

    small_batches(df.sparkSession)
    return df.select(*keep, as_bytes().alias("_text")).mapInArrow(run, f"{schema}, " + ", ".join(f"{c} double" for c in FEATURES))


def training_rows(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the bounded sample, on the driver: `sample_rows` times some 20 numbers."""
    quality = F.col("quality").cast("int")
    sample = (
        labels.where(quality.isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(quality).alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # The broadcast side has at most `sample_rows` rows of two numbers.
    joined = (documents.select(F.col("doc_id").cast("bigint").alias("_id"), "text")
              .join(F.broadcast(sample.withColumnRenamed("doc_id", "_id")), "_id"))
    rows = _statistics_of(joined, ["_id", "_y"]).toArrow()
    if not rows.num_rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    x = np.stack([rows[c].to_numpy() for c in FEATURES], 1)
    y = rows["_y"].to_numpy().astype(float)
    order = np.lexsort((*x.T, rows["_id"].to_numpy()))
    return x[order], y[order]


def fit_classifier(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = 80) -> boosting.Trees:
    """Boosted trees over all statistics, from labels outside the held-out fold."""
    x, y = training_rows(documents, labels, sample_rows)
    return boosting.fit(x, y, trees=trees)


def score_documents(documents: DataFrame, model: boosting.Trees) -> DataFrame:
    """`doc_id, score` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in byte_lists(batches, 1):
            _, features = statistics(texts)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(features))], ["doc_id", "score"])

    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes().alias("_text")).mapInArrow(run, "doc_id long, score double")


def quality_classifier(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`doc_id, held_out, score, predicted` of every document; predicted is 1 from a score of KEEP_AT."""
    scored = score_documents(documents, fit_classifier(documents, labels, sample_rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def keep_quality(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `documents` whose text the classifier accepts, all columns kept."""
    model = fit_classifier(documents, labels, sample_rows)

    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(names.index("text")).fill_null("").cast(pa.binary())
            keyed = pa.RecordBatch.from_arrays([text, pa.array(range(batch.num_rows), pa.int64())], ["text", "row"])
            for part, texts in byte_lists([keyed], 0):
                keep = model.score(statistics(texts)[1]) >= KEEP_AT
                yield batch.take(part.column(1).filter(pa.array(keep)))

    small_batches(documents.sparkSession)
    return documents.mapInArrow(run, documents.schema)


def quality_rules(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base counts of every document, the base rule, the score of the monotone trees and the verdict.

    `base_failed`: fewer than 10 words, or more than a fifth of the words in repeated windows. `kept` is false
    there, else whether the score reaches KEEP_AT. The score never rises with a feature of FALLING.
    """
    x, y = training_rows(documents, labels, sample_rows)
    chosen = [FEATURES.index(c) for c in RULE_FEATURES]
    model = boosting.fit(x[:, chosen], y, monotone={RULE_FEATURES.index(c): -1 for c in FALLING})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in byte_lists(batches, 1):
            base, features = statistics(texts)
            score = model.score(features[:, chosen])
            failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(c) for c in base.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= KEEP_AT))],
                ["doc_id", *BASE, "base_failed", "score", "kept"])

    small_batches(documents.sparkSession)
    return (documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes().alias("_text"))
            .mapInArrow(run, f"doc_id long, {_BASE_SCHEMA}, base_failed boolean, score double, kept boolean"))
