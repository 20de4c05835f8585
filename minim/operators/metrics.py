"""Model metrics and prediction metrics, each one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minim.operators.keyed import running_sums

# Probability clips for double and single precision scores.
CLIP_DOUBLE = 1e-15
CLIP_SINGLE = 1.1920928955078125e-07


def log_loss(df: DataFrame, label: str, p: str, clip: float = CLIP_DOUBLE) -> DataFrame:
    """Binary log loss; probabilities are clipped to `[clip, 1 - clip]` first."""
    clip = max(clip, CLIP_DOUBLE, 2.220446049250313e-16)
    q = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1.0 - clip))
    y = F.col(label).cast("double")
    return df.agg((-F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"))


def log_loss_multiclass(df: DataFrame, label: str, probabilities: str, clip: float = CLIP_DOUBLE) -> DataFrame:
    """Multiclass log loss; `label` is the index into the probability array, rows renormalized."""
    picked = F.greatest(F.get(F.col(probabilities), F.col(label).cast("int")), F.lit(clip))
    total = F.aggregate(F.transform(F.col(probabilities), lambda v: F.greatest(v, F.lit(clip))), F.lit(0.0), lambda a, v: a + v)
    return df.agg((-F.avg(F.log(picked / total))).alias("log_loss"))


def model_accuracy(df: DataFrame, label: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Share of rows where `p >= threshold` equals the label."""
    predicted = F.when(F.col(p) >= threshold, 1).otherwise(0)
    return df.agg(F.avg((predicted == F.col(label)).cast("double")).alias("accuracy"))


def model_accuracy_multiclass(df: DataFrame, label: str, probabilities: str) -> DataFrame:
    """Share of rows whose first largest probability is at the label's index."""
    scores = F.col(probabilities)
    predicted = F.array_position(scores, F.array_max(scores)) - 1
    return df.agg(F.avg((predicted == F.col(label)).cast("double")).alias("accuracy"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; NULL when one class is absent.

    Mann-Whitney: each distinct score adds `positives * (negatives below + half of its own)`.
    """
    histogram = df.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    ranked = running_sums(histogram, [], "s", ["neg"], histogram.count())
    below = F.col("neg_upto") - F.col("neg")
    return ranked.agg(
        F.sum(F.col("pos") * (below + F.col("neg") / 2.0)).alias("u"),
        F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"),
    ).select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).alias("roc_auc"))


def numeric_hit(true: Column, predicted: Column, tolerance: float) -> Column:
    """1.0 within the tolerance; a missing or non-finite side is a miss."""
    gap = F.abs(true - predicted)
    return F.when(gap.isNotNull() & ~F.isnan(gap) & (gap <= tolerance), 1.0).otherwise(0.0)


def numeric_accuracy(df: DataFrame, true: str, predicted: str, tolerance: float) -> DataFrame:
    return df.agg(F.avg(numeric_hit(F.col(true), F.col(predicted), tolerance)).alias("accuracy"))


def accuracy(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Exact-match share and error; NULL is a value of its own."""
    one = df.agg(F.avg(F.col(true).eqNullSafe(F.col(predicted)).cast("double")).alias("accuracy"))
    return one.withColumn("error", 1 - F.col("accuracy"))
