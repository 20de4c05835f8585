"""Attacks on a release."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minim.operators.keyed import attach
from minim.operators.metrics import numeric_hit
from minim.session import Scratch

BATCH = 32
MISSING_VALUE = "__MISSING__"


def subset_histograms(df: DataFrame, qis: Sequence[str], sizes: Sequence[int]) -> tuple[DataFrame, list[tuple[str, ...]]]:
    """Class-size histogram of every QI subset: `(subset, k, class_count)`, and the subsets.

    Rows are collapsed to full classes once; the grouping sets then expand classes and not rows,
    `BATCH` subsets at a time; each batch's histogram is written, so any number of subsets is worked off one plan at a time.
    """
    qis = list(qis)
    subsets = [s for m in sizes for s in combinations(qis, m)]
    classes = df.groupBy(*qis).agg(F.count(F.lit(1)).alias("_n"))
    scratch = Scratch(df.sparkSession, "background") if len(subsets) > BATCH else None
    if scratch:
        classes = scratch.save(classes)
    parts = []
    for start in range(0, len(subsets), BATCH):
        batch = subsets[start:start + BATCH]
        masks = {sum(1 << (len(qis) - 1 - i) for i, q in enumerate(qis) if q not in s): start + j
                 for j, s in enumerate(batch)}
        index = F.create_map(*[F.lit(x).cast("bigint") for pair in masks.items() for x in pair])
        grouped = classes.groupingSets([[F.col(q) for q in s] for s in batch], *[F.col(q) for q in qis]).agg(
            F.sum("_n").alias("k"), F.grouping_id().alias("_mask"))
        counted = grouped.groupBy(index[F.col("_mask").cast("bigint")].cast("int").alias("subset"), "k").agg(F.count(F.lit(1)).alias("class_count"))
        parts.append(scratch.save(counted) if scratch else counted)
    return reduce(DataFrame.unionByName, parts), subsets


def subset_risks(histograms: DataFrame) -> DataFrame:
    """Per subset: smallest candidate set, largest, mean and p95 (linear) of `1 / size` over rows."""
    rows = F.col("k") * F.col("class_count")
    w = Window.partitionBy("subset").orderBy(F.desc("k"))
    table = histograms.select(
        "subset", "k", "class_count", F.sum(rows).over(w).alias("upto"),
        F.sum(rows).over(Window.partitionBy("subset")).alias("total"))
    location = (F.col("total") - 1) * F.lit(0.95)

    def size_at(position: Column) -> Column:
        return F.max(F.when(F.col("upto") >= position + 1, F.col("k")))

    one = table.groupBy("subset").agg(
        F.min("k").alias("min_size"), (F.sum("class_count") / F.max("total")).alias("mean_success"),
        F.max("total").alias("total"), size_at(F.floor(location)).alias("_lo"), size_at(F.ceil(location)).alias("_hi"))
    lo, hi = F.lit(1.0) / F.col("_lo"), F.lit(1.0) / F.col("_hi")
    part = location - F.floor(location)
    return one.select("subset", "min_size", (F.lit(1.0) / F.col("min_size")).alias("max_success"),
                      "mean_success", (lo + part * (hi - lo)).alias("p95_success"))


def background_knowledge(df: DataFrame, qis: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """Risk for an attacker who knows m of the QIs, for every m in `sizes`.

    Worst, strongest and mean figures over all subsets of that size; the first subset wins ties.
    """
    histograms, subsets = subset_histograms(df, qis, sizes)
    risks = subset_risks(histograms)
    named = df.sparkSession.createDataFrame([(i, ",".join(s), len(s)) for i, s in enumerate(subsets)], "subset int, name string, known int")
    table = risks.join(named, "subset")

    def best(column: str, low: bool = False) -> Column:
        value = -F.col(column) if low else F.col(column)
        return F.max_by("name", F.struct(value, -F.col("subset")))

    return table.groupBy(F.col("known").cast("bigint").alias("known_attribute_count")).agg(
        F.count(F.lit(1)).alias("subset_count"),
        F.min("min_size").alias("worst_candidate_size"),
        F.max("max_success").alias("worst_success_probability"),
        best("min_size", low=True).alias("worst_subset"),
        F.max("mean_success").alias("strongest_mean_success_probability"),
        best("mean_success").alias("strongest_mean_subset"),
        F.avg("mean_success").alias("mean_success_probability_across_subsets"),
        F.max("p95_success").alias("strongest_p95_success_probability"),
        best("p95_success").alias("strongest_p95_subset"),
        F.avg("p95_success").alias("p95_success_probability_across_subsets"))


def most_exposed_row(df: DataFrame, subset: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """The first row, by id, among those with the smallest candidate set for one subset."""
    sizes = df.groupBy(*subset).agg(F.count(F.lit(1)).alias("k"), F.min(row_id).alias("worst_row_id"))
    return sizes.agg(F.min(F.struct("k", "worst_row_id")).alias("r")).select("r.k", "r.worst_row_id")


def target_value(column: str) -> Column:
    """Attack target as text; NULL is a class of its own."""
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING_VALUE))


def baseline_predictor(train: DataFrame, target: str, numeric: bool) -> DataFrame:
    """Constant prediction: the mean of a number, or the most frequent class (smallest on ties)."""
    if numeric:
        return train.agg(F.avg(target).alias("prediction"))
    counts = train.groupBy(target_value(target).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("prediction"))


def majority_attack(train: DataFrame, test: DataFrame, known: Sequence[str], target: str) -> DataFrame:
    """Look-up attack: predict the majority raw `target` per published key `known`.

    Returns accuracy, the baseline's accuracy and the leakage gap on `test`. A key the training
    release does not hold falls back to the baseline. `known` must not contain the target.
    """
    if target in known:
        raise ValueError("the target cannot be known")
    seen = train.groupBy(*known, target_value(target).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    table = seen.groupBy(*known).agg(
        F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias("_guess"), F.sum("_n").alias("_rows"))
    # One row.
    base = F.broadcast(baseline_predictor(train, target, numeric=False).withColumnRenamed("prediction", "_base"))
    tried = attach(test, table, known, "_rows").join(base)
    truth = target_value(target)
    return tried.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((truth == F.coalesce("_guess", "_base")).cast("double")).alias("accuracy"),
        F.avg((truth == F.col("_base")).cast("double")).alias("baseline_accuracy"),
    ).withColumn("leakage_gap", F.col("accuracy") - F.col("baseline_accuracy"))


def mean_attack(train: DataFrame, test: DataFrame, known: Sequence[str], target: str, tolerance: float) -> DataFrame:
    """Look-up attack on a number: predict the mean per published key; hits within `tolerance`."""
    table = train.groupBy(*known).agg(F.avg(target).alias("_guess"), F.count(F.lit(1)).alias("_rows"))
    base = F.broadcast(baseline_predictor(train, target, numeric=True).withColumnRenamed("prediction", "_base"))
    tried = attach(test, table, known, "_rows").join(base)
    return tried.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(numeric_hit(F.col(target), F.coalesce("_guess", "_base"), tolerance)).alias("accuracy"),
        F.avg(numeric_hit(F.col(target), F.col("_base"), tolerance)).alias("baseline_accuracy"),
    ).withColumn("leakage_gap", F.col("accuracy") - F.col("baseline_accuracy"))


def attack_summary(results: DataFrame) -> DataFrame:
    """Mean accuracy over attributes that could be attacked.

    `results` holds `(attr, rows, classes, numeric, accuracy)`. Skipped are attributes without
    valid rows and categorical ones with fewer than two classes.
    """
    usable = (F.col("rows") > 0) & (F.col("numeric") | (F.col("classes") >= 2))
    return results.agg(
        F.count(F.when(usable, 1)).alias("evaluated"), F.count(F.when(~usable, 1)).alias("skipped"),
        F.avg(F.when(usable, F.col("accuracy"))).alias("mean_accuracy"),
        (1 - F.avg(F.when(usable, F.col("accuracy")))).alias("mean_error"))
