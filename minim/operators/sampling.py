"""Seeded order, splits, samples and folds.

Rows are ordered by `md5(seed ':' row_id)`: a uniform order that no partitioning changes. A sample
of fixed size is "the rows up to a bound in that order", and the bound comes from counts, so
drawing it moves no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minim.functions.ordering import bucket_digits, head_bucket, key_head, seeded_key
from minim.operators.keyed import quota_bounds, rank_by_key
from minim.session import Scratch

MAX_LABELS = 10_000


def with_row_pos(df: DataFrame, seed: int, row_id: str = "row_id", name: str = "row_pos") -> DataFrame:
    """0-based position of every row in the seeded order."""
    keyed = df.withColumn("_key", seeded_key(seed, row_id))
    return rank_by_key(keyed, [], "_key", name).drop("_key")


def label_counts(df: DataFrame, label: str) -> list[tuple]:
    """Rows per label, refused above `MAX_LABELS` labels."""
    rows = (df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label)
            .limit(MAX_LABELS + 1).collect())
    if len(rows) > MAX_LABELS:
        raise ValueError(f"{label} has more than {MAX_LABELS} values")
    return [(r[0], r["n"]) for r in rows]


def _bounds(df: DataFrame, label: str, quotas: list[tuple], rows: int) -> DataFrame:
    kind = df.schema[label].dataType.simpleString()
    table = df.sparkSession.createDataFrame(quotas, f"`{label}` {kind}, quota bigint")
    # One row per label, checked by label_counts.
    return quota_bounds(df, [label], "_key", table, "quota", bucket_digits(rows))


def round_half_up(x: float) -> int:
    return int(math.floor(x + 0.5))


def stratified_split(
    df: DataFrame, label: str, val: float, test: float, seed: int, row_id: str = "row_id",
) -> DataFrame:
    """Add `split` in {train, val, test}, stratified by label.

    Test is drawn first; validation then takes `val / (1 - test)` of what remains. Within each
    label the first rows of the seeded order are test, the next validation.

    The input is evaluated once: its rows are written with the head of their key, and counts, bounds and every reader of
    the split start from these. A whole key is made only for rows whose head is that of a bound.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "stratified")
    key = seeded_key(seed, row_id)
    rows = scratch.save(df.withColumn("_head", key_head(key)))
    counts = label_counts(rows, label)
    if any(value is None for value, _ in counts):
        raise ValueError("labels must not be missing")
    n = sum(c for _, c in counts)
    tests, vals = [], []
    for value, count in counts:
        t = round_half_up(test * count)
        v = round_half_up(val / (1.0 - test) * (count - t))
        tests.append((value, t))
        vals.append((value, t + v))
    kind = df.schema[label].dataType.simpleString()
    quotas = spark.createDataFrame([(v, p, q) for p, found in enumerate((tests, vals)) for v, q in found], f"`{label}` {kind}, _part int, quota bigint")
    # Both bounds of a label in one pass; one row per label, checked by label_counts.
    slim = rows.select(*dict.fromkeys([label, row_id, "_head"]))
    bounds = quota_bounds(slim, [label], key, quotas, "quota", part="_part", bucket=head_bucket(F.col("_head"), bucket_digits(n)))
    marks = bounds.groupBy(F.col(label).alias("_l")).agg(F.max(F.when(F.col("_part") == 0, F.col("bound"))).alias("_test"),
                                                         F.max(F.when(F.col("_part") == 1, F.col("bound"))).alias("_val"))
    marks = scratch.save(marks.select("*", *[key_head(F.col(m)).alias(f"{m}_head") for m in ("_test", "_val")]))

    def upto(bound: str) -> Column:
        return F.when(F.col("_head") == F.col(f"{bound}_head"), key <= F.col(bound)).otherwise(F.col("_head") < F.col(f"{bound}_head"))

    split = F.when(upto("_test"), "test").when(upto("_val"), "val").otherwise("train")
    return (rows.join(F.broadcast(marks), rows[label] == marks["_l"])
            .select(*df.columns, split.alias("split")))


def covering_quotas(counts: Sequence[tuple], size: int) -> list[tuple]:
    """Quota per label: `max(1, floor(ideal))`, then surplus or deficit fixed one unit at a time."""
    total = sum(n for _, n in counts)
    if size < len(counts):
        raise ValueError("the sample must hold at least one row per label")
    if size > total:
        raise ValueError("the sample cannot exceed the row count")
    ideal = [size * n / total for _, n in counts]
    quota = [min(n, max(1, math.floor(x))) for x, (_, n) in zip(ideal, counts)]
    while sum(quota) > size:
        i = max((i for i in range(len(quota)) if quota[i] > 1), key=lambda i: (quota[i] - ideal[i], -i))
        quota[i] -= 1
    while sum(quota) < size:
        i = max((i for i in range(len(quota)) if quota[i] < counts[i][1]),
                key=lambda i: (ideal[i] - quota[i], -i))
        quota[i] += 1
    return [(value, q) for (value, _), q in zip(counts, quota)]


def label_covering_sample(df: DataFrame, label: str, size: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """Exactly `size` rows, about proportional by label, every label present."""
    counts = label_counts(df, label)
    quotas = covering_quotas(counts, size)
    keyed = df.withColumn("_key", seeded_key(seed, row_id))
    marks = _bounds(keyed.select(label, "_key"), label, quotas, sum(n for _, n in counts)).select(
        F.col(label).alias("_l"), F.col("bound").alias("_bound"))
    return (keyed.join(F.broadcast(marks), keyed[label] == marks["_l"])
            .where(F.col("_key") <= F.col("_bound")).select(*df.columns))


def missing_labels(df: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """Labels of the table that the sample does not cover."""
    return df.select(label).distinct().join(sample.select(label).distinct(), label, "left_anti")


def check_label_coverage(df: DataFrame, sample: DataFrame, label: str) -> None:
    if sample.isEmpty():
        raise ValueError("the sample must hold at least one row")
    if not missing_labels(df, sample, label).isEmpty():
        raise ValueError("the sample must hold at least one row of every label")


def fold(df: DataFrame, n: int, index: int | None, seed: int, row_id: str = "row_id") -> DataFrame:
    """Fold `index` of `n` in the seeded order (all folds with a `fold` column for None).

    Fold sizes differ by at most one, the larger ones first.
    """
    if n < 1 or (index is not None and not 0 <= index < n):
        raise ValueError("n and index do not identify a fold")
    total = df.count()
    small, extra = divmod(total, n)
    pos = F.col("_pos")
    head = extra * (small + 1)
    number = F.when(pos < head, F.floor(pos / F.lit(small + 1)))
    number = number.otherwise(F.lit(extra) + F.floor((pos - head) / F.lit(max(small, 1))))
    ranked = with_row_pos(df, seed, row_id, "_pos").withColumn("fold", number.cast("bigint")).drop("_pos")
    return ranked if index is None else ranked.where(F.col("fold") == index).drop("fold")


def query_sample(df: DataFrame, n: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """At most n rows, the first of the seeded order."""
    return df.orderBy(seeded_key(seed, row_id)).limit(int(n))
