"""Equivalence classes and privacy metrics.

Everything below the class table works on the size histogram `(k, class_count)`. Class sizes sum
to the row count N, so it has at most sqrt(2 N) rows: 1.4 million for 10**12 rows. That is the
only table an unpartitioned window is ever put on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minim.operators.keyed import attach

LOW_PERCENTILES = (1, 2, 3, 4, 5)


def retention_classes(df: DataFrame, qis: Sequence[str], size: str = "k") -> DataFrame:
    """Rows with equal QI values, NULL being a value: `(qis..., k)`."""
    return df.groupBy(*qis).agg(F.count(F.lit(1)).alias(size))


def size_histogram(classes: DataFrame, size: str = "k") -> DataFrame:
    return classes.groupBy(F.col(size).alias("k")).agg(F.count(F.lit(1)).alias("class_count"))


def class_key(qis: Sequence[str]) -> Column:
    """A 128-bit class id; NULL and the text 'NULL' differ. Each value stands behind its length, so no separator can be part of it."""
    texts = [F.col(q).cast("string") for q in qis]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("~")) for t in texts]))


def class_index(df: DataFrame, qis: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Row -> class id and class size, without numbering classes in one task."""
    return per_record_k(df.select(row_id, *qis), qis).select(row_id, class_key(qis).alias("class_id"), "k")


def min_k(df: DataFrame, qis: Sequence[str]) -> DataFrame:
    return retention_classes(df, qis).agg(F.min("k").alias("min_k"))


def per_record_k(df: DataFrame, qis: Sequence[str], size: str = "k") -> DataFrame:
    """Class size of every row. Sizes are pre-aggregated and joined back, heavy classes apart."""
    return attach(df, retention_classes(df, qis, size), qis, size)


def k_distribution_from_histogram(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Min-K, p1..p5 (linear), p95 (rank `(95 n + 99) / 100`), class counts: one row, or one for each value of `by`.

    With `by` there is `risk_k` as well, the size at the 1% smallest classes: -ln of it is the P99 tail risk where every row is published.
    """
    by = list(by)
    order = Window.partitionBy(*by).orderBy("k") if by else Window.orderBy("k")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = histogram.where((F.col("k") > 0) & (F.col("class_count") > 0)).select(
        *by, "k", "class_count",
        F.sum(F.col("k") * F.col("class_count")).over(upto).alias("upto"),
        F.sum(F.col("k") * F.col("class_count")).over(whole).alias("total"))

    def at_position(position: Column) -> Column:
        return F.min(F.when(F.col("upto") >= position + 1, F.col("k")))

    aggs = [F.min("k").alias("leak_k")]
    for p in LOW_PERCENTILES:
        location = (F.col("total") - 1) * F.lit(p / 100.0)
        aggs.append(at_position(F.floor(location)).alias(f"_lo{p}"))
        aggs.append(at_position(F.ceil(location)).alias(f"_hi{p}"))
    rank95 = F.floor((F.col("total") * 95 + 99) / 100)
    aggs += [
        at_position(rank95 - 1).alias("leak_k_95_percentile"),
        F.coalesce(F.sum("class_count"), F.lit(0)).alias("class_count"),
        F.min_by("class_count", "k").alias("min_k_class_count"),
        F.coalesce(F.max("total"), F.lit(0)).alias("record_count"),
    ]
    if by:
        aggs.append(at_position(F.col("total") - F.ceil(F.lit(0.99) * F.col("total"))).alias("risk_k"))
    one = table.groupBy(*by).agg(*aggs) if by else table.agg(*aggs)
    out = [F.coalesce("leak_k", F.lit(0)).cast("bigint").alias("leak_k")]
    for p in LOW_PERCENTILES:
        location = (F.col("record_count") - 1) * F.lit(p / 100.0)
        part = location - F.floor(location)
        value = F.col(f"_lo{p}") + part * (F.col(f"_hi{p}") - F.col(f"_lo{p}"))
        out.append(F.coalesce(value.cast("double"), F.lit(0.0)).alias(f"leak_k_p{p}"))
    return one.select(
        *by, *(["risk_k"] if by else []), *out, F.col("leak_k_95_percentile").cast("bigint").alias("leak_k_95_percentile"),
        "class_count", F.coalesce("min_k_class_count", F.lit(0)).alias("min_k_class_count"),
        "record_count")


def k_distribution(df: DataFrame, qis: Sequence[str]) -> DataFrame:
    return k_distribution_from_histogram(size_histogram(retention_classes(df, qis)))


def k_sorted(histogram: DataFrame) -> DataFrame:
    """Per-record k values in ascending order as runs: `(k, first_rank, last_rank)`.

    The runs are the list without repetition; expand them with `sequence` if rows are needed.
    """
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.sum(F.col("k") * F.col("class_count")).over(upto)
    return histogram.select("k", (last - F.col("k") * F.col("class_count") + 1).alias("first_rank"),
                            last.alias("last_rank"))


def check_released_ids(population: DataFrame, released: DataFrame, row_id: str = "row_id") -> None:
    """Raise unless released ids are unique members of the population with positive sizes."""
    if not released.join(population, row_id, "left_anti").isEmpty():
        raise ValueError("released rows must belong to the original population")
    if not released.groupBy(row_id).count().where("count > 1").isEmpty():
        raise ValueError("released row ids must be unique")
    if not released.where(F.col("k").isNull() | (F.col("k") < 1)).isEmpty():
        raise ValueError("released class sizes must be positive")


def tail_risk(population: DataFrame, released: DataFrame, row_id: str = "row_id",
              check: bool = False) -> DataFrame:
    """P99 over the population of `-ln k`, an absent row counting as `-inf`.

    Inverse CDF at rank `ceil(0.99 N)`. Absent rows come first, then larger classes first, so the
    rank is found on the histogram of released sizes.
    """
    if check:
        check_released_ids(population, released, row_id)
    histogram = released.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = histogram.withColumn("upto", F.sum("n").over(upto))
    total = population.agg(F.count(F.lit(1)).alias("population_size"))
    released_size = histogram.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("released_size"))
    rank = F.ceil(F.lit(0.99) * F.col("population_size"))
    absent = F.col("population_size") - F.col("released_size")
    # Two one-row tables: the joins below add columns, not rows.
    sizes = total.join(F.broadcast(released_size))
    joined = F.broadcast(sizes).join(ranked, F.col("upto") >= rank - absent, "left")
    return (
        joined.groupBy("population_size", "released_size")
        .agg(F.max("k").alias("_k"))
        .select(
            F.when(rank <= absent, F.lit(float("-inf"))).otherwise(F.lit(0.0) - F.log(F.col("_k").cast("double")))
            .alias("tail_risk_p99"),
            "population_size", "released_size")
    )


def published_sizes(df: DataFrame, qis: Sequence[str], selected: str = "selected",
                    exempt: str = "exempt") -> DataFrame:
    """Published classes `(qis..., k)`: those with a selected non-exempt row.

    k counts these rows plus every exempt row of the class.
    """
    ordinary = F.sum(F.when(F.col(selected) & ~F.col(exempt), 1).otherwise(0))
    waived = F.sum(F.when(F.col(exempt), 1).otherwise(0))
    return (
        df.groupBy(*qis).agg(ordinary.alias("_ordinary"), waived.alias("_exempt"))
        .where(F.col("_ordinary") > 0)
        .select(*qis, (F.col("_ordinary") + F.col("_exempt")).alias("k"))
    )


def subset_class_counts(df: DataFrame, qis: Sequence[str], member: Column, exempt: str = "exempt") -> DataFrame:
    """Class counts over a subset of rows, exempt rows left out."""
    return retention_classes(df.where(member & ~F.col(exempt)), qis)


def privacy_signature(distribution: DataFrame) -> DataFrame:
    """`(min_k, -classes at min_k)`: the larger, the more private."""
    return distribution.select(
        F.col("leak_k").alias("min_k"), (-F.col("min_k_class_count")).alias("neg_min_classes"))
