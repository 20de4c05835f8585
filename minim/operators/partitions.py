"""Fixed partitions: admission units that do not depend on equivalence classes.

Every function returns the rows with a `unit` column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minim.functions.ordering import seeded_key
from minim.operators.hierarchy import Forest, ensure_leaves, leaf_name
from minim.operators.keyed import attach, global_index, running_sums
from minim.operators.sampling import fold


def partition_sample(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One unit per row."""
    return df.withColumn("unit", F.col(row_id))


def partition_random(df: DataFrame, n: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """`n` random units whose sizes differ by at most one, the larger ones first."""
    return fold(df, n, None, seed, row_id).withColumnRenamed("fold", "unit")


def rings(df: DataFrame, cluster: str, distance: str, n_rings: int, name: str = "ring") -> DataFrame:
    """Ring of each row in its cluster: `floor((rank_min - 1) / (n - 1) * rings)`, clipped.

    Ranks come from running counts over distinct distances, so a cluster with a third of all rows
    is spread over the range partitions of that table.
    """
    histogram = df.groupBy(cluster, distance).agg(F.count(F.lit(1)).alias("_n"))
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("_size"))
    widest = sizes.agg(F.max("_size")).first()[0] or 0
    below = running_sums(histogram, [cluster], distance, ["_n"], widest)
    # One row per cluster.
    placed = below.join(F.broadcast(sizes), cluster)
    share = F.when(F.col("_size") > 1, (F.col("_n_upto") - F.col("_n")) / (F.col("_size") - 1)).otherwise(0.0)
    ring = F.least(F.floor(share * F.lit(n_rings)), F.lit(n_rings - 1)).cast("bigint")
    table = placed.select(cluster, distance, "_n", ring.alias(name))
    return attach(df, table, [cluster, distance], "_n").drop("_n")


def partition_kmeans_ring(
    df: DataFrame, features: Column, n_clusters: int, n_rings: int, seed: int,
) -> DataFrame:
    """KMeans cluster crossed with the distance ring inside it; unit text `cluster/ring`.

    The clustering is fitted by Spark ML; only the cluster centres reach the driver.
    """
    vectors = df.withColumn("_vector", array_to_vector(features))
    model = KMeans(k=n_clusters, seed=seed, featuresCol="_vector", predictionCol="cluster").fit(vectors)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    placed = model.transform(vectors)
    gap = F.zip_with(vector_to_array("_vector"), F.get(centres, F.col("cluster")),
                     lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x))
    placed = placed.withColumn("distance", distance).drop("_vector")
    return (rings(placed, "cluster", "distance", n_rings)
            .withColumn("unit", F.concat_ws("/", "cluster", "ring")))


def partition_leaf_bucket(df: DataFrame, forest: Forest, k: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """Rows in hierarchy leaf order cut into buckets of k; a short tail joins the last bucket.

    Missing leaves come last; ties follow the seeded row order.
    """
    rows = ensure_leaves(df, forest).withColumn("_key", seeded_key(seed, row_id))
    order = []
    for attr, tree in forest.items():
        name = f"_order_{attr}"
        rows = rows.withColumn(name, F.coalesce(F.col(leaf_name(attr)), F.lit(len(tree.leaves))))
        order.append(name)
    indexed = global_index(rows, [*order, "_key"], "_index")
    # The row count is the largest index plus one: an aggregate of one row.
    last = indexed.agg(F.greatest(F.floor((F.max("_index") + 1) / k) - 1, F.lit(0)).alias("_last"))
    return (indexed.join(F.broadcast(last))
            .withColumn("unit", F.least(F.floor(F.col("_index") / k), F.col("_last")).cast("bigint"))
            .drop("_index", "_last", "_key", *order))


def validate_partition(df: DataFrame, units: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One row: rows in several units, rows without one, rows outside the table, all counts."""
    seen = units.groupBy(row_id).agg(F.count(F.lit(1)).alias("n"))
    sides = df.select(row_id, F.lit(1).alias("known")).join(seen, row_id, "full")
    return sides.agg(
        F.count(F.when(F.col("n") > 1, 1)).alias("overlapping"),
        F.count(F.when(F.col("n").isNull(), 1)).alias("uncovered"),
        F.count(F.when(F.col("known").isNull(), 1)).alias("unknown"))


def start_unit(units: DataFrame) -> DataFrame:
    """The largest unit (smallest name on ties): the start state of a search over fixed units."""
    sizes = units.groupBy("unit").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.orderBy(F.desc("rows"), "unit").limit(1)


def unit_columns(units: DataFrame, keys: Sequence[str] = ("unit",)) -> DataFrame:
    return units.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
