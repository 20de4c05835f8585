"""Spark ML's boosted trees, fitted on weighted combinations of bins instead of rows.

The trees look at a feature through its thresholds alone (at most 31), so rows that agree in the label and in the bins of all features
are one point whose weight is their number. Thresholds are those Spark ML finds on the rows; the trees are grown by Spark ML on
the points, over bin numbers, and get the thresholds back. There are never more points than rows: how many fewer depends on the features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minim.session import Scratch

#: Bins of a feature at most, Spark ML's default, and the rows (on average) that Spark ML looks for thresholds on, or all where there are fewer.
BINS, DRAWN = 32, 10_000
#: Combinations that one 64-bit number holds.
ROOM = 1 << 62


def thresholds(values: Sequence[float], counts: Sequence[int], expected: float, bins: int) -> list[float]:
    """Spark ML's thresholds of one feature: between all values where these are few, else near the quantiles.

    `values` are the ones other than zero that were seen; zeros make up for what is missing of `expected` rows.
    """
    seen, drawn = dict(zip(values, (float(c) for c in counts))), float(sum(counts))
    if not seen:
        return []
    if expected - drawn > 2.0**-52 * drawn * 100:
        seen[0.0] = expected - drawn
    v = sorted(seen)
    if len(v) <= bins:
        return [(a + b) / 2.0 for a, b in zip(v, v[1:])]
    out, stride = [], expected / bins
    total, goal = seen[v[0]], expected / bins
    for a, b in zip(v, v[1:]):
        before, total = total, total + seen[b]
        if abs(before - goal) < abs(total - goal):
            out.append((a + b) / 2.0)
            goal += stride
    return out


def find_thresholds(rows: DataFrame, features: str, count: int, width: int, seed: int) -> list[list[float]]:
    """Thresholds of every feature, from the same draw that Spark ML takes of these rows."""
    spark = rows.sparkSession
    rate = min(1.0, max(BINS * BINS, DRAWN) / count)
    drawn = rows
    if rate < 1:
        draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        drawn = DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.rdd().sample(False, rate, draw), rows._jdf.schema()), spark)
    values = (drawn.select(F.posexplode(vector_to_array(features)).alias("feature", "value")).where("value <> 0")
              .groupBy("feature", "value").count())

    def cut(table: pa.Table) -> pa.Table:
        cuts = thresholds(table["value"].to_pylist(), table["count"].to_pylist(), rate * count, min(BINS, count))
        return pa.table({"feature": table["feature"][:1], "cuts": pa.array([cuts], pa.list_(pa.float64()))})

    out: list[list[float]] = [[] for _ in range(width)]
    # At most 31 numbers per feature.
    for r in values.groupBy("feature").applyInArrow(cut, "feature int, cuts array<double>").collect():
        out[r["feature"]] = r["cuts"]
    return out


def words(cuts: Sequence[Sequence[float]]) -> list[list[int]]:
    """The features with thresholds, as many to a group as one number can tell the bins of."""
    out: list[list[int]] = [[]]
    room = 1
    for j, c in enumerate(cuts):
        if not c:
            continue
        if room * (len(c) + 1) > ROOM:
            out.append([])
            room = 1
        out[-1].append(j)
        room *= len(c) + 1
    return out


def binned_points(rows: DataFrame, label: str, features: str, cuts: Sequence[Sequence[float]]) -> DataFrame:
    """`(label, _k0, _k1, ..., weight)`: a number per group of `words` with the bins of its features, and the rows that have them."""
    groups, width = words(cuts), len(cuts)
    edges = [np.asarray(c) for c in cuts]
    keys = [f"_k{g}" for g in range(len(groups))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0)
            if x.null_count or x.flatten().null_count or (np.diff(x.offsets.to_numpy()) != width).any():
                raise ValueError(f"features are to be vectors of {width} numbers")
            values = x.flatten().to_numpy().reshape(-1, width)
            if not np.isfinite(values).all():
                raise ValueError("features hold NaN or infinite numbers")
            out = []
            for group in groups:
                key = np.zeros(len(values), np.int64)
                for j in group:
                    key = key * (len(edges[j]) + 1) + np.searchsorted(edges[j], values[:, j])
                out.append(key)
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, out)], names=[label, *keys])

    schema = ", ".join([f"`{label}` double", *(f"{k} bigint" for k in keys)])
    made = rows.select(vector_to_array(features).alias("_x"), F.col(label).cast("double").alias(label)).mapInArrow(run, schema)
    return made.groupBy(label, *keys).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def point_vectors(points: DataFrame, label: str, features: str, cuts: Sequence[Sequence[float]]) -> DataFrame:
    """The points with a vector of bin numbers, from 1 on."""
    groups, width = words(cuts), len(cuts)
    keys = [f"_k{g}" for g in range(len(groups))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ones((batch.num_rows, width))
            for key, group in zip(keys, groups):
                rest = batch.column(key).to_numpy()
                for j in reversed(group):
                    rest, at = np.divmod(rest, len(cuts[j]) + 1)
                    x[:, j] += at
            offsets = np.arange(0, (batch.num_rows + 1) * width, width, dtype=np.int32) if width else np.zeros(batch.num_rows + 1, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(label), batch.column("weight"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))], names=[label, "weight", "_x"])

    made = points.select(label, "weight", *keys).mapInArrow(run, f"`{label}` double, weight double, _x array<double>")
    return made.select(label, "weight", array_to_vector("_x").alias(features))


def on_values(model: GBTClassificationModel, cuts: Sequence[Sequence[float]], scratch: Scratch) -> GBTClassificationModel:
    """The model over bin numbers as one over the features' values: the split after bin b becomes its threshold."""
    spark, path = scratch.spark, f"{scratch.path}/model"
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data")
    # At most 2^(depth + 1) nodes per tree.
    found = [r.asDict(True) for r in nodes.collect()]
    for r in found:
        split = r["nodeData"]["split"]
        if split["featureIndex"] >= 0:
            # Halfway between two numbers: one apart, or two where the bin between them is that of the zeros made up, without a point.
            split["leftCategoriesOrThreshold"] = [float(cuts[split["featureIndex"]][math.ceil(split["leftCategoriesOrThreshold"][0]) - 2])]
    spark.createDataFrame(found, nodes.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def fit_points(rows: DataFrame, dealt: DataFrame, label: str, estimator: GBTClassifier) -> GBTClassificationModel:
    """The model that `estimator` fits to the rows; `dealt` are the same ones in the partitions of the fit, which the draw depends on."""
    features = estimator.getFeaturesCol()
    kinds = rows.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    if kinds.get("nominal") or kinds.get("binary"):
        # Categories have no thresholds.
        return estimator.fit(dealt)
    count, first = rows.count(), rows.first()
    if first is None:
        raise ValueError("no rows to fit")
    scratch, cores = Scratch(rows.sparkSession, "trees"), rows.sparkSession.sparkContext.defaultParallelism
    cuts = find_thresholds(dealt, features, count, len(first[features]), estimator.getSeed())
    points = scratch.save(binned_points(rows, label, features, cuts).repartition(2 * cores))
    # So many bins that Spark looks for thresholds on all points; a feature has no more than before.
    bins = max(BINS, math.isqrt(points.count()) + 1)
    model = estimator.copy({estimator.weightCol: "weight", estimator.maxBins: bins}).fit(point_vectors(points, label, features, cuts))
    scratch.drop(points)
    return on_values(model, cuts, scratch)
