"""Fits that pass over their rows many times do so over packed rows or points, and give the models Spark ML gives on the rows."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from minim.operators import binned_trees as B
from minim.operators import models as L
from minim.operators import perceptron as P


def table(spark, count, classes=2, seed=7):
    """Two indicators that take two values, a number of few values (one of them rare, zeros among them) and one of many."""
    draw = np.random.default_rng(seed)
    many, few = draw.normal(size=count), draw.integers(0, 5, count) * 0.5
    few[draw.integers(0, count, 3)] = 9.0
    a, b = draw.integers(0, 2, count), draw.integers(0, 2, count)
    y = np.clip((many + a - b + few / 3 + draw.normal(size=count) * 0.7 > 0.6).astype(int) + (classes > 2) * (few > 1.4), 0, classes - 1)
    rows = [(i, int(y[i]), Vectors.dense([a[i] * 2.0 - 0.7, many[i], b[i] * 1.5, few[i]])) for i in range(count)]
    return spark.createDataFrame(rows, ["id", "label", "features"]).coalesce(1)


def scores(model, rows):
    return np.array([r["p"] for r in L.class_probability(model, rows).orderBy("id").select("p").collect()])


def spied(monkeypatch, kind):
    """The number of rows of each fit by Spark ML."""
    seen, fit = [], kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, data, params=None: seen.append(data.count()) or fit(self, data, params))
    return seen


@pytest.mark.parametrize("count, room", [(2500, B.ROOM), (12_500, 8)])
def test_boosted_trees_see_points(spark, monkeypatch, count, room):
    """Spark grows the trees on combinations of bins, and the model is the one of the rows, also where its thresholds come from a draw."""
    rows = table(spark, count)
    plain = GBTClassifier(featuresCol="features", labelCol="label", maxIter=4, maxDepth=3, stepSize=0.1, seed=42).fit(L.fit_table(rows, "label"))
    monkeypatch.setattr(B, "ROOM", room)
    seen = spied(monkeypatch, GBTClassifier)
    model = L.fit_gbt(rows, trees=4)
    assert len(seen) == 1 and seen[0] <= 2 * 2 * 2 * 6 * 32
    assert np.abs(scores(model, rows) - scores(plain, rows)).max() < 1e-9
    assert [t.numNodes for t in model.trees] == [t.numNodes for t in plain.trees]


def test_points_hold_all_rows(spark):
    rows = table(spark, 2000).unionAll(table(spark, 2000))
    cuts = B.find_thresholds(rows, "features", 4000, 4, 42)
    assert [len(c) for c in cuts] == [1, 31, 1, 5]
    points = B.binned_points(rows, "label", "features", cuts)
    assert points.agg(F.sum("weight")).first()[0] == 4000
    weights = {(r["label"], *r["features"]): r["weight"] for r in B.point_vectors(points, "label", "features", cuts).collect()}
    assert len(weights) == points.count()
    one = rows.where("id = 17").first()
    key = (float(one["label"]), *(1.0 + np.searchsorted(c, x) for c, x in zip(cuts, one["features"])))
    assert weights[key] >= 2


def test_thresholds():
    assert B.thresholds([1.0, 3.0], [1, 1], 2.0, 32) == [2.0]
    assert B.thresholds([1.0, 3.0], [1, 1], 5.0, 32) == [0.5, 2.0]
    assert B.thresholds([], [], 5.0, 32) == []
    assert B.thresholds([float(i) for i in range(1, 101)], [1] * 100, 100.0, 4) == [25.5, 50.5, 75.5]


@pytest.mark.parametrize("classes", [2, 3])
def test_perceptron_as_spark(spark, monkeypatch, classes):
    """Spark's classifier sees a single row, and the weights are those it finds on all of them."""
    rows = table(spark, 3000, classes)
    plain = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[4, 32, 32, classes], seed=42, maxIter=12).fit(L.fit_table(rows, "label"))
    seen = spied(monkeypatch, MultilayerPerceptronClassifier)
    monkeypatch.setattr(L, "PLAIN_ROWS", 1000)
    model = L.fit_mlp(rows, 4, classes, max_iter=12)
    assert set(seen) == {1}
    assert np.abs(model.weights.toArray() - plain.weights.toArray()).max() < 1e-7


def test_perceptron_gradient():
    """Sums per combination and per row give the derivatives of the loss; few-valued columns are kept once per combination."""
    draw = np.random.default_rng(3)
    x = np.column_stack([draw.integers(0, 2, 700), draw.normal(size=700), draw.integers(0, 3, 700) - 1.0])
    y, layers = draw.integers(0, 3, 700).astype(float), [3, 5, 4, 3]
    piece = P.pack(x, y, 1 / 128)
    assert len(piece["starts"]) // 4 <= 6 and len(piece["other"]) == 700 * 8
    flat = draw.normal(size=3 * 5 + 5 + 5 * 4 + 4 + 4 * 3 + 3)
    grad, nothing = np.zeros_like(flat), np.zeros_like(flat)
    P.add_piece(piece, P.layer_weights(flat, layers), P.layer_weights(grad, layers), 3)
    for i in range(len(flat)):
        up, down = ([P.add_piece(piece, P.layer_weights(flat + s * (np.arange(len(flat)) == i), layers), P.layer_weights(nothing, layers), 3) for s in (1e-5, -1e-5)])
        assert abs((up - down) / 2e-5 - grad[i]) < 1e-6


def test_perceptron_refuses_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "PLAIN_ROWS", 0)
    good = [(i % 2, Vectors.dense([float(i)])) for i in range(6)]
    for bad in ((2, Vectors.dense([1.0])), (1, Vectors.dense([float("nan")])), (1, Vectors.dense([1.0, 2.0]))):
        with pytest.raises(Exception, match="labels are to be|features"):
            L.fit_mlp(spark.createDataFrame([*good, bad], ["label", "features"]), 1)


def test_search_ends_in_the_minimum():
    def valley(w):
        x, y = w
        return (1 - x) ** 2 + 100 * (y - x * x) ** 2, np.array([-2 * (1 - x) - 400 * x * (y - x * x), 200 * (y - x * x)])
    assert np.abs(P.minimize_smooth(valley, np.array([-1.2, 1.0]), 200, 1e-12) - 1).max() < 1e-4


def test_rows_in_many_partitions_stay(spark):
    """Only rows in fewer partitions than cores are dealt."""
    rows = spark.range(400).withColumn("label", F.col("id") % 2)
    cores = spark.sparkContext.defaultParallelism
    assert L.dealt(rows.repartition(cores + 1)).rdd.getNumPartitions() == cores + 1
    assert L.dealt(rows.coalesce(1)).rdd.getNumPartitions() == L.FIT_WAVES * cores
