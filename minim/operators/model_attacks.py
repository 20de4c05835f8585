"""Attribute reconstruction and strong linkage with fitted models.

The attacker sees released vectors of published training rows, fits a model to raw values, and is
scored on released vectors of rows it has not seen. Fitting and scoring are Spark ML jobs. A fit runs until its tolerance is met
or Spark's optimizer gives up on a step; `limit_reached` is true where `max_iter` steps came first (null where nothing was fitted).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minim.operators.attacks import baseline_predictor, target_value
from minim.operators.metrics import numeric_hit
from minim.operators.models import FeatureSpace

RESULT = "attr string, rows bigint, classes bigint, numeric boolean, accuracy double, baseline_accuracy double, leakage_gap double, limit_reached boolean"
MAX_ITER = 1000


def attack_attribute(train: DataFrame, test: DataFrame, space: FeatureSpace, snapshots: Sequence, target: str, numeric: bool,
                     tolerance: float = 0.0, max_iter: int = MAX_ITER) -> tuple:
    """Fit on published rows, score on held-out rows: one result row.

    Both tables carry leaf columns, `snapshot` and the raw target. A categorical target is
    skipped (no accuracy) with fewer than two classes, any target without valid rows.
    """
    known_train = train if not numeric else train.where(F.col(target).isNotNull())
    known_test = test if not numeric else test.where(F.col(target).isNotNull())
    rows = known_test.count()
    if numeric:
        if not rows or known_train.isEmpty():
            return (target, rows, 0, True, None, None, None, None)
        made = space.vectors(known_train, snapshots).withColumn("_y", F.col(target).cast("double"))
        model = LinearRegression(featuresCol="features", labelCol="_y", predictionCol="_p", regParam=1e-6, maxIter=max_iter).fit(made)
        tried = model.transform(space.vectors(known_test, snapshots))
        # One row.
        base = F.broadcast(baseline_predictor(known_train, target, True).withColumnRenamed("prediction", "_base"))
        one = tried.join(base).agg(F.avg(numeric_hit(F.col(target).cast("double"), F.col("_p"), tolerance)).alias("a"),
                                   F.avg(numeric_hit(F.col(target).cast("double"), F.col("_base"), tolerance)).alias("b")).first()
        return (target, rows, 0, True, one["a"], one["b"], one["a"] - one["b"], model.summary.totalIterations >= max_iter)
    made = space.vectors(known_train, snapshots).withColumn("_v", target_value(target))
    indexer = StringIndexer(inputCol="_v", outputCol="_y", stringOrderType="alphabetAsc").fit(made)
    classes = len(indexer.labels)
    if classes < 2 or not rows:
        return (target, rows, classes, False, None, None, None, None)
    model = LogisticRegression(featuresCol="features", labelCol="_y", predictionCol="_p", maxIter=max_iter, standardization=False).fit(indexer.transform(made))
    tried = model.transform(space.vectors(known_test, snapshots))
    # One entry per class; a class the attacker never saw is always a miss.
    names = F.array(*[F.lit(x) for x in indexer.labels])
    base = F.broadcast(baseline_predictor(known_train, target, False).withColumnRenamed("prediction", "_base"))
    one = tried.join(base).agg(
        F.avg((F.get(names, F.col("_p").cast("int")) == target_value(target)).cast("double")).alias("a"),
        F.avg((F.col("_base") == target_value(target)).cast("double")).alias("b")).first()
    return (target, rows, classes, False, one["a"], one["b"], one["a"] - one["b"], model.summary.totalIterations >= max_iter)


def reconstruction_attack(train: DataFrame, test: DataFrame, space: FeatureSpace, snapshots: Sequence, tolerances: dict[str, float] | None = None,
                          max_iter: int = MAX_ITER) -> DataFrame:
    """Predict every raw QI from the whole released encoding: one row per QI."""
    tolerances = tolerances or {}
    rows = [attack_attribute(train, test, space, snapshots, a, t.numeric, tolerances.get(a, 0.5), max_iter) for a, t in space.forest.items()]
    return train.sparkSession.createDataFrame(rows, RESULT)


def linkage_attack(train: DataFrame, test: DataFrame, space: FeatureSpace, snapshots: Sequence, known: Sequence[str], targets: Sequence[str],
                   tolerances: dict[str, float] | None = None, max_iter: int = MAX_ITER) -> DataFrame:
    """Predict raw QIs `targets` from the released QIs `known`; the two must not overlap."""
    if set(known) & set(targets) or not known or not targets:
        raise ValueError("known and target attributes must be disjoint and present")
    tolerances = tolerances or {}
    mean, std = [], []
    for a in known:
        span = space.block(space.forest[a])
        mean += space.mean[span]
        std += space.std[span]
    part = FeatureSpace({a: space.forest[a] for a in known}, (), mean, std)
    rows = [attack_attribute(train, test, part, snapshots, b, space.forest[b].numeric, tolerances.get(b, 0.5), max_iter) for b in targets]
    return train.sparkSession.createDataFrame(rows, RESULT)
