"""Attack models and the sweep's classifier are fitted until their tolerance is met, and say where a limit came first."""

import pytest
from pyspark.sql import functions as F

from minim.operators import hierarchy_mondrian as H
from minim.operators.hierarchy import assign_leaves, nested_hierarchy
from minim.operators.model_attacks import linkage_attack, reconstruction_attack
from minim.operators.models import FIT_WAVES, FeatureSpace, fit_table
from minim.operators.release import Snapshot
from minim.plans.sweep import mondrian_sweep

FOREST = {"year": nested_hierarchy("year", {"early": ["1995 ~ 1998"], "late": ["1999 ~ 2002"]}, numeric=True),
          "town": nested_hierarchy("town", {"north": ["a", "b", "c"], "south": ["d", "e", "f"]})}


@pytest.fixture(scope="module")
def rows(spark):
    draw = F.pmod(F.xxhash64("id"), F.lit(1000))
    town = F.substring(F.lit("abcdef"), F.pmod(F.col("id") * 7 + (draw / 300).cast("int"), F.lit(6)).cast("int") + 1, F.lit(1))
    return spark.range(400).select((F.lit(1995) + F.pmod(F.col("id") + (draw / 400).cast("int"), F.lit(8))).cast("int").alias("year"), town.alias("town"),
                                   (draw < 300 + 60 * F.pmod("id", F.lit(6))).cast("int").alias("label"))


def test_attacks(spark, rows):
    released = assign_leaves(rows, FOREST).withColumn("snapshot", F.lit(0))
    space, snaps = FeatureSpace(FOREST).fit(released), [Snapshot(0, {"year": 0, "town": 0})]
    assert not any(r["limit_reached"] for r in reconstruction_attack(released, released, space, snaps).collect())
    assert not any(r["limit_reached"] for r in linkage_attack(released, released, space, snaps, ["year"], ["town"]).collect())
    assert linkage_attack(released, released, space, snaps, ["year"], ["town"], max_iter=1).first()["limit_reached"]


def test_sweep(spark, rows):
    assert not mondrian_sweep(rows, rows, FOREST, "label", [50], [H.MEDIAN]).first()["limit_reached"]
    assert mondrian_sweep(rows, rows, FOREST, "label", [50], [H.MEDIAN], max_iter=1).first()["limit_reached"]


def test_sweep_at_both_ends(spark, rows):
    """The smallest K and K = N, where the tree is one leaf."""
    out = {r["k"]: r for r in mondrian_sweep(rows, rows, FOREST, "label", [2, 400], [H.INFOGAIN]).collect()}
    assert out[2]["class_count"] > 1 and out[2]["min_k"] >= 2
    assert (out[400]["class_count"], out[400]["min_k"], out[400]["fallback_count"]) == (1, 400, 0)


def test_fits_get_even_partitions(spark):
    """A fit's rows are dealt over all cores, however few partitions they come in, and none is lost."""
    from pyspark.ml.linalg import Vectors
    rows = spark.createDataFrame([(i, i % 2, Vectors.dense([float(i)])) for i in range(400)], ["id", "label", "features"]).coalesce(1)
    made = fit_table(rows, "label")
    assert made.columns == ["label", "features"] and made.count() == 400
    assert made.rdd.getNumPartitions() >= FIT_WAVES * spark.sparkContext.defaultParallelism
