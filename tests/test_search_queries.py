"""Search queries run their operators with the operators' own options."""

from pyspark.sql import functions as F

from minim.checks import search
from minim.plans import sweep


def test_mondrian_sweep_takes_the_whole_grid(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(search, "split", lambda spark, sf_dir: (spark.range(1000), None, None))
    monkeypatch.setattr(sweep, "mondrian_sweep", lambda train, val, forest, label, ks, *rest: seen.append((list(ks), rest)))
    search.mondrian_sweep(spark, "")
    assert seen == [([2, 4, 8, 12, 16, 32, 64, 128, 235, 256, 1000], ())]


def test_the_sweep_agrees_with_single_trees(spark):
    """All points at once against each by itself, and the trees of `fit_trees` against `fit_mondrian`."""
    from minim.checks.tables import people, people_forest
    from minim.operators import hierarchy_mondrian as H
    from minim.operators.models import FeatureSpace
    from minim.operators.hierarchy import leaf_name

    forest = people_forest()
    rows = people(spark, "/root/testdata/sf0.001")
    train, val = (H.mondrian_values(rows.where(f"row_id % 10 {c} 0"), forest, check=False).select(*forest, *[leaf_name(a) for a in forest], "label")
                  for c in ("<>", "="))
    space = FeatureSpace(forest).fit(train)
    points = [(H.MEDIAN, 40), (H.INFOGAIN, 40), (H.MEDIAN, 200)]
    together = sweep.sweep_points(train, val, forest, "label", space, points)
    for (variant, k), got in zip(points, together):
        alone = sweep.sweep_point(train, val, forest, "label", space, k, variant)
        assert abs(alone.pop("validation_loss") - got.pop("validation_loss")) < 1e-5
        assert alone == got
    many = H.fit_trees(train, forest, "label", H.numbered_trees(points), check=False)
    one = H.fit_mondrian(train, forest, "label", 40, H.INFOGAIN, check=False)
    mine = sorted(repr(tuple(r)) for r in one.nodes.collect())
    theirs = many.nodes.where("path LIKE '1:%'").withColumn("path", F.substring("path", 3, 1_000_000))
    assert mine == sorted(repr(tuple(r)) for r in theirs.collect())
