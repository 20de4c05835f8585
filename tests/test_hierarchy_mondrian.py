"""Hierarchy Mondrian: known cuts, coverage, routing."""

import pytest
from pyspark.sql import functions as F

from minim.operators import hierarchy_mondrian as H
from minim.operators.hierarchy import nested_hierarchy


def forest(leaves=None):
    return {
        "age": nested_hierarchy("age", leaves or [str(i) for i in range(8)], root="age_root", numeric=True),
        "kind": nested_hierarchy("kind", [{"ab": ["a", "b"]}, "c"], root="kind_root"),
    }


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id int, age int, kind string, y int")


AGES = [(i, "a", int(i >= 2)) for i in range(8)]


@pytest.mark.parametrize("variant,threshold", [("median", 3.5), ("infogain", 1.5)])
def test_first_cut(spark, variant, threshold):
    fitted = H.fit_mondrian(frame(spark, AGES), forest(), "y", 2, variant)
    # The single kind is descended into first; the first numeric cut follows.
    first = fitted.nodes.where("kind = 'numeric'").orderBy("depth").first()
    assert first["threshold"] == threshold


def test_zero_gain_falls_back_to_median(spark):
    fitted = H.fit_mondrian(frame(spark, [(i, "a", 0) for i in range(8)]), forest(), "y", 2, "infogain")
    leaves = H.leaf_nodes(fitted).collect()
    assert len(leaves) == 4 and {r["size"] for r in leaves} == {2}


def test_coverage_and_k(spark):
    rows = [(i % 8, "abc"[i % 3], i % 2) for i in range(24)] + [(None, "a", 0), (None, "b", 1)]
    df = frame(spark, rows)
    for variant in ("median", "infogain"):
        fitted = H.fit_mondrian(df, forest(), "y", 2, variant)
        placed = H.mondrian_rows(df, fitted)
        sizes = placed.groupBy("path").count().collect()
        assert placed.where("path IS NULL").count() == 0
        assert sum(r["count"] for r in sizes) == len(rows) and min(r["count"] for r in sizes) >= 2
        assert H.published_k(fitted).agg(F.min("k")).first()[0] >= 2


def test_input_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(age):
        seen.add(1)
        return age

    df = frame(spark, AGES * 3).withColumn("age", F.udf(note, "int").asNondeterministic()("age"))
    fitted = H.fit_mondrian(df, forest(), "y", 2, "infogain")
    assert seen.value == 24
    assert H.leaf_nodes(fitted).agg(F.sum("size")).first()[0] == 24


def test_given_leaves_and_a_label_that_is_a_column_of_the_tree(spark):
    rows = [(i % 8, "abc"[i % 3], i % 2) for i in range(48)] + [(None, "a", 0)] * 3
    df = frame(spark, rows)
    plain = H.fit_mondrian(df, forest(), "kind", 2, "infogain")
    placed = H.mondrian_values(df, forest()).select("age", "kind", "age__leaf", "kind__leaf")
    given = H.fit_mondrian(placed, forest(), "kind", 2, "infogain", check=False)
    assert sorted(map(repr, plain.nodes.collect())) == sorted(map(repr, given.nodes.collect()))


def routed(spark, fitted, rows):
    df = frame(spark, rows)
    out = H.route_split_widening(df, fitted).collect()
    return {(r["age__value"], r["kind__value"]): r for r in out}


def test_empty_category_branch_goes_to_ancestor(spark):
    fitted = H.fit_mondrian(frame(spark, [(1, "a", 0)] * 4), forest(), "y", 2)
    got = routed(spark, fitted, [(1, "b", 0), (1, "c", 0), (7, "a", 0)])
    nodes = {r["path"]: r for r in H.node_regions(fitted).collect()}
    leaf_of = {v: i for i, v in enumerate(["a", "b", "c"])}
    b, c, a = (got[(1.0, float(leaf_of["b"]))], got[(1.0, float(leaf_of["c"]))], got[(7.0, float(leaf_of["a"]))])
    assert b["stop_kind"] != "leaf" and nodes[b["node"]]["kind__node"] == "ab"
    assert c["stop_kind"] != "leaf" and nodes[c["node"]]["kind__node"] == "kind_root"
    # At the leaf only age is widened, to the hierarchy root.
    assert a["stop_kind"] == "leaf" and a["kind__source"] == a["node"] and a["age__source"] == ""
    assert nodes[a["age__source"]]["age__hi"] == 7.0


def test_training_rows_reach_their_leaf_unwidened(spark):
    rows = [(i % 8, "abc"[i % 3], i % 2) for i in range(24)] + [(None, "a", 0), (None, "b", 1)]
    df = frame(spark, rows)
    fitted = H.fit_mondrian(df, forest(), "y", 2, "infogain")
    stats = H.routing_stats(H.route_split_widening(df, fitted), fitted.forest).first()
    assert stats["leaf_count"] == 26 and stats["widened_count"] == 0 and not stats["review_needed"]
    old = H.route_containment(df, fitted).groupBy("stop_kind").agg(F.sum("n")).collect()
    assert [tuple(r) for r in old] == [("leaf", 26)]


def test_review_flag_is_strict(spark):
    fitted = H.fit_mondrian(frame(spark, [(1, "a", 0)] * 4), forest(), "y", 2)
    rows = [(1, "a", 0)] * 99 + [(7, "a", 0)]
    stats = H.routing_stats(H.route_split_widening(frame(spark, rows), fitted), fitted.forest, 0.01).first()
    assert stats["adjusted_fraction"] == pytest.approx(0.01) and not stats["review_needed"]
    stats = H.routing_stats(H.route_split_widening(frame(spark, rows), fitted), fitted.forest, 0.009).first()
    assert stats["review_needed"]


def test_diagnosis_names_causes(spark):
    train = [(a, "a", a // 4) for a in (0, 0, 1, 1, 6, 6, 7, 7)]
    fitted = H.fit_mondrian(frame(spark, train), forest(), "y", 2)
    got = H.diagnose_routing(frame(spark, [(3, "a", 0), (0, "b", 0), (0, "a", 0)]), fitted)
    causes = {r["cause"]: r["rows"] for r in got.collect()}
    assert causes.pop("leaf") == 1 and sum(causes.values()) == 2
    assert any("split_numeric_observed_range_gap" in c for c in causes)


def test_values_outside_the_tree_are_refused(spark):
    with pytest.raises(ValueError):
        H.fit_mondrian(frame(spark, [(1, "z", 0)] * 4), forest(), "y", 2)


@pytest.mark.parametrize("lo,hi,mean,leaves,height", [(2, 9, 5.5, 2, 1), (0, 4, 2.0, 1, 0), (3, 12, 7.5, 3, 2)])
def test_region_representation(spark, lo, hi, mean, leaves, height):
    tree = nested_hierarchy("v", {"low": ["0 ~ 4", "5 ~ 9"], "high": ["10 ~ 14"]}, numeric=True)
    df = spark.createDataFrame([(float(lo), float(hi))], "lo double, hi double")
    got = H.region_representation(df, tree, "lo", "hi").first()
    assert (got["mean"], got["leaves"], got["height"]) == (mean, leaves, height)
