"""K sweep of hierarchy Mondrian: privacy, routing and loss at every (variant, K).

All trees grow in the same passes, the validation cells descend all of them in one walk, and the models of all trees are fitted side by side
(`lockstep`): what runs follows the depth of the deepest tree and the steps of the slowest fit, not the number of points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minim.operators import hierarchy_mondrian as H
from minim.operators import lockstep as K
from minim.operators.classes import k_distribution_from_histogram
from minim.operators.hierarchy import Forest, leaf_name
from minim.operators.keyed import attach
from minim.operators.models import FeatureSpace
from minim.session import Scratch

MAX_ITER = 1000


def region_columns(rows: DataFrame, space: FeatureSpace) -> DataFrame:
    """Rows with regions, with `<attr>__mean` for each numeric QI; the node of a categorical one is there already."""
    out = rows
    for attr, tree in space.forest.items():
        if tree.numeric:
            out = H.region_representation(out, tree, f"{attr}__lo", f"{attr}__hi").drop("leaves", "height").withColumnRenamed("mean", f"{attr}__mean")
    return out


def sourced_regions(routed: DataFrame, fitted: H.FittedMondrian) -> DataFrame:
    """Region columns of routed cells, each QI taken from its own source node."""
    out = routed
    for attr in fitted.forest:
        mine = [f"{attr}__{c}" for c in ("lo", "hi", "node", "missing")]
        table = fitted.nodes.select(F.col("path").alias(f"{attr}__source"), F.col("size").alias("_size"), *mine)
        out = attach(out, table, [f"{attr}__source"], "_size").drop("_size")
    return out


def labelled_cells(df: DataFrame, forest: Forest, label: str) -> DataFrame:
    rows = H.mondrian_values(df, forest, check=False)
    return rows.groupBy(*[H.value_name(a) for a in forest], label).agg(F.count(F.lit(1)).alias("weight"))


def encoded(rows: DataFrame, forest: Forest, label: str, scratch: Scratch) -> DataFrame:
    """The rows' QIs, leaf positions and label, written once for all points."""
    return scratch.save(H.mondrian_values(rows, forest, check=False).select(*forest, *[leaf_name(a) for a in forest], label))


def _design(rows: DataFrame, space: FeatureSpace, label: str, prefixes: Sequence[str]) -> DataFrame:
    """Cells `(group, region columns, label, n)` from rows with regions, their tree's prefix in `tree`, and weights."""
    columns = [c for c, _, _ in K.region_layout(space).blocks] + [c for c, _, _, _ in K.region_layout(space).numbers]
    group = F.array_position(F.array(*[F.lit(p) for p in prefixes]), F.col("tree")).cast("int") - 1
    made = region_columns(rows, space).select(group.alias("group"), *columns, F.col(label), "n")
    return made.groupBy("group", *columns, label).agg(F.sum("n").alias("n"))


def training_cells(fitted: H.FittedMondrian, space: FeatureSpace, label: str) -> DataFrame:
    """The published training rows of every tree, by region and label."""
    counts = fitted.cells.groupBy("path").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(fitted.classes))])
    leaves = H.leaf_nodes(fitted).select("path", "size", *H.region_columns(fitted.forest))
    both = attach(counts, leaves, ["path"], "size")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias(label), F.col(f"c{i}").alias("n")) for i, c in enumerate(fitted.classes)]))
    rows = both.select(H.tree_of(F.col("path")).alias("tree"), *H.region_columns(fitted.forest), each.alias("e")).select("*", "e.*").drop("e").where("n > 0")
    return _design(rows, space, label, list(fitted.trees))


def evaluation_cells(routed: DataFrame, cells: DataFrame, fitted: H.FittedMondrian, space: FeatureSpace, label: str) -> DataFrame:
    """The routed evaluation rows of every tree, by region and label; `cells` are `labelled_cells` of the rows."""
    values = fitted.values
    found = sourced_regions(routed.select(*values, "node", *[f"{a}__source" for a in fitted.forest]), fitted)
    found = found.select(*[F.col(v).alias(f"_{v}") for v in values], H.tree_of(F.col("node")).alias("tree"), *H.region_columns(fitted.forest))
    same = [F.col(v).eqNullSafe(F.col(f"_{v}")) for v in values]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    # One row per combination of values and tree on one side, one per combination and label on the other.
    rows = cells.withColumnRenamed("weight", "n").join(found, condition).drop(*values, *[f"_{v}" for v in values])
    return _design(rows, space, label, list(fitted.trees))


def fit_points(cells: DataFrame, space: FeatureSpace, trees: int, label: str, classes: int, max_iter: int) -> list[K.Fitted]:
    """The logistic model of every tree."""
    layout, rows = K.region_layout(space), 1 if classes <= 2 else classes

    def near():
        # Without parameters every class is as likely: the second derivatives over all trees start the steps of each.
        flat = [F.lit(1.0 / max(classes, 2))] * rows
        return K.inverse_curvature(cells, layout, np.zeros((rows, space.width + 1)), flat, F.col("n").cast("double"))

    return K.fit(cells, [layout] * trees, [K.Members(group=i) for i in range(trees)], label, classes, max_iter, near, group="group")


def sweep_points(train: DataFrame, val: DataFrame, forest: Forest, label: str, space: FeatureSpace, points: Sequence[tuple[str, int]],
                 max_iter: int = MAX_ITER) -> list[dict]:
    """Per (variant, K): min-K and percentiles, P99 tail risk, routing, validation loss of a logistic model and whether its fit reached `max_iter`."""
    scratch = Scratch(train.sparkSession, "sweep")
    fitted = H.fit_trees(train, forest, label, H.numbered_trees(points), check=False, scratch=scratch)
    prefixes = list(fitted.trees)
    if list(fitted.classes) != list(range(len(fitted.classes))):
        raise ValueError("labels must be 0..C-1")
    dist = {r["tree"]: r for r in k_distribution_from_histogram(H.published_histogram(fitted, per_tree=True), ["tree"]).collect()}
    cells = scratch.save(training_cells(fitted, space, label))
    models = fit_points(cells, space, len(points), label, len(fitted.classes), max_iter)
    routed = scratch.save(H.route_split_widening(val, fitted, check=False))
    stats = {r["tree"]: r for r in H.routing_stats(routed, forest, per_tree=True).collect()}
    tried = scratch.save(evaluation_cells(routed, labelled_cells(val, forest, label), fitted, space, label))
    layout = K.region_layout(space)
    losses = K.losses(tried, [m.params for m in models], [layout] * len(points), label, len(fitted.classes),
                      [K.Members(group=i) for i in range(len(points))], group="group")
    out = []
    for prefix, (variant, k), model, loss in zip(prefixes, points, models, losses):
        d, s = dist[prefix], stats[prefix]
        out.append({"variant": variant, "k": int(k), "min_k": d["leak_k"], "leak_k_p1": d["leak_k_p1"], "class_count": d["class_count"],
                    "tail_risk_p99": -math.log(d["risk_k"]), "validation_loss": loss, "fallback_count": s["fallback_count"],
                    "widened_count": s["widened_count"], "review_needed": s["review_needed"], "limit_reached": model.limit_reached,
                    "record_count": d["record_count"], "routed_count": s["population"]})
    scratch.drop(cells, routed, tried, fitted.cells, fitted.nodes)
    return out


def sweep_point(train: DataFrame, val: DataFrame, forest: Forest, label: str, space: FeatureSpace, k: int, variant: str, max_iter: int = MAX_ITER) -> dict:
    """One point of the sweep by itself."""
    return sweep_points(train, val, forest, label, space, [(variant, int(k))], max_iter)[0]


def mondrian_sweep(train: DataFrame, val: DataFrame, forest: Forest, label: str, ks: Sequence[int], variants: Sequence[str] = (H.MEDIAN, H.INFOGAIN),
                   max_iter: int = MAX_ITER) -> DataFrame:
    """One row per (variant, K)."""
    scratch = Scratch(train.sparkSession, "sweep-rows")
    train, val = encoded(train, forest, label, scratch), encoded(val, forest, label, scratch)
    space = FeatureSpace(forest).fit(train)
    found = sweep_points(train, val, forest, label, space, [(v, int(k)) for v in variants for k in ks], max_iter)
    return train.sparkSession.createDataFrame(
        [tuple(list(r.values())[:11]) for r in found],
        "variant string, k bigint, min_k bigint, leak_k_p1 double, class_count bigint, tail_risk_p99 double, validation_loss double, "
        "fallback_count bigint, widened_count bigint, review_needed boolean, limit_reached boolean")
