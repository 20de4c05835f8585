"""The removal-first loop as it runs, its candidates against all pairs of classes, and what must hold after every step."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from minim.operators import lockstep as K
from minim.operators import removal as D
from minim.operators.hierarchy import flat_hierarchy, nested_hierarchy
from minim.operators.release import Snapshot, node_columns
from minim.plans import removal_search as V
from minim.plans.minimize import MinimizeOptions, Search
from minim.session import Scratch

FOREST = {"kind": nested_hierarchy("kind", {"x": ["a", "b"], "y": ["c", "d", "e"]}),
          "age": nested_hierarchy("age", {"low": ["0 ~ 4", "5 ~ 9"], "high": ["10 ~ 14", "15 ~ 19"]}, numeric=True),
          "flag": flat_hierarchy("flag", ["p", "q"])}


def people(spark, n, seed, labels=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind, age = rng.choice("aabbbcddde"), min(19, int(rng.expovariate(0.2)))
        score = "abcde".index(kind) * 0.5 + age * 0.15 + rng.gauss(0, 1.2)
        rows.append((i, kind if rng.random() < 0.97 else None, age, rng.choice("ppq"), min(labels - 1, int(score > 2) + int(score > 3.2))))
    return spark.createDataFrame(rows, "row_id long, kind string, age int, flag string, label int")


@pytest.fixture(scope="module")
def halves(spark):
    return people(spark, 500, 1), people(spark, 200, 2)


def steps(result):
    return [tuple(r[c] for c in ("action", "candidate", "min_k", "min_k_class_count", "active_rows")) for r in result["iterations"]]


def test_the_loop(spark, halves):
    train, val = halves
    result = V.removal_search(train, val, FOREST, "label", V.RemovalOptions(max_iterations=6, tolerance=0.02))
    log = result["iterations"]
    assert log and result["termination"] in ("max_iterations_reached", "no_feasible_candidate", "no_positive_privacy_progress_candidate")
    pairs = [(r["min_k"], -r["min_k_class_count"]) for r in log]
    assert all(a < b for a, b in zip(pairs, pairs[1:])) and all(r["validation_loss"] <= result["threshold"] for r in log)
    # The state is a partition of the training rows with the logged privacy, and the proxy's loss is that of a fit of its own.
    cells = result["cells"]
    assert cells.agg(F.sum("n")).first()[0] == 500
    active = cells.where("active")
    assert active.agg(F.sum("n")).first()[0] == log[-1]["active_rows"]
    sizes = Counter(r["k"] for r in active.groupBy(*node_columns(FOREST, result["levels"])).agg(F.sum("n").alias("k")).collect())
    assert (min(sizes), sizes[min(sizes)]) == (log[-1]["min_k"], log[-1]["min_k_class_count"])
    search = Search(train, val, None, FOREST, "label", MinimizeOptions(max_fit_iterations=300))
    snap = [Snapshot(0, result["levels"])]
    model = search.fit(active.withColumn("snapshot", F.lit(0)), snap)
    alone = K.fit(active, [K.level_layout(search.space, result["levels"])], [K.Members()], "label", 2, 300, None)[0]
    assert alone.loss == pytest.approx(search.loss(model, active.withColumn("snapshot", F.lit(0)), snap), abs=1e-4)
    assert K.losses(search.val, [alone.params], [K.level_layout(search.space, result["levels"])], "label", 2)[0] == pytest.approx(log[-1]["validation_loss"], abs=1e-6)
    rows = V.removal_log(spark, result).collect()
    assert len(rows) == len(log) and {r["termination"] for r in rows} == {result["termination"]}
    assert V.removal_log(spark, {"iterations": [], "termination": "no_feasible_candidate"}).count() == 1


def test_the_page_does_not_matter(spark, halves):
    train, val = halves
    one, two = (V.removal_search(train, val, FOREST, "label", V.RemovalOptions(max_iterations=4, tolerance=0.004, page=p, growth=g)) for p, g in ((12, 4), (3, 1)))
    assert steps(one) == steps(two)


def test_three_labels(spark):
    result = V.removal_search(people(spark, 300, 3, 3), people(spark, 150, 4, 3), FOREST, "label", V.RemovalOptions(max_iterations=2, tolerance=0.05))
    assert len(result["iterations"]) == 2 and all(r["validation_loss"] <= result["threshold"] for r in result["iterations"])


@pytest.mark.parametrize("seed", range(3))
def test_candidates_at_the_smallest_size(spark, seed):
    """Against all classes and all pairs of classes: every candidate with progress, exchanges by their best score."""
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 1, 1, 2, 3, 5]), rng.gauss(0, 1), rng.choice([None, 1, 2, 2, 4]), rng.gauss(0, 1)) for i in range(30)]
    rows = [(i, a, s if a else None, r, t if r else None) for i, a, s, r, t in rows]
    classes = Scratch(spark, "test").save(spark.createDataFrame(rows, "k int, active_rows long, active_s double, removed_rows long, removed_s double"))
    least = D.bottom(classes, ["k"])
    active = {i: (a, s) for i, a, s, _, _ in rows if a}
    gone = {i: (r, t) for i, _, _, r, t in rows if r}
    n, total = sum(a for a, _ in active.values()), sum(s for _, s in active.values())

    def after(sizes):
        return (min(sizes), sizes.count(min(sizes))) if sizes else (0, 0)

    now = after([a for a, _ in active.values()])
    assert (least.rows, least.min_k, least.at_min, least.removed) == (n, *now, len(gone)) and least.s == pytest.approx(total)
    want = {}
    for i, (a, s) in active.items():
        k, c = after([b for j, (b, _) in active.items() if j != i])
        if k > now[0] or (k == now[0] and c < now[1]):
            want[i] = (k, c, n - a, -(a * total / n - s) / (n - a))
    got = {r["k"]: (r["next_k"], r["next_min_classes"], r["next_active_rows"], r["fast_utility_score"]) for r in D.removals_at_min(classes, ["k"], least).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i]) for i in got)
    best = {}
    for o, (a, s) in active.items():
        for i, (r, t) in gone.items():
            if r > a:
                continue
            sizes = {j: b for j, (b, _) in active.items() if j != o}
            sizes[i] = sizes.get(i, 0) + r
            k, c = after(list(sizes.values()))
            if k > now[0] or (k == now[0] and c < now[1]):
                key = (a, r, k, c if k == now[0] else 0)
                score = -((total - s + t) / (n - a + r) - total / n)
                best[key] = max(best.get(key, score), score)
    found = {}
    for r in D.exchanges_at_min(classes, ["k"], least).collect():
        if r["next_k"] > now[0] or r["next_min_classes"] < now[1]:
            key = (r["out_rows"], r["in_rows"], r["next_k"], r["next_min_classes"])
            found[key] = max(found.get(key, r["fast_utility_score"]), r["fast_utility_score"])
    assert set(found) == set(best) and all(found[k] == pytest.approx(best[k]) for k in best)


def test_moving_a_class_is_applying_a_membership(spark, halves):
    search = Search(*halves, None, FOREST, "label", MinimizeOptions())
    cells = search.cells.withColumn("active", F.xxhash64(*search.leaves) % 3 != 0)
    levels = {"kind": 1, "age": 1, "flag": 1}
    keys = [f"{a}__node" for a in FOREST]
    named = cells.select("*", *[c.alias(k) for c, k in zip(node_columns(FOREST, levels), keys)])
    listed = named.select(*keys).distinct().collect()
    for out, into in ((listed[0], listed[1]), (listed[-1], listed[0]), (listed[2], None)):
        moved = D.move_class(cells, FOREST, levels, tuple(out), into and tuple(into))
        table = [spark.createDataFrame([tuple(c)], ", ".join(f"{k} int" for k in keys)) if c else None for c in (out, into)]
        assert sorted(map(repr, moved.collect())) == sorted(map(repr, D.apply_membership(named, keys, *table).select(*cells.columns).collect()))


def test_scores_are_those_of_the_column_form(spark, halves):
    search = Search(*halves, None, FOREST, "label", MinimizeOptions())
    levels = {"kind": 1, "age": 0, "flag": 0}
    rng = random.Random(5)
    params, gradient = ([[rng.gauss(0, 0.4) for _ in range(search.space.width + 1)]] for _ in range(2))
    from minim.operators.models import Gradient, Linear, influence_scalar
    import numpy as np
    keys = [f"{a}__node" for a in FOREST]
    made = K.scored(search.cells, np.array(params), [K.level_layout(search.space, levels)], [[(0, np.array(gradient), 2.0)]], K.class_positions(search.space, levels),
                    keys, "label", ["n"])
    column = influence_scalar(search.space, Linear((tuple(params[0][:-1]),), (params[0][-1],)), Gradient((tuple(gradient[0][:-1]),), (gradient[0][-1],), 1.0), levels, "label")
    want = search.cells.select(*[c.alias(k) for c, k in zip(node_columns(FOREST, levels), keys)], "n", (column * 2).alias("s"))
    got = sorted((tuple(r)[:-1], round(r["s0"], 9)) for r in made.na.fill(-1).collect())
    assert got == sorted((tuple(r)[:-1], round(r["s"], 9)) for r in want.na.fill(-1).collect())
