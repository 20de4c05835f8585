"""Fits side by side against plain numpy: gradients, second derivatives, losses, moved classes, groups, several classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from minim.operators import lockstep as K
from minim.operators.hierarchy import flat_hierarchy, leaf_name, nested_hierarchy
from minim.operators.models import FeatureSpace

FOREST = {"kind": nested_hierarchy("kind", {"x": ["a", "b"], "y": ["c", "d", "e"]}),
          "age": nested_hierarchy("age", {"low": ["0 ~ 4", "5 ~ 9"], "high": ["10 ~ 14", "15 ~ 19"]}, numeric=True),
          "flag": flat_hierarchy("flag", ["p", "q"])}
LEVELS = [{"kind": 0, "age": 0, "flag": 0}, {"kind": 1, "age": 0, "flag": 0}, {"kind": 1, "age": 1, "flag": 1}]


def rows(classes, n=900, seed=1):
    rng = np.random.default_rng(seed)
    leaf = np.stack([rng.integers(-1, 5, n), rng.integers(-1, 4, n), rng.integers(-1, 2, n)], 1)
    size = rng.normal(size=n)
    score = np.stack([leaf[:, 0] * 0.3 * (c + 1) - leaf[:, 1] * 0.4 * c + size * 0.5 * c for c in range(classes)], 1) + rng.gumbel(size=(n, classes))
    return leaf, size, score.argmax(1), rng.integers(1, 5, n), rng.random(n) < 0.8


def cells(spark, classes):
    leaf, size, y, n, active = rows(classes)
    names = [leaf_name(a) for a in FOREST]
    made = [(*[None if x < 0 else int(x) for x in v], float(s), int(c), int(w), bool(a), int(g % 3)) for g, (v, s, c, w, a) in enumerate(zip(leaf, size, y, n, active))]
    return spark.createDataFrame(made, ", ".join(f"{c} int" for c in names) + ", size double, label int, n long, active boolean, tree int").repartition(3)


def space():
    rng = np.random.default_rng(3)
    s = FeatureSpace(FOREST, ("size",))
    return FeatureSpace(FOREST, ("size",), rng.random(s.width).tolist(), (0.5 + rng.random(s.width)).tolist())


def design(sp, leaf, size, levels):
    out = np.zeros((len(leaf), sp.width))
    for i, (a, t) in enumerate(FOREST.items()):
        for r, x in enumerate(leaf[:, i]):
            out[r, sp.block(t)] = sp.node_vector(t, None if x < 0 else t.climb(int(x), levels[a]))
    out[:, sp.offset["size"]] = (size - sp.mean[-1]) / sp.std[-1]
    return np.hstack([out, np.ones((len(leaf), 1))])


def reference(x, y, w, params):
    """Loss, gradient and second derivatives of weighted rows."""
    z = x @ params.T
    if len(params) == 1:
        p = 1 / (1 + np.exp(-z[:, 0]))
        loss = -(w * np.log(np.where(y == 1, p, 1 - p))).sum()
        g = ((p - y) * w) @ x
        return loss, g[None], (x * (w * p * (1 - p))[:, None]).T @ x
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = -(w * np.log(p[np.arange(len(y)), y])).sum()
    rest = p - np.eye(len(params))[y]
    h = np.block([[(x * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x for b in range(len(params))] for a in range(len(params))])
    return loss, (rest * w[:, None]).T @ x, h


def weights(leaf, n, active, levels, out, into):
    def inside(nodes):
        return np.array([all((-1 if x < 0 else t.position[t.climb(int(x), levels[a])]) == v for (a, t), x, v in zip(FOREST.items(), r, nodes)) for r in leaf])
    w = np.where(active, n, 0)
    if out:
        w = np.where(active & inside(out), 0, w)
    if into:
        w = np.where(~active & inside(into), n, w)
    return w


@pytest.mark.parametrize("classes", [2, 3])
def test_sums_and_second_derivatives(spark, classes):
    sp, df = space(), cells(spark, classes)
    leaf, size, y, n, active = rows(classes)
    rng = np.random.default_rng(9)
    shape = (1 if classes == 2 else classes, sp.width + 1)
    params = [rng.normal(size=shape) * 0.3 for _ in LEVELS]
    node = lambda a, v: FOREST[a].position[v]
    moves = [(None, None), ((node("kind", "x"), node("age", "5 ~ 9"), -1), None), ((node("kind", "y"), node("age", "high"), node("flag", "any")),
             (node("kind", "x"), -1, node("flag", "any")))]
    members = [K.Members(K.class_positions(sp, lv), *m) for lv, m in zip(LEVELS, moves)]
    layouts = [K.level_layout(sp, lv) for lv in LEVELS]
    found = K.sums(df, params, layouts, members, "label", classes)
    for lv, p, m, s in zip(LEVELS, params, moves, found):
        w = weights(leaf, n, active, lv, *m)
        x = design(sp, leaf, size, lv)
        loss, g, h = reference(x, y, w, p)
        assert s.weight == w.sum() and s.loss == pytest.approx(loss) and np.allclose(s.gradient, g)
        assert np.allclose(s.labels, np.bincount(y, weights=w, minlength=classes))
        if m == (None, None):
            weight = F.when(F.col("active"), F.col("n")).otherwise(0).cast("double")
            got = K.hessian(df, K.level_layout(sp, lv), p, K.level_probabilities(sp, p, lv), weight)
            assert np.allclose(got, h / w.sum()) and np.allclose(K.sums(df, [p], [K.level_layout(sp, lv)], [K.Members()], "label", classes, second=True)[0].second, h)
            assert np.allclose(K.hessian(df, K.level_layout(sp, lv), p, K.level_probabilities(sp, p, lv), weight, diagonal=True), np.diag(h) / w.sum())


@pytest.mark.parametrize("classes,newton,dense,direct", [(2, 400, 0, 1 << 26), (2, 0, 1000, 1 << 26), (2, 0, 0, 0), (3, 400, 0, 0), (3, 0, 1000, 1 << 26)])
def test_fits_reach_the_optimum(spark, monkeypatch, classes, newton, dense, direct):
    """By Newton steps, with the full and the diagonal start of others, and with sums added up in Spark; gradients vanish and losses agree."""
    monkeypatch.setattr(K, "NEWTON", newton)
    monkeypatch.setattr(K, "MAX_DENSE", dense)
    monkeypatch.setattr(K, "DIRECT_BYTES", direct)
    sp, df = space(), cells(spark, classes)
    leaf, size, y, n, active = rows(classes)
    start = np.zeros((1 if classes == 2 else classes, sp.width + 1))
    layouts = [K.level_layout(sp, lv) for lv in LEVELS]
    fitted = K.fit(df, layouts, [K.Members()] * 3, "label", classes, 300,
                   lambda: K.inverse_curvature(df, layouts[0], start, [F.lit(1.0 / classes)] * len(start), F.col("n").cast("double")))
    for f, lv in zip(fitted, LEVELS):
        w = np.where(active, n, 0)
        x = design(sp, leaf, size, lv)
        loss, g, _ = reference(x, y, w, f.params)
        assert not f.limit_reached and np.abs(g / w.sum()).max() < 1e-3 and f.loss == pytest.approx(loss / w.sum())
        p = np.zeros_like(start)
        for _ in range(60):
            lo, g, h = reference(x, y, w, p)
            p = p - (np.linalg.pinv(h, rcond=1e-10, hermitian=True) @ g.reshape(-1)).reshape(p.shape)
        assert f.loss == pytest.approx(reference(x, y, w, p)[0] / w.sum(), abs=1e-6)
        if newton:
            assert np.allclose(f.params, p, atol=1e-3)
    held = K.losses(df.drop("active"), [f.params for f in fitted], layouts, "label", classes)
    for f, lv, got in zip(fitted, LEVELS, held):
        assert got == pytest.approx(reference(design(sp, leaf, size, lv), y, n, f.params)[0] / n.sum())


def test_groups_limits_and_empty_models(spark):
    sp, df = space(), cells(spark, 2)
    leaf, size, y, n, _ = rows(2)
    layout = K.level_layout(sp, LEVELS[0])
    who = [K.Members(group=i) for i in (0, 1, 2, 7)]
    fitted = K.fit(df, [layout] * 4, who, "label", 2, 300, None, group="tree")
    for i in range(3):
        w = np.where(np.arange(len(y)) % 3 == i, n, 0)
        assert np.abs(reference(design(sp, leaf, size, LEVELS[0]), y, w, fitted[i].params)[1] / w.sum()).max() < 1e-3
    assert fitted[3].weight == 0 and not fitted[3].params.any()
    assert K.fit(df, [layout], who[:1], "label", 2, 1, None, group="tree")[0].limit_reached and K.fit(df, [], [], "label", 2, 1, None) == []
    assert K.sums(df, [], [], [], "label", 2) == []


@pytest.mark.parametrize("classes,solved", [(2, 2000), (3, 2000), (3, 0)])
def test_influence_agrees_with_a_dense_solve(spark, monkeypatch, classes, solved):
    """From sums per pair of leaves, and by conjugate gradients without the matrix."""
    from minim.operators import models as L

    monkeypatch.setattr(L, "MAX_SOLVED", solved)
    sp, df = space(), cells(spark, classes)
    leaf, size, y, _, active = rows(classes)
    rng = np.random.default_rng(4)
    params = rng.normal(size=(1 if classes == 2 else classes, sp.width + 1)) * 0.3
    x, ones = design(sp, leaf, size, LEVELS[1]), np.ones(len(y))
    grads = []
    for some in (active, ones > 0, ~active):
        _, g, h = reference(x[some], y[some], ones[some], params)
        grads.append(g.reshape(-1) / some.sum())
        if some.all():
            whole = h / len(y)
    step = np.linalg.solve(whole + 0.05 * np.eye(len(whole)), grads[0] - grads[1])
    estimate, got = L.influence(df, df.where("active"), df.where("NOT active"), sp, K.as_linear(params), LEVELS[1], "label", 0.5, 0.05)
    assert np.allclose(got, step, atol=1e-7) and estimate == pytest.approx(0.5 - grads[2] @ step)


def test_private_step_of_three_classes(spark):
    """Every row's gradient is cut to the bound, and the noise has its deviation."""
    from minim.operators import models as L

    sp, df = space(), cells(spark, 3).withColumn("row_id", F.monotonically_increasing_id())
    leaf, size, y, _, _ = rows(3)
    params = np.random.default_rng(4).normal(size=(3, sp.width + 1)) * 0.3
    x = design(sp, leaf, size, LEVELS[0])
    each = np.stack([reference(x[i:i + 1], y[i:i + 1], np.ones(1), params)[1].reshape(-1) for i in range(len(y))])
    each *= np.minimum(1, 1.5 / np.linalg.norm(each, axis=1))[:, None]
    g, n = L.dp_gradient_step(df, sp, K.as_linear(params), LEVELS[0], "label", 1.0, 1.5, 0.0, 1)
    assert n == len(y) and np.allclose(L.flat_gradient(g), each.mean(0))
    noisy = [L.flat_gradient(L.dp_gradient_step(df, sp, K.as_linear(params), LEVELS[0], "label", 1.0, 1.5, 2.0, seed)[0]) for seed in range(4)]
    off = (np.array(noisy) - each.mean(0)) * len(y) / 3.0
    assert abs(off.mean()) < 0.3 and 0.8 < off.std() < 1.2 and len({tuple(v) for v in noisy}) == 4
