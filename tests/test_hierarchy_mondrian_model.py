"""Hierarchy Mondrian against a recursive model on random tables."""

import math
import random

import pytest

from minim.operators import hierarchy_mondrian as H
from minim.operators.hierarchy import nested_hierarchy

TREES = {
    "age": nested_hierarchy("age", {"lo": ["0 ~ 3", "4 ~ 7"], "hi": ["8 ~ 11"]}, numeric=True),
    "kind": nested_hierarchy("kind", [{"ab": ["a", "b"]}, {"cd": ["c", "d"]}, "e"], root="kinds"),
    "flag": nested_hierarchy("flag", ["x", "y"], root="flags"),
}


def bits(rows):
    counts = {}
    for r in rows:
        counts[r["y"]] = counts.get(r["y"], 0) + 1
    return -sum(c / len(rows) * math.log2(c / len(rows)) for c in counts.values()) if rows else 0.0


def gain(rows, parts):
    return bits(rows) - sum(len(p) * bits(p) for p in parts) / len(rows)


def model(rows, k, variant):
    """Sets of row ids per leaf."""
    attrs = list(TREES)
    leaves = []

    def path(attr, value):
        tree = TREES[attr]
        return tree.paths[[tree.nodes[x].value for x in tree.leaves].index(value)]

    def walk(part, depth, missing):
        found = []
        for order, a in enumerate(attrs):
            tree = TREES[a]
            if tree.numeric:
                present = sorted((r for r in part if r[a] is not None), key=lambda r: r[a])
                lost = [r for r in part if r[a] is None]
                values = [r[a] for r in present]
                cuts = [i for i in range(1, len(values)) if values[i] != values[i - 1] and i >= k and len(values) - i >= k]
                if not cuts or 0 < len(lost) < k:
                    continue
                width = (values[-1] - values[0]) / 11
                middle = min(cuts, key=lambda i: (abs(i - len(values) / 2), i))
                sides = {i: [present[:i], present[i:], *([lost] if lost else [])] for i in cuts}
                gains = {i: gain(part, sides[i]) for i in cuts}
                top = max(gains.values())
                best = min((i for i in cuts if abs(gains[i] - top) <= 1e-12), key=lambda i: (abs(i - len(values) / 2), i))
                found.append((a, order, width, 0.0, sides[middle], "median"))
                found.append((a, order, width, top, sides[best], "infogain"))
                continue
            if a in missing:
                continue
            groups = {}
            ended = False
            for r in part:
                if r[a] is None:
                    groups.setdefault(None, []).append(r)
                    continue
                p = path(a, r[a])
                if len(p) <= depth[a] + 1:
                    ended = True
                    break
                groups.setdefault(p[depth[a] + 1], []).append(r)
            if ended or any(len(g) < k for g in groups.values()):
                continue
            entry = (a, order, len({r[a] for r in part}) / len(tree.leaves), gain(part, list(groups.values())), list(groups.values()), "both")
            if len(groups) == 1:
                found = [entry]
                chosen = entry
                break
            found.append(entry)
        else:
            chosen = None
        if chosen is None and variant == "infogain":
            informative = [f for f in found if f[5] != "median" and f[3] > 1e-12]
            if informative:
                chosen = max(informative, key=lambda f: (round(f[3], 10), f[2], -f[1]))
        if chosen is None:
            medians = [f for f in found if f[5] != "infogain"]
            chosen = max(medians, key=lambda f: (f[2], -f[1])) if medians else None
        if chosen is None:
            leaves.append(frozenset(r["row_id"] for r in part))
            return
        for sub in chosen[4]:
            if not sub:
                continue
            a = chosen[0]
            if TREES[a].numeric:
                walk(sub, depth, missing)
            elif sub[0][a] is None:
                walk(sub, depth, missing | {a})
            else:
                walk(sub, {**depth, a: depth[a] + 1}, missing)

    walk(rows, {a: 0 for a in attrs}, frozenset())
    return set(leaves)


@pytest.mark.parametrize("seed,k,variant", [(1, 4, "median"), (2, 6, "infogain"), (3, 9, "infogain")])
def test_matches_recursive_model(spark, seed, k, variant):
    rng = random.Random(seed)
    rows = [{"row_id": i, "age": rng.choice([None, None, *range(12)]), "kind": rng.choice("aabcde"), "flag": rng.choice(["x", "y", None]),
             "y": rng.randrange(3)} for i in range(130)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "row_id int, age int, kind string, flag string, y int")
    fitted = H.fit_mondrian(df, TREES, "y", k, variant)
    got = {}
    for r in H.mondrian_rows(df, fitted).select("row_id", "path").collect():
        got.setdefault(r["path"], set()).add(r["row_id"])
    assert {frozenset(v) for v in got.values()} == model(rows, k, variant)
    sizes = {r["path"]: r["size"] for r in H.leaf_nodes(fitted).collect()}
    assert sizes == {p: len(v) for p, v in got.items()}


@pytest.mark.parametrize("variant", [H.MEDIAN, H.INFOGAIN])
def test_split_windows_give_the_same_tree(spark, monkeypatch, variant):
    """Groups longer than one task's window: running sums across range partitions."""
    monkeypatch.setattr(H.keyed, "WINDOW_ROWS", 3)
    test_matches_recursive_model(spark, 1, 4, variant)
