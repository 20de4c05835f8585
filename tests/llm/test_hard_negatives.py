"""Mined negatives against brute force: ties, repeated rows, odd vectors, empty tables, scores beyond doubles and longs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from minim.llm import hard_negatives
from minim.llm.hard_negatives import mine_hard_negatives, pack_pair, unpack_pair

SCHEMA = "vec_id long, embedding array<double>, label int, anchor_id string, key int, at int"


def plain(rows, anchors, positives=5, negatives=5, low=80, high=100):
    """`rows` of (id, vector, label); each anchor id asks once, equal (score, id) pairs count once."""
    def whole(v):
        return [math.floor(256 * x) for x in v]

    usable = sorted({(i, y, tuple(whole(v))) for i, v, y in rows
                     if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    asked = set()
    for i, y, v in usable:
        if i in asked or not anchors(i):
            continue
        asked.add(i)
        scored = sorted({(-sum(a * b for a, b in zip(v, w)), j, z == y) for j, z, w in usable if j != i})
        for p, j, same in [s for s in scored if s[2]][:positives]:
            mine = [s for s in scored if not s[2] and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            cut = [max(-2**63, min(2**63 - 1, -s[0])) for s in mine]
            out += [(i, j, r + 1, s[1], max(-2**63, min(2**63 - 1, -p)), c) for r, (s, c) in enumerate(zip(mine, cut))]
    return sorted(out)


def run(spark, rows, every=10, **options):
    rows = [(i, v and [x if x is None else float(x) for x in v], y) for i, v, y in rows]
    df = spark.createDataFrame([(i, v, y, "x", 1, 2) for i, v, y in rows], SCHEMA).repartition(3)
    found = mine_hard_negatives(df, F.col("vec_id") % every == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def vectors(rng, n, width=6, grain=8):
    return [(i, [rng.randrange(-grain, grain + 1) / 16 for _ in range(width)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("block,state", [(4096, 8), (16, 1)])
def test_agrees_with_brute_force(spark, monkeypatch, block, state):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "OPEN_BLOCKS", state)
    rows = vectors(random.Random(1), 160)
    want = plain(rows, lambda i: i % 10 == 0)
    assert want and run(spark, rows) == want


def test_one_vector_held_by_most_rows(spark):
    rng = random.Random(2)
    rows = vectors(rng, 60) + [(100 + i, [0.5, 0.25, 0, 0, 0, 0.5], 1) for i in range(150)]
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_repeated_rows_and_ids(spark):
    rows = vectors(random.Random(3), 40)
    rows += rows[:15] + [(10, [0.5] * 6, 2), (11, [0.25] * 6, 0)]
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    rows = vectors(random.Random(4), 50)
    rows += [(None, [1.0] * 6, 1), (60, None, 1), (70, [1.0] * 6, None), (80, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (90, [float("nan")] * 6, 1),
             (100, [float("inf")] * 6, 1), (110, [], 1), (120, [0.5], 1), (130, [0.5] * 9, 2), (-10, [0.5] * 6, 0)]
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_large_components(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1e9, 3e11, -2e10, 5.5]) for _ in range(3)], rng.randrange(2)) for i in range(40)]
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_negative_and_zero_scores(spark):
    rows = [(0, [1.0], 0), (1, [-1.0], 0), (2, [0.0], 0), (3, [0.0], 1), (4, [-0.9], 1), (5, [0.5], 1)]
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0) == [(0, 2, 1, 3, 0, 0)]


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert run(spark, [(10, [1.0], 0)]) == []


def test_options(spark):
    rows = vectors(random.Random(6), 80)
    assert run(spark, rows, positives=2, negatives=9, low=30, high=90) == plain(rows, lambda i: i % 10 == 0, 2, 9, 30, 90)


def test_pairs_sort_by_anchor_score_kind_and_id():
    pairs = [(a, s, k, i) for a in (-3, 0, 2**40) for s in (-2**70, -1, 0, 5, 2**70) for k in (b"\0", b"\1") for i in (-2**63, -1, 0, 9, 2**63 - 1)]
    shuffled = sorted((pack_pair(*p) for p in random.Random(7).sample(pairs, len(pairs))))
    assert [unpack_pair(k) for k in shuffled] == sorted(pairs, key=lambda p: (p[0], -p[1], p[2], p[3]))
