"""Keyed operations, classes, sampling, hierarchies and analytics with hand values."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from minim.functions.ordering import seeded_key
from minim.operators import analytics as N
from minim.operators import classes as C
from minim.operators import clean as K
from minim.operators import hierarchy as H
from minim.operators import keyed, partitions
from minim.operators import sampling as P
from minim.operators import release as R


def hot(spark, n=600):
    """One key owns a third of the rows, one key is NULL."""
    return spark.range(n).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") < n // 3, "hot").when(F.col("id") < n // 2, None).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"),
        seeded_key(1, "id").alias("h"))


def test_attach_matches_null_and_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HEAVY_KEYS", 2)
    df = hot(spark)
    got = C.per_record_k(df, ["key"]).select("row_id", "k").collect()
    assert len(got) == 600
    want = {}
    for r in df.collect():
        want.setdefault(r["key"], []).append(r["row_id"])
    size = {i: len(v) for v in want.values() for i in v}
    assert all(size[r["row_id"]] == r["k"] for r in got)


def test_heavy_rows_are_scattered(spark):
    df = hot(spark)
    plan = C.per_record_k(df, ["key"])._jdf.queryExecution().toString()
    assert "_slot" in plan and "Broadcast" in plan


@pytest.mark.parametrize("digits", [1, 2])
def test_rank_and_first_rows(spark, digits):
    df = hot(spark)
    rows = df.collect()
    ranked = {r["row_id"]: r["rank"] for r in keyed.rank_by_key(df, ["key"], "h", digits=digits).collect()}
    groups = {}
    for r in sorted(rows, key=lambda r: r["h"]):
        groups.setdefault(r["key"], []).append(r["row_id"])
    assert ranked == {i: p for v in groups.values() for p, i in enumerate(v)}
    got = {r["row_id"] for r in keyed.first_rows(df, ["key"], "h", 9).collect()}
    assert got == {i for v in groups.values() for i in v[:9]}


def test_global_index_and_leaf_buckets(spark):
    df = hot(spark)
    got = {r["row_id"]: r["index"] for r in keyed.global_index(df, ["key", "h"]).collect()}
    order = sorted(df.collect(), key=lambda r: (r["key"] is not None, r["key"] or "", r["h"]))
    assert got == {r["row_id"]: i for i, r in enumerate(order)}
    tree = {"key": H.flat_hierarchy("key", ["hot", *[f"k{i}" for i in range(40)]])}
    units = partitions.partition_leaf_bucket(df, tree, 70, 1).groupBy("unit").count().collect()
    assert sorted(r["count"] for r in units) == [70] * 7 + [110]


def test_running_sums_on_range_partitions(spark, monkeypatch):
    table = spark.range(200).select(F.when(F.col("id") < 150, "hot").otherwise("cold").alias("g"), F.col("id").alias("o"), F.lit(2).alias("v"))
    plain = keyed.running_sums(table, ["g"], "o", ["v"], 10).select("g", "o", "v_upto", "v_total")
    monkeypatch.setattr(keyed, "WINDOW_ROWS", 5)
    spread = keyed.running_sums(table, ["g"], "o", ["v"], 10).select("g", "o", "v_upto", "v_total")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, spread.collect()))


def test_tail_risk_cases(spark):
    population = spark.range(100).withColumnRenamed("id", "row_id")
    released = spark.range(50).select(F.col("id").alias("row_id"), (F.col("id") + 1).alias("k"))
    assert C.tail_risk(population, released).first()["tail_risk_p99"] == pytest.approx(-math.log(2))
    assert C.tail_risk(population, released.limit(0)).first()["tail_risk_p99"] == float("-inf")
    stranger = spark.createDataFrame([(1000, 1)], "row_id bigint, k bigint")
    with pytest.raises(ValueError):
        C.tail_risk(population, stranger, check=True)


def test_raw_sizes_differ_from_binned(spark):
    df = spark.createDataFrame([(0, 0, "a"), (1, 0, "a"), (2, 1, "a"), (3, 1, "a")], "row_id int, age int, kind string")
    tree = {"age": H.nested_hierarchy("age", ["0 ~ 7"], numeric=True), "kind": H.flat_hierarchy("kind", ["a"])}
    assert [r["k"] for r in C.per_record_k(df, ["age", "kind"]).collect()] == [2, 2, 2, 2]
    assert C.retention_classes(H.generalize(df, tree, {}), ["age", "kind"]).count() == 1


def test_coarsening_never_lowers_min_k(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.choice("abc"), rng.randrange(8)) for i in range(120)], "row_id int, kind string, age int")
    tree = {"kind": H.nested_hierarchy("kind", [{"ab": ["a", "b"]}, "c"], root="kind_root"),
            "age": H.nested_hierarchy("age", {"low": [str(i) for i in range(4)], "high": [str(i) for i in range(4, 8)]}, numeric=True)}
    ks = [C.min_k(H.generalize(df, tree, {"kind": a, "age": b}), ["kind", "age"]).first()[0] for a, b in ((0, 0), (1, 0), (1, 1), (2, 1), (2, 2))]
    assert ks == sorted(ks)


def test_uneven_tree_climbs_past_the_level():
    tree = H.nested_hierarchy("kind", [{"ab": ["a", "b"]}, "c"], root="top")
    assert tree.targets(1) == ["ab", "ab", "top"] and tree.targets(0) == ["a", "b", "c"]
    assert tree.category_weights("ab") == [0.5, 0.5, 0.0]
    spans = H.nested_hierarchy("v", {"x": ["0 ~ 4", "5 ~ 9"], "y": ["10 ~ 14"]}, numeric=True)
    assert spans.numeric_value("x") == 4.5 and spans.numeric_value("any") == 7.0
    with pytest.raises(ValueError):
        H.Hierarchy("bad", [H.Node("r", None), H.Node("s", None)])
    with pytest.raises(ValueError):
        H.Hierarchy("bad", [H.Node("r", None), H.Node("a", "b"), H.Node("b", "a")])


def test_dedup_before_limit(spark):
    df = spark.createDataFrame([(0, 30, 10, "NO"), (1, 20, 20, ">30"), (2, 10, 10, "<30")], "pos int, enc int, pat int, y string")
    first = K.first_per_entity(df, "pat", "enc", "pos")
    labelled = K.map_label(first, "y", {"NO": 0, ">30": 1, "<30": 1})
    assert [(r["pos"], r["y"]) for r in K.limit_rows(labelled, 1, "pos").collect()] == [(1, 1)]
    assert [(r["pos"], r["y"]) for r in K.limit_rows(labelled, None, "pos").orderBy("pos").collect()] == [(1, 1), (2, 1)]
    with pytest.raises(Exception, match="unknown label"):
        K.map_label(first, "y", {"NO": 0}).collect()


def test_k_grid(spark):
    got = sorted(r["k"] for r in N.k_grid(spark.range(1000)).collect())
    assert got == [2, 4, 8, 12, 16, 32, 64, 128, 235, 256, 1000]


def test_student_t():
    # 0.95 quantiles from published tables.
    for df, t in ((1, 6.3137515), (2, 2.9199856), (4, 2.1318468), (9, 1.8331129), (30, 1.6972609)):
        assert N.student_t_quantile(0.95, df) == pytest.approx(t, abs=1e-6)


def test_split_and_sample(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 20, 1).otherwise(0).alias("y"))
    counts = {(r["y"], r["split"]): r["count"] for r in P.stratified_split(df, "y", 0.15, 0.15, 5).groupBy("y", "split").count().collect()}
    assert counts == {(0, "test"): 147, (0, "val"): 147, (0, "train"): 686, (1, "test"): 3, (1, "val"): 3, (1, "train"): 14}
    sample = P.label_covering_sample(df, "y", 10, 5)
    assert sample.count() == 10
    P.check_label_coverage(df, sample, "y")
    folds = P.fold(df, 3, None, 5).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in folds] == [334, 333, 333]
    assert P.covering_quotas([("a", 97), ("b", 2), ("c", 1)], 3) == [("a", 1), ("b", 1), ("c", 1)]
    with pytest.raises(ValueError):
        P.covering_quotas([("a", 1), ("b", 1)], 1)


def test_split_evaluates_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(y):
        seen.add(1)
        return y

    df = spark.range(1000).select(F.col("id").alias("row_id"), F.udf(note, "int").asNondeterministic()(F.expr("CAST(id % 50 = 0 AS INT)")).alias("y"))
    rows = P.stratified_split(df, "y", 0.15, 0.15, 5)
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    assert counts == {"test": 150, "val": 150, "train": 700} and rows.where("split = 'train'").count() == 700
    assert seen.value == 1000


@pytest.mark.parametrize("digits", [1, 6])
def test_split_is_exact_where_many_keys_share_their_head(spark, monkeypatch, digits):
    monkeypatch.setattr("minim.functions.ordering.MAX_DIGITS", digits)
    df = spark.range(1000).selectExpr("id AS row_id", "CAST(id % 3 = 0 AS INT) AS y")
    got = {r["row_id"]: r["split"] for r in P.stratified_split(df, "y", 0.15, 0.15, 5).collect()}
    want = {}
    for y in (0, 1):
        ids = sorted((i for i in range(1000) if int(i % 3 == 0) == y), key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())
        t = P.round_half_up(0.15 * len(ids))
        v = P.round_half_up(0.15 / (1.0 - 0.15) * (len(ids) - t))
        want.update({i: "test" if n < t else "val" if n < t + v else "train" for n, i in enumerate(ids)})
    assert got == want


def test_release_publishes_each_row_once(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.choice(["a", "b", "c", None]), rng.randrange(8)) for i in range(200)], "row_id int, kind string, age int")
    tree = {"kind": H.nested_hierarchy("kind", [{"ab": ["a", "b"]}, "c"], root="kind_root"),
            "age": H.nested_hierarchy("age", {"low": [str(i) for i in range(4)], "high": [str(i) for i in range(4, 8)]}, numeric=True)}
    steps = [R.Snapshot(-1, {"kind": 2, "age": 2}), R.Snapshot(0, {"kind": 1, "age": 1}), R.Snapshot(1, {"kind": 0, "age": 0})]
    rel = R.materialize_release(R.leaf_cells(df, tree), tree, steps, 9)
    rows = R.release_rows(df, tree, rel)
    assert rows.count() == 200 and rows.select("row_id").distinct().count() == 200
    stats = R.release_stats(rel, tree).first()
    assert stats["min_k"] >= 9 and stats["row_count"] + stats["suppressed_row_count"] == 200
    saved = rows.where("snapshot IS NOT NULL").select("row_id", "snapshot")
    again = R.rebuild_release(df, saved, tree, steps, 9)
    assert again.count() == stats["row_count"]
    with pytest.raises(ValueError):
        R.rebuild_release(df, saved.unionAll(saved.limit(1)), tree, steps, 9)
    with pytest.raises(ValueError):
        R.rebuild_release(df, saved, tree, steps, 500)


def test_large_and_overlapping_interval_trees(spark):
    import bisect

    from minim.operators.hierarchy import Hierarchy, Node, assign_leaves, count_below

    wide = Hierarchy("v", [Node("any", None)] + [Node(f"l{i}", "any", f"{3 * i} ~ {3 * i + 1}") for i in range(20_000)], numeric=True)
    values = [(float(v),) for v in (-1, 0, 1, 2, 3, 29_999, 59_997, 59_998, 59_999, 0.5, 2.5)]
    got = assign_leaves(spark.createDataFrame(values + [(None,)], "v double"), {"v": wide}).collect()
    for r in got:
        inside = r["v"] is not None and 0 <= r["v"] <= 59_998 and r["v"] % 3 <= 1
        assert r["v__leaf"] == (int(r["v"] // 3) if inside else None), r
    rng = random.Random(4)
    spans = [(a, a + rng.randrange(40)) for a in (rng.randrange(3000) for _ in range(1500))]
    nodes = [Node("any", None)] + [Node(f"l{i}", "any", f"{a} ~ {b}") for i, (a, b) in enumerate(spans)]
    tree = Hierarchy("v", nodes, numeric=True)
    leaves = [(tree.nodes[x].lo, tree.nodes[x].hi) for x in tree.leaves]
    values = [(rng.randrange(3100) / 2,) for _ in range(300)]
    for r in assign_leaves(spark.createDataFrame(values, "v double"), {"v": tree}).collect():
        assert r["v__leaf"] == next((i for i, (a, b) in enumerate(leaves) if a <= r["v"] <= b), None), r
    ends = sorted(rng.sample(range(1000), 200))
    rows = spark.createDataFrame([(float(x),) for x in range(-2, 1003, 7)], "v double")
    for strict, side in ((True, bisect.bisect_left), (False, bisect.bisect_right)):
        for some in (ends, ends[:50]):
            found = rows.select("v", count_below(some, F.col("v"), strict).alias("n")).collect()
            assert all(r["n"] == side(some, r["v"]) for r in found)


def test_first_rows_with_many_large_groups(spark):
    """More large groups than the broadcast holds, the largest last in key order: its rows are spread over tasks."""
    from minim.operators.keyed import first_rows

    rows = spark.range(1500 * 12).select((F.col("id") % 1500).alias("g"), F.md5(F.col("id").cast("string")).alias("k"))
    rows = rows.union(spark.range(6000).select(F.lit(99_999).cast("bigint").alias("g"), F.md5((F.col("id") + 10**6).cast("string")).alias("k")))
    got = first_rows(rows, ["g"], "k", 10)
    assert got.groupBy("g").count().agg(F.min("count"), F.max("count")).first()[:] == (10, 10)
    expected = sorted(r["k"] for r in rows.where("g = 99999").collect())[:10]
    assert sorted(r["k"] for r in got.where("g = 99999").collect()) == expected


def test_normalize_to_odd_references(spark, tmp_path):
    """References of zero and NULL keep their rows, NULL keys meet nothing, and ties are rounded as the SQL does."""
    inf = float("inf")
    data = [("click", 1, 0.0), ("view", 1, 3.0), ("click", 2, None), ("view", 2, 3.0), ("click", None, 1.0), ("click", 3, 2.0), ("view", 3, 3.0), ("view", 4, 3.0)]
    out = N.normalize_to(spark.createDataFrame(data, "method string, seed int, seconds double"), "click", ["seed"], "seconds")
    got = sorted((r["seed"], r["method"], str(r["relative"])) for r in out.collect())
    assert got == [(1, "click", "nan"), (1, "view", str(inf)), (2, "click", "None"), (2, "view", "None"), (3, "click", "1.0"), (3, "view", "1.5")]

    import duckdb
    from minim.checks import QUERIES, SQL, load_all
    load_all()
    con = duckdb.connect()
    events = [("click", 1, 0.0), ("view", 1, 3.0), ("click", 2, 51.2), ("error", 2, 13.67), ("click", 3, 51.2), ("signup", 3, 51.83)]
    rows = ", ".join(f"({u}, '{m}', {v}::DOUBLE, TIMESTAMP '2024-01-02 00:00:00')" for m, u, v in events)
    con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}) e(user_id, event_type, value, ts)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = [tuple(map(str, r)) for r in con.execute(SQL["normalize_to"]).fetchall()]
    assert sorted(tuple(map(str, r)) for r in QUERIES["normalize_to"](spark, str(tmp_path)).collect()) == sorted(want)
