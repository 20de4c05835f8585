"""Plain Mondrian against a recursive model on small random tables."""

import random

from pyspark.sql import functions as F

from minim.operators import mondrian as M


def model(rows, numeric, categorical, k):
    attrs = [*numeric, *categorical]
    span, rank, distinct = {}, {}, {}
    for a in numeric:
        seen = [r[a] for r in rows if r[a] is not None]
        span[a] = max(seen) - min(seen) if seen else 0
    for a in categorical:
        counts = {}
        for r in rows:
            counts[r[a]] = counts.get(r[a], 0) + 1
        order = sorted(counts, key=lambda v: (-counts[v], v is None, v or ""))
        rank[a], distinct[a] = {v: i for i, v in enumerate(order)}, len(order)

    def key(r, a):
        if a in span:
            return float("inf") if r[a] is None else float(r[a])
        return -1 if r[a] is None else rank[a][r[a]]

    def width(part, a):
        if a in span:
            seen = [r[a] for r in part if r[a] is not None]
            return (max(seen) - min(seen)) / span[a] if seen and span[a] > 0 else 0.0
        return len({r[a] for r in part}) / distinct[a]

    def cut(part, path):
        scored = sorted(((width(part, a), -i, a) for i, a in enumerate(attrs)), reverse=True)
        if len(part) >= 2 * k and scored[0][0] > 0:
            for _, _, a in scored:
                keys = sorted(key(r, a) for r in part)
                at = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1] and i >= k and len(keys) - i >= k]
                if at:
                    best = min(at, key=lambda i: (abs(i - len(keys) / 2), i))
                    edge = keys[best - 1]
                    cut([r for r in part if key(r, a) <= edge], path + "L")
                    cut([r for r in part if key(r, a) > edge], path + "R")
                    return
        for r in part:
            out[r["row_id"]] = path

    out = {}
    cut(rows, "")
    return out


def test_matches_recursive_model(spark):
    for seed, k in ((1, 3), (2, 5), (3, 8)):
        rng = random.Random(seed)
        rows = [{"row_id": i, "a": rng.choice([None, *range(12)]), "b": round(rng.random(), 2),
                 "c": rng.choice(["x", "y", "z", "z", None])} for i in range(90)]
        df = spark.createDataFrame([(r["row_id"], r["a"], r["b"], r["c"]) for r in rows], "row_id int, a int, b double, c string")
        got = {r["row_id"]: r["partition"] for r in M.mondrian(df, ["a", "b"], ["c"], k).collect()}
        assert got == model(rows, ["a", "b"], ["c"], k)


def test_hot_value_keeps_k(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), F.when(F.col("id") < 100, 7).otherwise(F.col("id") % 50).alias("a"))
    sizes = [r["count"] for r in M.mondrian(df, ["a"], [], 10).groupBy("partition").count().collect()]
    assert sum(sizes) == 300 and min(sizes) >= 10


def test_value_sets_as_bits(spark):
    """Bits hold the lists: several chunks, NULL values, a partition of NULLs, a NULL partition, an empty table."""
    data = [("a", f"v{i:03d}") for i in range(0, 200, 3)] + [("b", f"v{i:03d}") for i in range(200)] * 2 + [("c", None), (None, "v199"), ("a", None)]
    df = spark.createDataFrame(data, "partition string, cat string").withColumn("x", F.lit(1.0))
    lists = {r["partition"]: (r["size"], r["cat__values"]) for r in M.partition_summary(df, ["x"], ["cat"]).collect()}
    words = [f"v{i:03d}" for i in range(200)]
    found = M.partition_summary(df, ["x"], ["cat"], sets=M.BITS).collect()
    assert len(found) == len(lists)
    for r in found:
        named = [words[c["chunk"] * M.CHUNK + i] for c in r["cat__bits"] for i in range(M.CHUNK) if c["bits"] >> i & 1]
        assert (r["size"], named) == lists[r["partition"]]
    dictionary = M.value_dictionary(df, "cat")
    members = M.set_members(M.value_bitmaps(df, "cat", dictionary), "cat", dictionary).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in members) == sorted((str(p), v, 1.0 / len(vs)) for p, (_, vs) in lists.items() for v in vs)
    recoded = M.mondrian_recode(df, ["x"], ["cat"], sets=M.BITS)
    assert recoded.count() == len(data) and recoded.where("partition = 'c'").first()["cat__pub"] == []
    assert M.partition_summary(df.limit(0), ["x"], ["cat"], sets=M.BITS).collect() == []


def test_set_members_carry_no_whole_set(spark):
    """Members come from single chunks: no row of the plan holds a partition's whole bitmap, and both forms of a set have the same members."""
    df = spark.createDataFrame([("a", f"v{i:03d}") for i in range(150)] + [("b", "v149")], "partition string, cat string")
    dictionary = M.value_dictionary(df, "cat")
    members = M.set_members(M.value_bitmaps(df, "cat", dictionary), "cat", dictionary)
    assert "cat__bits" not in members._jdf.queryExecution().optimizedPlan().toString()
    want = sorted([("a", f"v{i:03d}", 1 / 150) for i in range(150)] + [("b", "v149", 1.0)])
    assert sorted(tuple(r) for r in members.collect()) == want
    assert sorted(tuple(r) for r in M.set_members(M.value_chunks(df, "cat", dictionary), "cat", dictionary).collect()) == want


def test_small_partitions_are_finished_alike(spark, monkeypatch):
    """Passes alone, passes down to small partitions, and one task give the same tree; small partitions leave the passes."""
    rng = random.Random(7)
    data = [(i, rng.choice([None, float("nan"), *map(float, range(9))]), round(rng.random(), 2), rng.choice(["x", "y", "z", "z", None])) for i in range(400)]
    df = spark.createDataFrame(data, "row_id int, a double, b double, c string")
    found, joins = [], []
    small = M.attach_small
    for rows in (0, 90, 1000):
        monkeypatch.setattr(M, "LOCAL_ROWS", rows)
        passes = []
        monkeypatch.setattr(M, "attach_small", lambda *a: passes.append(1) or small(*a))
        found.append({r["row_id"]: r["partition"] for r in M.mondrian(df, ["a", "b"], ["c"], 4).collect()})
        joins.append(len(passes))
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) > 40
    assert joins[0] > joins[1] > joins[2] == 0
