"""The class swap against a row-by-row model, on random states."""

import random

from pyspark.sql import functions as F

from minim.operators import candidates as G


def model(rows, max_rounds):
    """Rows are (class, selected, exempt, position); returns the selected positions."""
    rows = [list(r) for r in rows]
    order = {r[3]: (0, r[3]) for r in rows if r[1]}
    for rnd in range(max_rounds):
        small, large = {}, {}
        for cls, sel, ex, pos in rows:
            if sel and not ex:
                n, first = small.get(cls, (0, None))
                small[cls] = (n + 1, order[pos] if first is None else min(first, order[pos]))
            if not sel:
                n, first = large.get(cls, (0, None))
                large[cls] = (n + 1, pos if first is None else min(first, pos))
        if not small or not large:
            break
        b_cls = min(large, key=lambda c: (-large[c][0], large[c][1]))
        b = large[b_cls][0]
        queue = sorted(small, key=lambda c: small[c])
        if small[queue[0]][0] >= b:
            break
        out, total = set(), 0
        for c in queue:
            if total + small[c][0] > b:
                break
            out.add(c)
            total += small[c][0]
        entering = [r for r in rows if r[0] == b_cls and not r[1]]
        for r in rows:
            if r[0] in out and r[1] and not r[2]:
                r[1] = False
        for r in entering:
            r[1] = True
            order[r[3]] = (1 + rnd, "")
    return {r[3] for r in rows if r[1]}


def state(rng, n_classes, n_rows):
    rows = []
    for i in range(n_rows):
        selected = rng.random() < 0.4
        rows.append((rng.randrange(n_classes) if rng.random() < 0.7 else 0, selected, selected and rng.random() < 0.2, f"{i:05d}"))
    return rows


def test_swap_matches_row_model_in_memory():
    for seed in range(300):
        rng = random.Random(seed)
        rows = state(rng, rng.randint(1, 9), rng.randint(2, 60))
        groups = {}
        for cls, sel, ex, pos in rows:
            groups.setdefault(cls, []).append((sel, ex, pos))
        table = {}
        for cls, members in groups.items():
            mine = [p for s, e, p in members if s and not e]
            free = [p for s, e, p in members if not s]
            table[(cls,)] = (len(mine), (0, min(mine)) if mine else None, min(mine, default=None), len(free), min(free, default=None))
        small = [(c, G.SwapClass(*table[c])) for c in sorted((c for c in table if table[c][0]), key=lambda c: (table[c][0], table[c][1]))]
        large = [(c, G.SwapClass(*table[c])) for c in sorted((c for c in table if table[c][3]), key=lambda c: (-table[c][3], table[c][4]))]
        rounds = rng.choice([1, 2, 50])
        result = G.swap(iter(small), iter(large), sum(r[1] for r in rows), len(rows), 1, rounds)
        flags = {c: (keep, take) for c, keep, take, _ in result.moves}
        got = set()
        for cls, sel, ex, pos in rows:
            keep, take = flags.get((cls,), (True, False))
            if (sel and (ex or keep)) or (not sel and take):
                got.add(pos)
        assert got == model(rows, rounds), seed


def test_swap_on_spark_reads_pages(spark):
    rng = random.Random(7)
    rows = state(rng, 12, 150)
    df = spark.createDataFrame([(None if c == 3 else str(c), s, e, p, 0) for c, s, e, p in rows], "cls string, selected boolean, exempt boolean, _key string, batch int")
    table = G.swap_table(df, ["cls"]).cache()
    result = G.swap_classes(table, ["cls"], 1, page=2)
    moved = G.apply_moves(df, table, G.moves_table(spark, ["cls"], ["string"], result), ["cls"])
    assert {r[0] for r in moved.where(F.col("selected")).select("_key").collect()} == model(rows, 3000)


def test_swap_state_is_written_back_at_any_limit(spark):
    """Every limit gives the rows of the row model, with nulls in the key; a limit of 1 ends each round on Spark."""
    for seed, limit in [(1, 1), (2, 2), (3, 3), (4, 1), (5, 5)]:
        rng = random.Random(seed)
        rows = state(rng, 30, 90)
        df = spark.createDataFrame([(None if c == 3 else str(c), s, e, p, 0) for c, s, e, p in rows], "cls string, selected boolean, exempt boolean, _key string, batch int").cache()
        table = G.swap_table(df, ["cls"]).cache()
        whole = G.swap_classes(table, ["cls"], 1)
        result = G.swap_classes(table, ["cls"], 1, page=3, limit=limit)
        assert (result.rounds, result.moved_out, result.moved_in, result.reason) == (whole.rounds, whole.moved_out, whole.moved_in, whole.reason)
        moved = G.apply_moves(df, table, G.moves_table(spark, ["cls"], ["string"], result), ["cls"])
        assert {r[0] for r in moved.where(F.col("selected")).select("_key").collect()} == model(rows, 3000), (seed, limit)
        listed = [sorted(map(str, G.moves_table(spark, ["cls"], ["string"], r).collect())) for r in (whole, result)]
        assert listed[0] == listed[1]


def test_swap_round_of_many_small_classes(spark):
    """One open class as large as thousands of single-row classes: the driver holds ten of them."""
    df = spark.range(6000).select(
        F.when(F.col("id") < 3000, F.lit(-1)).otherwise(F.col("id")).alias("cls"), (F.col("id") >= 3000).alias("selected"),
        F.lit(False).alias("exempt"), F.lpad(F.col("id").cast("string"), 6, "0").alias("_key"), F.lit(0).alias("batch"))
    table = G.swap_table(df, ["cls"]).cache()
    result = G.swap_classes(table, ["cls"], 1, page=20, limit=10)
    assert (result.rounds, result.moved_out, result.moved_in) == (1, 3000, 3000)
    assert result.table.where(~F.col("keep")).count() == 3000
    empty = G.swap_classes(table.limit(0), ["cls"], 1)
    assert (empty.rounds, empty.moves) == (0, [])
