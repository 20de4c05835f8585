"""Candidates of the removal-first search: drop a class, coarsen a QI, exchange two classes.

The search only ever moves whole classes, and rows with equal leaves share every class, so its
state is a table of weighted leaf cells and never of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minim.functions.expressions import privacy_progress, utility_cost
from minim.operators.hierarchy import Forest, leaf_name
from minim.operators.keyed import attach
from minim.operators.release import node_columns


def class_table(cells: DataFrame, keys: Sequence[str], s: Column, weight: str = "n") -> DataFrame:
    """`(keys..., rows, s)`: size and summed influence of every class."""
    return cells.groupBy(*keys).agg(F.sum(weight).alias("rows"), F.sum(F.col(weight) * s).alias("s"))


def stats_after_removal(histogram: DataFrame) -> DataFrame:
    """Min-K and the classes at it after removing one class of each size: `(rows, next_k, next_min_classes)`.

    Only the smallest size can change the answer, so the two smallest entries decide all of them.
    """
    w = Window.orderBy("k")
    ranked = histogram.select("k", "class_count", F.row_number().over(w).alias("_r"))
    one = ranked.agg(F.max(F.when(F.col("_r") == 1, F.struct("k", "class_count"))).alias("a"),
                     F.max(F.when(F.col("_r") == 2, F.struct("k", "class_count"))).alias("b"))
    # One row.
    both = histogram.join(F.broadcast(one))
    last = (F.col("k") == F.col("a.k")) & (F.col("a.class_count") == 1)
    return both.select(
        F.col("k").alias("rows"),
        F.when(last, F.coalesce("b.k", F.lit(0))).otherwise(F.col("a.k")).alias("next_k"),
        F.when(last, F.coalesce("b.class_count", F.lit(0)))
        .otherwise(F.col("a.class_count") - F.when(F.col("k") == F.col("a.k"), 1).otherwise(0)).alias("next_min_classes"))


def removal_candidates(classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dropping each class: score `-g_val . (g_next - g_now)`, min-K and bottleneck count afterwards.

    `classes` is a `class_table` of the active rows; a class holding all rows is no candidate.
    """
    total = classes.agg(F.sum("rows").alias("_n"), F.sum("s").alias("_s"))
    histogram = classes.groupBy(F.col("rows").alias("k")).agg(F.count(F.lit(1)).alias("class_count"))
    after = stats_after_removal(histogram)
    scored = classes.join(F.broadcast(total)).where(F.col("rows") < F.col("_n"))
    change = (F.col("rows") * F.col("_s") / F.col("_n") - F.col("s")) / (F.col("_n") - F.col("rows"))
    scored = scored.select(*keys, "rows", (-change).alias("fast_utility_score"), (F.col("_n") - F.col("rows")).alias("next_active_rows"))
    # At most sqrt(2 N) distinct sizes.
    return scored.join(after, "rows").select(*keys, "rows", "fast_utility_score", "next_active_rows", "next_k", "next_min_classes")


def coarsen_candidates(cells: DataFrame, forest: Forest, levels: Mapping[str, int]) -> DataFrame:
    """One QI one level up: `(attr, from_level, to_level, next_k, next_min_classes, class_count)`.

    All QIs share one pass: every cell is tagged once per QI and grouped by (QI, next class).
    """
    options = [a for a in forest if int(levels.get(a, 0)) < forest[a].height]
    if not options:
        raise ValueError("every quasi-identifier is at its top level")
    tagged = []
    for a in options:
        up = {**levels, a: int(levels.get(a, 0)) + 1}
        tagged.append(F.struct(F.lit(a).alias("attr"), *node_columns(forest, up)))
    classes = (cells.select("n", F.explode(F.array(*tagged)).alias("t")).select("n", "t.*")
               .groupBy("attr", *forest).agg(F.sum("n").alias("rows")))
    sizes = classes.groupBy("attr", "rows").agg(F.count(F.lit(1)).alias("c"))
    out = sizes.groupBy("attr").agg(F.min("rows").alias("next_k"), F.min_by("c", "rows").alias("next_min_classes"), F.sum("c").alias("class_count"))
    now = F.lit(0)
    for a in options:
        now = F.when(F.col("attr") == a, F.lit(int(levels.get(a, 0)))).otherwise(now)
    return out.select("attr", now.alias("from_level"), (now + 1).alias("to_level"), "next_k", "next_min_classes", "class_count")


def _best_of_sizes(active: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outgoing and incoming classes that can be the best exchange of some pair of sizes, paired by size.

    The score of a pair of given sizes grows with the outgoing s and falls with the incoming one, and what min-K becomes depends
    on the incoming size, the size of its active class and whether both are one class. So of all outgoing classes of a size
    the two with the largest s are kept, of all incoming ones of a size and active size the two with the smallest s (two, as
    the best one may be the same class), and exchanges of a class with its own removed part. There are at most sqrt(2 N)
    sizes on a side.
    """
    there = attach(removed, active.select(*keys, F.col("rows").alias("_active")), keys, "_active")
    out_rank = F.row_number().over(Window.partitionBy("rows").orderBy(F.desc("s"), *[F.desc(k) for k in keys]))
    in_rank = F.row_number().over(Window.partitionBy("rows", "_active").orderBy("s", *[F.desc(k) for k in keys]))
    outs = active.withColumn("_r", out_rank).where("_r <= 2").select(F.struct(*keys).alias("out"), F.col("rows").alias("out_rows"), F.col("s").alias("out_s"))
    ins = there.withColumn("_r", in_rank).where("_r <= 2").select(F.struct(*keys).alias("in"), F.col("rows").alias("in_rows"), F.col("s").alias("in_s"))
    pairs = ins.join(outs, F.col("in_rows") <= F.col("out_rows"))
    both = removed.select(*keys, F.col("rows").alias("in_rows"), F.col("s").alias("in_s"))
    own = attach(both, active.select(*keys, F.col("rows").alias("out_rows"), F.col("s").alias("out_s")), keys, "out_rows", how="inner")
    own = own.where("in_rows <= out_rows").select(F.struct(*keys).alias("in"), "in_rows", "in_s", F.struct(*keys).alias("out"), "out_rows", "out_s")
    return pairs.select("in", "in_rows", "in_s", "out", "out_rows", "out_s").unionByName(own).distinct()


def exchange_candidates(active: DataFrame, removed: DataFrame, keys: Sequence[str], pool: int | None = None) -> DataFrame:
    """One active class out, one removed class in; rows must not grow and min-K must not fall.

    With a `pool` the `pool` best outgoing classes by removal score meet, each, the `pool` best removed classes that are not
    larger. Without one every pair of sizes is represented by its best exchange, so the best of all exchanges is there and
    no two classes are paired that cannot be it.
    """
    total = active.agg(F.sum("rows").alias("_n"), F.sum("s").alias("_s"))
    n, all_s = F.col("_n"), F.col("_s")
    drop = (F.col("rows") * all_s / n - F.col("s")) / (n - F.col("rows"))
    add = (F.col("s") - F.col("rows") * all_s / n) / (n + F.col("rows"))
    outs = (active.join(F.broadcast(total)).withColumn("_score", F.when(F.col("rows") < n, -drop).otherwise(0.0))
            .orderBy(F.desc("_score"), "rows", *[F.desc(k) for k in keys]).limit(int(pool or 1))
            .select(F.struct(*keys).alias("out"), F.col("rows").alias("out_rows"), F.col("s").alias("out_s"), "_n", "_s"))
    ins = removed.join(F.broadcast(total)).withColumn("_score", -add).select(
        F.struct(*keys).alias("in"), F.col("rows").alias("in_rows"), F.col("s").alias("in_s"), F.col("_score").alias("in_score"))
    # At most `pool` rows on the broadcast side, and the rank keeps `pool` rows per outgoing class.
    pairs = ins.join(F.broadcast(outs), F.col("in_rows") <= F.col("out_rows"))
    best = Window.partitionBy("out").orderBy(F.desc("in_score"), F.desc("in_rows"), F.desc("in"))
    kept = pairs.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= int(pool or 1)).drop("_r")
    if pool is None:
        kept = _best_of_sizes(active, removed, keys).join(F.broadcast(total))
    # Sizes after the exchange: the outgoing class is gone, the incoming one joins its active class.
    named = kept.withColumns({k: F.col(f"in.{k}") for k in keys})
    same = active.select(*keys, F.col("rows").alias("_there"))
    joined = attach(named, same, keys, "_there").drop(*keys)
    smallest = active.orderBy("rows", *keys).limit(3).agg(F.collect_list(F.struct("rows", F.struct(*keys).alias("c"))).alias("_least"))
    sized = joined.join(F.broadcast(smallest))
    others = F.array_min(F.transform(
        F.filter(F.col("_least"), lambda x: (x["c"] != F.col("out")) & (x["c"] != F.col("in"))), lambda x: x["rows"]))
    grown = F.col("in_rows") + F.when(F.col("in") == F.col("out"), 0).otherwise(F.coalesce("_there", F.lit(0)))
    next_k = F.coalesce(F.least(others, grown), grown)
    now_k = F.array_min(F.transform("_least", lambda x: x["rows"]))
    next_n = F.col("_n") - F.col("out_rows") + F.col("in_rows")
    change = (F.col("_s") - F.col("out_s") + F.col("in_s")) / next_n - F.col("_s") / F.col("_n")
    return sized.withColumns({"next_k": next_k, "_now": now_k}).where(F.col("next_k") >= F.col("_now")).select(
        "out", "in", "out_rows", "in_rows", next_n.alias("next_active_rows"), "next_k", (-change).alias("fast_utility_score"),
        F.coalesce("_there", F.lit(0)).alias("in_active_rows"), grown.alias("grown_rows"))


@dataclass(frozen=True)
class Bottom:
    """What candidates need to know of all classes: active rows and score sum, the two smallest sizes with their class counts, the three smallest classes."""

    rows: int
    s: float
    min_k: int
    at_min: int
    next_size: int
    at_next: int
    least: tuple[tuple[int, tuple], ...]
    removed: int


def both_sides(cells: DataFrame, keys: Sequence[str], s: Column, more: Sequence[Column] = (), weight: str = "n", active: str = "active") -> DataFrame:
    """`(keys..., active_rows, active_s, removed_rows, removed_s, more...)`: every class with its active and its removed part, null where it has none."""
    n, here = F.col(weight), F.col(active)
    parts = [c for flag, name in ((here, "active"), (~here, "removed")) for c in (
        F.sum(F.when(flag, n)).alias(f"{name}_rows"), F.sum(F.when(flag, n * s)).alias(f"{name}_s"))]
    return cells.groupBy(*keys).agg(*parts, *more)


def bottom(classes: DataFrame, keys: Sequence[str]) -> Bottom:
    """`classes` is a written table of `both_sides`; at most five rows and the sums reach the driver."""
    live = classes.where("active_rows IS NOT NULL")
    total = classes.agg(F.sum("active_rows").alias("n"), F.sum("active_s").alias("s"), F.count("removed_rows").alias("gone")).first()
    sizes = live.groupBy("active_rows").agg(F.count(F.lit(1)).alias("c")).orderBy("active_rows").limit(2).collect()
    least = live.orderBy("active_rows", *keys).limit(3).collect()
    (k, c), (k2, c2) = ([*((r["active_rows"], r["c"]) for r in sizes), (0, 0), (0, 0)])[:2]
    return Bottom(total["n"] or 0, total["s"] or 0.0, k, c, k2, c2, tuple((r["active_rows"], tuple(r[x] for x in keys)) for r in least), total["gone"])


def removals_at_min(classes: DataFrame, keys: Sequence[str], least: Bottom) -> DataFrame:
    """The rows of `removal_candidates` that can raise min-K or lower the classes at it: the classes of the smallest size."""
    n, total = F.lit(least.rows), F.lit(float(least.s))
    rows = F.col("active_rows")
    change = (rows * total / n - F.col("active_s")) / (n - rows)
    after = (least.next_size, least.at_next) if least.at_min == 1 else (least.min_k, least.at_min - 1)
    return classes.where((rows == least.min_k) & (rows < n)).select(
        *keys, rows.alias("rows"), (-change).alias("fast_utility_score"), (n - rows).cast("bigint").alias("next_active_rows"),
        F.lit(after[0]).cast("bigint").alias("next_k"), F.lit(after[1]).cast("bigint").alias("next_min_classes"))


def exchanges_at_min(classes: DataFrame, keys: Sequence[str], least: Bottom) -> DataFrame:
    """The exchanges of `exchange_candidates` without a pool that can raise min-K or lower the classes at it.

    One of the two classes then has the smallest size: the outgoing one leaves it, or the incoming one joins an active class of it. Of each
    pair of sizes (and size of the active class that is joined) the best exchange is there, two classes a side being kept as the best ones
    may be the same class.
    """
    key = F.struct(*[F.col(k) for k in keys])
    live = classes.where("active_rows IS NOT NULL").select(key.alias("out"), F.col("active_rows").alias("out_rows"), F.col("active_s").alias("out_s"))
    gone = classes.where("removed_rows IS NOT NULL").select(
        key.alias("in"), F.col("removed_rows").alias("in_rows"), F.col("removed_s").alias("in_s"), F.coalesce("active_rows", F.lit(0)).alias("in_active_rows"))

    def two(table: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
        # Spark keeps two rows per group in each task before it shuffles.
        return table.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_r <= 2").drop("_r")

    outs = two(live, ["out_rows"], [F.desc("out_s"), F.desc("out")])
    ins = two(gone.where((F.col("in_rows") <= least.min_k) | (F.col("in_active_rows") == least.min_k)), ["in_rows", "in_active_rows"], [F.asc("in_s"), F.desc("in")])
    # A class and its own removed part only trade rows of the smallest size. There are at most sqrt(2 N) sizes on a side.
    meet = (F.col("in_rows") <= F.col("out_rows")) & (F.col("in") != F.col("out")) & (
        (F.col("out_rows") == least.min_k) | (F.col("in_active_rows") == least.min_k))
    pairs = ins.join(outs, meet)

    def is_class(column: str, nodes: tuple) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"{column}.{k}").eqNullSafe(F.lit(x)) for k, x in zip(keys, nodes)])

    others = F.lit(None).cast("bigint")
    for size, nodes in reversed(least.least):
        others = F.when(~is_class("out", nodes) & ~is_class("in", nodes), F.lit(size).cast("bigint")).otherwise(others)
    grown = F.col("in_rows") + F.col("in_active_rows")
    next_n = F.lit(least.rows) - F.col("out_rows") + F.col("in_rows")
    total = F.lit(float(least.s))
    change = (total - F.col("out_s") + F.col("in_s")) / next_n - total / F.lit(least.rows)

    def at_min(size: Column) -> Column:
        return F.when(size == least.min_k, 1).otherwise(0)

    after = F.lit(least.at_min) - at_min(F.col("out_rows")) - at_min(F.col("in_active_rows")) + at_min(grown)
    return (pairs.withColumn("next_k", F.coalesce(F.least(others, grown), grown)).where(F.col("next_k") >= least.min_k)
            .select("out", "in", "out_rows", "in_rows", next_n.cast("bigint").alias("next_active_rows"), "next_k",
                    F.when(F.col("next_k") > least.min_k, 0).otherwise(after).cast("bigint").alias("next_min_classes"), (-change).alias("fast_utility_score")))


def rank_candidates(candidates: DataFrame, k_now: int, min_classes_now: int, tolerance: float, epsilon: float) -> DataFrame:
    """Privacy progress and normalized cost of each candidate; only positive progress stays."""
    progress = privacy_progress(F.lit(int(k_now)), F.col("next_k"), F.lit(int(min_classes_now)), F.col("next_min_classes"))
    cost = utility_cost(-F.col("fast_utility_score"), tolerance, epsilon)
    return (candidates.withColumn("privacy_progress", progress).where(F.col("privacy_progress") > 0)
            .withColumn("fast_cost", F.coalesce(cost, F.lit(float("inf")))))


def apply_membership(cells: DataFrame, keys: Sequence[str], out: DataFrame | None = None, into: DataFrame | None = None, active: str = "active") -> DataFrame:
    """Move whole classes: `out` leaves the active cells, `into` joins them; the rest stays."""
    flag = F.col(active)
    result = cells
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cells"))
    for name, table in (("_out", out), ("_in", into)):
        if table is not None:
            # Weighed by the class size, so that a hot class is told by the broadcast part.
            named = table.select(*keys).distinct()
            weighed = named.join(sizes.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_cells").alias(name)),
                                 reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]))
            result = attach(result, weighed.select(*keys, name), keys, name)
    if out is not None:
        flag = F.when(F.col(active) & F.col("_out").isNotNull(), F.lit(False)).otherwise(flag)
    if into is not None:
        flag = F.when(~F.col(active) & F.col("_in").isNotNull(), F.lit(True)).otherwise(flag)
    return result.withColumn("_flag", flag).drop("_out", "_in").withColumn(active, F.col("_flag")).drop("_flag")


def move_class(cells: DataFrame, forest: Forest, levels: Mapping[str, int], out: Sequence[int | None] | None = None,
               into: Sequence[int | None] | None = None, active: str = "active") -> DataFrame:
    """`apply_membership` for one class on each side, named by its node positions (None: missing): a projection, as a class is a predicate on leaves."""
    def inside(nodes: Sequence[int | None]) -> Column:
        return reduce(lambda a, b: a & b, [c.eqNullSafe(F.lit(x).cast("int")) for c, x in zip(node_columns(forest, levels), nodes)])

    flag = F.col(active)
    if out is not None:
        flag = F.when(F.col(active) & inside(out), F.lit(False)).otherwise(flag)
    if into is not None:
        flag = F.when(~F.col(active) & inside(into), F.lit(True)).otherwise(flag)
    return cells.withColumn(active, flag)


def check_membership(before: DataFrame, after: DataFrame, ids: Sequence[str], active: str = "active") -> None:
    """Active and removed cells must stay a partition of all cells, with some of them active."""
    if not before.select(*ids).exceptAll(after.select(*ids)).isEmpty() or not after.select(*ids).exceptAll(before.select(*ids)).isEmpty():
        raise ValueError("active and removed rows must partition all rows")
    if after.where(F.col(active)).isEmpty():
        raise ValueError("an action cannot remove every row")


def cell_hash(forest: Forest) -> Column:
    """What a cell adds to the fingerprint of a state it is active in."""
    return F.xxhash64(*[leaf_name(a) for a in forest]).cast("decimal(38,0)")


def fingerprint_of(count: int, hashes: int, forest: Forest, levels: Mapping[str, int]) -> str:
    return f"{count}:{hashes}:" + ",".join(f"{a}={int(levels.get(a, 0))}" for a in sorted(forest))


def state_fingerprint(cells: DataFrame, forest: Forest, levels: Mapping[str, int], active: str = "active") -> str:
    """Order-free hash of the active cells, with the levels."""
    row = cells.where(F.col(active)).agg(F.count(F.lit(1)).alias("n"), F.sum(cell_hash(forest)).alias("h")).first()
    return fingerprint_of(row["n"], int(row["h"] or 0), forest, levels)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
