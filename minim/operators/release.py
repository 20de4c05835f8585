"""Mixed-level releases: materialize, route, verify, close."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minim.operators.classes import k_distribution_from_histogram, retention_classes, size_histogram
from minim.operators.hierarchy import Forest, ensure_leaves, leaf_name, node_position
from minim.operators.keyed import attach
from minim.session import Scratch

NO_SNAPSHOT = -1_000_000


@dataclass(frozen=True)
class Snapshot:
    """One step of the level history; a larger iteration is newer and finer."""

    iteration: int
    levels: Mapping[str, int]


def node_columns(forest: Forest, levels: Mapping[str, int], attrs: Sequence[str] | None = None) -> list:
    """Published node positions per QI: short integer class keys."""
    return [node_position(forest[a], int(levels.get(a, 0))).alias(a) for a in attrs or forest]


@dataclass(frozen=True)
class Release:
    """Cell-level result of one materialization.

    `cells` has one row per combination of leaves: `(leaf columns, n, snapshot)`, `snapshot` being
    the iteration that publishes it, or NULL where the cell is suppressed. Rows with equal leaves
    share every generalization, so they share their snapshot.
    """

    cells: DataFrame
    leaf_columns: tuple[str, ...]
    snapshots: tuple[Snapshot, ...]
    target_k: int


def leaf_cells(train: DataFrame, forest: Forest) -> DataFrame:
    """Rows per combination of leaves: everything a release decision depends on."""
    rows = ensure_leaves(train, forest)
    return rows.groupBy(*[leaf_name(a) for a in forest]).agg(F.count(F.lit(1)).alias("n"))


def materialize_release(
    cells: DataFrame, forest: Forest, snapshots: Sequence[Snapshot], target_k: int,
    scratch: Scratch | None = None,
) -> Release:
    """Newest snapshot first: generalize what remains, publish the groups of at least `target_k`.

    Works on leaf cells (`leaf_cells`), so every step groups pre-aggregated counts and no step
    touches the rows again. A step reads its cells more than once, so they are written out first:
    otherwise each step would triple the plan before it.
    """
    if target_k < 1:
        raise ValueError("target_k must be at least 1")
    if not snapshots:
        raise ValueError("a release needs at least one snapshot")
    leaves = [leaf_name(a) for a in forest]
    ordered = sorted(snapshots, key=lambda s: s.iteration, reverse=True)
    scratch = scratch or Scratch(cells.sparkSession, "release")
    state = cells.select(*leaves, "n", F.lit(None).cast("int").alias("snapshot"))
    for snap in ordered:
        state = scratch.save(state)
        keys = node_columns(forest, snap.levels)
        names = list(forest)
        open_cells = state.where(F.col("snapshot").isNull()).select("*", *keys)
        safe = (open_cells.groupBy(*names).agg(F.sum("n").alias("_size"))
                .where(F.col("_size") >= int(target_k)))
        marked = attach(state.select("*", *keys), safe, names, "_size")
        state = marked.select(*leaves, "n", F.coalesce(
            "snapshot", F.when(F.col("_size").isNotNull(), F.lit(int(snap.iteration)))).alias("snapshot"))
    return Release(scratch.save(state), tuple(leaves), tuple(ordered), int(target_k))


def release_rows(train: DataFrame, forest: Forest, release: Release) -> DataFrame:
    """Training rows with the snapshot that publishes them (NULL: suppressed)."""
    rows = ensure_leaves(train, forest)
    return attach(rows, release.cells, release.leaf_columns, "n").drop("n")


def suppressed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("snapshot").isNull())


def published_nodes(rows: DataFrame, forest: Forest, snapshots: Sequence[Snapshot]) -> DataFrame:
    """Replace each QI by the position of the node its snapshot publishes."""
    out = {}
    for attr, tree in forest.items():
        value = F.lit(None).cast("int")
        for snap in snapshots:
            value = F.when(F.col("snapshot") == int(snap.iteration),
                           node_position(tree, int(snap.levels.get(attr, 0)))).otherwise(value)
        out[attr] = value
    return rows.withColumns(out)


def published_text(rows: DataFrame, forest: Forest) -> DataFrame:
    """Node positions back to node ids."""
    from minim.operators.hierarchy import at
    return rows.withColumns({a: at(list(t.nodes), F.col(a), "string") for a, t in forest.items()})


def accepted_groups(release: Release, forest: Forest) -> DataFrame:
    """Group keys each snapshot publishes: `(snapshot, node position per QI, n)`."""
    published = release.cells.where(F.col("snapshot").isNotNull())
    named = published_nodes(published, forest, release.snapshots)
    return named.groupBy("snapshot", *forest).agg(F.sum("n").alias("n"))


def route_eval(rows: DataFrame, forest: Forest, release: Release) -> DataFrame:
    """Add `snapshot`: the newest snapshot that publishes the row's group, else the coarsest.

    `routed` is false for rows that matched no published group. Matching is null-safe and runs on
    the evaluation cells, then one join brings the answer to the rows.
    """
    cells = leaf_cells(rows, forest)
    leaves = list(release.leaf_columns)
    scratch = Scratch(rows.sparkSession, "route")
    # A cell is listed once per snapshot with its keys there; one join finds the published ones, and the first of them wins.
    groups = accepted_groups(release, forest).withColumnRenamed("n", "_size")
    listed = F.array(*[F.struct(F.lit(i).alias("_rank"), F.lit(int(s.iteration)).alias("snapshot"), *node_columns(forest, s.levels))
                       for i, s in enumerate(release.snapshots)])
    tagged = cells.select(*leaves, "n", F.explode(listed).alias("_t")).select(*leaves, "n", "_t.*")
    matched = attach(tagged, groups, ["snapshot", *forest], "_size")
    hit = F.min(F.when(F.col("_size").isNotNull(), F.struct("_rank", "snapshot")))
    coarsest = int(release.snapshots[-1].iteration)
    state = matched.groupBy(*leaves).agg(F.first("n").alias("n"), hit.alias("_hit")).select(
        *leaves, "n", F.col("_hit").isNotNull().alias("routed"), F.coalesce("_hit.snapshot", F.lit(coarsest)).alias("snapshot"))
    return attach(ensure_leaves(rows, forest), scratch.save(state), leaves, "n").drop("n")


def published_classes(release: Release, forest: Forest) -> DataFrame:
    """Classes of the whole release; equal nodes of different snapshots are one class."""
    return (accepted_groups(release, forest).groupBy(*forest).agg(F.sum("n").alias("k")))


def release_stats(release: Release, forest: Forest) -> DataFrame:
    """One row: rows, suppressed rows, coverage, class metrics, and whether min-K holds."""
    rows = release.cells.agg(
        F.sum("n").alias("population"),
        F.coalesce(F.sum(F.when(F.col("snapshot").isNotNull(), F.col("n"))), F.lit(0)).alias("row_count"))
    distribution = k_distribution_from_histogram(size_histogram(published_classes(release, forest)))
    # Two one-row tables side by side.
    both = rows.join(F.broadcast(distribution))
    return both.select(
        F.lit(release.target_k).cast("bigint").alias("target_k"), "row_count",
        (F.col("population") - F.col("row_count")).alias("suppressed_row_count"),
        (F.col("row_count") / F.col("population")).alias("coverage_fraction"),
        (F.col("row_count") == F.col("population")).alias("full_release"),
        (F.col("leak_k") >= release.target_k).alias("privacy_constraint_met"),
        F.col("leak_k").alias("min_k"),
        *[c for c in distribution.columns if c not in ("leak_k", "record_count")])


def assignment_counts(release: Release) -> DataFrame:
    """Rows per snapshot; a snapshot that publishes nothing counts 0."""
    listed = release.cells.sparkSession.createDataFrame(
        [(int(s.iteration),) for s in release.snapshots], "snapshot int")
    found = (release.cells.where(F.col("snapshot").isNotNull())
             .groupBy("snapshot").agg(F.sum("n").alias("rows")))
    return listed.join(found, "snapshot", "left").select("snapshot", F.coalesce("rows", F.lit(0)).alias("rows"))


def eval_stats(routed: DataFrame, release: Release) -> DataFrame:
    """Evaluation rows by finest, coarser and unmatched routing, with fractions."""
    finest = int(release.snapshots[0].iteration)
    total = F.count(F.lit(1))
    fine = F.count(F.when(F.col("routed") & (F.col("snapshot") == finest), 1))
    unmatched = F.count(F.when(~F.col("routed"), 1))
    return routed.agg(total.alias("population"), fine.alias("finest_rows"),
                      (total - fine).alias("coarser_rows"), unmatched.alias("coarsest_release_rows")).select(
        "*", (F.col("coarser_rows") / F.col("population")).alias("coarser_fraction"),
        (F.col("coarsest_release_rows") / F.col("population")).alias("coarsest_release_fraction"))


def rebuild_release(
    train: DataFrame, assignments: DataFrame, forest: Forest, snapshots: Sequence[Snapshot],
    target_k: int, row_id: str = "row_id", check: bool = True,
) -> DataFrame:
    """Published rows from saved `(row_id, snapshot)` pairs, verified.

    Checks duplicate ids, ids outside the training rows, unknown snapshots, and that every
    published class still has at least `target_k` rows.
    """
    known = [int(s.iteration) for s in snapshots]
    if check:
        if not assignments.groupBy(row_id).count().where("count > 1").isEmpty():
            raise ValueError("duplicate row ids in the saved release")
        if not assignments.where(F.col("snapshot").isNull() | ~F.col("snapshot").isin(known)).isEmpty():
            raise ValueError("the saved release names unknown snapshots")
        if not assignments.join(train, row_id, "left_anti").isEmpty():
            raise ValueError("the saved release holds rows outside the training split")
    rows = ensure_leaves(train, forest).join(assignments.select(row_id, "snapshot"), row_id)
    out = published_nodes(rows, forest, snapshots)
    if check:
        smallest = retention_classes(out, list(forest)).agg(F.min("k")).first()[0]
        if smallest is None or smallest < target_k:
            raise ValueError(f"the rebuilt release has min-K {smallest}, below {target_k}")
    return out


def close_classes(df: DataFrame, qis: Sequence[str], published: str = "published", selected: str = "selected") -> DataFrame:
    """Every class with a published row admits all its rows: `selected` and `published` updated.

    Newly admitted rows count as published; rows of `exempt` stay unpublished.
    """
    live = df.where(F.col(published)).groupBy(*qis).agg(F.count(F.lit(1)).alias("_live"))
    marked = attach(df, live, qis, "_live")
    admits = F.col("_live").isNotNull()
    newly = admits & ~F.col(selected)
    exempt = F.col("exempt") if "exempt" in df.columns else F.lit(False)
    return marked.withColumns({
        published: F.col(published) | (newly & ~exempt),
        selected: F.col(selected) | admits,
    }).drop("_live")


def merge_exempt(df: DataFrame, qis: Sequence[str], published: str = "published", exempt: str = "exempt") -> DataFrame:
    """Exempt rows stay only where the whole rest of their class is published: `(.., retained)`."""
    whole = df.groupBy(*qis).agg(
        F.count(F.lit(1)).alias("_rows"),
        (F.sum(F.when(~F.col(exempt), 1).otherwise(0)) > 0).alias("_has_rest"),
        F.min(F.when(~F.col(exempt), F.col(published).cast("int"))).alias("_all_published"))
    kept = whole.where(F.col("_has_rest") & (F.col("_all_published") == 1)).select(*qis, "_rows")
    marked = attach(df, kept, qis, "_rows")
    return marked.withColumn("retained", F.col(exempt) & F.col("_rows").isNotNull()).drop("_rows")


def evict_low_k(df: DataFrame, qis: Sequence[str], threshold: int, selected: str = "selected", exempt: str = "exempt") -> DataFrame:
    """Deselect non-exempt rows of classes with fewer than `threshold` selected non-exempt rows."""
    movable = F.col(selected) & ~F.col(exempt)
    low = (df.where(movable).groupBy(*qis).agg(F.count(F.lit(1)).alias("_movable"))
           .where(F.col("_movable") < int(threshold)))
    marked = attach(df, low, qis, "_movable")
    return marked.withColumn(selected, F.col(selected) & (F.col(exempt) | F.col("_movable").isNull())).drop("_movable")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
