"""Mondrian over hierarchies: fit, published regions, and routing of evaluation rows.

Rows are collapsed to cells (QI values x label, with a count). One pass cuts all open nodes, so
passes follow the depth of the tree. Node ids are paths: `r`, then `/L`, `/R`, `/M` for numeric
branches and `/<child position>` or `/M` for categorical ones; the synthetic root above `r` is the
empty path. The fitted tree is a node table, so routing joins on paths and nothing row-sized or
node-sized reaches the driver.

Several trees over the same rows grow together (`fit_trees`): the paths of tree i begin with `i:`, so all of them are cut, routed and
summed up in the passes of the deepest one. A single tree (`fit_mondrian`) has no prefix.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minim.functions.expressions import ENTROPY_GAIN_MIN, weighted_entropy
from minim.operators.hierarchy import Forest, Hierarchy, assign_leaves, at, common_height, count_below, leaf_name, out_of_domain
from minim.operators import keyed
from minim.operators.keyed import attach, attach_small
from minim.session import Scratch

MEDIAN, INFOGAIN = "median", "infogain"
TOP = ""
FIRST = "r"
MISSING_BRANCH = "M"
MAX_CLASSES = 100
_STEP = "\u0002"


@dataclass(frozen=True)
class FittedMondrian:
    """`nodes`: one row per node (path, depth, size, kind, split, region per QI).

    `cells`: fitted cells with their leaf node's path and the rows of each of `classes`, in columns `c0, c1, ...`. `values`: the QI columns of
    a cell. `k` and `variant` are those of the first of `trees`, which names each tree's variant and k by its prefix.
    """

    nodes: DataFrame
    cells: DataFrame
    forest: Forest
    k: int
    variant: str
    classes: tuple = ()
    trees: Mapping[str, tuple[str, int]] = field(default_factory=lambda: {TOP: ()})

    @property
    def values(self) -> list[str]:
        return [value_name(a) for a in self.forest]


def tree_of(path: Column) -> Column:
    """The prefix of a path's tree, which is the path of the tree's synthetic root; empty for a single tree."""
    return F.substring_index(path, FIRST, 1)


def _is_top(path: Column) -> Column:
    return ~path.contains(FIRST)


def _by_tree(path: Column, values: Mapping[str, object]) -> Column:
    """One value per tree."""
    if len(values) == 1:
        return F.lit(next(iter(values.values())))
    return F.get(F.array(*[F.lit(v) for v in values.values()]), F.substring_index(path, ":", 1).cast("int"))


def _each_tree(trees: Mapping[str, object]) -> Column:
    """The prefixes, one row each."""
    return F.explode(F.array(*[F.lit(p) for p in trees]))


def value_name(attr: str) -> str:
    return f"{attr}__value"


def numeric_attrs(forest: Forest) -> list[str]:
    return [a for a, t in forest.items() if t.numeric]


def categorical_attrs(forest: Forest) -> list[str]:
    return [a for a, t in forest.items() if not t.numeric]


def mondrian_values(df: DataFrame, forest: Forest, check: bool = True) -> DataFrame:
    """Add `<attr>__value`: the number of a numeric QI, the leaf position of a categorical one.

    Values outside the hierarchy, and fractions of numeric QIs, are refused.
    """
    rows = assign_leaves(df, {a: t for a, t in forest.items() if leaf_name(a) not in df.columns})
    if check and not out_of_domain(rows, forest).isEmpty():
        raise ValueError("values outside the fixed hierarchy")
    out = {}
    for attr, tree in forest.items():
        if tree.numeric:
            number = F.col(attr).cast("double")
            bad = F.raise_error(F.lit(f"{attr}: numeric quasi-identifiers must be whole numbers")).cast("double")
            out[value_name(attr)] = F.when(number.isNull() | (number == F.floor(number)), number).otherwise(bad)
        else:
            out[value_name(attr)] = F.col(leaf_name(attr)).cast("double")
    return rows.withColumns(out)


def _paths(tree: Hierarchy) -> list[str]:
    return [_STEP.join(str(tree.position[n]) for n in p) for p in tree.paths]


def child_at(tree: Hierarchy, leaf: Column, depth: Column) -> Column:
    """Node position of a leaf's ancestor at a depth; NULL below the leaf."""
    path = F.split(F.get(F.split(F.lit("\u0001".join(_paths(tree))), "\u0001"), leaf.cast("int")), _STEP)
    return F.get(path, depth.cast("int")).cast("int")


def _span(tree: Hierarchy) -> tuple[float, float]:
    return (min(tree.nodes[x].lo for x in tree.leaves), max(tree.nodes[x].hi for x in tree.leaves))


def root_region(tree: Hierarchy, attr: str) -> list[Column]:
    lo, hi = _span(tree) if tree.numeric else (None, None)
    return [F.lit(lo).cast("double").alias(f"{attr}__lo"), F.lit(hi).cast("double").alias(f"{attr}__hi"),
            F.lit(tree.position[tree.root]).alias(f"{attr}__node"), F.lit(True).alias(f"{attr}__missing")]


def region_columns(forest: Forest) -> list[str]:
    return [f"{a}__{c}" for a in forest for c in ("lo", "hi", "node", "missing")]


def fit_mondrian(
    df: DataFrame, forest: Forest, label: str, k: int, variant: str = MEDIAN, check: bool = True,
    scratch: Scratch | None = None, max_passes: int = 10_000,
) -> FittedMondrian:
    """Fit a median or information-gain tree; every leaf holds at least k rows (see `fit_trees`)."""
    return fit_trees(df, forest, label, {TOP: (variant, k)}, check, scratch, max_passes)


def numbered_trees(points: Sequence[tuple[str, int]]) -> dict[str, tuple[str, int]]:
    """Prefixes for several `(variant, k)`."""
    return {f"{i}:": (v, int(k)) for i, (v, k) in enumerate(points)}


def fit_trees(
    df: DataFrame, forest: Forest, label: str, trees: Mapping[str, tuple[str, int]], check: bool = True,
    scratch: Scratch | None = None, max_passes: int = 10_000,
) -> FittedMondrian:
    """Fit a tree for each `prefix: (variant, k)`, all in the same passes over the cells.

    A categorical cut replaces a node by its children (every occupied child, and the missing
    branch, needs k rows); a single occupied child is descended into before anything else. A
    numeric cut needs k rows on both sides and none or at least k missing. Information gain is in
    bits; without a gain above 1e-12 the median rule decides.
    """
    if not trees or any(v not in (MEDIAN, INFOGAIN) for v, _ in trees.values()):
        raise ValueError("variant is median or infogain")
    if any(k < 1 for _, k in trees.values()):
        raise ValueError("k must be positive")
    scratch = scratch or Scratch(df.sparkSession, "tree")
    attrs = list(forest)
    values = [value_name(a) for a in attrs]
    # The input is read once: checks, classes and cells come from its distinct QI values and labels.
    given = [a for a, t in forest.items() if t.numeric or check or leaf_name(a) not in df.columns]
    given += [leaf_name(a) for a in attrs if leaf_name(a) in df.columns]
    counted = scratch.save(df.groupBy(*dict.fromkeys([*given, label])).agg(F.count(F.lit(1)).alias("_rows")))
    rows = mondrian_values(counted, forest, check).select(*values, label, "_rows")
    classes = [r[0] for r in rows.select(label).distinct().orderBy(label).limit(MAX_CLASSES + 1).collect()]
    if len(classes) > MAX_CLASSES or None in classes:
        raise ValueError("labels must be present and few")
    counts = [f"c{i}" for i in range(len(classes))]
    cells = rows.groupBy(*values).agg(
        F.sum("_rows").alias("n"),
        *[F.sum(F.when(F.col(label) == F.lit(c), F.col("_rows")).otherwise(0)).alias(name) for c, name in zip(classes, counts)])
    cells = scratch.save(cells)
    total = cells.agg(F.sum("n").alias("n")).first()["n"]
    if not total or total < max(k for _, k in trees.values()):
        raise ValueError("the training rows must number at least k")
    state = scratch.save(cells.select(*values, "n", *counts, _each_tree(trees).alias("_tree")).select(
        *values, "n", *counts, F.concat("_tree", F.lit(FIRST)).alias("path"),
        # Depth of the current hierarchy node per categorical QI; -1 once the missing branch is taken.
        *[F.lit(0).alias(f"{a}__depth") for a in categorical_attrs(forest)],
        *[F.lit(True).alias(f"{a}__open") for a in categorical_attrs(forest)]))
    carried = state.columns
    # Distinct values of the widest QI, bounded from above by a sketch; its error is far below the doubling.
    sketches = cells.agg(*[F.approx_count_distinct(v).alias(v) for v in values]).first()
    widest = 2 * max(sketches)
    all_cuts, fitted_cells = [], []
    for _ in range(max_passes):
        cuts = scratch.save(_best_cuts(state, forest, counts, trees, widest, scratch))
        entries = cuts.count()
        if entries == 0:
            fitted_cells.append(state.select(*values, "n", *counts, "path"))
            break
        all_cuts.append(cuts)
        marked = attach_small(state, cuts, ["path"], "rows", entries)
        branch = _branch(forest)
        moves = {"path": F.when(F.col("attr").isNotNull(), F.concat_ws("/", "path", branch)).otherwise(F.col("path"))}
        for a in categorical_attrs(forest):
            here = F.coalesce(F.col("attr") == attrs.index(a), F.lit(False))
            gone = here & F.col(value_name(a)).isNull()
            moves[f"{a}__depth"] = F.when(here & ~gone, F.col(f"{a}__depth") + 1).otherwise(F.col(f"{a}__depth"))
            moves[f"{a}__open"] = F.col(f"{a}__open") & ~gone
        split = scratch.save(marked.withColumn("_more", F.col("attr").isNotNull()).withColumns(moves)
                             .select(*carried, "_more"), partition_by=("_more",))
        fitted_cells.append(split.where(~F.col("_more")).select(*values, "n", *counts, "path"))
        state = split.where(F.col("_more")).select(*carried)
    else:
        raise RuntimeError("too many passes")
    cells = scratch.save(reduce(DataFrame.unionByName, fitted_cells))
    nodes = scratch.save(_node_table(cells, all_cuts, forest, total, trees))
    variant, k = next(iter(trees.values()))
    return FittedMondrian(nodes, cells, forest, k, variant, tuple(classes), dict(trees))


def _node_table(cells: DataFrame, all_cuts: Sequence[DataFrame], forest: Forest, total: int, trees: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Every node with its split and published region, from the leaves upward: cells are summed per leaf first, and leaves meet their ancestors.

    A numeric region is the observed range and whether a value is missing. A categorical one is the
    node the last split on that QI led to; at the root it takes missing values along, below it
    they have a branch of their own.
    """
    spark = cells.sparkSession
    attrs = list(forest)
    first, again = [F.sum("n").alias("size")], [F.sum("size").alias("size")]
    for a in numeric_attrs(forest):
        v = F.col(value_name(a))
        for name, agg, column in ((f"{a}__lo", F.min, v), (f"{a}__hi", F.max, v), (f"{a}__missing", F.max, v.isNull())):
            first.append(agg(column).alias(name))
            again.append(agg(name).alias(name))
    above = cells.groupBy("path").agg(*first).withColumn("path", F.explode(F.slice(_ancestors(F.col("path")), 2, 1_000_000)))
    seen = above.groupBy("path").agg(*again)
    empty = spark.createDataFrame([], "path string, rows bigint, attr int, kind string, threshold double, gain double")
    cuts = reduce(DataFrame.unionByName, all_cuts, empty)
    # (node, ancestor, branch taken at the ancestor) -> the last branch per categorical QI.
    steps = F.split("path", "/")
    walk = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.struct(
        F.array_join(F.slice(steps, 1, i), "/").alias("path"), F.get(steps, i).alias("branch"), i.alias("at")))
    walked = seen.where(F.size(steps) > 1).select(F.col("path").alias("node"), F.explode(walk).alias("w")).select("node", "w.*")
    taken = attach(walked, cuts.select("path", "attr", "rows"), ["path"], "rows")
    last = taken.groupBy("node").agg(*[
        F.max_by(F.when(F.col("attr") == attrs.index(a), F.col("branch")), F.when(F.col("attr") == attrs.index(a), F.col("at"))).alias(f"_{a}")
        for a in categorical_attrs(forest)], F.count(F.lit(1)).alias("_steps"))
    named = attach(seen, cuts, ["path"], "rows").drop("rows")
    named = attach(named, last.withColumnRenamed("node", "path"), ["path"], "_steps").drop("_steps")
    for a, t in forest.items():
        if t.numeric:
            named = named.withColumn(f"{a}__node", F.lit(None).cast("int"))
            continue
        branch = F.col(f"_{a}")
        node = F.when(branch.isNull(), F.lit(t.position[t.root])).when(branch != MISSING_BRANCH, branch.try_cast("int"))
        named = named.withColumns({
            f"{a}__lo": F.lit(None).cast("double"), f"{a}__hi": F.lit(None).cast("double"), f"{a}__node": node,
            f"{a}__missing": branch.isNull() | (branch == MISSING_BRANCH)})
    named = named.select("path", "size", F.coalesce("kind", F.lit("leaf")).alias("kind"), "attr", "threshold", "gain", *region_columns(forest))
    top = spark.range(1).select(
        _each_tree(trees).alias("path"), F.lit(total).cast("bigint").alias("size"), F.lit("root").alias("kind"),
        F.lit(None).cast("int").alias("attr"), F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("double").alias("gain"),
        *[c for a, t in forest.items() for c in root_region(t, a)])
    return named.unionByName(top).withColumn("depth", F.when(_is_top(F.col("path")), 0).otherwise(F.size(F.split("path", "/"))))


def _split_sums(histogram: DataFrame, names: Sequence[str], lost: Column, entries_per_group: int) -> DataFrame:
    """The window columns of `_best_cuts` for groups that are too long for one task."""
    group = ["path", "attr"]
    numbered = keyed.dense_index(histogram, group, ["key", "leaf"], "_i")
    summed = keyed.running_sums(numbered, group, "_i", list(names), entries_per_group)
    following = summed.select(*[F.col(g).alias(f"_f_{g}") for g in group], (F.col("_i") - 1).alias("_f_i"), F.col("key").alias("next_key"))
    joined = summed.join(following, (F.col("path") == F.col("_f_path")) & (F.col("attr") == F.col("_f_attr")) & (F.col("_i") == F.col("_f_i")), "left")
    ends = histogram.groupBy(*group).agg(
        F.min(F.when(~lost, F.col("key"))).alias("lo"), F.max(F.when(~lost, F.col("key"))).alias("hi"), F.count(F.lit(1)).alias("_entries"),
        *[F.sum(F.when(lost, F.col(c)).otherwise(0)).alias(f"{c}_lost") for c in names])
    return attach(joined.drop("_f_path", "_f_attr", "_f_i", "_i"), ends, group, "_entries").drop("_entries")


def _best_cuts(
    state: DataFrame, forest: Forest, counts: Sequence[str], trees: Mapping[str, tuple[str, int]], entries_per_group: int, scratch: Scratch,
) -> DataFrame:
    """The chosen cut of every open node that has one: `(path, attr, kind, threshold, gain, rows)`.

    One histogram `(path, attr, key, leaf)` serves all QIs. It is windowed per (path, attr), where it has at most
    `entries_per_group` entries: one per number or leaf of that QI, however many rows the node holds. Beyond what one task
    windows, running sums are taken across range partitions instead.
    """
    attrs = list(forest)
    entries = []
    for i, a in enumerate(attrs):
        t = forest[a]
        v = F.col(value_name(a))
        if t.numeric:
            # Missing numbers sort last, behind every cut.
            key = F.coalesce(v, F.lit(float("inf")))
            entries.append(F.struct(F.lit(i).alias("attr"), key.alias("key"), key.alias("leaf")))
        else:
            # -1 is the missing branch; -2 marks rows at a leaf or past the missing branch: no cut.
            child = child_at(t, v, F.col(f"{a}__depth") + 1).cast("double")
            usable = F.col(f"{a}__open") & (child.isNotNull() | v.isNull())
            entries.append(F.struct(F.lit(i).alias("attr"), F.when(usable, F.coalesce(child, F.lit(-1.0))).otherwise(F.lit(-2.0)).alias("key"),
                                    F.coalesce(v, F.lit(-1.0)).alias("leaf")))
    sums = [F.sum(c).alias(c) for c in ("n", *counts)]
    histogram = (state.select("path", "n", *counts, F.explode(F.array(*entries)).alias("e")).select("path", "e.*", "n", *counts)
                 .groupBy("path", "attr", "key", "leaf").agg(*sums))
    numeric_ids = [i for i, a in enumerate(attrs) if forest[a].numeric]
    is_numeric = F.col("attr").isin(*numeric_ids) if numeric_ids else F.lit(False)
    lost = F.col("key") == F.lit(float("inf"))
    names = ("n", *counts)
    if entries_per_group <= keyed.WINDOW_ROWS:
        group = Window.partitionBy("path", "attr")
        by_key = group.orderBy("key", "leaf")
        upto = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        table = histogram.select(
            "*", F.lead("key").over(by_key).alias("next_key"),
            F.min(F.when(~lost, F.col("key"))).over(whole).alias("lo"), F.max(F.when(~lost, F.col("key"))).over(whole).alias("hi"),
            *[F.sum(c).over(upto).alias(f"{c}_upto") for c in names], *[F.sum(c).over(whole).alias(f"{c}_total") for c in names],
            *[F.sum(F.when(lost, F.col(c)).otherwise(0)).over(whole).alias(f"{c}_lost") for c in names])
    else:
        table = _split_sums(scratch.save(histogram), names, lost, entries_per_group)
    k = _by_tree(F.col("path"), {p: size for p, (_, size) in trees.items()})
    # Numeric cuts: k rows on either side, none or at least k missing.
    present = F.col("n_total") - F.col("n_lost")
    legal = (is_numeric & ~lost & (F.col("n_upto") >= k) & (present - F.col("n_upto") >= k) & ((F.col("n_lost") == 0) | (F.col("n_lost") >= k)))
    cut_gain = (weighted_entropy([F.col(f"{c}_total") for c in counts]) - weighted_entropy([F.col(f"{c}_upto") for c in counts])
                - weighted_entropy([F.col(f"{c}_total") - F.col(f"{c}_upto") - F.col(f"{c}_lost") for c in counts])
                - weighted_entropy([F.col(f"{c}_lost") for c in counts])) / F.col("n_total")
    table = table.withColumns({"legal": legal, "gain": F.when(legal, cut_gain)})
    if entries_per_group <= keyed.WINDOW_ROWS:
        table = table.withColumn("top_gain", F.max("gain").over(group))
    else:
        table = scratch.save(table)
        tops = table.groupBy("path", "attr").agg(F.max("gain").alias("top_gain"), F.count(F.lit(1)).alias("_entries"))
        table = attach(table, tops, ["path", "attr"], "_entries").drop("_entries")
    table = table.withColumns({
        "off": F.abs(F.col("n_upto") - present / 2.0),
        "threshold": (F.col("key") + F.col("next_key")) / 2.0})
    tied = F.col("legal") & (F.abs(F.col("gain") - F.col("top_gain")) <= ENTROPY_GAIN_MIN)
    # Per child first, so that a child's entropy counts once.
    children = table.groupBy("path", "attr", "key").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in counts], F.count(F.lit(1)).alias("leaves"),
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("top_gain").alias("top_gain"),
        F.min(F.when(F.col("legal"), F.struct("off", "n_upto", "threshold"))).alias("middle"),
        F.min(F.when(tied, F.struct("off", "n_upto", "threshold"))).alias("informed"))
    own = weighted_entropy([F.col(c) for c in counts])
    per_attr = children.withColumn("_own", own).groupBy("path", "attr").agg(
        F.sum("n").alias("rows"), *[F.sum(c).alias(c) for c in counts], F.sum("leaves").alias("leaves"), F.sum("_own").alias("_own"),
        F.count(F.lit(1)).alias("branches"), F.min("n").alias("least"), F.min("key").alias("first_key"),
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("top_gain").alias("top_gain"),
        F.min("middle").alias("middle"), F.min("informed").alias("informed"))
    numeric_row = F.col("attr").isin(*numeric_ids) if numeric_ids else F.lit(False)
    scale = F.create_map(*[x for i, a in enumerate(attrs) for x in (
        F.lit(i), F.lit(max(_span(forest[a])[1] - _span(forest[a])[0], 1.0) if forest[a].numeric else float(len(forest[a].leaves))))])
    spread = F.when(numeric_row, F.col("hi") - F.col("lo")).otherwise(F.col("leaves").cast("double")) / scale[F.col("attr")]
    split_gain = (own - F.col("_own")) / F.col("rows")
    usable = F.when(numeric_row, F.col("middle").isNotNull()).otherwise((F.col("first_key") != -2.0) & (F.col("least") >= k))
    options = per_attr.where(usable).select(
        "path", "attr", "rows", F.when(numeric_row, "numeric").otherwise("categorical").alias("kind"), spread.alias("width"),
        F.when(numeric_row, F.col("top_gain")).otherwise(split_gain).alias("gain"),
        F.when(numeric_row, F.lit(2)).otherwise(F.col("branches")).alias("branches"),
        F.col("middle.threshold").alias("median_at"), F.col("informed.threshold").alias("informed_at"))
    unary = F.col("branches") == 1
    pick_median = F.struct("attr", "kind", F.col("median_at").alias("threshold"),
                           F.when(F.col("kind") == "numeric", 0.0).otherwise(F.col("gain")).alias("gain"))
    pick_gain = F.struct("attr", "kind", F.col("informed_at").alias("threshold"), "gain")
    informative = F.col("gain") > ENTROPY_GAIN_MIN
    chosen = options.groupBy("path").agg(
        F.max("rows").alias("rows"),
        F.min_by(F.when(unary, pick_gain), F.when(unary, F.col("attr"))).alias("descend"),
        F.max_by(F.when(informative, pick_gain), F.when(informative, F.struct("gain", "width", -F.col("attr")))).alias("informed"),
        F.max_by(pick_median, F.struct("width", -F.col("attr"))).alias("median"))
    by_gain = _by_tree(F.col("path"), {p: v == INFOGAIN for p, (v, _) in trees.items()})
    return chosen.withColumn("p", F.coalesce("descend", F.when(by_gain, F.col("informed")), "median")).select(
        "path", "rows", F.col("p.attr").alias("attr"), F.col("p.kind").alias("kind"), F.col("p.threshold").alias("threshold"), F.col("p.gain").alias("gain"))


def _branch(forest: Forest) -> Column:
    """Branch of a cell under the split in columns `attr`, `threshold`."""
    out = F.lit(None).cast("string")
    for i, (a, t) in enumerate(forest.items()):
        v = F.col(value_name(a))
        if t.numeric:
            side = F.when(v.isNull(), MISSING_BRANCH).when(v <= F.col("threshold"), "L").otherwise("R")
        else:
            child = child_at(t, v, F.col(f"{a}__depth") + 1)
            side = F.when(v.isNull(), MISSING_BRANCH).otherwise(child.cast("string"))
        out = F.when(F.col("attr") == i, side).otherwise(out)
    return out


# ---- published results ----------------------------------------------------------------------

def leaf_nodes(fitted: FittedMondrian) -> DataFrame:
    return fitted.nodes.where(F.col("kind") == "leaf")


def node_regions(fitted: FittedMondrian) -> DataFrame:
    """Region of every node, with hierarchy nodes by id and 'missing' where only NULLs were seen."""
    out = fitted.nodes
    for a in categorical_attrs(fitted.forest):
        out = out.withColumn(f"{a}__node", at(list(fitted.forest[a].nodes), F.col(f"{a}__node"), "string"))
    return out


def mondrian_rows(df: DataFrame, fitted: FittedMondrian) -> DataFrame:
    """Training rows with the path of their leaf."""
    rows = mondrian_values(df, fitted.forest, check=False)
    return attach(rows, fitted.cells.select(*fitted.values, "n", "path"), fitted.values, "n").drop("n")


def published_k(fitted: FittedMondrian) -> DataFrame:
    """Class size per leaf, equal published regions being one class: `(path, k)`."""
    regions = region_columns(fitted.forest)
    leaves = leaf_nodes(fitted)
    sizes = leaves.groupBy(*regions).agg(F.sum("size").alias("k"))
    return attach(leaves.select("path", *regions), sizes, regions, "k").select("path", "k")


def published_histogram(fitted: FittedMondrian, per_tree: bool = False) -> DataFrame:
    """`(k, class_count)` of the published regions, with the column `tree` for several trees."""
    tree = [tree_of(F.col("path")).alias("tree")] if per_tree else []
    sizes = leaf_nodes(fitted).groupBy(*tree, *region_columns(fitted.forest)).agg(F.sum("size").alias("k"))
    return sizes.groupBy(*(["tree"] if per_tree else []), "k").agg(F.count(F.lit(1)).alias("class_count"))


def region_representation(regions: DataFrame, tree: Hierarchy, lo: str, hi: str) -> DataFrame:
    """Numeric ranges to model values: mean, number of covered leaves, height of the common ancestor.

    Covered leaves are found by position (the first leaf ending at or after lo, the last starting
    at or before hi), and means come from prefix sums over the sorted leaves: no range is expanded.
    A sparse scalar tree averages its leaves; an interval tree averages the integers in the cut leaves.
    """
    spans = sorted((tree.nodes[x].lo, tree.nodes[x].hi, i) for i, x in enumerate(tree.leaves))
    scalar = not tree.interval_leaves
    size, total = [0.0], [0.0]
    for a, b, _ in spans:
        n = 1.0 if scalar else b - a + 1
        size.append(size[-1] + n)
        total.append(total[-1] + (a if scalar else (a + b) * n / 2))
    first = count_below([s[1] for s in spans], F.col(lo), strict=True)
    last = count_below([s[0] for s in spans], F.col(hi)) - 1
    starts, ends = [s[0] for s in spans], [s[1] for s in spans]
    n = at(size, last + 1, "double") - at(size, first, "double")
    t = at(total, last + 1, "double") - at(total, first, "double")
    if not scalar:
        cut_lo = F.greatest(F.col(lo) - at(starts, first, "double"), F.lit(0.0))
        cut_hi = F.greatest(at(ends, last, "double") - F.col(hi), F.lit(0.0))
        t = t - cut_lo * (at(starts, first, "double") * 2 + cut_lo - 1) / 2 - cut_hi * (at(ends, last, "double") * 2 - cut_hi + 1) / 2
        n = n - cut_lo - cut_hi
    order = [s[2] for s in spans]
    height = common_height(tree, at(order, first, "int"), at(order, last, "int"))
    return regions.select("*", (t / n).alias("mean"), (last - first + 1).cast("bigint").alias("leaves"), height.cast("bigint").alias("height"))


def encode_regions(fitted: FittedMondrian) -> DataFrame:
    """Model layout of every leaf's published region: long form `(path, attr, feature, value)`.

    Numeric QIs give their mean and the ancestor's height; categorical ones a uniform weight over
    the leaves under the node, and the node's height.
    """
    parts = []
    leaves = leaf_nodes(fitted)
    for a, t in fitted.forest.items():
        if t.numeric:
            made = region_representation(leaves.where(F.col(f"{a}__lo").isNotNull()).select("path", f"{a}__lo", f"{a}__hi"), t, f"{a}__lo", f"{a}__hi")
            for feature in ("mean", "height"):
                parts.append(made.select("path", F.lit(a).alias("attr"), F.lit(feature).alias("feature"), F.col(feature).cast("double").alias("value")))
            continue
        node = F.col(f"{a}__node")
        firsts = [n.leaf_first for n in t.nodes.values()]
        sizes = [n.leaf_count for n in t.nodes.values()]
        heights = [n.height for n in t.nodes.values()]
        named = leaves.where(node.isNotNull())
        start, count = at(firsts, node, "int"), at(sizes, node, "int")
        spread = named.select("path", F.explode(F.sequence(start, start + count - 1)).alias("leaf"), count.alias("count"))
        parts.append(spread.select("path", F.lit(a).alias("attr"),
                                   at([t.nodes[x].value for x in t.leaves], F.col("leaf"), "string").alias("feature"), (F.lit(1.0) / F.col("count")).alias("value")))
        parts.append(named.select("path", F.lit(a).alias("attr"), F.lit("height").alias("feature"), at(heights, node, "double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


# ---- routing --------------------------------------------------------------------------------

def _contains(forest: Forest, attr: str, prefix: str = "") -> Column:
    """Whether a node's region holds a cell's value."""
    t = forest[attr]
    v = F.col(value_name(attr))
    missing = F.coalesce(F.col(f"{prefix}{attr}__missing"), F.lit(False))
    if t.numeric:
        lo, hi = F.col(f"{prefix}{attr}__lo"), F.col(f"{prefix}{attr}__hi")
        inside = F.coalesce((v >= lo) & (v <= hi), F.lit(False))
    else:
        node = F.col(f"{prefix}{attr}__node")
        first = at([n.leaf_first for n in t.nodes.values()], node, "int")
        count = at([n.leaf_count for n in t.nodes.values()], node, "int")
        inside = F.coalesce((v >= first) & (v < first + count), F.lit(False))
    return F.when(v.isNull(), missing).otherwise(inside)


def _ancestors(path: Column) -> Column:
    """All paths above and including a path: the synthetic root, `r`, `r/..`, ..."""
    steps = F.split(path, "/")
    return F.concat(F.array(tree_of(path)), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")))


def routing_cells(df: DataFrame, forest: Forest, check: bool = True) -> DataFrame:
    """Evaluation rows per combination of QI values."""
    values = [value_name(a) for a in forest]
    return mondrian_values(df, forest, check).groupBy(*values).agg(F.count(F.lit(1)).alias("n"))


def route_split_widening(df: DataFrame, fitted: FittedMondrian, check: bool = True) -> DataFrame:
    """Route by the fitted splits, one node level per pass; every cell of QI values gets one row.

    Columns: the cell's values, `n`, `node` (where it stops), `stop_kind` (leaf, internal, root),
    `stopped_at` and `reason` for an absent branch, and `<attr>__source`: the node whose region
    represents the QI. At a leaf each QI takes the deepest ancestor that contains it; a cell without
    a branch stops whole at the deepest ancestor that contains all its QIs.
    """
    forest = fitted.forest
    scratch = Scratch(df.sparkSession, "routing")
    values, cats = fitted.values, categorical_attrs(forest)
    nodes = fitted.nodes
    holds = reduce(lambda a, b: a & b, [_contains(forest, a) for a in forest])
    sources = [f"{a}__source" for a in forest]
    # What a cell has found on its way down: per QI the deepest node holding its value, and the deepest one holding all of them.
    cells = routing_cells(df, forest, check).select("*", _each_tree(fitted.trees).alias("_tree"))
    roots = cells.select("*", *[c for a, t in forest.items() for c in root_region(t, a)])
    state = scratch.save(roots.select(
        *values, "n", F.concat("_tree", F.lit(FIRST)).alias("path"), *[F.lit(0).alias(f"{a}__depth") for a in cats],
        *[F.when(_contains(forest, a), F.col("_tree")).alias(f"{a}__source") for a in forest], F.when(holds, F.col("_tree")).alias("_whole")))
    depths = nodes.agg(F.max("depth")).first()[0]
    level_columns = ["path", "kind", "attr", "threshold", "size", *region_columns(forest)]
    arrived, lost = [], []
    attrs = list(forest)
    for depth in range(1, depths + 1):
        level = nodes.where(F.col("depth") == depth).select(*level_columns)
        met = attach(state, level, ["path"], "size")
        found = {f"{a}__source": F.when(_contains(forest, a), F.col("path")).otherwise(F.col(f"{a}__source")) for a in forest}
        at_node = met.withColumns({**found, "_whole": F.when(holds, F.col("path")).otherwise(F.col("_whole"))})
        arrived.append(at_node.where(F.col("kind") == "leaf").select(*values, "n", F.col("path").alias("node"), *sources))
        inner = at_node.where(F.col("kind") != "leaf")
        moves = {"_next": F.concat_ws("/", "path", _branch(forest))}
        for a in cats:
            here = (F.col("attr") == attrs.index(a)) & F.col(value_name(a)).isNotNull()
            moves[f"{a}__depth"] = F.when(here, F.col(f"{a}__depth") + 1).otherwise(F.col(f"{a}__depth"))
        stepped = inner.withColumns(moves).select(
            *values, "n", F.col("path").alias("_from"), F.col("kind").alias("_kind"), F.col("_next").alias("path"), *[f"{a}__depth" for a in cats], *sources, "_whole")
        below = nodes.where(F.col("depth") == depth + 1).select("path", F.col("size").alias("_size"))
        checked = scratch.save(attach(stepped, below, ["path"], "_size"))
        lost.append(checked.where(F.col("_size").isNull()).select(*values, "n", F.col("_from").alias("stopped_at"), F.col("_kind").alias("kind"), "_whole"))
        state = checked.where(F.col("_size").isNotNull()).drop("_size", "_from", "_kind")
        if state.isEmpty():
            break
    at_leaf = reduce(DataFrame.unionByName, arrived).select(
        *values, "n", "node", F.lit("leaf").alias("stop_kind"), F.lit(None).cast("string").alias("stopped_at"), F.lit(None).cast("string").alias("reason"), *sources)
    reason = F.when(F.col("kind") == "categorical", "unoccupied_categorical_branch").otherwise("unobserved_numeric_missing_branch")
    # A cell outside the root's region is held by no node at all, and is left out as before.
    stopped = reduce(DataFrame.unionByName, lost).where(F.col("_whole").isNotNull()).select(
        *values, "n", F.col("_whole").alias("node"), F.when(_is_top(F.col("_whole")), "root").otherwise("internal").alias("stop_kind"),
        "stopped_at", reason.alias("reason"), *[F.col("_whole").alias(s) for s in sources])
    return at_leaf.unionByName(stopped)


def route_containment(df: DataFrame, fitted: FittedMondrian, check: bool = True) -> DataFrame:
    """Older policy: descend while one child's whole region contains the record.

    Sibling regions do not overlap, so the next child is the split branch, taken only if its region
    holds the cell; otherwise the cell stops at the current node.
    """
    forest = fitted.forest
    scratch = Scratch(df.sparkSession, "containment")
    values, cats = fitted.values, categorical_attrs(forest)
    nodes = fitted.nodes
    regions = nodes.select("path", "kind", "attr", "threshold", F.col("size"), "depth", *region_columns(forest))
    holds = reduce(lambda a, b: a & b, [_contains(forest, a) for a in forest])
    attrs = list(forest)
    state = scratch.save(routing_cells(df, forest, check).select(
        *values, "n", _each_tree(fitted.trees).alias("_at"), F.lit("root").alias("_kind"), *[F.lit(0).alias(f"{a}__depth") for a in cats])
        .withColumn("path", F.concat("_at", F.lit(FIRST))))
    stopped = []
    for depth in range(1, nodes.agg(F.max("depth")).first()[0] + 2):
        level = regions.where(F.col("depth") == depth).drop("depth")
        tried = attach(state, level, ["path"], "size").withColumn("_in", F.coalesce(holds & F.col("size").isNotNull(), F.lit(False)))
        tried = scratch.save(tried.select(*values, "n", "_at", "_kind", "path", "kind", "attr", "threshold", "_in", *[f"{a}__depth" for a in cats]))
        stopped.append(tried.where(~F.col("_in")).select(*values, "n", F.col("_at").alias("node"), F.col("_kind").alias("kind")))
        stopped.append(tried.where(F.col("_in") & (F.col("kind") == "leaf")).select(*values, "n", F.col("path").alias("node"), "kind"))
        inner = tried.where(F.col("_in") & (F.col("kind") != "leaf"))
        moves = {"_next": F.concat_ws("/", "path", _branch(forest))}
        for a in cats:
            here = (F.col("attr") == attrs.index(a)) & F.col(value_name(a)).isNotNull()
            moves[f"{a}__depth"] = F.when(here, F.col(f"{a}__depth") + 1).otherwise(F.col(f"{a}__depth"))
        state = inner.withColumns(moves).select(*values, "n", F.col("path").alias("_at"), F.col("kind").alias("_kind"),
                                                F.col("_next").alias("path"), *[f"{a}__depth" for a in cats])
        if state.isEmpty():
            break
    out = reduce(DataFrame.unionByName, stopped)
    kind = F.when(_is_top(F.col("node")), "root").when(F.col("kind") == "leaf", "leaf").otherwise("internal")
    return out.select(*values, "n", "node", kind.alias("stop_kind"))


def routing_stats(routed: DataFrame, forest: Forest, review_threshold: float = 0.01, per_tree: bool = False) -> DataFrame:
    """Stops by kind, widened rows, adjusted share, and whether it exceeds the threshold: one row, or one per `tree`."""
    widened = [F.col("stop_kind").eqNullSafe("leaf") & (F.col(f"{a}__source") != F.col("node")) for a in forest]
    any_widened = reduce(lambda a, b: a | b, widened)
    n = F.col("n")

    def rows(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    grouped = routed.groupBy(tree_of(F.col("node")).alias("tree")) if per_tree else routed
    out = grouped.agg(
        F.sum("n").alias("population"), rows(F.col("stop_kind") == "leaf").alias("leaf_count"),
        rows(F.col("stop_kind") == "internal").alias("internal_count"), rows(F.col("stop_kind") == "root").alias("root_count"),
        rows(any_widened).alias("widened_count"),
        reduce(lambda a, b: a + b, [rows(w) for w in widened]).alias("widened_qi_count"),
        *[rows(w).alias(f"{a}__widened") for a, w in zip(forest, widened)])
    fallback = F.col("internal_count") + F.col("root_count")
    adjusted = (fallback + F.col("widened_count")) / F.col("population")
    return out.select("*", (F.col("leaf_count") - F.col("widened_count")).alias("unmodified_count"),
                      fallback.alias("fallback_count"), adjusted.alias("adjusted_fraction"), (adjusted > review_threshold).alias("review_needed"))


def diagnose_routing(df: DataFrame, fitted: FittedMondrian) -> DataFrame:
    """Why containment stops rows early, beside what split routing does with them: `(cause, stop_kind, widened, rows)`.

    A stop is caused by the observed range of the split QI (a gap), by the shrunken range of other
    numeric QIs, by values outside the training root, or by an absent branch.
    """
    forest = fitted.forest
    values = fitted.values
    scratch = Scratch(df.sparkSession, "diagnosis")
    old = scratch.save(route_containment(df, fitted))
    new = scratch.save(route_split_widening(df, fitted))
    cats = categorical_attrs(forest)
    attrs = list(forest)
    nodes = fitted.nodes
    here = attach(old, nodes.select(F.col("path").alias("node"), "attr", "threshold", F.col("kind").alias("node_kind"), "size"), ["node"], "size").drop("size")
    # Depth of each categorical QI at a node, counted from the splits on the way down.
    lineage = scratch.save(_categorical_depths(nodes, cats, attrs))
    placed = attach(here, lineage, ["node"], "_weight").drop("_weight")
    child = F.when(_is_top(F.col("node")), F.lit(FIRST)).otherwise(F.concat_ws("/", "node", _branch(forest)))
    regions = nodes.select("path", F.col("size").alias("_size"), *region_columns(forest))
    tried = attach(placed.withColumn("path", child), regions, ["path"], "_size")
    fails = []
    for i, a in enumerate(attrs):
        kind = (F.when(_is_top(F.col("node")), "outside_observed_training_root")
                .when(F.lit(forest[a].numeric) & (F.col("attr") == i), "split_numeric_observed_range_gap")
                .when(F.lit(forest[a].numeric), "non_split_numeric_observed_range_shrink")
                .otherwise("unexpected_non_split_categorical_exclusion"))
        fails.append(F.when(~_contains(forest, a), kind))
    found = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*fails)))), "+")
    absent = F.when(F.col("node_kind") == "categorical", "unoccupied_categorical_branch").otherwise("unobserved_numeric_missing_branch")
    cause = F.when(F.col("stop_kind") == "leaf", "leaf").when(F.col("_size").isNull(), absent).otherwise(found)
    causes = tried.select(*values, "n", cause.alias("cause"))
    widened = reduce(lambda a, b: a + b, [(F.col(f"{a}__source") != F.col("node")).cast("int") for a in forest])
    after = new.select(*values, F.col("n").alias("_rows"), "stop_kind", F.when(F.col("stop_kind") == "leaf", widened).otherwise(0).alias("widened"))
    return (attach(causes, after, values, "_rows").groupBy("cause", "stop_kind", "widened").agg(F.sum("n").alias("rows")))


def _categorical_depths(nodes: DataFrame, cats: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    """Per node: how many of its ancestors split each categorical QI (and were not the missing branch)."""
    climbed = nodes.select(F.col("path").alias("node"), F.col("size").alias("_weight"), F.explode(_ancestors(F.col("path"))).alias("path"))
    above = climbed.where(F.col("path") != F.col("node"))
    splits = nodes.select("path", "attr", F.col("size").alias("_size"))
    seen = attach(above, splits, ["path"], "_size")
    counted = seen.groupBy("node").agg(*[F.sum(F.when(F.col("attr") == attrs.index(a), 1).otherwise(0)).cast("int").alias(f"{a}__depth") for a in cats])
    base = nodes.select(F.col("path").alias("node"), F.col("size").alias("_weight"))
    return base.join(counted, "node", "left").fillna(0, [f"{a}__depth" for a in cats])
