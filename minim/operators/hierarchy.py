"""Value hierarchies: node tables, closure, audits, and generalization of rows.

A `Hierarchy` is the driver's copy of one attribute's tree. Its node count is checked against
`MAX_NODES`; below that bound a tree is compiled into literal arrays, so that generalizing a row
is an array lookup inside whole-stage codegen: no join, no shuffle, no Python.

Trees held as DataFrames (any size) are handled by the functions on node tables.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minim.operators.keyed import dense_index

MAX_NODES = 200_000
MISSING = "__missing__"
# Fixed value: the spellings of a closed interval leaf ("0 ~ 4", "0 to 4", dashes).
INTERVAL = re.compile(
    r"^\s*([+-]?\d+(?:\.\d+)?)\s*(?:~|to|–|—|-)\s*([+-]?\d+(?:\.\d+)?)\s*$"
)

NODE_SCHEMA = T.StructType([
    T.StructField("attr", T.StringType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("parent", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("lo", T.DoubleType()),
    T.StructField("hi", T.DoubleType()),
    T.StructField("leaf_count", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
])


def normalize_code(value) -> str:
    """Text of a category code, with `1.0` and `1` as the same code."""
    text = str(value).strip()
    try:
        number = float(text)
    except ValueError:
        return str(value)
    return str(int(number)) if number.is_integer() else repr(number)


@dataclass
class Node:
    node_id: str
    parent: str | None
    value: str | None = None
    lo: float | None = None
    hi: float | None = None
    children: list[str] = field(default_factory=list)
    depth: int = 0
    height: int = 0
    leaf_first: int = 0
    leaf_count: int = 0


class Hierarchy:
    """One attribute's tree, leaves numbered in depth-first order."""

    def __init__(self, attr: str, nodes: Iterable[Node], numeric: bool = False,
                 string_codes: bool = False):
        self.attr, self.numeric, self.string_codes = attr, numeric, string_codes
        listed = list(nodes)
        if len(listed) > MAX_NODES:
            raise ValueError(f"{attr}: {len(listed)} nodes exceed the driver bound {MAX_NODES}")
        self.nodes = {n.node_id: n for n in listed}
        if len(self.nodes) != len(listed):
            raise ValueError(f"{attr}: duplicate node ids")
        roots = [n.node_id for n in listed if n.parent is None]
        if len(roots) != 1 or MISSING in self.nodes:
            raise ValueError(f"{attr}: expected one root and no reserved id")
        self.root = roots[0]
        for n in listed:
            if n.parent is not None:
                if n.parent not in self.nodes:
                    raise ValueError(f"{attr}: missing parent {n.parent!r}")
                self.nodes[n.parent].children.append(n.node_id)
        self.leaves: list[str] = []
        self.paths: list[list[str]] = []
        self._number()
        if len(self._seen) != len(listed):
            raise ValueError(f"{attr}: cyclic or disconnected nodes")
        self.position = {name: i for i, name in enumerate(self.nodes)}

    def _number(self) -> None:
        self._seen: set[str] = set()
        path: list[str] = []
        stack = [(self.root, False)]
        while stack:
            name, closing = stack.pop()
            node = self.nodes[name]
            if closing:
                node.leaf_count = len(self.leaves) - node.leaf_first
                if node.children:
                    node.height = 1 + max(self.nodes[c].height for c in node.children)
                path.pop()
                continue
            if name in self._seen:
                raise ValueError(f"{self.attr}: cyclic nodes")
            self._seen.add(name)
            node.depth, node.leaf_first = len(path), len(self.leaves)
            path.append(name)
            stack.append((name, True))
            if node.children:
                stack.extend((c, False) for c in reversed(node.children))
            else:
                self.leaves.append(name)
                self.paths.append(list(path))
                if self.numeric and node.lo is None:
                    node.lo, node.hi = parse_interval(node.value)
                if not self.numeric and node.value is not None and not self.string_codes:
                    node.value = normalize_code(node.value)

    @property
    def height(self) -> int:
        return self.nodes[self.root].height

    @property
    def interval_leaves(self) -> bool:
        return any(self.nodes[x].lo != self.nodes[x].hi for x in self.leaves)

    @property
    def numeric_codes(self) -> bool:
        return any(re.match(NUMBER, self.nodes[x].value or "") for x in self.leaves)

    def climb(self, leaf: int, level: int) -> str:
        """Go up from a leaf while the node is lower than `level` and has a parent."""
        path = self.paths[leaf]
        for name in reversed(path):
            if self.nodes[name].height >= level:
                return name
        return path[0]

    def targets(self, level: int) -> list[str]:
        """The published node of every leaf at a level."""
        return [self.climb(i, level) for i in range(len(self.leaves))]

    def leaf_range(self, name: str) -> range:
        node = self.nodes[name]
        return range(node.leaf_first, node.leaf_first + node.leaf_count)

    def numeric_value(self, name: str, lo: float | None = None, hi: float | None = None) -> float:
        """Mean of the integers under a node (interval trees) or of its leaf values.

        With `lo`, `hi` the leaves are cut to that range first.
        """
        spans = [(self.nodes[self.leaves[i]].lo, self.nodes[self.leaves[i]].hi)
                 for i in self.leaf_range(name)]
        return span_mean(spans, self.interval_leaves, lo, hi)

    def category_weights(self, name: str) -> list[float]:
        """Uniform weight over the leaves under a node."""
        out = [0.0] * len(self.leaves)
        span = self.leaf_range(name)
        for i in span:
            out[i] = 1.0 / len(span)
        return out

    def rows(self) -> list[tuple]:
        out = []
        for n in self.nodes.values():
            kind = "root" if n.parent is None else ("internal" if n.children else "leaf")
            out.append((self.attr, n.node_id, n.parent, kind, n.value,
                        None if n.lo is None else float(n.lo),
                        None if n.hi is None else float(n.hi),
                        n.leaf_count, n.depth, n.height))
        return out


Forest = Mapping[str, Hierarchy]


def parse_interval(text) -> tuple[float, float]:
    """`"0 ~ 4"` -> (0, 4); a single number -> (v, v)."""
    match = INTERVAL.match(str(text))
    if match:
        return float(match.group(1)), float(match.group(2))
    return float(text), float(text)


def span_mean(spans: Sequence[tuple[float, float]], intervals: bool,
              lo: float | None = None, hi: float | None = None) -> float:
    """Mean of the integers in a union of spans, in closed form; or of scalar leaf values."""
    kept = [(a, b) for a, b in spans
            if (hi is None or a <= hi) and (lo is None or b >= lo)]
    if not kept:
        raise ValueError("the range contains no leaves")
    if not intervals:
        return sum(a for a, _ in kept) / len(kept)
    total = count = 0
    reach = None
    for a, b in sorted(kept):
        a = int(a if lo is None else max(a, lo))
        b = int(b if hi is None else min(b, hi))
        if reach is not None:
            a = max(a, reach + 1)
        if b < a:
            continue
        total += (a + b) * (b - a + 1) // 2
        count += b - a + 1
        reach = b
    return total / count


def flat_hierarchy(attr: str, values: Sequence, root: str = "any") -> Hierarchy:
    """Every value directly under the root."""
    return Hierarchy(attr, [Node(root, None)] + [Node(str(v), root, str(v)) for v in values])


def nested_hierarchy(attr: str, tree: Mapping, root: str = "any", numeric: bool = False) -> Hierarchy:
    """A hierarchy from nested dicts and lists; list items are leaf values."""
    nodes = [Node(root, None)]

    def walk(parent: str, item) -> None:
        if isinstance(item, Mapping):
            for name, below in item.items():
                nodes.append(Node(str(name), parent))
                walk(str(name), below)
        else:
            for value in item:
                if isinstance(value, Mapping):
                    walk(parent, value)
                else:
                    nodes.append(Node(str(value), parent, str(value)))

    walk(root, tree)
    return Hierarchy(attr, nodes, numeric=numeric)


def node_table(spark: SparkSession, forest: Forest) -> DataFrame:
    """All trees as one table `(attr, node_id, parent, kind, value, lo, hi, ...)`."""
    rows = [r for h in forest.values() for r in h.rows()]
    return spark.createDataFrame(rows, NODE_SCHEMA)


def hierarchy_from_table(attr: str, nodes: DataFrame, numeric: bool = False) -> Hierarchy:
    """The driver's copy of a node table, refused above `MAX_NODES`."""
    rows = nodes.select("node_id", "parent", "value", "lo", "hi").limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError(f"{attr}: more than {MAX_NODES} nodes")
    return Hierarchy(attr, [Node(r.node_id, r.parent, r.value, r.lo, r.hi) for r in
                            sorted(rows, key=lambda r: r.node_id)], numeric=numeric)


# ---- rows -> leaves -------------------------------------------------------------------------

def leaf_name(attr: str) -> str:
    return f"{attr}__leaf"


_SEP, _STEP = "\u0001", "\u0002"


def _array(values: Sequence, kind: str) -> Column:
    """A literal array. It is spelled as one constant text that the optimizer folds once."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    text = _SEP.join(repr(v) if isinstance(v, float) else str(v) for v in values)
    return F.split(F.lit(text), _SEP).cast(f"array<{kind}>")


def _path(texts: Sequence[str], position: Column, kind: str = "string") -> Column:
    """One of several short lists, by position."""
    return F.split(F.get(_array(texts, "string"), position), _STEP).cast(f"array<{kind}>")


def at(values: Sequence, position: Column, kind: str) -> Column:
    """`values[position]` with the values as one literal array; NULL position gives NULL."""
    return F.get(_array(values, kind), position)


# Up to this many sorted values a search is nested CASEs inside codegen; a longer list is a literal array, halved step by step.
INLINE_VALUES = 64


def count_below(sorted_values: Sequence[float], value: Column, strict: bool = False) -> Column:
    """How many of the sorted values are at most (`strict`: below) a number; its expression does not grow with the list."""
    n = len(sorted_values)

    def search(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        below = (F.lit(sorted_values[mid]) < value) if strict else (F.lit(sorted_values[mid]) <= value)
        return F.when(below, search(mid + 1, b)).otherwise(search(a, mid))

    if n <= INLINE_VALUES:
        return search(0, n)
    values = _array([float(v) for v in sorted_values], "double")
    steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)])

    def further(at_: Column, step: Column) -> Column:
        here = F.get(values, at_ + step - 1)
        # Beyond the end there is no value, and the step is not taken.
        return F.when((here < value) if strict else (here <= value), at_ + step).otherwise(at_)

    return F.aggregate(steps, F.lit(0), further)


def _winners(spans: Sequence[tuple[float, float]]) -> tuple[list[float], list[int], list[int]]:
    """Endpoints of the intervals in order, with the first interval that holds each, and the first that holds what follows it; -1 for none."""
    points = sorted({p for span in spans for p in span})
    starts = sorted(range(len(spans)), key=lambda i: spans[i][0])
    heap: list[int] = []
    at_point, after, nxt = [], [], 0
    for p in points:
        while nxt < len(starts) and spans[starts[nxt]][0] <= p:
            heapq.heappush(heap, starts[nxt])
            nxt += 1
        while heap and spans[heap[0]][1] < p:
            heapq.heappop(heap)
        at_point.append(heap[0] if heap else -1)
        while heap and spans[heap[0]][1] <= p:
            heapq.heappop(heap)
        after.append(heap[0] if heap else -1)
    return points, at_point, after


def _interval_position(tree: Hierarchy, value: Column) -> Column:
    """Leaf of a number, by binary search over the ends of the leaf intervals.

    Where leaves overlap, the first leaf in tree order wins: the line is cut at all ends beforehand.
    """
    spans = sorted((tree.nodes[x].lo, tree.nodes[x].hi, i) for i, x in enumerate(tree.leaves))
    if len(spans) <= INLINE_VALUES and all(a[1] < b[0] for a, b in zip(spans, spans[1:])):
        def search(a: int, b: int) -> Column:
            if b - a == 1:
                lo, hi, i = spans[a]
                return F.when((value >= lo) & (value <= hi), F.lit(i))
            mid = (a + b) // 2
            return F.when(value < F.lit(spans[mid][0]), search(a, mid)).otherwise(search(mid, b))

        return search(0, len(spans))
    points, at_point, after = _winners([(tree.nodes[x].lo, tree.nodes[x].hi) for x in tree.leaves])
    place = count_below(points, value) - 1
    found = F.when(at([float(p) for p in points], place, "double") == value, at(at_point, place, "int")).otherwise(at(after, place, "int"))
    return F.when(found >= 0, found)


# Text that reads as a number. Tested before casting: a failed cast is far dearer than a pattern.
NUMBER = r"^\s*[+-]?\d+(\.\d*)?([eE][+-]?\d+)?\s*$"


def code_column(df: DataFrame, column: str, tree: Hierarchy | None = None) -> Column:
    """Category code as text; whole numbers lose their decimals.

    Text is taken as it is when the tree has no numeric code that another spelling could mean.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType) or (tree is not None and (tree.string_codes or not tree.numeric_codes)):
        return F.col(column).cast("string")
    if isinstance(kind, T.NumericType):
        c = F.col(column)
        return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))
    number = F.when(F.col(column).rlike(NUMBER), F.trim(F.col(column)).cast("double"))
    return F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("bigint").cast("string")).otherwise(F.col(column))


# A category list this short is searched inside codegen; longer ones are hash-joined.
INLINE_CATEGORIES = 64


def assign_leaves(df: DataFrame, forest: Forest) -> DataFrame:
    """Add `<attr>__leaf`: the depth-first position of each value's leaf, NULL outside the tree."""
    out = df
    for attr, tree in forest.items():
        if tree.numeric:
            value = F.col(attr).cast("double")
            out = out.withColumn(leaf_name(attr), _interval_position(tree, value))
            continue
        code = code_column(df, attr, tree)
        values = [tree.nodes[x].value for x in tree.leaves]
        if len(values) <= INLINE_CATEGORIES:
            found = F.array_position(_array(values, "string"), code)
            out = out.withColumn(leaf_name(attr), F.when(found > 0, (found - 1).cast("int")))
        else:
            # Bounded: a Hierarchy holds at most MAX_NODES nodes.
            table = df.sparkSession.createDataFrame(
                list(zip(values, range(len(values)))), f"_code string, {leaf_name(attr)} int")
            out = (out.withColumn("_value", code)
                   .join(F.broadcast(table), F.col("_value") == F.col("_code"), "left")
                   .drop("_code", "_value"))
    return out


def node_column(tree: Hierarchy, level: int, raw: Column | None = None) -> Column:
    """Published node id of a row at a level, from its leaf position.

    A value outside the tree is published as it is (`raw` as text); a NULL stays NULL.
    """
    target = at(tree.targets(level), F.col(leaf_name(tree.attr)), "string")
    return target if raw is None else F.coalesce(target, raw.cast("string"))


def node_position(tree: Hierarchy, level: int) -> Column:
    """Position of the published node in the tree's node list, for lookups."""
    targets = [tree.position[t] for t in tree.targets(level)]
    return at(targets, F.col(leaf_name(tree.attr)), "int")


def ensure_leaves(df: DataFrame, forest: Forest) -> DataFrame:
    missing = {a: t for a, t in forest.items() if leaf_name(a) not in df.columns}
    return assign_leaves(df, missing) if missing else df


def generalize(df: DataFrame, forest: Forest, levels: Mapping[str, int], keep_raw: bool = False) -> DataFrame:
    """Replace each QI by its node id at the asked level. One projection, no shuffle."""
    with_leaves = ensure_leaves(df, forest)
    nodes = {}
    for attr, tree in forest.items():
        raw = F.col(attr)
        if not tree.numeric:
            raw = code_column(df, attr, tree)
        nodes[attr] = node_column(tree, int(levels.get(attr, 0)), raw)
    if keep_raw:
        return with_leaves.select("*", *[c.alias(f"{a}__node") for a, c in nodes.items()])
    return with_leaves.select(*[nodes[c].alias(c) if c in nodes else F.col(c) for c in df.columns])


def generalize_value(df: DataFrame, tree: Hierarchy, level: int, column: str | None = None) -> Column:
    """Node of single values: the expression `generalize` uses, for a column of raw values."""
    column = column or tree.attr
    if tree.numeric:
        position = _interval_position(tree, F.col(column).cast("double"))
        raw = F.col(column)
    else:
        raw = code_column(df, column, tree)
        found = F.array_position(_array([tree.nodes[x].value for x in tree.leaves], "string"), raw)
        position = F.when(found > 0, (found - 1).cast("int"))
    return F.coalesce(at(tree.targets(level), position, "string"), raw.cast("string"))


def max_levels(forest: Forest) -> dict[str, int]:
    return {a: t.height for a, t in forest.items()}


def out_of_domain(df: DataFrame, forest: Forest) -> DataFrame:
    """Non-NULL values without a leaf: `(attr, value, n)`."""
    with_leaves = ensure_leaves(df, forest)
    pairs = F.array(*[
        F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value"),
                 F.col(leaf_name(a)).isNull().alias("outside"))
        for a in forest])
    return (
        with_leaves.select(F.explode(pairs).alias("p")).select("p.*")
        .where(F.col("outside") & F.col("value").isNotNull())
        .groupBy("attr", "value").agg(F.count(F.lit(1)).alias("n"))
    )


# ---- node tables of any size ----------------------------------------------------------------

def hierarchy_from_columns(df: DataFrame, attr: str, levels: Sequence[str], root: str = "any") -> DataFrame:
    """Node table of a dimension whose columns run from coarse to fine; the last is the leaf.

    Node ids are prefixed with the column, so equal texts on two levels stay apart.
    """
    tags = [F.concat_ws(":", F.lit(c), F.col(c).cast("string")) for c in levels]
    depth = len(levels)
    base = df.select(*[t.alias(c) for c, t in zip(levels, tags)],
                     F.col(levels[-1]).cast("string").alias("_value")).distinct()
    parts = [base.agg(F.count(F.lit(1)).alias("leaf_count")).select(
        F.lit(root).alias("node_id"), F.lit(None).cast("string").alias("parent"),
        F.lit("root").alias("kind"), F.lit(None).cast("string").alias("value"),
        F.col("leaf_count").cast("int"), F.lit(0).alias("depth"), F.lit(depth).alias("height"))]
    for i, c in enumerate(levels):
        leaf = i == depth - 1
        parent = F.lit(root) if i == 0 else F.first(levels[i - 1])
        parts.append(
            base.groupBy(c).agg(parent.alias("parent"), F.count(F.lit(1)).alias("n"),
                                F.first("_value").alias("v"))
            .select(F.col(c).alias("node_id"), F.col("parent"),
                    F.lit("leaf" if leaf else "internal").alias("kind"),
                    (F.col("v") if leaf else F.lit(None).cast("string")).alias("value"),
                    F.col("n").cast("int").alias("leaf_count"),
                    F.lit(i + 1).alias("depth"), F.lit(depth - 1 - i).alias("height")))
    return reduce(DataFrame.unionByName, parts).select(F.lit(attr).alias("attr"), "*")


def hierarchy_closure(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Leaf -> ancestor pairs `(attr, leaf_id, ancestor_id, up, height, parent)`.

    One equi-join per tree level; a leaf is its own ancestor at `up = 0`.
    """
    if max_depth is None:
        max_depth = nodes.agg(F.max("depth")).first()[0] or 0
    lookup = nodes.select(F.col("attr").alias("_a"), F.col("node_id").alias("_id"),
                          F.col("parent").alias("_parent"), F.col("height").alias("_height"))
    step = (nodes.where(F.col("kind") == "leaf")
            .select("attr", F.col("node_id").alias("leaf_id"), F.col("node_id").alias("ancestor_id"),
                    F.lit(0).alias("up"), "height", "parent"))
    parts = [step]
    for up in range(1, max_depth + 1):
        step = (
            step.where(F.col("parent").isNotNull())
            .join(lookup, (F.col("attr") == F.col("_a")) & (F.col("parent") == F.col("_id")))
            .select("attr", "leaf_id", F.col("_id").alias("ancestor_id"), F.lit(up).alias("up"),
                    F.col("_height").alias("height"), F.col("_parent").alias("parent"))
        )
        parts.append(step)
    return reduce(DataFrame.unionByName, parts)


def level_map(closure: DataFrame, levels: Mapping[str, int]) -> DataFrame:
    """Climb rule on a closure: the lowest ancestor with `height >= level`, else the root."""
    # An unlisted attribute stays at its leaves.
    level = F.lit(0)
    for attr, value in levels.items():
        level = F.when(F.col("attr") == attr, F.lit(int(value))).otherwise(level)
    reached = (F.col("height") >= level) | F.col("parent").isNull()
    return (
        closure.where(reached).groupBy("attr", "leaf_id")
        .agg(F.min_by("ancestor_id", "up").alias("target_id"))
    )


def max_level_table(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("attr").agg(F.max("height").cast("bigint").alias("max_level"))


def numeric_values(closure: DataFrame, leaves: DataFrame, disjoint: bool = True) -> DataFrame:
    """Mean of the integers covered by the leaves under every node: `(attr, node_id, value)`.

    Each interval adds its arithmetic series; none is expanded into its integers. Leaves of an
    audited hierarchy are disjoint. With `disjoint=False` overlapping ones are merged first, by a
    running maximum of the upper ends in one sorted pass per node.
    """
    spans = closure.join(
        leaves.select("attr", F.col("node_id").alias("leaf_id"), "lo", "hi"), ["attr", "leaf_id"])
    start = F.col("lo")
    if not disjoint:
        w = Window.partitionBy("attr", "ancestor_id").orderBy("lo", "hi")
        reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
        start = F.greatest(F.col("lo"), F.coalesce(reach + 1, F.col("lo")))
    size = F.greatest(F.col("hi") - start + 1, F.lit(0.0))
    return (
        spans.select("attr", F.col("ancestor_id").alias("node_id"), size.alias("n"),
                     ((start + F.col("hi")) * size / 2).alias("total"))
        .groupBy("attr", "node_id")
        .agg((F.sum("total") / F.sum("n")).alias("value"))
    )


def category_vectors(closure: DataFrame) -> DataFrame:
    """Mean one-hot of every node in long form: `(attr, node_id, leaf_id, weight)`."""
    counts = closure.groupBy("attr", "ancestor_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        closure.join(counts, ["attr", "ancestor_id"])
        .select("attr", F.col("ancestor_id").alias("node_id"), "leaf_id",
                (F.lit(1.0) / F.col("n")).alias("weight"))
    )


def audit_hierarchy(nodes: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """Violations per attribute and rule: `(attr, rule, n)`; no rows means a sound hierarchy.

    Rules: one root, unique ids, known parents, every node above a leaf, every leaf below a root
    (a cycle has none), unique leaf values, disjoint intervals, and `observed(attr, value)`
    covered by leaf values or intervals.
    """
    def found(df: DataFrame, rule: str) -> DataFrame:
        return (df.groupBy("attr").agg(F.count(F.lit(1)).alias("n"))
                .select("attr", F.lit(rule).alias("rule"), "n"))

    leaves = nodes.where(F.col("kind") == "leaf")
    parents = nodes.select("attr", F.col("node_id").alias("parent"))
    roots = nodes.groupBy("attr").agg(F.count(F.when(F.col("parent").isNull(), 1)).alias("r"))
    closure = hierarchy_closure(nodes)
    above = closure.select("attr", F.col("ancestor_id").alias("node_id")).distinct()
    rooted = closure.where(F.col("parent").isNull()).select("attr", F.col("leaf_id").alias("node_id"))
    parts = [
        found(roots.where(F.col("r") != 1), "one_root"),
        found(nodes.groupBy("attr", "node_id").count().where("count > 1"), "duplicate_node"),
        found(nodes.where(F.col("parent").isNotNull()).join(parents, ["attr", "parent"], "left_anti"),
              "missing_parent"),
        found(nodes.join(above, ["attr", "node_id"], "left_anti"), "node_without_leaves"),
        found(leaves.join(rooted, ["attr", "node_id"], "left_anti"), "leaf_without_root"),
        found(leaves.where(F.col("value").isNotNull()).groupBy("attr", "value").count()
              .where("count > 1"), "duplicate_leaf"),
    ]
    if "lo" in nodes.columns:
        # Neighbours by number: leaves of any count are numbered across tasks.
        spans = dense_index(leaves.where(F.col("lo").isNotNull()).select("attr", "node_id", "lo", "hi"), ["attr"], ["lo", "hi", "node_id"], "_i")
        following = spans.select("attr", (F.col("_i") - 1).alias("_i"), F.col("lo").alias("next"))
        parts.append(found(spans.join(following, ["attr", "_i"]).where(F.col("hi") >= F.col("next")), "overlapping_leaves"))
    if observed is not None:
        seen = observed.where(F.col("value").isNotNull()).select("attr", "value").distinct()
        uncovered = seen.join(leaves.select("attr", "value"), ["attr", "value"], "left_anti")
        if "lo" in nodes.columns:
            # Cells as wide as a leaf on average: a value meets the leaves of its cell only. One row per attribute.
            line = leaves.where(F.col("lo").isNotNull()).groupBy("attr").agg(
                F.min("lo").alias("_from"), F.greatest((F.max("hi") - F.min("lo")) / F.count(F.lit(1)), F.lit(1e-9)).alias("_wide"))
            cell = lambda c: F.floor((c - F.col("_from")) / F.col("_wide"))
            spans = (leaves.where(F.col("lo").isNotNull()).join(F.broadcast(line), "attr")
                     .select(F.col("attr").alias("_a"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("_c")))
            numbers = uncovered.withColumn("_v", F.col("value").try_cast("double")).join(F.broadcast(line), "attr", "left").withColumn("_cell", cell(F.col("_v")))
            uncovered = numbers.join(spans, (F.col("attr") == F.col("_a")) & (F.col("_cell") == F.col("_c"))
                                     & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")), "left_anti").select("attr", "value")
        parts.append(found(uncovered, "uncovered_value"))
    return reduce(DataFrame.unionByName, parts)


def value_ranges(leaves: DataFrame, values: DataFrame, value: str, cell: float) -> DataFrame:
    """Range join of values with leaf intervals on equal grid cells of width `cell`.

    Each interval is listed once per cell it touches, so the join is an equi-join on (attr, cell)
    and never compares every value with every interval.
    """
    cells = leaves.withColumn("_cell", F.explode(F.sequence(
        F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    return (
        values.withColumn("_cell", F.floor(F.col(value) / cell))
        .join(cells.select("_cell", "node_id", "lo", "hi"), "_cell")
        .where((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")))
        .drop("_cell")
    )


# ---- lowest common ancestors ----------------------------------------------------------------

def common_ancestor(tree: Hierarchy, low: Column, high: Column) -> Column:
    """Node id of the lowest common ancestor of two leaf positions.

    Leaves are numbered depth first, so the ancestor of a whole set of leaves is the ancestor of
    its smallest and largest position. The root paths agree exactly down to it.
    """
    paths = [_STEP.join(p) for p in tree.paths]
    a, b = _path(paths, low), _path(paths, high)
    return F.get(a, _shared_steps(a, b) - 1)


def common_height(tree: Hierarchy, low: Column, high: Column) -> Column:
    """Height of the lowest common ancestor of two leaf positions, read off the root path."""
    a, b = (_path([_STEP.join(p) for p in tree.paths], c) for c in (low, high))
    heights = _path([_STEP.join(str(tree.nodes[n].height) for n in p) for p in tree.paths], low, "int")
    return F.get(heights, _shared_steps(a, b) - 1)


def _shared_steps(a: Column, b: Column) -> Column:
    agree = F.zip_with(a, b, lambda x, y: x == y)
    return F.size(F.filter(agree, lambda hit: F.coalesce(hit, F.lit(False))))


def group_ancestors(df: DataFrame, keys: Sequence[str], forest: Forest) -> DataFrame:
    """Lowest common ancestor per group and attribute: `(keys..., <attr>__lca, n)`.

    Only the smallest and largest leaf position per group are shuffled.
    """
    rows = ensure_leaves(df, forest)
    spans = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[f(leaf_name(a)).alias(f"_{n}_{a}") for a in forest for n, f in (("lo", F.min), ("hi", F.max))])
    return spans.select(*keys, "n", *[
        common_ancestor(t, F.col(f"_lo_{a}"), F.col(f"_hi_{a}")).alias(f"{a}__lca")
        for a, t in forest.items()])


def group_information_loss(df: DataFrame, keys: Sequence[str], forest: Forest) -> DataFrame:
    """Sum over QIs of (leaves under the LCA - 1) / (leaves - 1), and the same times group size."""
    rows = ensure_leaves(df, forest)
    spans = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[f(leaf_name(a)).alias(f"_{n}_{a}") for a in forest for n, f in (("lo", F.min), ("hi", F.max))])
    loss = F.lit(0.0)
    for attr, tree in forest.items():
        denominator = len(tree.leaves) - 1
        if denominator <= 0:
            continue
        paths = [_STEP.join(p) for p in tree.paths]
        counts = [_STEP.join(str(tree.nodes[n].leaf_count) for n in p) for p in tree.paths]
        low, high = F.col(f"_lo_{attr}"), F.col(f"_hi_{attr}")
        same = _shared_steps(_path(paths, low), _path(paths, high))
        under = F.get(_path(counts, low, "int"), same - 1)
        loss = loss + F.coalesce((under - 1) / F.lit(float(denominator)), F.lit(0.0))
    return spans.select(*keys, "n", loss.alias("loss")).withColumn("total_loss", F.col("loss") * F.col("n"))
