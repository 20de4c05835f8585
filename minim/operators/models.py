"""Feature spaces over hierarchies, gradients as plain sums, and Spark ML fits.

A generalized QI is a node. Its model vector (mean one-hot, or a mean number) is fixed by the
node, so a dot product with any weight vector is one number per node: `w . x` becomes one array
lookup per QI and stays in generated code. Wide vectors are only built for Spark ML.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minim.functions.ordering import seeded_key, seeded_normal, unit_interval
from minim.operators.binned_trees import fit_points
from minim.operators.hierarchy import Forest, Hierarchy, at, leaf_name
from minim.operators.perceptron import BLOCK, fit_weights
from minim.session import Scratch

# A node's vectors are broadcast as one table per QI: leaves x width numbers.
MAX_BLOCK = 4_000_000


@dataclass
class FeatureSpace:
    """Columns of the model matrix: QI blocks in order, then other numeric features.

    A numeric QI has one column; a categorical QI one per leaf. `mean` and `std` are frozen.
    """

    forest: Forest
    extras: tuple[str, ...] = ()
    mean: list[float] = field(default_factory=list)
    std: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.offset, at_ = {}, 0
        for attr, tree in self.forest.items():
            self.offset[attr] = at_
            at_ += 1 if tree.numeric else len(tree.leaves)
        for e in self.extras:
            self.offset[e] = at_
            at_ += 1
        self.width = at_
        self.mean = self.mean or [0.0] * at_
        self.std = self.std or [1.0] * at_

    @property
    def names(self) -> list[str]:
        out = []
        for attr, tree in self.forest.items():
            out += [attr] if tree.numeric else [f"{attr}={tree.nodes[x].value}" for x in tree.leaves]
        return out + list(self.extras)

    def block(self, tree: Hierarchy) -> slice:
        start = self.offset[tree.attr]
        return slice(start, start + (1 if tree.numeric else len(tree.leaves)))

    def node_vector(self, tree: Hierarchy, node: str | None) -> list[float]:
        """Standardized block of a node; a missing category is all zeros, a missing number the mean."""
        span = self.block(tree)
        mean, std = self.mean[span], self.std[span]
        if node is None:
            raw = mean if tree.numeric else [0.0] * len(tree.leaves)
        else:
            raw = [tree.numeric_value(node)] if tree.numeric else tree.category_weights(node)
        return [(x - m) / s for x, m, s in zip(raw, mean, std)]

    def leaf_values(self, tree: Hierarchy, level: int, weights: Sequence[float]) -> tuple[list[float], float]:
        """`weights . block` for every leaf at a level, and for a missing value."""
        known: dict[str, float] = {}
        out = []
        for target in tree.targets(level):
            if target not in known:
                known[target] = sum(w * x for w, x in zip(weights, self.node_vector(tree, target)))
            out.append(known[target])
        return out, sum(w * x for w, x in zip(weights, self.node_vector(tree, None)))

    def dot(self, weights: Sequence[float], levels: Mapping[str, int]) -> Column:
        """`weights . x` of a row at a level vector."""
        total = F.lit(0.0)
        for attr, tree in self.forest.items():
            values, missing = self.leaf_values(tree, int(levels.get(attr, 0)), weights[self.block(tree)])
            total = total + F.coalesce(at(values, F.col(leaf_name(attr)), "double"), F.lit(missing))
        for e in self.extras:
            i = self.offset[e]
            total = total + F.coalesce((F.col(e) - F.lit(self.mean[i])) / F.lit(self.std[i]), F.lit(0.0)) * F.lit(weights[i])
        return total

    def dot_released(self, weights: Sequence[float], snapshots: Sequence) -> Column:
        """`weights . x` of a row published by the snapshot in column `snapshot`."""
        out = F.lit(None).cast("double")
        for snap in snapshots:
            out = F.when(F.col("snapshot") == int(snap.iteration), self.dot(weights, snap.levels)).otherwise(out)
        return out

    def fit(self, rows: DataFrame, weight: str | None = None) -> FeatureSpace:
        """Freeze population means and deviations of the level-0 matrix, zero deviation as 1.

        Category columns come from leaf counts, so no indicator column is ever materialized.
        """
        n = F.col(weight) if weight else F.lit(1)
        w = rows.withColumn("_w", n)
        pairs = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(leaf_name(a)).alias("leaf")) for a in self.forest])
        # At most one row per leaf of the trees.
        counts = (w.select("_w", F.explode(pairs).alias("p")).groupBy("p.attr", "p.leaf")
                  .agg(F.sum("_w").alias("n")).collect())
        per: dict[str, dict] = {a: {} for a in self.forest}
        for r in counts:
            per[r["attr"]][r["leaf"]] = r["n"]
        mean, std = [0.0] * self.width, [1.0] * self.width
        for attr, tree in self.forest.items():
            seen = per[attr]
            total = sum(seen.values())
            if tree.numeric:
                values = [(tree.numeric_value(tree.leaves[i]), c) for i, c in seen.items() if i is not None]
                count = sum(c for _, c in values) or 1
                m = sum(v * c for v, c in values) / count
                s = math.sqrt(sum(c * (v - m) ** 2 for v, c in values) / count)
                mean[self.offset[attr]], std[self.offset[attr]] = m, s if s > 0 else 1.0
                continue
            for i in range(len(tree.leaves)):
                p = seen.get(i, 0) / total if total else 0.0
                mean[self.offset[attr] + i] = p
                s = math.sqrt(max(p * (1 - p), 0.0))
                std[self.offset[attr] + i] = s if s > 0 else 1.0
        if self.extras:
            sums = w.agg(*[f for e in self.extras for f in (
                (F.sum(F.col(e) * F.col("_w")) / F.sum(F.when(F.col(e).isNotNull(), F.col("_w")))).alias(f"m_{e}"),
                (F.sum(F.col(e) * F.col(e) * F.col("_w")) / F.sum(F.when(F.col(e).isNotNull(), F.col("_w")))).alias(f"q_{e}"))]).first()
            for e in self.extras:
                m = sums[f"m_{e}"] or 0.0
                s = math.sqrt(max((sums[f"q_{e}"] or 0.0) - m * m, 0.0))
                mean[self.offset[e]], std[self.offset[e]] = m, s if s > 0 else 1.0
        return FeatureSpace(self.forest, self.extras, mean, std)

    def vectors(self, rows: DataFrame, snapshots: Sequence, name: str = "features") -> DataFrame:
        """Add the standardized Spark ML vector; `snapshots` are the levels, chosen per row by `snapshot`.

        Each QI joins a broadcast table of node vectors, whose size is checked against `MAX_BLOCK`.
        """
        out, blocks = rows, []
        for attr, tree in self.forest.items():
            if len(tree.leaves) ** 2 > MAX_BLOCK:
                raise ValueError(f"{attr}: {len(tree.leaves)} leaves are too many for dense vectors")
            position = F.lit(None).cast("int")
            for snap in snapshots:
                targets = [tree.position[t] for t in tree.targets(int(snap.levels.get(attr, 0)))]
                position = F.when(F.col("snapshot") == int(snap.iteration),
                                  at(targets, F.col(leaf_name(attr)), "int")).otherwise(position)
            used = sorted({tree.position[t] for s in snapshots for t in tree.targets(int(s.levels.get(attr, 0)))})
            ids = list(tree.nodes)
            entries = [(p, Vectors.dense(self.node_vector(tree, ids[p]))) for p in used]
            entries.append((-1, Vectors.dense(self.node_vector(tree, None))))
            schema = T.StructType([T.StructField("_node", T.IntegerType()), T.StructField(f"_v_{attr}", VectorUDT())])
            table = rows.sparkSession.createDataFrame(entries, schema)
            out = (out.withColumn("_at", F.coalesce(position, F.lit(-1)))
                   .join(F.broadcast(table), F.col("_at") == F.col("_node")).drop("_at", "_node"))
            blocks.append(f"_v_{attr}")
        for e in self.extras:
            i = self.offset[e]
            out = out.withColumn(f"_v_{e}", F.coalesce((F.col(e) - F.lit(self.mean[i])) / F.lit(self.std[i]), F.lit(0.0)))
            blocks.append(f"_v_{e}")
        made = VectorAssembler(inputCols=blocks, outputCol=name).transform(out)
        return made.drop(*blocks)


def tree_model_columns(forest: Forest, levels: Mapping[str, int]) -> dict[str, Column]:
    """Named model columns at a level vector.

    A numeric QI at level 0 stays a number; above, each group value is an indicator column named
    `<attr>_cat=<value>`. A categorical QI is its mean one-hot, one column per leaf.
    """
    out: dict[str, Column] = {}
    for attr, tree in forest.items():
        level = int(levels.get(attr, 0))
        leaf = F.col(leaf_name(attr))
        if tree.numeric and level <= 0:
            out[attr] = F.col(attr).cast("double")
        elif tree.numeric:
            values = [tree.numeric_value(t) for t in tree.targets(level)]
            for v in sorted(set(values)):
                text = str(int(v)) if float(v).is_integer() else f"{v:.12g}"
                hits = [1.0 if x == v else 0.0 for x in values]
                out[f"{attr}_cat={text}"] = F.coalesce(at(hits, leaf, "double"), F.lit(0.0))
        else:
            vectors = [tree.category_weights(t) for t in tree.targets(level)]
            for i, name in enumerate(tree.leaves):
                column = [v[i] for v in vectors]
                out[f"{attr}={tree.nodes[name].value}"] = F.coalesce(at(column, leaf, "double"), F.lit(0.0))
    return out


def tree_model_input(rows: DataFrame, forest: Forest, levels: Mapping[str, int], keep: Sequence[str] = ()) -> DataFrame:
    columns = tree_model_columns(forest, levels)
    return rows.select(*keep, *[c.alias(n) for n, c in columns.items()])


def leaf_space(rows: DataFrame, forest: Forest, levels: Mapping[str, int], extras: Sequence[str] = (), name: str = "features") -> DataFrame:
    """Fixed sparse space: each QI is uniform over the leaves under its node, plus the node's height.

    The layout is the same at every level vector. A value outside the tree fails the task; a
    missing value is all zeros at height 0.
    """
    out, blocks = rows, []
    schema = T.StructType([T.StructField("_node", T.IntegerType()), T.StructField("_v", VectorUDT())])
    for attr, tree in forest.items():
        leaf = F.col(leaf_name(attr))
        size = len(tree.leaves)
        position = at([tree.position[t] for t in tree.targets(int(levels.get(attr, 0)))], leaf, "int")
        bad = F.raise_error(F.concat(F.lit(f"{attr}: value outside the leaf space: "), F.col(attr).cast("string"))).cast("int")
        position = F.when(leaf.isNull() & F.col(attr).isNotNull(), bad).otherwise(F.coalesce(position, F.lit(-1)))
        entries = [(-1, Vectors.sparse(size + 1, {}))]
        for t in dict.fromkeys(tree.targets(int(levels.get(attr, 0)))):
            span = tree.leaf_range(t)
            cells = {i: 1.0 / len(span) for i in span}
            if tree.nodes[t].height:
                cells[size] = float(tree.nodes[t].height)
            entries.append((tree.position[t], Vectors.sparse(size + 1, cells)))
        # Bounded by the hierarchy's node count.
        table = rows.sparkSession.createDataFrame(entries, schema)
        out = (out.withColumn("_at", position).join(F.broadcast(table), F.col("_at") == F.col("_node"))
               .drop("_at", "_node").withColumnRenamed("_v", f"_v_{attr}"))
        blocks.append(f"_v_{attr}")
    made = VectorAssembler(inputCols=[*blocks, *extras], outputCol=name).transform(out)
    return made.drop(*blocks)


# ---- linear models and their gradients ------------------------------------------------------

@dataclass(frozen=True)
class Linear:
    """Logistic model: one weight row for two classes, one per class for more."""

    weights: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    @property
    def classes(self) -> int:
        return max(2, len(self.weights))

    def probabilities(self, logits: Sequence[Column]) -> list[Column]:
        """Probability per weight row (of class 1 for two classes)."""
        if len(logits) == 1:
            return [F.lit(1.0) / (F.lit(1.0) + F.exp(-logits[0]))]
        top = F.greatest(*logits)
        parts = [F.exp(z - top) for z in logits]
        total = reduce(lambda a, b: a + b, parts)
        return [p / total for p in parts]


def logits(space: FeatureSpace, model: Linear, levels: Mapping[str, int]) -> list[Column]:
    return [space.dot(w, levels) + F.lit(b) for w, b in zip(model.weights, model.intercepts)]


def residuals(space: FeatureSpace, model: Linear, levels: Mapping[str, int], label: str) -> list[Column]:
    """`p_c - [y = c]` per weight row."""
    p = model.probabilities(logits(space, model, levels))
    if len(p) == 1:
        return [p[0] - F.col(label).cast("double")]
    return [q - F.when(F.col(label) == c, 1.0).otherwise(0.0) for c, q in enumerate(p)]


@dataclass(frozen=True)
class Gradient:
    """Mean logistic gradient: one row of `width` numbers and one intercept per weight row."""

    weights: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]
    rows: float


def mean_gradient(
    rows: DataFrame, space: FeatureSpace, model: Linear, levels: Mapping[str, int], label: str,
    weight: str | None = None, scalars: Sequence[Column] | None = None,
) -> Gradient:
    """Mean gradient of the logistic loss over the rows, in one aggregation; with `scalars` the mean of scalar times [x, 1] per weight row instead.

    Residuals are summed per combination of leaves first and per (QI, leaf) second; the leaf sums,
    one row per leaf of the trees, are expanded to feature columns on the driver.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    res = residuals(space, model, levels, label) if scalars is None else list(scalars)
    k = len(res)
    made = rows.select(*[F.col(leaf_name(a)) for a in space.forest], *[F.col(e) for e in space.extras], w.alias("_w"),
                       *[(r * w).alias(f"_r{c}") for c, r in enumerate(res)])
    sums = [F.sum(f"_r{c}").alias(f"_r{c}") for c in range(k)] + [F.sum("_w").alias("_w")]
    for e in space.extras:
        i = space.offset[e]
        x = F.coalesce((F.col(e) - F.lit(space.mean[i])) / F.lit(space.std[i]), F.lit(0.0))
        sums += [F.sum(F.col(f"_r{c}") * x).alias(f"_e{c}_{e}") for c in range(k)]
    cells = made.groupBy(*[leaf_name(a) for a in space.forest]).agg(*sums)
    pairs = [F.struct(F.lit(a).alias("name"), F.col(leaf_name(a)).alias("leaf"),
                      *[F.col(f"_r{c}").alias(f"g{c}") for c in range(k)], F.col("_w").alias("w")) for a in space.forest]
    pairs += [F.struct(F.lit(e).alias("name"), F.lit(None).cast("int").alias("leaf"),
                       *[F.col(f"_e{c}_{e}").alias(f"g{c}") for c in range(k)], F.col("_w").alias("w")) for e in space.extras]
    out = (cells.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.name", "p.leaf")
           .agg(*[F.sum(f"p.g{c}").alias(f"g{c}") for c in range(k)], F.sum("p.w").alias("w")).collect())
    first = next(iter(space.forest), None) or space.extras[0]
    total = sum(r["w"] for r in out if r["name"] == first)
    if not total:
        raise ValueError("no rows to take a gradient over")
    grads = [[0.0] * space.width for _ in range(k)]
    bias = [0.0] * k
    for r in sorted(out, key=lambda r: (r["name"], -1 if r["leaf"] is None else r["leaf"])):
        for c in range(k):
            if r["name"] == first:
                bias[c] += r[f"g{c}"]
            if r["name"] in space.extras:
                grads[c][space.offset[r["name"]]] += r[f"g{c}"]
                continue
            tree = space.forest[r["name"]]
            node = None if r["leaf"] is None else tree.climb(r["leaf"], int(levels.get(r["name"], 0)))
            for i, x in enumerate(space.node_vector(tree, node), start=space.offset[r["name"]]):
                grads[c][i] += r[f"g{c}"] * x
    return Gradient(tuple(tuple(g / total for g in row) for row in grads), tuple(b / total for b in bias), float(total))


def influence_scalar(space: FeatureSpace, model: Linear, g: Gradient, levels: Mapping[str, int], label: str) -> Column:
    """`s_i = g . grad(loss_i)`: one number per row, as a column.

    Sums of s give every candidate's score: see `minim.operators.candidates`.
    """
    res = residuals(space, model, levels, label)
    parts = [r * (space.dot(w, levels) + F.lit(b)) for r, w, b in zip(res, g.weights, g.intercepts)]
    return reduce(lambda a, b: a + b, parts)


def fit_logistic(vectors: DataFrame, label: str = "label", features: str = "features", weight: str | None = None,
                 classes: int = 2, max_iter: int = 100) -> Linear:
    """Unregularized logistic regression by L-BFGS; only the parameters reach the driver."""
    return fit_logistic_reporting(vectors, label, features, weight, classes, max_iter)[0]


def fit_logistic_reporting(vectors: DataFrame, label: str = "label", features: str = "features", weight: str | None = None,
                           classes: int = 2, max_iter: int = 100) -> tuple[Linear, bool]:
    """`fit_logistic`, and whether `max_iter` steps were taken before the tolerance was met."""
    estimator = LogisticRegression(
        featuresCol=features, labelCol="_label", maxIter=max_iter, regParam=0.0, standardization=False, tol=1e-6,
        family="binomial" if classes <= 2 else "multinomial")
    if weight:
        estimator = estimator.setWeightCol(weight)
    model = estimator.fit(vectors.withColumn("_label", F.col(label).cast("double")))
    limit_reached = model.summary.totalIterations >= max_iter
    if classes <= 2:
        return Linear((tuple(float(x) for x in model.coefficients.toArray()),), (float(model.intercept),)), limit_reached
    matrix = model.coefficientMatrix.toArray()
    return Linear(tuple(tuple(float(x) for x in row) for row in matrix), tuple(float(x) for x in model.interceptVector.toArray())), limit_reached


# Rows a partition of an iterative fit holds at most where rows are dealt, and the partitions per core below that.
FIT_ROWS, FIT_WAVES = 100_000, 2
# Rows up to which Spark's own perceptron is quicker than packed rows, whose passes cost more to start.
PLAIN_ROWS = 100_000


def fit_rows(vectors: DataFrame, label: str, features: str = "features") -> DataFrame:
    """Label and features only, written once."""
    return Scratch(vectors.sparkSession, "fit").save(vectors.select(label, features))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows in at least one partition per core as they are, fewer partitions dealt evenly over all cores.

    The partitions of a small file or of a coalesced shuffle are few and would leave most cores idle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(max(FIT_WAVES * cores, -(-rows.count() // FIT_ROWS)))


def fit_table(vectors: DataFrame, label: str, features: str = "features") -> DataFrame:
    """The rows of a fit, written once and spread over all cores."""
    return dealt(fit_rows(vectors, label, features))


def fit_mlp(vectors: DataFrame, width: int, classes: int = 2, label: str = "label", seed: int = 42, max_iter: int = 100):
    """Two hidden layers of 32; Spark's perceptron is sigmoid with L-BFGS, the reference's ReLU with Adam.

    Beyond `PLAIN_ROWS` rows `perceptron` takes Spark's steps: Spark gives the first weights and holds the fitted ones, by fits
    without a step to a single row.
    """
    rows, layers = fit_rows(vectors, label), [width, 32, 32, classes]
    plain = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=layers, seed=seed, maxIter=max_iter, blockSize=BLOCK)
    count = rows.count()
    if count <= PLAIN_ROWS:
        return plain.fit(dealt(rows))
    single = rows.sparkSession.createDataFrame(
        [(0.0, Vectors.dense([0.0] * width))], T.StructType([T.StructField(label, T.DoubleType()), T.StructField("features", VectorUDT())]))
    still = plain.copy({plain.maxIter: 0})
    found = fit_weights(dealt(rows), count, label, layers, still.fit(single).weights.toArray(), max_iter, plain.getTol())
    return still.setInitialWeights(Vectors.dense(found)).fit(single)


def fit_gbt(vectors: DataFrame, label: str = "label", seed: int = 42, trees: int = 100, depth: int = 3, rate: float = 0.1):
    """Boosted trees: 100 trees of depth 3 at rate 0.1 (two classes)."""
    rows = fit_rows(vectors, label)
    return fit_points(rows, dealt(rows), label, GBTClassifier(
        featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed))


def class_probability(fitted, vectors: DataFrame, name: str = "p") -> DataFrame:
    """Probability of class 1 from a fitted Spark ML classifier."""
    scored = fitted.transform(vectors)
    return scored.withColumn(name, F.get(vector_to_array("probability"), F.lit(1)))


def dp_gradient_step(
    rows: DataFrame, space: FeatureSpace, model: Linear, levels: Mapping[str, int], label: str, rate: float, clip: float,
    sigma: float, seed: int, row_id: str = "row_id",
) -> tuple[Gradient, int]:
    """One private gradient for any number of classes: Poisson sample, per-row clipping, sum, Gaussian noise of deviation `sigma * clip`.

    A row's gradient is its residuals times [x, 1], so its norm is `|r| * sqrt(|x|^2 + 1)`, and |x|^2 is a sum of
    node lookups: clipping is one factor per row and no gradient vector is materialized. Who is sampled, and the noise of each coordinate (numbered
    by weight row, then feature, the intercept last), follow from seeded keys, so that another engine can repeat both.
    Returns the noisy mean over the expected batch size, and the sampled row count.
    """
    norm = F.lit(1.0)
    for attr, tree in space.forest.items():
        squares = [sum(x * x for x in space.node_vector(tree, t)) for t in tree.targets(int(levels.get(attr, 0)))]
        gone = sum(x * x for x in space.node_vector(tree, None))
        norm = norm + F.coalesce(at(squares, F.col(leaf_name(attr)), "double"), F.lit(gone))
    for e in space.extras:
        i = space.offset[e]
        x = F.coalesce((F.col(e) - F.lit(space.mean[i])) / F.lit(space.std[i]), F.lit(0.0))
        norm = norm + x * x
    drawn = unit_interval(seeded_key(f"{seed}:sample", row_id)) < F.lit(float(rate))
    # The sizes come from the ids alone.
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(drawn, 1)).alias("n")).first()
    if not counts["n"]:
        raise ValueError("the sample is empty")
    length = F.sqrt(reduce(lambda a, b: a + b, [r * r for r in residuals(space, model, levels, label)])) * F.sqrt(norm)
    clipped = rows.where(drawn).withColumn("_scale", F.least(F.lit(1.0), F.lit(float(clip)) / F.greatest(length, F.lit(1e-12))))
    # The gradient of a weighted loss is linear in the weights: sum = mean * weight.
    g = mean_gradient(clipped, space, model, levels, label, weight="_scale")
    expected, d = rate * counts["rows"], space.width + 1
    noise = [0.0] * (len(model.weights) * d)
    if sigma > 0:
        # One number per coordinate.
        table = rows.sparkSession.range(len(noise)).select("id", seeded_normal(seeded_key(f"{seed}:noise", "id")).alias("z"))
        for r in table.collect():
            noise[r["id"]] = r["z"] * sigma * clip
    weights = tuple(tuple((x * g.rows + noise[c * d + i]) / expected for i, x in enumerate(row)) for c, row in enumerate(g.weights))
    intercepts = tuple((b * g.rows + noise[c * d + d - 1]) / expected for c, b in enumerate(g.intercepts))
    return Gradient(weights, intercepts, float(counts["n"])), counts["n"]


def curvature_along(rows: DataFrame, space: FeatureSpace, model: Linear, levels: Mapping[str, int], label: str, v: Sequence[float]) -> list[float]:
    """The mean second derivatives times `v` (per weight row the features, then the intercept), in one aggregation and without the matrix."""
    d = space.width + 1
    parts = [v[c * d:(c + 1) * d] for c in range(len(model.weights))]
    p = model.probabilities(logits(space, model, levels))
    z = [space.dot(part[:-1], levels) + F.lit(float(part[-1])) for part in parts]
    if len(p) == 1:
        scalars = [p[0] * (1 - p[0]) * z[0]]
    else:
        mean = reduce(lambda a, b: a + b, [q * x for q, x in zip(p, z)])
        scalars = [q * (x - mean) for q, x in zip(p, z)]
    return flat_gradient(mean_gradient(rows, space, model, levels, label, scalars=scalars))


def flat_gradient(g: Gradient) -> list[float]:
    """Per weight row the features, then the intercept."""
    return [x for row, b in zip(g.weights, g.intercepts) for x in (*row, b)]


# Parameters up to which the second derivatives are collected and solved; above, Spark multiplies them with one vector at a time.
MAX_SOLVED = 2000


def influence_direction(
    rows: DataFrame, space: FeatureSpace, model: Linear, levels: Mapping[str, int], label: str, v: Sequence[float], damping: float,
) -> list[float]:
    """`(H + damping I)^-1 v` for the logistic second derivatives H of the rows, for any number of classes; v and the result per weight row, the
    intercept last.

    Up to `MAX_SOLVED` parameters H comes from sums per pair of leaves; beyond that conjugate gradients need one aggregation a step.
    """
    import numpy as np
    v = np.asarray(v, dtype=float)
    if len(v) <= MAX_SOLVED:
        from minim.operators.lockstep import as_params, hessian, level_layout
        p = model.probabilities(logits(space, model, levels))
        h = hessian(rows, level_layout(space, levels), as_params(model), p, F.lit(1.0))
        return [float(x) for x in np.linalg.solve(h + damping * np.eye(len(v)), v)]
    x, r = np.zeros_like(v), v.copy()
    step, size = r.copy(), float(r @ r)
    goal = 1e-20 * size
    # In exact arithmetic as many steps as parameters suffice.
    for _ in range(2 * len(v)):
        if size <= goal:
            break
        along = np.asarray(curvature_along(rows, space, model, levels, label, [float(s) for s in step])) + damping * step
        a = size / float(step @ along)
        x, r = x + a * step, r - a * along
        before, size = size, float(r @ r)
        step = r + size / before * step
    return [float(s) for s in x]


def influence(
    original: DataFrame, state: DataFrame, validation: DataFrame, space: FeatureSpace, model: Linear, levels: Mapping[str, int],
    label: str, loss: float, damping: float = 1e-3,
) -> tuple[float, list[float]]:
    """Influence estimate of the validation loss after moving from the original rows to a state, for any number of classes.

    Solves `H d = g_state - g_orig` and returns `loss - g_val . d` together with d.
    """
    g_state, g_orig, g_val = (flat_gradient(mean_gradient(rows, space, model, levels, label)) for rows in (state, original, validation))
    step = influence_direction(original, space, model, levels, label, [a - b for a, b in zip(g_state, g_orig)], damping)
    return loss - sum(a * b for a, b in zip(g_val, step)), step


def mlp_gradient_scalar(vectors: DataFrame, weights: Sequence, g: Sequence[float], label: str, keep: Sequence[str]) -> DataFrame:
    """`s_i = g . grad(loss_i)` for a small ReLU network, batch by batch: `(keep..., s)`.

    `weights` lists (matrix, bias) per layer, the last one feeding a sigmoid; `g` is the flat
    validation gradient in the same order. Each Arrow batch is one set of matrix products.
    """
    import numpy as np
    layers = [(np.asarray(m, dtype=float), np.asarray(b, dtype=float)) for m, b in weights]
    direction, at_ = [], 0
    flat = np.asarray(g, dtype=float)
    for m, b in layers:
        dm = flat[at_:at_ + m.size].reshape(m.shape)
        at_ += m.size
        direction.append((dm, flat[at_:at_ + b.size]))
        at_ += b.size
    slim = vectors.select(*keep, F.col(label).alias("_y"), vector_to_array("features").alias("_x"))

    def score(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["_x"].to_numpy())
            acts, pre = [x], []
            for i, (m, b) in enumerate(layers):
                z = acts[-1] @ m + b
                pre.append(z)
                acts.append(z if i == len(layers) - 1 else np.maximum(z, 0.0))
            delta = 1.0 / (1.0 + np.exp(-pre[-1])) - batch["_y"].to_numpy(dtype=float)[:, None]
            s = np.zeros(len(batch))
            for i in range(len(layers) - 1, -1, -1):
                dm, db = direction[i]
                s += ((acts[i] @ dm + db) * delta).sum(axis=1)
                if i:
                    delta = (delta @ layers[i][0].T) * (pre[i - 1] > 0)
            out = batch[list(keep)].copy()
            out["s"] = s
            yield out

    schema = T.StructType([slim.schema[c] for c in keep] + [T.StructField("s", T.DoubleType())])
    return slim.mapInPandas(score, schema)
