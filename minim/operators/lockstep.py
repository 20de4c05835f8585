"""Many logistic models fitted side by side: one Spark job per optimizer step answers all of them.

The rows are weighted cells, written once. A model sees them through a `Layout`: per column of codes a block that says what vector a code stands
for, and plain numeric columns. The driver holds the parameters of the models and, per block, one number per code and weight row; a
job returns, per model, the loss and the sums of residuals per code, from which the gradient follows by the blocks' adjoints. Nothing of a
row's or a cell's size reaches the driver, and no matrix of features by features is made in a task.

Which cells a model is fitted on is its `Members`: the active ones, less one class, plus one class of the inactive ones, or those of one group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minim.operators.hierarchy import Hierarchy, leaf_name
from minim.operators.models import FeatureSpace, Gradient, Linear
from minim.session import share_package

#: Sums that come to the driver from each task; beyond it they are added up in Spark first.
DIRECT_BYTES = 64 << 20
#: Parameters up to which second derivatives are taken in full; above, only the diagonal.
MAX_DENSE = 1000
#: Parameters, and sums of second derivatives a model, up to which every step takes its own second derivatives.
NEWTON, NEWTON_SUMS = 400, 100_000
MEMORY = 10
#: A step that lowers the loss by less than this is the last one, as is a gradient below it.
TOLERANCE = 1e-8
#: Losses of the clipped probabilities, for two classes and for more.
CLIP_TWO, CLIP_MANY = 36.04365338911715, 34.538776394910684


@dataclass(frozen=True)
class RangeBlock:
    """Codes that stand for uniform weights over a run of leaves; the code behind the last is a missing value, all zeros. Standardized."""

    first: np.ndarray
    size: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    @property
    def codes(self) -> int:
        return len(self.first) + 1

    def forward(self, w: np.ndarray) -> np.ndarray:
        """`w . x` of every code."""
        upto = np.concatenate([[0.0], np.cumsum(w / self.std)])
        known = (upto[self.first + self.size] - upto[self.first]) / np.maximum(self.size, 1)
        return np.append(known, 0.0) - float((w * self.mean / self.std).sum())

    def adjoint(self, s: np.ndarray) -> np.ndarray:
        """The sum of `s` times the code's vector over all codes."""
        share = s[:-1] / np.maximum(self.size, 1)
        marks = np.zeros(len(self.mean) + 1)
        np.add.at(marks, self.first, share)
        np.subtract.at(marks, self.first + self.size, share)
        return (np.cumsum(marks)[:-1] - s.sum() * self.mean) / self.std

    def matrix(self) -> np.ndarray:
        return np.stack([self.adjoint(row) for row in np.eye(self.codes)])


@dataclass(frozen=True)
class ValueBlock:
    """Codes that stand for one number; the code behind the last is a missing value, 0 after standardizing."""

    values: np.ndarray
    mean: float
    std: float

    @property
    def codes(self) -> int:
        return len(self.values) + 1

    @property
    def scaled(self) -> np.ndarray:
        return np.append((self.values - self.mean) / self.std, 0.0)

    def forward(self, w: np.ndarray) -> np.ndarray:
        return self.scaled * w[0]

    def adjoint(self, s: np.ndarray) -> np.ndarray:
        return np.array([float(self.scaled @ s)])

    def matrix(self) -> np.ndarray:
        return self.scaled[:, None]


@dataclass(frozen=True)
class Layout:
    """`blocks`: column of codes, offset of its features, block. `numbers`: column, offset, mean, deviation (missing counts as the mean)."""

    blocks: tuple[tuple[str, int, RangeBlock | ValueBlock], ...]
    numbers: tuple[tuple[str, int, float, float], ...]
    width: int


def _block(space: FeatureSpace, tree: Hierarchy, targets: Sequence[str]) -> RangeBlock | ValueBlock:
    span = space.block(tree)
    mean, std = np.array(space.mean[span]), np.array(space.std[span])
    if tree.numeric:
        known = {t: tree.numeric_value(t) for t in dict.fromkeys(targets)}
        return ValueBlock(np.array([known[t] for t in targets]), float(mean[0]), float(std[0]))
    nodes = [tree.nodes[t] for t in targets]
    return RangeBlock(np.array([n.leaf_first for n in nodes], np.int64), np.array([n.leaf_count for n in nodes], np.int64), mean, std)


def level_layout(space: FeatureSpace, levels: Mapping[str, int]) -> Layout:
    """Cells that carry leaf positions, seen at a level vector."""
    blocks = tuple((leaf_name(a), space.offset[a], _block(space, t, t.targets(int(levels.get(a, 0))))) for a, t in space.forest.items())
    return Layout(blocks, _extras(space), space.width)


def region_layout(space: FeatureSpace) -> Layout:
    """Cells that carry regions: a node position per categorical QI (`<attr>__node`), a number per numeric one (`<attr>__mean`)."""
    blocks = tuple((f"{a}__node", space.offset[a], _block(space, t, list(t.position))) for a, t in space.forest.items() if not t.numeric)
    means = tuple((f"{a}__mean", space.offset[a], space.mean[space.offset[a]], space.std[space.offset[a]]) for a, t in space.forest.items() if t.numeric)
    return Layout(blocks, means + _extras(space), space.width)


def _extras(space: FeatureSpace) -> tuple:
    return tuple((e, space.offset[e], space.mean[space.offset[e]], space.std[space.offset[e]]) for e in space.extras)


@dataclass(frozen=True)
class Members:
    """Cells of one model. `classes`: per block the class position of each code, to compare with `out` and `into` (None: no class moves)."""

    classes: tuple[np.ndarray, ...] = ()
    out: tuple[int, ...] | None = None
    into: tuple[int, ...] | None = None
    group: int | None = None


def class_positions(space: FeatureSpace, levels: Mapping[str, int]) -> tuple[np.ndarray, ...]:
    """Per QI, the published node position of each leaf, and -1 for a missing value."""
    return tuple(np.append([t.position[x] for x in t.targets(int(levels.get(a, 0)))], -1).astype(np.int64) for a, t in space.forest.items())


@dataclass
class Sums:
    """Weighted sums over one model's cells."""

    loss: float
    weight: float
    labels: np.ndarray
    gradient: np.ndarray
    second: np.ndarray | None = None


@dataclass
class Fitted:
    params: np.ndarray
    loss: float
    weight: float
    labels: np.ndarray
    steps: int
    limit_reached: bool

    @property
    def model(self) -> Linear:
        return as_linear(self.params)


def as_linear(params: np.ndarray) -> Linear:
    return Linear(tuple(tuple(float(x) for x in row[:-1]) for row in params), tuple(float(row[-1]) for row in params))


def as_params(model: Linear) -> np.ndarray:
    return np.array([[*w, b] for w, b in zip(model.weights, model.intercepts)])


def as_gradient(sums: Sums) -> Gradient:
    """The mean gradient, as `models.mean_gradient` returns it."""
    mean = sums.gradient / sums.weight
    return Gradient(tuple(tuple(float(x) for x in row[:-1]) for row in mean), tuple(float(row[-1]) for row in mean), float(sums.weight))


def _weights(members: Members, codes: Sequence[np.ndarray], n: np.ndarray, active: np.ndarray, groups: np.ndarray | None) -> np.ndarray:
    if members.group is not None:
        return np.where(groups == members.group, n, 0.0)

    def inside(wanted: tuple[int, ...], among: np.ndarray) -> np.ndarray:
        for c, table, x in zip(codes, members.classes, wanted):
            among = among & (table[c] == x)
        return among

    w = np.where(active, n, 0.0)
    if members.out is not None:
        w[inside(members.out, active)] = 0.0
    if members.into is not None:
        joins = inside(members.into, ~active)
        w[joins] = n[joins]
    return w


def _sources(layout: Layout) -> list[tuple[int, int]]:
    """Codes and offset of each block, each number and the intercept."""
    return [(b.codes, at) for _, at, b in layout.blocks] + [(1, at) for _, at, _, _ in layout.numbers] + [(1, layout.width)]


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def _evaluate(params: Sequence[np.ndarray], layouts: Sequence[Layout], members: Sequence[Members], label: str, classes: int, clip: bool, group: str | None,
              second: bool = False):
    """A function over Arrow batches of cells to `(model, sums)`: loss, weight, labels, then per weight row the residuals and their sums per code.

    With `second`, the second derivatives per pair of codes of every two columns follow, for each pair of weight rows.
    """
    tables = [[np.stack([b.forward(row[at:at + len(_features(b))]) for row in p]) for _, at, b in lay.blocks] for p, lay in zip(params, layouts)]
    columns = [c for c, _, _ in layouts[0].blocks]
    numbers = [c for c, _, _, _ in layouts[0].numbers]
    limit = (CLIP_TWO if classes <= 2 else CLIP_MANY) if clip else np.inf

    def run(batches):
        total: list[np.ndarray | None] = [None] * len(params)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = []
            for i, c in enumerate(columns):
                missing = layouts[0].blocks[i][2].codes - 1
                codes.append(batch.column(c).fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64))
            values = [batch.column(c).cast("float64").to_numpy(zero_copy_only=False) for c in numbers]
            y = batch.column(label).to_numpy(zero_copy_only=False).astype(np.int64)
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
            active = batch.column("active").to_numpy(zero_copy_only=False).astype(bool) if "active" in batch.schema.names else np.ones(len(n), bool)
            groups = batch.column(group).to_numpy(zero_copy_only=False) if group else None
            for m, (p, lay, who) in enumerate(zip(params, layouts, members)):
                w = _weights(who, codes, n, active, groups)
                at = np.flatnonzero(w)
                if not len(at):
                    continue
                w, mine, yy = w[at], [c[at] for c in codes], y[at]
                z = np.repeat(p[:, -1:], len(at), axis=1)
                for table, c in zip(tables[m], mine):
                    z = z + table[:, c]
                scaled = [np.nan_to_num((v[at] - mean) / std) for v, (_, _, mean, std) in zip(values, lay.numbers)]
                for x, (_, offset, _, _) in zip(scaled, lay.numbers):
                    z = z + p[:, offset:offset + 1] * x
                if len(p) == 1:
                    each = np.logaddexp(0.0, z[0]) - yy * z[0]
                    p_ = 0.5 * (1 + np.tanh(0.5 * z[:1]))
                    rest = (p_ - yy) * w
                else:
                    top = z.max(axis=0)
                    e = np.exp(z - top)
                    whole = e.sum(axis=0)
                    each = np.log(whole) + top - z[yy, np.arange(len(at))]
                    p_ = e / whole
                    rest = p_.copy()
                    rest[yy, np.arange(len(at))] -= 1.0
                    rest = rest * w
                parts = [[float((np.minimum(each, limit) * w).sum()), float(w.sum())], np.bincount(yy, weights=w, minlength=classes)]
                for r in rest:
                    parts.append([r.sum()])
                    parts += [np.bincount(c, weights=r, minlength=b.codes) for c, (_, _, b) in zip(mine, lay.blocks)]
                    parts.append([float(r @ x) for x in scaled])
                if second:
                    sizes = [n for n, _ in _sources(lay)]
                    places = [*mine, *[np.zeros(len(at), np.int64)] * (len(scaled) + 1)]
                    factors = [None] * len(mine) + [*scaled, None]
                    for a, b in _pairs(len(p_)):
                        h = p_[a] * ((1.0 if a == b else 0.0) - p_[b]) * w
                        for i, j in _pairs(len(sizes)):
                            hh = h if factors[i] is None else h * factors[i]
                            hh = hh if factors[j] is None else hh * factors[j]
                            parts.append(np.bincount(places[i] * sizes[j] + places[j], weights=hh, minlength=sizes[i] * sizes[j]))
                found = np.concatenate([np.asarray(x, float) for x in parts])
                total[m] = found if total[m] is None else total[m] + found
        kept = [(m, t.tobytes()) for m, t in enumerate(total) if t is not None]
        yield pa.record_batch([pa.array([m for m, _ in kept], pa.int32()), pa.array([t for _, t in kept], pa.binary())], names=["model", "sums"])

    return run


def scored(
    cells: DataFrame, params: np.ndarray, layouts: Sequence[Layout], terms: Sequence[Sequence[tuple[int, np.ndarray, float]]],
    classes: Sequence[np.ndarray], keys: Sequence[str], label: str, keep: Sequence[str],
) -> DataFrame:
    """`(keys..., keep..., s0, s1, ...)` of every cell: its class and gradient scores.

    A score is a sum of terms `(layout, gradient, factor)`: the cell's loss gradient at that layout, under the model `params`, times the gradient.
    `classes` names the class position of each code, per block; a missing value's is null.
    """
    lay = layouts[0]
    columns, numbers = [c for c, _, _ in lay.blocks], [c for c, _, _, _ in lay.numbers]

    def tables(p: np.ndarray, layout: Layout) -> list[np.ndarray]:
        return [np.stack([b.forward(row[at:at + len(_features(b))]) for row in p]) for _, at, b in layout.blocks]

    model = [tables(params, x) for x in layouts]
    directions = [[(at, g, tables(g, layouts[at]), factor) for at, g, factor in score] for score in terms]

    def run(batches):
        for batch in batches:
            codes = [batch.column(c).fill_null(b.codes - 1).to_numpy(zero_copy_only=False).astype(np.int64) for c, (_, _, b) in zip(columns, lay.blocks)]
            scaled = [np.nan_to_num((batch.column(c).cast("float64").to_numpy(zero_copy_only=False) - mean) / std) for c, (_, _, mean, std) in zip(numbers, lay.numbers)]
            y = batch.column(label).to_numpy(zero_copy_only=False).astype(np.int64)

            def along(p: np.ndarray, made: list[np.ndarray], layout: Layout) -> np.ndarray:
                z = np.repeat(p[:, -1:], len(y), axis=1)
                for table, c in zip(made, codes):
                    z = z + table[:, c]
                for x, (_, offset, _, _) in zip(scaled, layout.numbers):
                    z = z + p[:, offset:offset + 1] * x
                return z

            rest = []
            for layout, made in zip(layouts, model):
                z = along(params, made, layout)
                if len(params) == 1:
                    rest.append(0.5 * (1 + np.tanh(0.5 * z)) - y)
                    continue
                e = np.exp(z - z.max(axis=0))
                r = e / e.sum(axis=0)
                r[y, np.arange(len(y))] -= 1.0
                rest.append(r)
            found = [sum(((rest[at] * along(g, made, layouts[at])).sum(axis=0) * factor for at, g, made, factor in score), np.zeros(len(y))) for score in directions]
            named = [pa.array(table[c], pa.int32(), mask=table[c] < 0) for table, c in zip(classes, codes)]
            yield pa.record_batch([*named, *[batch.column(c) for c in keep], *[pa.array(x, pa.float64()) for x in found]],
                                  names=[*keys, *keep, *[f"s{i}" for i in range(len(found))]])

    wanted = list(dict.fromkeys([*columns, *numbers, label, *keep]))
    rows = cells.select(*wanted)
    schema = [f"{k} int" for k in keys] + [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"s{i} double" for i in range(len(terms))]
    share_package(cells.sparkSession)
    return rows.mapInArrow(run, ", ".join(schema))


def _features(block: RangeBlock | ValueBlock) -> np.ndarray:
    return block.mean if isinstance(block, RangeBlock) else np.zeros(1)


def _add(table: pa.Table) -> pa.Table:
    arrays = [np.frombuffer(x, float) for x in table.column("sums").to_pylist()]
    return pa.table({"model": table.column("model").slice(0, 1), "sums": pa.array([sum(arrays[1:], arrays[0]).tobytes()], pa.binary())})


def sums(
    cells: DataFrame, params: Sequence[np.ndarray], layouts: Sequence[Layout], members: Sequence[Members], label: str, classes: int,
    clip: bool = False, group: str | None = None, second: bool = False,
) -> list[Sums]:
    """Loss, weight, weight per label and gradient of every model over its cells, in one job; with `second` the second derivatives as well.

    A model without cells has weight 0. `clip` bounds the loss of a row as clipped probabilities do.
    """
    if not params:
        return []
    lay = layouts[0]
    keep = [c for c, _, _ in lay.blocks] + [c for c, _, _, _ in lay.numbers] + [label, "n"]
    keep += ["active"] if "active" in cells.columns else []
    keep += [group] if group else []
    share_package(cells.sparkSession)
    found = cells.select(*keep).mapInArrow(_evaluate(params, layouts, members, label, classes, clip, group, second), "model int, sums binary")
    size = 8 * len(params[0]) * (sum(b.codes for _, _, b in lay.blocks) + len(lay.numbers) + 4) + (8 * _second_sums(lay, len(params[0])) if second else 0)
    if size * len(params) * cells.rdd.getNumPartitions() > DIRECT_BYTES:
        found = found.groupBy("model").applyInArrow(_add, "model int, sums binary")
    total: dict[int, np.ndarray] = {}
    for r in found.collect():
        got = np.frombuffer(r["sums"], float)
        total[r["model"]] = total[r["model"]] + got if r["model"] in total else got
    return [_unpacked(total.get(m), p, lay, classes, second) for m, (p, lay) in enumerate(zip(params, layouts))]


def _second_sums(layout: Layout, rows: int) -> int:
    sizes = [n for n, _ in _sources(layout)]
    return sum(sizes[i] * sizes[j] for i, j in _pairs(len(sizes))) * len(_pairs(rows))


def _unpacked(flat: np.ndarray | None, params: np.ndarray, layout: Layout, classes: int, second: bool) -> Sums:
    if flat is None:
        return Sums(0.0, 0.0, np.zeros(classes), np.zeros_like(params), np.zeros((params.size, params.size)) if second else None)
    gradient = np.zeros_like(params)
    at = 2 + classes
    for k in range(len(params)):
        gradient[k, -1] = flat[at]
        at += 1
        for _, offset, block in layout.blocks:
            part = block.adjoint(flat[at:at + block.codes])
            gradient[k, offset:offset + len(part)] += part
            at += block.codes
        for i, (_, offset, _, _) in enumerate(layout.numbers):
            gradient[k, offset] += flat[at + i]
        at += len(layout.numbers)
    return Sums(float(flat[0]), float(flat[1]), flat[2:2 + classes], gradient, _square(flat[at:], layout, len(params)) if second else None)


def _square(flat: np.ndarray, layout: Layout, rows: int) -> np.ndarray:
    """The matrix of second derivatives from sums per pair of codes."""
    sources = _sources(layout)
    vectors = [b.matrix() for _, _, b in layout.blocks] + [np.ones((1, 1))] * (len(layout.numbers) + 1)
    d = layout.width + 1
    out = np.zeros((rows, d, rows, d))
    at = 0
    for a, b in _pairs(rows):
        for i, j in _pairs(len(sources)):
            (n, to), (m, fro) = sources[i], sources[j]
            part = vectors[i].T @ flat[at:at + n * m].reshape(n, m) @ vectors[j]
            at += n * m
            for x, y in ((a, b), (b, a)):
                out[x, to:to + len(part), y, fro:fro + part.shape[1]] = part
                out[y, fro:fro + part.shape[1], x, to:to + len(part)] = part.T
    return out.reshape(rows * d, rows * d)


def hessian(cells: DataFrame, layout: Layout, params: np.ndarray, p: Sequence[Column], weight: Column, diagonal: bool = False) -> np.ndarray:
    """Mean second derivatives of the logistic loss: a square matrix over all weight rows (features, then the intercept), or its diagonal.

    Weighted sums over pairs of columns: per pair and combination of codes one number, so what is grouped follows the codes that occur together and no
    task holds a matrix. `p` are the model's probabilities as columns, one per weight row.
    """
    rows = len(params)
    # A source is a column of codes with a factor: a block, a number (one code, the number as factor), the intercept.
    sources = [(F.coalesce(F.col(c), F.lit(b.codes - 1)), F.lit(1.0), offset, b.matrix()) for c, offset, b in layout.blocks]
    sources += [(F.lit(0), F.coalesce((F.col(c).cast("double") - F.lit(m)) / F.lit(s), F.lit(0.0)), offset, np.ones((1, 1))) for c, offset, m, s in layout.numbers]
    sources.append((F.lit(0), F.lit(1.0), layout.width, np.ones((1, 1))))
    pairs = [(i, j) for i in range(len(sources)) for j in range(i, len(sources)) if not diagonal or i == j]
    cross = [(a, b) for a in range(rows) for b in range(a, rows) if not diagonal or a == b]
    second = [(p[a] * ((1.0 if a == b else 0.0) - p[b]) * weight).alias(f"h{i}") for i, (a, b) in enumerate(cross)]
    made = cells.select(*[c.alias(f"c{i}") for i, (c, *_) in enumerate(sources)], *[f.alias(f"f{i}") for i, (_, f, *_) in enumerate(sources)],
                        *second, weight.alias("w"))
    entries = [F.struct(F.lit(k).alias("pair"), F.col(f"c{i}").alias("a"), F.col(f"c{j}").alias("b"),
                        *[(F.col(f"h{x}") * F.col(f"f{i}") * F.col(f"f{j}")).alias(f"h{x}") for x in range(len(cross))]) for k, (i, j) in enumerate(pairs)]
    # At most the product of two blocks' codes per pair, and the blocks are bounded by MAX_DENSE features where the matrix is asked for.
    found = (made.select("w", F.explode(F.array(*entries)).alias("e")).select("w", "e.*").groupBy("pair", "a", "b")
             .agg(*[F.sum(f"h{x}").alias(f"h{x}") for x in range(len(cross))], F.sum("w").alias("w")).collect())
    # The intercept with itself holds every row.
    total = sum(r["w"] for r in found if r["pair"] == len(pairs) - 1)
    d = layout.width + 1
    if diagonal:
        out = np.zeros((rows, d))
        for r in found:
            _, _, offset, v = sources[pairs[r["pair"]][0]]
            for x, (a, _) in enumerate(cross):
                out[a, offset:offset + v.shape[1]] += r[f"h{x}"] * v[r["a"]] ** 2
        return out.reshape(-1) / total
    dense = {k: np.zeros((len(cross), len(sources[i][3]), len(sources[j][3]))) for k, (i, j) in enumerate(pairs)}
    for r in found:
        dense[r["pair"]][:, r["a"], r["b"]] += [r[f"h{x}"] for x in range(len(cross))]
    out = np.zeros((rows, d, rows, d))
    for k, (i, j) in enumerate(pairs):
        (_, _, at, v), (_, _, to, u) = sources[i], sources[j]
        for x, (a, b) in enumerate(cross):
            part = v.T @ dense[k][x] @ u
            for s, t, m in ((a, b, part), (b, a, part)):
                out[s, at:at + len(m), t, to:to + m.shape[1]] = m
                out[t, to:to + m.shape[1], s, at:at + len(m)] = m.T
    return out.reshape(rows * d, rows * d) / total


def level_probabilities(space: FeatureSpace, params: np.ndarray, levels: Mapping[str, int]) -> list[Column]:
    """Probability per weight row of cells that carry leaf positions, seen at a level vector."""
    model = as_linear(params)
    return model.probabilities([space.dot(w, levels) + F.lit(b) for w, b in zip(model.weights, model.intercepts)])


def inverse_curvature(cells: DataFrame, layout: Layout, params: np.ndarray, p: Sequence[Column], weight: Column) -> Callable[[np.ndarray], np.ndarray]:
    """A start for quasi-Newton steps: the damped inverse of the second derivatives, of their diagonal where there are many parameters."""
    if params.size <= MAX_DENSE:
        h = hessian(cells, layout, params, p, weight)
        inverse = np.linalg.inv(h + (1e-6 * np.trace(h) / len(h) + 1e-9) * np.eye(len(h)))
        return lambda g: inverse @ g
    diagonal = hessian(cells, layout, params, p, weight, diagonal=True)
    floor = 1e-3 * diagonal.mean() + 1e-9
    return lambda g: g / (diagonal + floor)


@dataclass
class _Run:
    x: np.ndarray
    f: float
    g: np.ndarray
    start: Callable[[np.ndarray], np.ndarray]
    pairs: list = field(default_factory=list)
    d: np.ndarray | None = None
    t: float = 1.0
    steps: int = 0
    state: str = "open"
    h: np.ndarray | None = None

    def aim(self) -> None:
        """The next direction: a Newton step, or two loops over the last steps around the given inverse curvature.

        A Newton step has no part along what the rows do not determine.
        """
        if self.h is not None:
            self.d, self.t = -np.linalg.pinv(self.h, rcond=1e-10, hermitian=True) @ self.g, 1.0
            if float(self.d @ self.g) >= 0:
                self.d = -self.g
            return
        q, held = self.g.copy(), []
        for s, y in reversed(self.pairs):
            a = float(s @ q) / float(s @ y)
            held.append(a)
            q = q - a * y
        q = self.start(q)
        for (s, y), a in zip(self.pairs, reversed(held)):
            q = q + s * (a - float(y @ q) / float(s @ y))
        if float(q @ self.g) <= 0:
            self.pairs, q = [], self.start(self.g)
        self.d, self.t = -q, 1.0

    def take(self, f: float, g: np.ndarray, limit: int, h: np.ndarray | None = None) -> None:
        """The outcome of the last try."""
        slope = float(self.g @ self.d)
        if not np.isfinite(f) or f > self.f + 1e-4 * self.t * slope:
            # The lowest point of the parabola through what is known, kept within bounds.
            curve = f - self.f - self.t * slope
            best = -slope * self.t**2 / (2 * curve) if np.isfinite(curve) and curve > 0 else 0.1 * self.t
            self.t = min(max(best, 0.1 * self.t), 0.5 * self.t)
            if self.t < 1e-12 or -self.t * slope < 1e-14:
                self.state = "done"
            return
        s, y = self.t * self.d, g - self.g
        if float(s @ y) > 1e-12 * float(np.linalg.norm(s) * np.linalg.norm(y)):
            self.pairs = [*self.pairs[-(MEMORY - 1):], (s, y)]
        gain = self.f - f
        self.x, self.f, self.g, self.h, self.steps = self.x + s, f, g, h, self.steps + 1
        if gain <= TOLERANCE * max(1.0, abs(f)) or np.abs(g).max(initial=0.0) <= TOLERANCE:
            self.state = "done"
        elif self.steps >= limit:
            self.state = "limit"
        else:
            self.aim()


def takes_newton(layout: Layout, rows: int) -> bool:
    """Whether fits of this shape are small enough for second derivatives in every step."""
    return rows * (layout.width + 1) <= NEWTON and _second_sums(layout, rows) <= NEWTON_SUMS


def fit(
    cells: DataFrame, layouts: Sequence[Layout], members: Sequence[Members], label: str, classes: int, max_iter: int,
    near: Callable[[], Callable[[np.ndarray], np.ndarray]], group: str | None = None,
) -> list[Fitted]:
    """Unregularized logistic fits of all models from zeros, a job per step for those that are still open.

    Models of few parameters take Newton steps from sums per pair of codes and end at the smallest of equal optima. Others take quasi-Newton
    steps; `near()` then gives the inverse curvature that all start from. Where labels are separable there is no optimum, and the
    tolerance ends the steps: that is why no fit starts from another one. A model that has seen `max_iter` steps without meeting the tolerance is returned as it is, with `limit_reached`; one
    without cells keeps zeros and weight 0.
    """
    if not layouts:
        return []
    rows = 1 if classes <= 2 else classes
    zeros = np.zeros((rows, layouts[0].width + 1))
    newton = takes_newton(layouts[0], rows)
    first_step = (lambda g: g) if newton else near()
    first = sums(cells, [zeros] * len(layouts), layouts, members, label, classes, group=group, second=newton)
    runs = []
    for s in first:
        w = s.weight or 1.0
        run = _Run(zeros.reshape(-1).copy(), s.loss / w, (s.gradient / w).reshape(-1), first_step, h=None if s.second is None else s.second / w)
        if not s.weight or np.abs(run.g).max(initial=0.0) <= TOLERANCE:
            run.state = "done"
        elif max_iter <= 0:
            run.state = "limit"
        else:
            run.aim()
        runs.append(run)
    while True:
        open_ = [i for i, r in enumerate(runs) if r.state == "open"]
        if not open_:
            break
        tries = [(runs[i].x + runs[i].t * runs[i].d).reshape(zeros.shape) for i in open_]
        found = sums(cells, tries, [layouts[i] for i in open_], [members[i] for i in open_], label, classes, group=group, second=newton)
        for i, s in zip(open_, found):
            runs[i].take(s.loss / s.weight, (s.gradient / s.weight).reshape(-1), max_iter, None if s.second is None else s.second / s.weight)
    return [Fitted(r.x.reshape(zeros.shape), r.f, s.weight, s.labels, r.steps, r.state == "limit") for r, s in zip(runs, first)]


def losses(cells: DataFrame, params: Sequence[np.ndarray], layouts: Sequence[Layout], label: str, classes: int,
           members: Sequence[Members] | None = None, group: str | None = None) -> list[float]:
    """Mean clipped log loss of every model, in one job."""
    who = members or [Members()] * len(params)
    return [s.loss / s.weight if s.weight else float("nan") for s in sums(cells, params, layouts, who, label, classes, True, group)]
