"""Spark ML's perceptron, fitted with the passes over the rows as numpy matrix products.

First weights, objective, steps and stopping rules are those of `MultilayerPerceptronClassifier` (sigmoid layers, softmax with
cross entropy on top, L-BFGS of Breeze), so the model is the same up to rounding. Only the form of the rows differs: they are
packed once into pieces of at most `PIECE` rows, sorted by the combination of their few-valued columns (indicators, numbers
of a hierarchy node). The first layer is computed once per combination; a row adds its other columns alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minim.session import Scratch

#: Rows of a block. The objective is the mean of the blocks' means, as in Spark ML: rows of a partition's last, shorter block weigh more.
BLOCK = 128
#: Rows of a packed piece, and of one matrix product (whose arrays stay in a core's cache).
PIECE, STEP = 512 * BLOCK, 512
#: Distinct values up to which a column takes part in combinations, and the rows that are looked at first.
FEW, PROBE = 32, 512
#: Tasks of a pass per core: each returns one gradient to the driver, whatever the number of rows.
WAVES = 2
#: Pieces of a file, on average at most: Parquet looks at a page's size every hundred records only, and a piece has a megabyte or two.
FILED = 4

PACKED = "rows int, blocks int, scale double, coded binary, starts binary, cells binary, other binary, target binary"
SUMS = "loss double, blocks bigint, gradient binary"


def pack(x: np.ndarray, y: np.ndarray, scale: float) -> dict:
    """Rows (one per line of `x`) as a piece; `scale` is the weight of a row inside its block."""
    columns = np.ascontiguousarray(x.T)
    coded, key, room = [], np.zeros(len(x), np.int64), 1
    for j, column in enumerate(columns):
        values = np.unique(column[:PROBE])
        if len(values) > FEW:
            continue
        at = np.minimum(np.searchsorted(values, column), len(values) - 1)
        if (values[at] != column).any():
            values, at = np.unique(column, return_inverse=True)
        if len(values) > FEW or room * len(values) >= 1 << 62:
            continue
        key, room = key * len(values) + at, room * len(values)
        coded.append(j)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    other = np.setdiff1d(np.arange(x.shape[1]), coded)
    return {"rows": len(x), "blocks": -(-len(x) // BLOCK), "scale": scale, "coded": np.array(coded, np.int32).tobytes(),
            "starts": starts.astype(np.int32).tobytes(), "cells": x[order[starts]][:, coded].tobytes(),
            "other": columns[other][:, order].tobytes("F"), "target": y[order].astype(np.int32).tobytes()}


def packed_rows(rows: DataFrame, label: str, features: str, width: int, classes: int) -> DataFrame:
    """The rows of each partition as pieces, in blocks of `BLOCK` rows from its first row on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        schema = pa.schema([("rows", pa.int32()), ("blocks", pa.int32()), ("scale", pa.float64()),
                            *((c, pa.binary()) for c in ("coded", "starts", "cells", "other", "target"))])

        def pieces(last: bool) -> Iterator[pa.RecordBatch]:
            x, y = (np.concatenate(part) for part in zip(*kept, strict=True))
            kept.clear()
            whole = len(x) // BLOCK * BLOCK
            full = whole if last else len(x) // PIECE * PIECE
            for i in range(0, full, PIECE):
                end = min(i + PIECE, full)
                yield pa.RecordBatch.from_pylist([pack(x[i:end], y[i:end], 1.0 / BLOCK)], schema)
            if full < len(x) and last:
                yield pa.RecordBatch.from_pylist([pack(x[full:], y[full:], 1.0 / (len(x) - full))], schema)
            elif full < len(x):
                kept.append((x[full:], y[full:]))

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = batch.column(0), batch.column(1)
            lengths = np.diff(x.offsets.to_numpy())
            if x.null_count or x.flatten().null_count or (lengths != width).any():
                raise ValueError(f"features are to be vectors of {width} numbers")
            values = x.flatten().to_numpy().reshape(-1, width)
            if not np.isfinite(values).all():
                raise ValueError("features hold NaN or infinite numbers")
            found = y.to_numpy(zero_copy_only=False)
            if y.null_count or not ((found >= 0) & (found < classes) & (found == np.floor(found))).all():
                raise ValueError(f"labels are to be whole numbers from 0 to {classes - 1}")
            kept.append((values, found))
            if sum(len(part) for _, part in kept) >= PIECE:
                yield from pieces(False)
        if kept:
            yield from pieces(True)

    return rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(run, PACKED)


def layer_weights(flat: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """`(matrix, bias)` per layer as views of Spark's flat weights; a matrix has one line per input."""
    out, at = [], 0
    for n, m in zip(layers, layers[1:]):
        out.append((flat[at:at + n * m].reshape(n, m), flat[at + n * m:at + n * m + m]))
        at += n * m + m
    return out


def add_piece(piece: dict, weights: Sequence[tuple], sums: Sequence[tuple], width: int) -> float:
    """Add a piece's gradient to `sums`, which has the shape of `weights`, and return its loss."""
    n, scale = piece["rows"], piece["scale"]
    coded = np.frombuffer(piece["coded"], np.int32)
    starts = np.frombuffer(piece["starts"], np.int32)
    cells = np.frombuffer(piece["cells"]).reshape(len(starts), len(coded))
    other = np.setdiff1d(np.arange(width), coded)
    x = np.frombuffer(piece["other"]).reshape(n, len(other))
    target = np.frombuffer(piece["target"], np.int32)
    w0, b0 = weights[0]
    # Minus the logits, as the sigmoid takes them.
    hidden = [(-w, np.tile(-b, (STEP, 1))) for w, b in weights[1:-1]]
    back = [np.ascontiguousarray(w.T) for w, _ in weights]
    (w0, b0), (top, bias) = (-w0, -b0), weights[-1]
    table, free = cells @ w0[coded] + b0, w0[other]
    cell = np.repeat(np.arange(len(starts)), np.diff(starts, append=n))
    cell_sums, other_sums = np.zeros_like(table), np.zeros_like(free)
    classes = np.arange(len(bias))[:, None]
    loss = 0.0
    for s in range(0, n, STEP):
        e = min(s + STEP, n)
        ones = np.ones(e - s)
        z = table.take(cell[s:e], 0)
        if len(other):
            z += x[s:e] @ free
        acts = []
        for w, b in [*hidden, (None, None)]:
            np.exp(z, out=z)
            z += 1.0
            np.reciprocal(z, out=z)
            acts.append(z)
            if w is not None:
                z = z @ w
                z += b[:e - s]
        # The last layer has one line per class.
        p = top.T @ z.T
        p += bias[:, None]
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        hit = (classes == target[s:e]).astype(float)
        loss -= float((hit * np.log(p)).sum())
        p -= hit
        p *= scale
        delta = p.T
        for w, (gw, gb), a in zip(back[:0:-1], sums[:0:-1], acts[::-1]):
            gw += a.T @ delta
            gb += ones @ delta
            delta = delta @ w
            delta *= a
            np.subtract(1.0, a, out=a)
            delta *= a
        first, last = cell[s], cell[e - 1]
        cell_sums[first:last + 1] += np.add.reduceat(delta, np.maximum(starts[first:last + 1] - s, 0), axis=0)
        if len(other):
            other_sums += x[s:e].T @ delta
    gw, gb = sums[0]
    gw[coded] += cells.T @ cell_sums
    gw[other] += other_sums
    gb += cell_sums.sum(0)
    return loss * scale


def objective(packed: DataFrame, layers: Sequence[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Loss and gradient at flat weights: one job over the packed rows."""
    tasks = WAVES * packed.sparkSession.sparkContext.defaultParallelism
    fields = packed.columns

    def value(flat: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, total = layer_weights(flat, layers), np.zeros_like(flat)
            sums, loss, blocks = layer_weights(total, layers), 0.0, 0
            # An overflow shows in the loss, and the line search steps back.
            with np.errstate(all="ignore"):
                for batch in batches:
                    for i in range(batch.num_rows):
                        piece = {c: batch.column(k)[i] for k, c in enumerate(fields)}
                        piece = {c: v.as_buffer() if pa.types.is_binary(v.type) else v.as_py() for c, v in piece.items()}
                        loss += add_piece(piece, weights, sums, layers[0])
                        blocks += piece["blocks"]
            yield pa.RecordBatch.from_pydict({"loss": [loss], "blocks": [blocks], "gradient": [total.tobytes()]})

        parts = packed.coalesce(tasks).mapInArrow(run, SUMS).collect()
        blocks = sum(p["blocks"] for p in parts)
        if not blocks:
            raise ValueError("no rows to fit")
        return sum(p["loss"] for p in parts) / blocks, np.sum([np.frombuffer(p["gradient"]) for p in parts], axis=0) / blocks

    return value


class _Failed(Exception):
    """A step that cannot be taken: the history is dropped once, then the search ends."""


def _direction(steps: list[np.ndarray], changes: list[np.ndarray], gradient: np.ndarray) -> np.ndarray:
    """Minus the approximate inverse Hessian times the gradient; the latest step comes first."""
    scale = 1.0
    if steps:
        sy = steps[0] @ changes[0]
        if not sy >= 0:
            raise _Failed("history")
        scale = np.divide(sy, changes[0] @ changes[0])
    out, parts = gradient.copy(), []
    for s, c in zip(steps, changes):
        rho = s @ c
        a = np.divide(s @ out, rho)
        if math.isnan(a):
            raise _Failed("history")
        out -= a * c
        parts.append((a, rho))
    out *= scale
    for s, c, (a, rho) in zip(steps[::-1], changes[::-1], parts[::-1]):
        out += (a - np.divide(c @ out, rho)) * s
    return -out


def _step_size(at: Callable[[float], tuple[float, float]], start: tuple[float, float], t: float) -> float:
    """Strong Wolfe line search; `at` gives value and slope at a step, `start` those at 0. The last step evaluated is the one returned."""
    value, slope = start
    if slope > 0:
        raise _Failed("no descent")

    def between(left, right):
        (tl, fl, dl), (tr, fr, dr) = left, right
        d1 = dl + dr - 3 * (fl - fr) / (tl - tr)
        d2 = np.sqrt(np.float64(d1 * d1 - dl * dr))
        t = tr - (tr - tl) * np.divide(dr + d2 - d1, dr - dl + 2 * d2)
        low, high = tl + 0.1 * (tr - tl), tl + 0.9 * (tr - tl)
        return low if t < low else high if t > high else float(t)

    def zoom(low, high):
        for _ in range(10):
            t = between(high, low) if low[0] > high[0] else between(low, high)
            f, d = at(t)
            if f > value + 1e-4 * t * slope or f >= low[1]:
                high = (t, f, d)
                continue
            if abs(d) <= 0.9 * abs(slope):
                return t
            if d * (high[0] - low[0]) >= 0:
                high = low
            low = (t, f, d)
        raise _Failed("zoom")

    low = (0.0, value, slope)
    for i in range(10):
        f, d = at(t)
        if not math.isfinite(f):
            t /= 2.0
            continue
        if f > value + 1e-4 * t * slope or (f >= low[1] and i > 0):
            return zoom(low, (t, f, d))
        if abs(d) <= 0.9 * abs(slope):
            return t
        if d >= 0:
            return zoom((t, f, d), low)
        low = (t, f, d)
        t *= 1.5
    raise _Failed("line search")


@np.errstate(all="ignore")
def minimize_smooth(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """L-BFGS with Breeze's steps and stopping rules, as Spark ML uses it."""
    known: list = [None, None]

    def cached(w):
        if known[0] is None or not np.array_equal(known[0], w):
            known[:] = w, value(w)
        return known[1]

    f, g = cached(x)
    first, seen, taken, failed = abs(f), [math.inf], 0, False
    steps, changes = [], []
    while True:
        if (taken >= max_iter or len(seen) >= 2 and abs(f - max(seen)) <= tolerance * first
                or np.linalg.norm(g) <= max(tolerance * abs(f), 1e-8)):
            return x
        try:
            way = _direction(steps, changes, g)

            def at(t, x=x, way=way):
                v, grad = cached(x + t * way)
                return v, float(grad @ way)

            t = _step_size(at, (f, float(g @ way)), 1.0 / np.linalg.norm(way) if taken == 0 else 1.0)
            if t * np.linalg.norm(g) < 1e-10:
                raise _Failed("step")
        except _Failed:
            if failed:
                return x
            failed, steps, changes = True, [], []
            continue
        new = x + t * way
        value_new, grad_new = cached(new)
        steps, changes = [new - x, *steps][:memory], [grad_new - g, *changes][:memory]
        x, f, g = new, value_new, grad_new
        seen = [*seen, f][-20:]
        taken, failed = taken + 1, False


def fit_weights(
    rows: DataFrame, count: int, label: str, layers: Sequence[int], first: Sequence[float], max_iter: int, tolerance: float, features: str = "features",
) -> list[float]:
    """Flat weights of the perceptron fitted to the rows, `count` in all, from the weights `first` on."""
    spark = rows.sparkSession
    scratch, batch = Scratch(spark, "perceptron"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    # What shares a block is settled with the pieces; these can lie anywhere.
    parts = max(WAVES * spark.sparkContext.defaultParallelism, -(-count // (PIECE * FILED)))
    packed = scratch.save(packed_rows(rows, label, features, layers[0], layers[-1]).repartition(parts))
    before = spark.conf.get(batch)
    spark.conf.set(batch, "1")
    try:
        return minimize_smooth(objective(packed, layers), np.asarray(first, dtype=float), max_iter, tolerance).tolist()
    finally:
        spark.conf.set(batch, before)
        scratch.drop(packed)
