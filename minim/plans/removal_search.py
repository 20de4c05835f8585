"""Removal-first search: start from all rows and give up detail or rows for privacy.

The state is a table of weighted leaf cells. A candidate's state is a predicate on them, so a page of candidates is certified by fitting all its
proxies side by side (`lockstep`): a job per optimizer step, whatever the page holds. Only the state that is taken is written.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from minim.operators import lockstep as K
from minim.operators import removal as D
from minim.operators.hierarchy import Forest
from minim.plans.minimize import MinimizeOptions, Search

MAX_PAGE = 200
REMOVE, COARSEN, EXCHANGE = "remove_retention_class", "attribute_coarsen", "k_safe_class_exchange"


@dataclass(frozen=True)
class RemovalOptions:
    tolerance: float = 0.01
    epsilon: float = 1e-6
    rank_top_k: int = 3
    max_iterations: int = 50
    exchange: bool = True
    # None: the best exchange of every pair of class sizes; a number: so many classes on each side.
    pool: int | None = None
    max_fit_iterations: int = 300
    # Candidates that are certified together at first, and how much larger each further page is; the result does not depend on it.
    page: int = 12
    growth: int = 4


@dataclass
class _State:
    """Cells with their `active` flag, level vector, proxy and its loss, the class table and what it says of all classes."""

    cells: DataFrame
    levels: dict[str, int]
    params: np.ndarray
    loss: float
    classes: DataFrame
    least: D.Bottom
    count: int
    hashes: int
    # Mean change of the gradient score per QI that can go a level up.
    steps: dict[str, float]

    @property
    def fingerprint(self) -> str:
        return D.fingerprint_of(self.count, self.hashes, self.levels, self.levels)


def _state(search: Search, cells: DataFrame, levels: dict[str, int], params: np.ndarray, loss: float) -> _State:
    """One job over the validation cells, one over the cells; the rest reads the class table."""
    forest, label = search.forest, search.label
    keys = [f"{a}__node" for a in forest]
    up = [a for a in forest if int(levels.get(a, 0)) < forest[a].height]
    seen = [levels, *[{**levels, a: int(levels.get(a, 0)) + 1} for a in up]]
    # The validation gradient at this level vector and at each one a step up.
    layouts = [K.level_layout(search.space, v) for v in seen]
    found = K.sums(search.val, [params] * len(seen), layouts, [K.Members()] * len(seen), label, search.classes)
    g = [s.gradient / s.weight for s in found]
    # Scores of the cells, and the change of the mean gradient per step, with the next level's validation gradient on both sides.
    terms = [[(0, g[0], 1.0)], *[[(i, g[i], 1.0), (0, g[i], -1.0)] for i in range(1, len(seen))]]
    named = K.scored(cells.withColumn("_h", D.cell_hash(forest)), params, layouts, terms, K.class_positions(search.space, levels), keys, label, ["n", "active", "_h"])
    here = F.col("active")
    more = [c for flag, name in ((here, "active"), (~here, "removed")) for c in (
        F.count(F.when(flag, 1)).alias(f"{name}_cells"), F.sum(F.when(flag, F.col("_h"))).alias(f"{name}_hash"))]
    more += [F.sum(F.when(here, F.col("n") * F.col(f"s{i + 1}"))).alias(f"d{i}") for i in range(len(up))]
    classes = search.scratch.save(D.both_sides(named, keys, F.col("s0"), more))
    total = classes.agg(F.sum("active_cells").alias("c"), F.sum("active_hash").alias("h"), F.sum("active_rows").alias("n"),
                        *[F.sum(f"d{i}").alias(f"d{i}") for i in range(len(up))]).first()
    return _State(cells, levels, params, loss, classes, D.bottom(classes, keys), int(total["c"] or 0), int(total["h"] or 0),
                  {a: float(total[f"d{i}"]) / total["n"] for i, a in enumerate(up)})


def _ranked(search: Search, state: _State, options: RemovalOptions) -> DataFrame:
    """All candidates with positive progress, to be ordered by cost."""
    forest, levels = search.forest, state.levels
    keys = [f"{a}__node" for a in forest]
    columns = ["action", "candidate", "next_active_rows", "next_k", "next_min_classes", "fast_utility_score"]
    parts = [D.removals_at_min(state.classes, keys, state.least).withColumns({
        "action": F.lit(REMOVE), "candidate": F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})}).select(*columns)]
    if state.steps:
        score = F.lit(None).cast("double")
        for a, step in state.steps.items():
            score = F.when(F.col("attr") == a, F.lit(-step)).otherwise(score)
        coarse = D.coarsen_candidates(state.cells.where("active"), forest, levels)
        parts.append(coarse.select(F.lit(COARSEN).alias("action"), F.col("attr").alias("candidate"), F.lit(state.least.rows).cast("bigint").alias("next_active_rows"),
                                   "next_k", "next_min_classes", score.alias("fast_utility_score")))
    if options.exchange and state.least.removed:
        if options.pool is None:
            swaps = D.exchanges_at_min(state.classes, keys, state.least)
        else:
            swaps = _pooled(state, keys, options.pool)
        parts.append(swaps.withColumns({"action": F.lit(EXCHANGE), "candidate": F.to_json(F.struct("out", "in"), {"ignoreNullFields": "false"})}).select(*columns))
    return D.rank_candidates(D.union_all(parts), state.least.min_k, state.least.at_min, options.tolerance, options.epsilon)


def _pooled(state: _State, keys: Sequence[str], pool: int) -> DataFrame:
    """Exchanges among the `pool` best classes of each side."""
    active = state.classes.where("active_rows IS NOT NULL").select(*keys, F.col("active_rows").alias("rows"), F.col("active_s").alias("s"))
    removed = state.classes.where("removed_rows IS NOT NULL").select(*keys, F.col("removed_rows").alias("rows"), F.col("removed_s").alias("s"))
    least = state.least

    # Classes at min-K after the exchange: the outgoing one leaves, the incoming one takes
    # its active class to a new size.
    def at_min(size):
        return F.when(size == least.min_k, 1).otherwise(0)

    joined = F.when(F.col("in") == F.col("out"), 0).otherwise(F.col("in_active_rows"))
    after = F.lit(least.at_min) - at_min(F.col("out_rows")) - at_min(joined) + at_min(F.col("grown_rows"))
    return D.exchange_candidates(active, removed, keys, pool).withColumn(
        "next_min_classes", F.when(F.col("next_k") > least.min_k, 0).otherwise(after).cast("bigint"))


def _in_order(search: Search, ranked: DataFrame, page: int, growth: int) -> Iterator[list[Row]]:
    """Candidates by estimated cost, a bounded page at a time (at most MAX_PAGE), resumed behind the last one; they are written when a second page is asked for."""
    order = F.struct("fast_cost", "next_active_rows", "action", "candidate")
    rows = ranked.withColumn("_order", order).orderBy("_order").limit(int(page)).collect()
    if rows:
        yield rows
    if len(rows) < page:
        return
    written = search.scratch.save(ranked)
    ordered = written.withColumn("_order", order)
    kinds = ordered.schema["_order"].dataType.fields
    while len(rows) == page:
        page = min(MAX_PAGE, page * growth)
        last = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(rows[-1]["_order"], kinds)])
        rows = ordered.where(F.col("_order") > last).orderBy("_order").limit(int(page)).collect()
        if rows:
            yield rows
    search.scratch.drop(written)


@dataclass
class _Move:
    """A candidate as a change of the state."""

    row: Row
    levels: dict[str, int]
    out: tuple | None = None
    into: tuple | None = None

    def members(self, classes: tuple[np.ndarray, ...]) -> K.Members:
        def positions(c):
            return None if c is None else tuple(-1 if x is None else x for x in c)

        return K.Members(classes, positions(self.out), positions(self.into))


def _move(search: Search, state: _State, row: Row) -> _Move:
    keys = [f"{a}__node" for a in search.forest]
    if row["action"] == COARSEN:
        return _Move(row, {**state.levels, row["candidate"]: int(state.levels.get(row["candidate"], 0)) + 1})
    named = json.loads(row["candidate"])
    if row["action"] == REMOVE:
        return _Move(row, dict(state.levels), tuple(named[k] for k in keys))
    return _Move(row, dict(state.levels), tuple(named["out"][k] for k in keys), tuple(named["in"][k] for k in keys))


def _unseen(search: Search, state: _State, moves: Sequence[_Move], visited: set[str]) -> list[_Move]:
    """The moves without exchanges that lead back to a visited state."""
    swaps = [m for m in moves if m.into is not None]
    if not swaps:
        return list(moves)
    keys = [f"{a}__node" for a in search.forest]
    wanted = sorted({c for m in swaps for c in (m.out, m.into)}, key=repr)
    # Two classes for each candidate of a page.
    asked = search.spark.createDataFrame(wanted, ", ".join(f"_{k} int" for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    rows = state.classes.join(F.broadcast(asked), condition).select(*keys, "active_cells", "active_hash", "removed_cells", "removed_hash").collect()
    known = {tuple(r[k] for k in keys): r for r in rows}
    out = []
    for m in moves:
        if m.into is not None:
            leaves, joins = known[m.out], known[m.into]
            count = state.count - leaves["active_cells"] + joins["removed_cells"]
            hashes = state.hashes - int(leaves["active_hash"]) + int(joins["removed_hash"])
            if D.fingerprint_of(count, hashes, search.forest, m.levels) in visited:
                continue
        out.append(m)
    return out


def removal_search(train: DataFrame, val: DataFrame, forest: Forest, label: str, options: RemovalOptions = RemovalOptions()) -> dict:
    """Greedy search by privacy progress per utility cost.

    Each iteration orders all candidates by estimated cost, certifies them in batches of
    `rank_top_k` by refitting the proxy, and takes the best ratio of the first batch with a
    feasible one (ties: progress, loss, rows, action, id). It ends when no candidate is feasible.
    A page of candidates is refitted at once.
    """
    search = Search(train, val, None, forest, label, MinimizeOptions(tolerance=options.tolerance, max_fit_iterations=options.max_fit_iterations))
    cells = search.scratch.save(search.cells.withColumn("active", F.lit(True)))
    levels = dict.fromkeys(forest, 0)
    layout = K.level_layout(search.space, levels)
    first = K.fit(cells, [layout], [K.Members()], label, search.classes, options.max_fit_iterations, lambda: _near(search, cells, levels))[0]
    loss = K.losses(search.val, [first.params], [layout], label, search.classes)[0]
    threshold = loss + options.tolerance
    state = _state(search, cells, levels, first.params, loss)
    visited = {state.fingerprint}
    log, reason = [], "max_iterations_reached"
    limits = int(first.limit_reached)
    for iteration in range(options.max_iterations):
        best, batch, seen = None, [], 0
        for page in _in_order(search, _ranked(search, state, options), options.page, options.growth):
            moves = [_move(search, state, r) for r in page]
            kept = {id(m) for m in _unseen(search, state, moves, visited)}
            certified = iter(_certify(search, state, [m for m in moves if id(m) in kept], options))
            for m in moves:
                seen += 1
                if id(m) in kept:
                    fitted, candidate_loss = next(certified)
                    limits += fitted.limit_reached
                    if (fitted.labels > 0).all():
                        cost = max((candidate_loss - state.loss) / max(options.tolerance, options.epsilon), options.epsilon)
                        progress = m.row["privacy_progress"]
                        batch.append((-progress / cost, -progress, candidate_loss, m.row["next_active_rows"], m.row["action"], m.row["candidate"], m, fitted))
                if seen % options.rank_top_k == 0:
                    best = _best(batch, threshold)
                    batch = []
                    if best is not None:
                        break
            if best is not None:
                break
        best = best or _best(batch, threshold)
        if best is None:
            reason = "no_feasible_candidate" if seen else "no_positive_privacy_progress_candidate"
            break
        move, fitted = best[6], best[7]
        cells = state.cells
        if move.out is not None:
            cells = search.scratch.replace(cells, D.move_class(cells, forest, state.levels, move.out, move.into))
        levels = move.levels
        search.scratch.drop(state.classes)
        state = _state(search, cells, levels, fitted.params, best[2])
        visited.add(state.fingerprint)
        log.append({"iteration": iteration, "action": best[4], "candidate": best[5], "min_k": state.least.min_k, "min_k_class_count": state.least.at_min,
                    "active_rows": best[3], "validation_loss": state.loss, "greedy_ratio": -best[0], "limit_reached": fitted.limit_reached, "levels": dict(levels)})
    return {"iterations": log, "termination": reason, "cells": state.cells, "levels": levels, "threshold": threshold, "fits_at_limit": limits}


def _best(batch: list[tuple], threshold: float) -> tuple | None:
    return min((b for b in batch if b[2] <= threshold), key=lambda b: b[:6], default=None)


def _near(search: Search, cells: DataFrame, levels: Mapping[str, int]):
    """Inverse curvature of the active cells where all classes are as likely."""
    rows = 1 if search.classes <= 2 else search.classes
    weight = F.when(F.col("active"), F.col("n")).otherwise(0).cast("double")
    return K.inverse_curvature(cells, K.level_layout(search.space, levels), np.zeros((rows, search.space.width + 1)), [F.lit(1.0 / search.classes)] * rows, weight)


def _certify(search: Search, state: _State, moves: Sequence[_Move], options: RemovalOptions) -> list[tuple[K.Fitted, float]]:
    """Refitted proxy and validation loss of every move."""
    if not moves:
        return []
    # One object per level vector: what travels to the tasks holds it once.
    known = {key: K.level_layout(search.space, dict(key)) for key in {tuple(m.levels.items()) for m in moves}}
    layouts = [known[tuple(m.levels.items())] for m in moves]
    classes = K.class_positions(search.space, state.levels)
    fitted = K.fit(state.cells, layouts, [m.members(classes) for m in moves], search.label, search.classes, options.max_fit_iterations,
                   lambda: _near(search, state.cells, state.levels))
    return list(zip(fitted, K.losses(search.val, [f.params for f in fitted], layouts, search.label, search.classes)))


LOG = ("iteration int, action string, candidate string, min_k bigint, min_k_class_count bigint, active_rows bigint, validation_loss double, "
       "greedy_ratio double, limit_reached boolean, termination string")


def removal_log(spark, result: dict) -> DataFrame:
    """One row per iteration, each with the reason the search ended; a search without iterations has one row with nothing but that."""
    rows = [(r["iteration"], r["action"], r["candidate"], int(r["min_k"]), int(r["min_k_class_count"]), int(r["active_rows"]), float(r["validation_loss"]),
             float(r["greedy_ratio"]), bool(r["limit_reached"]), result["termination"]) for r in result["iterations"]]
    return spark.createDataFrame(rows or [(None,) * 9 + (result["termination"],)], LOG)
