"""Admission and refinement candidates, their scores, and the class swap.

`s_i = g_val . grad(loss_i)` is one number per row (`models.influence_scalar`). With n selected
rows of mean s, a class of m rows scores `(sum(s) - m * mean) / (n + m)` when admitted, and
`(m * mean - sum(s)) / (n - m)` when removed; a refinement scores `mean(s_next - s_cur)`.
So all candidates are scored by one grouped sum.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minim.functions.ordering import seeded_key, unit_interval
from minim.operators.keyed import attach, first_rows, running_sums
from minim.session import Scratch

PAGE = 4096
# Classes that the swap holds on the driver before their state is written back; a class takes about a kilobyte there.
TOUCHED = 50_000
LIMIT_REACHED = "limit_reached"
# Shares of a type in the first step of `top_k_per_type`.
SHARES = 256


def selected_mean(rows: DataFrame, s: Column, selected: str = "selected") -> tuple[int, float]:
    """Number of selected rows and their mean s."""
    one = rows.where(F.col(selected)).agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("m")).first()
    return one["n"], one["m"] or 0.0


def admission_rows(rows: DataFrame, keys: Sequence[str], key: str, current_k: int, selected: str = "selected",
                   whole: bool = False) -> DataFrame:
    """Rows each class would admit: its first `min(size, current_k)` unselected rows.

    A `current_k` of 0, or `whole`, admits the class as it is.
    """
    open_rows = rows.where(~F.col(selected))
    if whole or current_k <= 0:
        return open_rows
    return first_rows(open_rows, keys, key, int(current_k))


def lga_admission(admitted: DataFrame, keys: Sequence[str], s: Column, n_selected: int, mean_selected: float) -> DataFrame:
    """Score of admitting each class: `(keys..., rows, lga_score)`."""
    sums = admitted.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(s).alias("_s"))
    score = (F.col("_s") - F.col("rows") * F.lit(mean_selected)) / (F.col("rows") + F.lit(n_selected))
    return sums.select(*keys, "rows", score.alias("lga_score"))


def lga_removal(rows: DataFrame, keys: Sequence[str], s: Column) -> DataFrame:
    """Score of removing each class, with the sign of the removal search: `(keys..., rows, fast_utility_score)`.

    The whole table scores 0: nothing would be left.
    """
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(s).alias("_s"))
    total = sums.agg(F.sum("rows").alias("_n"), F.sum("_s").alias("_all"))
    both = sums.join(F.broadcast(total))
    gain = (F.col("rows") * F.col("_all") / F.col("_n") - F.col("_s")) / (F.col("_n") - F.col("rows"))
    score = F.when(F.col("rows") < F.col("_n"), -gain).otherwise(F.lit(0.0))
    return both.select(*keys, "rows", score.alias("fast_utility_score"))


def lga_changes(rows: DataFrame, pairs: Mapping[str, tuple[Column, Column]]) -> dict[str, float]:
    """`mean(s_next - s_cur)` for several changes in one aggregation."""
    if not pairs:
        return {}
    one = rows.agg(*[F.avg(nxt - cur).alias(name) for name, (cur, nxt) in pairs.items()]).first()
    return {name: float(one[name] or 0.0) for name in pairs}


def vertical_candidates(levels: Mapping[str, int]) -> dict[str, dict[str, int]]:
    """One QI one level finer, for every QI above level 0."""
    return {a: {**levels, a: int(v) - 1} for a, v in levels.items() if int(v) > 0}


def reference_filter(classes: DataFrame, rows: DataFrame, keys: Sequence[str], label: str, proxy: str, estimator: str) -> DataFrame:
    """Classes holding a row that the proxy gets right and the estimator gets wrong."""
    hits = rows.where((F.col(proxy) == F.col(label)) & (F.col(estimator) != F.col(label)))
    qualified = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hits"))
    return attach(classes, qualified, keys, "_hits", how="inner").drop("_hits")


def top_k_per_type(candidates: DataFrame, k: int, score: str = "rank_score", ties: Sequence[str] = ("candidate_id",)) -> DataFrame:
    """The k best candidates of each type; ties by position.

    Ranked within hashed shares of a type first, so that no type is ever sorted whole: the second rank sees at most
    `SHARES * k` rows of a type. The number of types is free.
    """
    order = [F.desc(score), *ties]
    out = candidates.withColumn("_share", F.pmod(F.xxhash64(*ties), F.lit(SHARES)))
    for group in (["candidate_type", "_share"], ["candidate_type"]):
        out = out.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= int(k))
    return out.select(*candidates.columns)


def random_shortlist(candidates: DataFrame, seed: int, iteration: int) -> DataFrame:
    """One candidate drawn uniformly from all types: the smallest seeded key."""
    key = seeded_key(seed, F.lit(iteration), F.col("candidate_type"), F.col("candidate_id"))
    return candidates.orderBy(key).limit(1)


def random_score(seed: int, iteration: Column, kind: Column, candidate: Column) -> Column:
    """Score in [0, 1) fixed by seed, iteration, type and id."""
    return unit_interval(seeded_key(seed, iteration, kind, candidate))


def next_k(classes: DataFrame, keys: Sequence[str], count: str, admitted: str) -> DataFrame:
    """Min-K after admitting each class: `(keys..., next_k)`.

    `count` is the class's published rows, `admitted` what it would add. The minimum over the other
    classes needs only the two smallest ones, which are two rows.
    """
    positive = classes.where(F.col(count) > 0)
    two = [r[0] for r in positive.orderBy(count).limit(2).select(count).collect()]
    least = F.lit(two[0] if two else None).cast("bigint")
    second = F.lit(two[1] if len(two) > 1 else None).cast("bigint")
    own = F.col(count) + F.col(admitted)
    # A class at the minimum leaves the minimum of the others; equal minima leave it as it is.
    others = F.when(F.col(count) == least, second).otherwise(least)
    mine = F.when(own > 0, own)
    return classes.select(*keys, F.coalesce(F.least(others, mine), F.lit(0)).cast("bigint").alias("next_k"))


def argmax_candidate(candidates: DataFrame, score: str = "score", position: str = "position") -> DataFrame:
    """The best candidate; the first one wins ties. One row, by a mergeable aggregate."""
    row = F.struct(*candidates.columns)
    return candidates.agg(F.max_by(row, F.struct(F.col(score), -F.col(position))).alias("_r")).select("_r.*")


def evaluation_pool(candidates: DataFrame, scores: Sequence[str], n: int, ids: Sequence[str] = ("candidate_type", "candidate_id")) -> DataFrame:
    """Union of the top n of several scores; each top n is a bounded sort."""
    out = None
    for s in scores:
        best = candidates.orderBy(F.desc(s), *ids).limit(int(n)).select(*ids)
        out = best if out is None else out.unionByName(best)
    return candidates.join(F.broadcast(out.distinct()), list(ids), "left_semi")


def extra_swap_in(classes: DataFrame, keys: Sequence[str], n_selected: int, size: str = "n_open") -> DataFrame:
    """The largest unselected class, if larger than the number of selected rows: 0 or 1 row.

    Its first `n_selected` unselected rows move in.
    """
    return classes.where(F.col(size) > int(n_selected)).orderBy(F.desc(size), *keys).limit(1)


# ---- swap -----------------------------------------------------------------------------------

class SwapClass:
    """Two groups of one class: the rows selected at the start, and the rows open at the start.

    Every exchange moves whole groups, so two flags describe any state the class can reach.
    """

    __slots__ = ("count", "order", "first", "selected")

    def __init__(self, n_selected: int, order: tuple, first_selected: str, n_open: int, first_open: str):
        self.count = [n_selected, n_open]
        self.order = [order, None]
        self.first = [first_selected, first_open]
        self.selected = [True, False]

    def groups(self, selected: bool) -> list[int]:
        return [g for g in (0, 1) if self.count[g] and self.selected[g] == selected]

    def small_key(self):
        """`(selected rows, first selection order)`, or None without selected rows."""
        mine = self.groups(True)
        return (sum(self.count[g] for g in mine), min(self.order[g] for g in mine)) if mine else None

    def large_key(self):
        """`(-open rows, first open position)`, or None without open rows."""
        mine = self.groups(False)
        return (-sum(self.count[g] for g in mine), min(self.first[g] for g in mine)) if mine else None


class _Frontier:
    """Smallest entry among untouched classes of a sorted stream and touched ones in a heap."""

    def __init__(self, stream: Iterator[tuple], touched: dict, key: str):
        self.stream, self.touched, self.key = stream, touched, key
        self.heap: list = []
        self.head = None

    def push(self, cls: tuple) -> None:
        value = getattr(self.touched[cls], self.key)()
        if value is not None:
            heapq.heappush(self.heap, (value, cls))

    def top(self):
        """`(key, class, SwapClass)` of the first live entry, or None."""
        while self.heap and getattr(self.touched[self.heap[0][1]], self.key)() != self.heap[0][0]:
            heapq.heappop(self.heap)
        while self.head is None or self.head[0] in self.touched or getattr(self.head[1], self.key)() is None:
            self.head = next(self.stream, None)
            if self.head is None:
                break
        best = (*self.heap[0], self.touched[self.heap[0][1]]) if self.heap else None
        if self.head is not None:
            fresh = (getattr(self.head[1], self.key)(), *self.head)
            if best is None or fresh[:2] < best[:2]:
                return fresh
        return best


@dataclass(frozen=True)
class OpenRound:
    """A round that the limit interrupted: its class and size, the groups coming in, and the rows dropped so far."""

    cls: tuple
    size: int
    entering: list[int]
    dropped: int


@dataclass(frozen=True)
class SwapResult:
    """What a swap did; `rounds` counts finished rounds.

    `moves`: (class, starting rows stay selected, open rows become selected, round of the last move-in).
    `table`: the same as columns, where the driver does not hold all moves. `touched`: the states behind `moves`.
    """

    moves: list[tuple]
    rounds: int
    moved_out: int
    moved_in: int
    reason: str
    table: DataFrame | None = None
    touched: Mapping[tuple, SwapClass] | None = None
    interrupted: OpenRound | None = None


def swap(small: Iterator[tuple], large: Iterator[tuple], n_selected: int, n_rows: int,
         next_batch: int = 1, max_rounds: int | None = None, limit: int | None = None) -> SwapResult:
    """Exchange small selected classes for large unselected ones.

    Both streams yield `(class, SwapClass)`: `small` by `(selected rows, first order)`, `large` by
    `(-open rows, first position)`. Each round takes the largest open class (size b) and drops the
    smallest selected classes while their sum stays within b; it ends when the smallest selected
    class is not smaller than b, or after `max_rounds` if that is given. The streams are read only as far as the rounds reach.
    With a `limit` it stops once that many classes are touched, in the middle of a round if need be (`interrupted`).
    """
    touched: dict = {}
    least = _Frontier(iter(small), touched, "small_key")
    most = _Frontier(iter(large), touched, "large_key")
    last_in: dict = {}
    rounds = moved_out = moved_in = 0
    interrupted = None

    def full() -> bool:
        return limit is not None and len(touched) >= limit

    reason = "max_rounds"
    while max_rounds is None or rounds < max_rounds:
        if full():
            reason = LIMIT_REACHED
            break
        if n_selected >= n_rows:
            reason = "no_candidates"
            break
        if n_selected == 0:
            reason = "no_selected_groups"
            break
        lowest, highest = least.top(), most.top()
        if lowest is None:
            reason = "no_swappable_selected_groups"
            break
        if highest is None:
            reason = "no_candidate_groups"
            break
        b = -highest[0][0]
        if lowest[0][0] >= b:
            reason = "converged"
            break
        incoming = highest[1]
        if incoming not in touched:
            touched[incoming] = highest[2]
            # It leaves both streams, and may be among the smallest selected ones itself.
            least.push(incoming)
        # The rows that come in are those open before anything moves out.
        entering = touched[incoming].groups(False)
        dropped, total = [], 0
        while True:
            entry = least.top()
            if entry is None or total + entry[0][0] > b:
                break
            if full():
                interrupted = OpenRound(incoming, b, entering, total)
                break
            state = touched.setdefault(entry[1], entry[2])
            for g in state.groups(True):
                state.selected[g] = False
            dropped.append(entry[1])
            total += entry[0][0]
        if interrupted:
            moved_out += total
            reason = LIMIT_REACHED
            break
        state = touched[incoming]
        for g in entering:
            state.selected[g] = True
            state.order[g] = (next_batch + rounds, "")
        last_in[incoming] = next_batch + rounds
        for cls in {*dropped, incoming}:
            least.push(cls)
            most.push(cls)
        moved_out += total
        moved_in += b
        n_selected += b - total
        rounds += 1
    moves = [(cls, st.selected[0], st.selected[1], last_in.get(cls)) for cls, st in sorted(touched.items())]
    return SwapResult(moves, rounds, moved_out, moved_in, reason, touched=touched, interrupted=interrupted)


def swap_table(rows: DataFrame, keys: Sequence[str], key: str = "_key", selected: str = "selected",
               exempt: str = "exempt", batch: str = "batch") -> DataFrame:
    """Per class: movable, exempt and open row counts with their first order and position."""
    movable, free = F.col(selected) & ~F.col(exempt), ~F.col(selected)
    return rows.groupBy(*keys).agg(
        F.sum(F.when(movable, 1).otherwise(0)).alias("n_selected"),
        F.sum(F.when(F.col(selected) & F.col(exempt), 1).otherwise(0)).alias("n_exempt"),
        F.sum(F.when(free, 1).otherwise(0)).alias("n_open"),
        F.min(F.when(movable, F.struct(F.col(batch).alias("batch"), F.col(key).alias("key")))).alias("first_order"),
        F.min(F.when(movable, F.col(key))).alias("first_selected"),
        F.min(F.when(free, F.col(key))).alias("first_open"))


def _sortable(values) -> tuple:
    """A class key whose parts compare even when NULL: NULL sorts first, as in Spark."""
    return tuple((v is not None, v if v is not None else 0) for v in values)


def _plain(cls: tuple) -> tuple:
    return tuple(v if known else None for known, v in cls)


def _swap_state(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both groups of every class at the start: rows, order and first position, and whether they are selected."""
    order = table.schema["first_order"].dataType
    return table.select(
        *keys, F.col("n_selected").alias("_c0"), F.col("n_open").alias("_c1"),
        F.col("first_order").alias("_o0"), F.lit(None).cast(order).alias("_o1"),
        F.col("first_selected").alias("_p0"), F.col("first_open").alias("_p1"),
        F.lit(True).alias("keep"), F.lit(False).alias("take"), F.lit(None).cast("int").alias("round"), F.lit(False).alias("_touched"))


def _selected_classes(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Classes with selected movable rows: `_size`, and `_o` as the order in which they are dropped."""
    mine = [F.col("keep") & (F.col("_c0") > 0), F.col("take") & (F.col("_c1") > 0)]
    first = F.least(F.when(mine[0], F.col("_o0")), F.when(mine[1], F.col("_o1")))
    size = F.when(mine[0], F.col("_c0")).otherwise(0) + F.when(mine[1], F.col("_c1")).otherwise(0)
    sized = state.withColumns({"_size": size, "_first": first})
    return sized.withColumn("_o", F.struct("_size", F.col("_first.batch").alias("_batch"), F.col("_first.key").alias("_key"), *keys)).drop("_first")


def _open_classes(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Classes with open rows, and `_o` as the order in which they come in."""
    free = [~F.col("keep") & (F.col("_c0") > 0), ~F.col("take") & (F.col("_c1") > 0)]
    first = F.least(F.when(free[0], F.col("_p0")), F.when(free[1], F.col("_p1")))
    size = F.when(free[0], F.col("_c0")).otherwise(0) + F.when(free[1], F.col("_c1")).otherwise(0)
    sized = state.withColumn("_size", size)
    return sized.withColumn("_o", F.struct((-F.col("_size")).alias("_rank"), first.alias("_first"), *keys))


def _bound(table: DataFrame, values: Sequence) -> Column:
    """Values of `_o` as a literal of its type."""
    return F.struct(*[F.lit(v).cast(f.dataType) for v, f in zip(values, table.schema["_o"].dataType.fields)])


def _pages(ordered: DataFrame, keys: Sequence[str], page: int) -> Iterator[tuple]:
    """Classes of a positive `_size` by `_o`, one bounded sort of `page` rows at a time, resumed after the last key."""
    last = None
    while True:
        part = ordered.where(F.col("_size") > 0)
        if last is not None:
            part = part.where(F.col("_o") > _bound(ordered, last))
        rows = part.orderBy("_o").limit(page).collect()
        for r in rows:
            cls = SwapClass(r["_c0"], None, r["_p0"], r["_c1"], r["_p1"])
            cls.order = [tuple(o) if o else None for o in (r["_o0"], r["_o1"])]
            cls.selected = [r["keep"], r["take"]]
            yield _sortable(r[k] for k in keys), cls
        if len(rows) < page:
            return
        last = list(rows[-1]["_o"])


def _write_back(state: DataFrame, keys: Sequence[str], result: SwapResult) -> DataFrame:
    """The class state with the touched classes of one pass put in; they are at most `limit` and one, so they are broadcast."""
    kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"_new struct<keep: boolean, take: boolean, o0: {kinds['_o0']}, o1: {kinds['_o1']}, round: int>"])
    rows = [(*_plain(cls), (keep, take, *result.touched[cls].order, rnd)) for cls, keep, take, rnd in result.moves]
    delta = state.sparkSession.createDataFrame(rows, schema)
    named = delta.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_new")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    new = F.col("_new").isNotNull()
    return state.join(F.broadcast(named), on, "left").withColumns({
        "keep": F.when(new, F.col("_new.keep")).otherwise(F.col("keep")),
        "take": F.when(new, F.col("_new.take")).otherwise(F.col("take")),
        "_o0": F.when(new, F.col("_new.o0")).otherwise(F.col("_o0")),
        "_o1": F.when(new, F.col("_new.o1")).otherwise(F.col("_o1")),
        "round": F.coalesce("_new.round", "round"),
        "_touched": F.col("_touched") | new}).select(*state.columns)


def _finish_round(state: DataFrame, keys: Sequence[str], cut: OpenRound, number: int) -> tuple[DataFrame, int]:
    """The rest of an interrupted round, and the rows it drops.

    Running sums over the range-partitioned order find the last class that fits. Only that
    watermark reaches the driver; the round is then a projection of the state.
    """
    ordered = _selected_classes(state, keys)
    classes = ordered.where(F.col("_size") > 0).select("_o", "_size")
    fits = running_sums(classes, [], "_o", ["_size"], classes.count()).where(F.col("_size_upto") <= cut.size - cut.dropped)
    last = fits.agg(F.max("_o").alias("o"), F.coalesce(F.sum("_size"), F.lit(0)).alias("n")).first()
    leaves = F.lit(False) if last["o"] is None else (F.col("_size") > 0) & (F.col("_o") <= _bound(ordered, list(last["o"])))
    comes = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v).cast(state.schema[k].dataType)) for k, v in zip(keys, _plain(cut.cls))])
    order = F.struct(F.lit(number).alias("batch"), F.lit("").alias("key")).cast(state.schema["_o0"].dataType)
    made = {"round": F.when(comes, F.lit(number)).otherwise(F.col("round")), "_touched": F.col("_touched") | leaves | comes}
    for g, flag in enumerate(("keep", "take")):
        enters = comes if g in cut.entering else F.lit(False)
        made[flag] = F.when(enters, True).when(leaves, False).otherwise(F.col(flag))
        made[f"_o{g}"] = F.when(enters, order).otherwise(F.col(f"_o{g}"))
    return ordered.withColumns(made).select(*state.columns), last["n"]


def swap_classes(table: DataFrame, keys: Sequence[str], next_batch: int, max_rounds: int | None = None, page: int = PAGE,
                 limit: int = TOUCHED) -> SwapResult:
    """`swap` over a written class table, with at most `limit` touched classes and two pages on the driver.

    Once that many are touched, their state is written into the class table and the swap goes on
    from there. A round that drops more classes than that is ended by running sums. The result is
    the same for every `page` and `limit`.
    """
    one = table.agg(F.sum(F.col("n_selected") + F.col("n_exempt")).alias("s"),
                    F.sum(F.col("n_selected") + F.col("n_exempt") + F.col("n_open")).alias("n")).first()
    n_selected, n_rows = one["s"] or 0, one["n"] or 0
    scratch = Scratch(table.sparkSession, "swap-state")
    state, stored = _swap_state(table, keys), None
    rounds = moved_out = moved_in = 0
    while True:
        left = None if max_rounds is None else max_rounds - rounds
        part = swap(_pages(_selected_classes(state, keys), keys, page), _pages(_open_classes(state, keys), keys, page),
                    n_selected, n_rows, next_batch + rounds, left, limit)
        rounds, moved_out, moved_in = rounds + part.rounds, moved_out + part.moved_out, moved_in + part.moved_in
        n_selected += part.moved_in - part.moved_out
        if stored is None and part.reason != LIMIT_REACHED:
            # One pass was enough: its moves are the result.
            return part
        if part.moves:
            state = stored = scratch.replace(stored, _write_back(state, keys, part))
        if part.interrupted:
            finished, dropped = _finish_round(state, keys, part.interrupted, next_batch + rounds)
            state = stored = scratch.replace(stored, finished)
            rounds, moved_out, moved_in = rounds + 1, moved_out + dropped, moved_in + part.interrupted.size
            n_selected += part.interrupted.size - dropped
        if part.reason != LIMIT_REACHED:
            moves = state.where("_touched").select(*keys, "keep", "take", "round")
            return SwapResult([], rounds, moved_out, moved_in, part.reason, table=moves)


def moves_table(spark, keys: Sequence[str], kinds: Sequence[str], result: SwapResult) -> DataFrame:
    """The swap's moves as a table on the class keys."""
    if result.table is not None:
        return result.table
    schema = ", ".join([f"`{k}` {t}" for k, t in zip(keys, kinds)] + ["keep boolean", "take boolean", "round int"])
    return spark.createDataFrame([(*_plain(cls), keep, take, rnd) for cls, keep, take, rnd in result.moves], schema)


def apply_moves(rows: DataFrame, table: DataFrame, moves: DataFrame, keys: Sequence[str], selected: str = "selected",
                exempt: str = "exempt", batch: str = "batch") -> DataFrame:
    """Rows after a swap: exempt rows stay, movable rows keep or leave, open rows stay or come in."""
    sizes = table.select(*keys, (F.col("n_selected") + F.col("n_open")).alias("_rows"))
    sized = attach(moves, sizes, keys, "_rows")
    marked = attach(rows, sized, keys, "_rows")
    movable, free = F.col(selected) & ~F.col(exempt), ~F.col(selected)
    enters = free & F.coalesce("take", F.lit(False))
    return (marked.withColumns({
        selected: F.when(movable, F.coalesce("keep", F.lit(True))).when(free, F.coalesce("take", F.lit(False))).otherwise(F.col(selected)),
        batch: F.when(enters, F.col("round")).otherwise(F.col(batch)),
    }).drop("keep", "take", "round", "_rows"))
