"""The greedy minimization loop: rank, certify on a release, commit, enumerate again.

The driver holds the level history, at most `rank_top_k` candidates per type and the model
parameters. Rows live in one written state table; every iteration reads it a fixed number of times
and writes it once.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minim.functions.ordering import seeded_key
from minim.operators import candidates as G
from minim.operators.classes import k_distribution_from_histogram, size_histogram
from minim.operators.hierarchy import Forest, ensure_leaves, leaf_name, max_levels
from minim.operators.keyed import attach
from minim.operators.models import FeatureSpace, Linear, fit_logistic_reporting, influence_scalar, mean_gradient
from minim.operators.release import (
    Release, Snapshot, close_classes, evict_low_k, leaf_cells, materialize_release, merge_exempt, node_columns, published_classes, route_eval,
)
from minim.operators.sampling import label_covering_sample
from minim.session import Scratch
from minim.sources.files import write_rows

ADMIT, REFINE = "retention_class", "vertical_refinement"
FULL_SWAP, EVICT, NONE = "full_swap", "evict_low_k", "none"
MAX_RANKED = 100_000
POLICIES = ("ratio", "privacy", "utility", "influence")


@dataclass(frozen=True)
class MinimizeOptions:
    """Switches of the search."""

    actions: tuple[str, ...] = (ADMIT, REFINE)
    start: str = "sample"                # "sample" (S0) or "all_rows"
    postprocessing: str = FULL_SWAP
    evict_threshold: int = 2
    tolerance: float = 0.01
    max_iterations: int = 30
    rank_top_k: int = 3
    sample_size: int | None = None
    sample_fraction: float | None = 0.01
    target_k: int | None = None
    stop_on_utility: bool = True
    reference_filtering: bool = False
    policy: str = "ratio"
    # None: the swap of a refinement runs until it has converged.
    max_swap_rounds: int | None = None
    # Where each iteration appends its certified candidates, if given: a run that breaks off leaves its log.
    log_path: str | None = None
    seed: int = 42
    extras: tuple[str, ...] = ()
    # Steps of a proxy fit; the log says where they did not suffice.
    max_fit_iterations: int = 300
    # Optional callbacks: choose positions from ranked candidates, and score a certified one.
    shortlist: Callable[[list[dict]], Sequence[int]] | None = None
    score: Callable[[dict], float] | None = None

    def __post_init__(self):
        if not set(self.actions) <= {ADMIT, REFINE} or not self.actions:
            raise ValueError("unknown or empty action set")
        if self.start not in ("sample", "all_rows") or self.postprocessing not in (FULL_SWAP, EVICT, NONE):
            raise ValueError("unknown start state or post-processing")
        if self.policy not in POLICIES:
            raise ValueError(f"unknown score policy {self.policy!r}; known: {POLICIES}")
        if self.policy == "influence" and self.score is None:
            raise ValueError("the influence policy needs a `score` callback with the influence of a candidate")


@dataclass
class MinimizeResult:
    history: list[Snapshot]
    iterations: list[dict]
    candidates: list[dict]
    termination: str
    baseline_loss: float
    release: Release | None
    state: DataFrame
    test_loss: float | None = None
    extra: dict = field(default_factory=dict)


def weighted_log_loss(rows: DataFrame, p: Sequence[Column], label: str, weight: str = "n") -> float:
    """Clipped log loss of weighted rows; p holds one column for two classes, else one per class."""
    low = F.lit(1e-15)
    if len(p) == 1:
        q = F.least(F.greatest(p[0], F.lit(2.220446049250313e-16)), F.lit(1 - 2.220446049250313e-16))
        each = -F.when(F.col(label) == 1, F.log(q)).otherwise(F.log(1 - q))
    else:
        chosen = p[0]
        for c, col in enumerate(p):
            chosen = F.when(F.col(label) == c, col).otherwise(chosen)
        each = -F.log(F.greatest(chosen, low))
    return float(rows.agg((F.sum(each * F.col(weight)) / F.sum(weight)).alias("l")).first()["l"])


class Search:
    """Shared pieces of one run: cells, baseline, certification with a cache."""

    def __init__(self, train: DataFrame, val: DataFrame, test: DataFrame | None, forest: Forest, label: str, options: MinimizeOptions):
        self.forest, self.label, self.options = forest, label, options
        self.spark = train.sparkSession
        self.scratch = Scratch(self.spark, "search")
        self.leaves = [leaf_name(a) for a in forest]
        self.train = ensure_leaves(train, forest)
        self.cells = self._cells(train)
        self.val = self._cells(val)
        self.test = None if test is None else self._cells(test)
        # Distinct leaf combinations of the training rows: what releases are decided on.
        self.train_leaves = self.scratch.save(self.cells.groupBy(*self.leaves).agg(F.sum("n").alias("n")))
        self.space = FeatureSpace(forest, options.extras).fit(self.cells, "n")
        labels = self.cells.groupBy(label).agg(F.sum("n").alias("n")).limit(1001).collect()
        if len(labels) > 1000:
            raise ValueError("more than 1000 labels")
        values = sorted(r[label] for r in labels)
        if values != list(range(len(values))):
            raise ValueError("labels must be 0..C-1")
        self.classes = len(values)
        self.certified: dict = {}

    def _cells(self, rows: DataFrame) -> DataFrame:
        """Rows with equal leaves, label and other features as one weighted row."""
        out = ensure_leaves(rows, self.forest)
        return self.scratch.save(out.groupBy(*self.leaves, self.label, *self.options.extras).agg(F.count(F.lit(1)).alias("n")))

    def fit(self, weighted: DataFrame, snapshots: Sequence[Snapshot]) -> Linear:
        """Fit on weighted rows published by `snapshot`."""
        return self.fit_reporting(weighted, snapshots)[0]

    def fit_reporting(self, weighted: DataFrame, snapshots: Sequence[Snapshot]) -> tuple[Linear, bool]:
        """`fit`, and whether the step limit came before the tolerance."""
        made = self.space.vectors(weighted.withColumn("_weight", F.col("n").cast("double")), snapshots)
        return fit_logistic_reporting(made, self.label, "features", "_weight", self.classes, self.options.max_fit_iterations)

    def loss(self, model: Linear, weighted: DataFrame, snapshots: Sequence[Snapshot]) -> float:
        logits = [self.space.dot_released(w, snapshots) + F.lit(b) for w, b in zip(model.weights, model.intercepts)]
        return weighted_log_loss(weighted, model.probabilities(logits), self.label)

    def baseline(self, target: DataFrame) -> float:
        """Loss of a model on the ungeneralized training rows."""
        raw = [Snapshot(0, dict.fromkeys(self.forest, 0))]
        model = self.fit(self.cells.withColumn("snapshot", F.lit(0)), raw)
        return self.loss(model, target.withColumn("snapshot", F.lit(0)), raw)

    def certify(self, history: Sequence[Snapshot], target_k: int, target: DataFrame | None = None) -> dict | None:
        """Release of a level history at a target size, its proxy model and its validation loss.

        Results are kept by (levels, target): two candidates with the same published min-K share
        one release, because the release starts from all training rows.
        """
        target = self.val if target is None else target
        key = (tuple((s.iteration, tuple(sorted(s.levels.items()))) for s in history), target_k, target is self.val)
        if key in self.certified:
            return self.certified[key]
        result = None
        if target_k >= 1:
            release = materialize_release(self.train_leaves, self.forest, history, target_k, self.scratch)
            released = attach(self.cells.withColumnRenamed("n", "_n"), release.cells, self.leaves, "n").drop("n")
            released = released.withColumnRenamed("_n", "n").where(F.col("snapshot").isNotNull())
            totals = released.agg(F.sum("n").alias("rows"), F.count_distinct(self.label).alias("labels")).first()
            if totals["rows"] and totals["labels"] == self.classes:
                model, limit_reached = self.fit_reporting(released, release.snapshots)
                routed = route_eval(target.withColumnRenamed("n", "_n"), self.forest, release).drop("routed")
                loss = self.loss(model, routed.withColumnRenamed("_n", "n"), release.snapshots)
                result = {"release": release, "model": model, "loss": loss, "rows": totals["rows"], "target_k": target_k, "limit_reached": limit_reached}
        self.certified[key] = result
        return result


def class_rows(state: DataFrame, forest: Forest, levels: Mapping[str, int]) -> tuple[DataFrame, list[str]]:
    """State rows with the class keys of a level vector."""
    keys = [f"{a}__node" for a in forest]
    return state.select("*", *[c.alias(k) for c, k in zip(node_columns(forest, levels), keys)]), keys


def published_min_k(table: DataFrame) -> int:
    """Smallest published class: movable selected rows plus the exempt rows of their class."""
    row = table.where(F.col("n_selected") > 0).agg(F.min(F.col("n_selected") + F.col("n_exempt")).alias("k")).first()
    return row["k"] or 0


def movable_min_k(table: DataFrame) -> int:
    return table.where(F.col("n_selected") > 0).agg(F.min("n_selected").alias("k")).first()["k"] or 0


def refine(search: Search, state: DataFrame, levels: Mapping[str, int], batch: int) -> tuple[DataFrame, DataFrame, dict]:
    """State after a refinement and its post-processing: `(state, class table, statistics)`."""
    options, forest = search.options, search.forest
    rows, keys = class_rows(state, forest, levels)
    if options.postprocessing == NONE:
        return state, search.scratch.save(G.swap_table(rows, keys)), {"moved_out": 0, "moved_in": 0, "reason": "postprocessing_disabled"}
    if options.postprocessing == EVICT:
        kept = search.scratch.save(evict_low_k(rows, keys, options.evict_threshold))
        table = search.scratch.save(G.swap_table(kept, keys))
        return kept.drop(*keys), table, {"moved_out": 0, "moved_in": 0, "reason": "low_k_groups_evicted"}
    table = search.scratch.save(G.swap_table(rows, keys))
    before = table.agg(F.sum(F.col("n_selected") + F.col("n_exempt")).alias("n")).first()["n"] or 0
    result = G.swap_classes(table, keys, batch, options.max_swap_rounds)
    stats = {"moved_out": result.moved_out, "moved_in": result.moved_in, "reason": result.reason, "rounds": result.rounds}
    if result.rounds:
        kinds = [rows.schema[k].dataType.simpleString() for k in keys]
        rows = search.scratch.save(G.apply_moves(rows, table, G.moves_table(search.spark, keys, kinds, result), keys))
        table = search.scratch.save(G.swap_table(rows, keys))
    extra = G.extra_swap_in(table, keys, before).select(*keys, F.col("n_open").alias("_open")) if before else None
    if extra is not None and not extra.isEmpty():
        opened = attach(rows.where(~F.col("selected")), extra, keys, "_open", how="inner").drop("_open")
        moved = G.first_rows(opened, keys, "_key", before).select("row_id", F.lit(True).alias("_moved"))
        rows = rows.join(moved, "row_id", "left").withColumns({
            "selected": F.col("selected") | F.col("_moved").isNotNull(),
            "batch": F.when(F.col("_moved").isNotNull(), F.lit(batch + result.rounds)).otherwise(F.col("batch")),
        }).drop("_moved")
        rows = search.scratch.save(rows)
        table = search.scratch.save(G.swap_table(rows, keys))
        stats["extra_in"] = int(before)
    return rows.drop(*keys), table, stats


def minimize(
    train: DataFrame, val: DataFrame, forest: Forest, label: str, options: MinimizeOptions = MinimizeOptions(),
    test: DataFrame | None = None, row_id: str = "row_id",
) -> MinimizeResult:
    """Grow a release from the coarsest levels until the proxy's validation loss is within tolerance.

    Each iteration scores all admissions (one class: its first min(size, K) open rows) and all
    refinements (one QI one level finer), certifies the best `rank_top_k` of each type on a real
    release, and commits the best score among those that lower the loss.
    """
    search = Search(train, val, test, forest, label, options)
    baseline = search.baseline(search.val)
    threshold = baseline + options.tolerance
    levels = max_levels(forest)
    keyed = search.train.select(F.col(row_id).alias("row_id"), label, *options.extras, *search.leaves,
                                seeded_key(options.seed, row_id).alias("_key"))
    keyed = search.scratch.save(keyed)
    total = keyed.count()
    size = options.sample_size or max(1, int(total * (options.sample_fraction or 0)))
    size = max(size, search.classes)
    s0 = label_covering_sample(keyed, label, size, options.seed).select("row_id", F.lit(True).alias("exempt"))
    state = search.scratch.save(
        keyed.join(s0, "row_id", "left")
        .withColumn("exempt", F.coalesce("exempt", F.lit(False)))
        .withColumn("selected", F.lit(True) if options.start == "all_rows" else F.col("exempt"))
        .withColumn("published", F.col("selected") & ~F.col("exempt"))
        .withColumn("batch", F.lit(0)))
    history = [Snapshot(-1, dict(levels))]
    log: list[dict] = []
    iterations: list[dict] = []
    batch = 1
    estimator = _estimator(search, state, history[-1])
    proxy = estimator
    loss = _level_loss(search, proxy, search.val, levels)
    termination, last = None, None
    while last is None or not options.stop_on_utility or loss > threshold:
        if len(iterations) >= options.max_iterations:
            termination = "max_iterations_reached"
            break
        started = time.time()
        chosen = _step(search, state, history, levels, estimator, proxy, loss, len(iterations), batch)
        log += chosen["log"]
        if options.log_path and chosen["log"]:
            write_rows(candidate_rows(search.spark, chosen["log"]), options.log_path, append=True)
        if chosen["best"] is None:
            termination = "no_action_available"
            break
        best = chosen["best"]
        levels, state, loss, proxy = best["levels"], best["commit"](), best["loss"], best["certified"]["model"]
        history.append(Snapshot(len(iterations), dict(levels)))
        # Rounds of the committed swap and one extra move have taken numbers from `batch` on.
        batch += best["rounds"] + 2
        estimator = _estimator(search, state, history[-1])
        last = best["certified"]
        iterations.append({
            "iteration": len(iterations), "action": best["action"], "candidate": best["candidate"],
            "levels": dict(levels), "target_k": last["target_k"], "row_count": last["rows"],
            "suppressed_row_count": total - last["rows"], "coverage_fraction": last["rows"] / total,
            "validation_loss": loss, "delta_u": loss - baseline, "utility_constraint_met": loss <= threshold,
            "seconds": time.time() - started})
    if termination is None:
        termination = "loss_threshold_met"
    rows, keys = class_rows(state, forest, levels)
    closed = merge_exempt(close_classes(rows, keys), keys)
    final = search.scratch.save(closed.withColumn("selected", F.when(F.col("exempt"), F.col("retained")).otherwise(F.col("selected"))).drop(*keys))
    result = MinimizeResult(history, iterations, log, termination, baseline, last["release"] if last else None, final)
    if last and search.test is not None:
        done = search.certify(history, last["target_k"], search.test)
        result.test_loss = done["loss"] if done else None
    return result


def _estimator(search: Search, state: DataFrame, snap: Snapshot) -> Linear:
    chosen = state.where(F.col("selected")).groupBy(*search.leaves, search.label, *search.options.extras).agg(F.count(F.lit(1)).alias("n"))
    return search.fit(chosen.withColumn("snapshot", F.lit(int(snap.iteration))), [snap])


def _level_loss(search: Search, model: Linear, target: DataFrame, levels: Mapping[str, int]) -> float:
    return search.loss(model, target.withColumn("snapshot", F.lit(0)), [Snapshot(0, levels)])


def _step(search, state, history, levels, model, proxy, loss, iteration, batch) -> dict:
    """Rank, certify and score the candidates of one iteration."""
    options, forest, label = search.options, search.forest, search.label
    rows, keys = class_rows(state, forest, levels)
    table = search.scratch.save(G.swap_table(rows, keys))
    current_k = movable_min_k(table)
    g = mean_gradient(search.val, search.space, model, levels, label, "n")
    s = influence_scalar(search.space, model, g, levels, label)
    ranked: list[dict] = []
    if ADMIT in options.actions:
        n, mean = G.selected_mean(rows, s)
        admitted = G.admission_rows(rows, keys, "_key", current_k)
        scored = G.lga_admission(admitted, keys, s, n, mean)
        if options.reference_filtering:
            scored = G.reference_filter(scored, _predicted(search, admitted, levels, model, proxy), keys, label, "_proxy", "_estimator")
        # Ties of equal scores go to the smaller class key. A shortlist callback sees every class,
        # up to a bound on what the driver holds; beyond it the run is refused, not cut.
        limit = options.rank_top_k if options.shortlist is None else MAX_RANKED + 1
        found = scored.orderBy(F.desc("lga_score"), *keys).limit(limit).collect()
        if len(found) > MAX_RANKED:
            raise ValueError(f"more than {MAX_RANKED} candidates for a shortlist callback")
        for r in found:
            ranked.append({"action": ADMIT, "candidate": tuple(r[k] for k in keys), "rows": r["rows"], "rank_score": r["lga_score"]})
    if REFINE in options.actions:
        pairs, finer = {}, G.vertical_candidates(levels)
        for attr, nxt in finer.items():
            g_next = mean_gradient(search.val, search.space, model, nxt, label, "n")
            pairs[attr] = (influence_scalar(search.space, model, g_next, levels, label), influence_scalar(search.space, model, g_next, nxt, label))
        changes = G.lga_changes(rows.where(F.col("selected")), pairs)
        order = sorted(changes, key=lambda a: -changes[a])
        for attr in order if options.shortlist is not None else order[:options.rank_top_k]:
            ranked.append({"action": REFINE, "candidate": attr, "levels": finer[attr], "rank_score": changes[attr]})
    if options.shortlist is not None:
        ranked = [ranked[i] for i in options.shortlist(ranked)]
    best, log = None, []
    for cand in ranked:
        outcome = _certify(search, state, rows, keys, table, history, levels, cand, current_k, loss, iteration, batch)
        if outcome is None:
            continue
        log.append({k: v for k, v in outcome.items() if k not in ("commit", "certified")})
        if outcome["utility_gain"] > 0 and (best is None or outcome["score"] > best["score"]):
            best = outcome
    for entry in log:
        entry["selected"] = best is not None and entry["candidate"] == best["candidate"] and entry["action"] == best["action"]
    return {"best": best, "log": log}


def _predicted(search, rows, levels, model, proxy) -> DataFrame:
    """Rows with the classes the proxy and the estimator predict."""
    def predicted(m: Linear) -> Column:
        p = m.probabilities([search.space.dot(w, levels) + F.lit(b) for w, b in zip(m.weights, m.intercepts)])
        if len(p) == 1:
            return F.when(p[0] >= 0.5, 1).otherwise(0)
        return F.array_position(F.array(*p), F.greatest(*p)) - 1
    return rows.select("*", predicted(proxy).alias("_proxy"), predicted(model).alias("_estimator"))


def _certify(search, state, rows, keys, table, history, levels, cand, current_k, loss, iteration, batch) -> dict | None:
    options, forest = search.options, search.forest
    if cand["action"] == ADMIT:
        here = F.lit(True)
        for k, v in zip(keys, cand["candidate"]):
            here = here & F.col(k).eqNullSafe(F.lit(v))
        after = table.withColumn("n_selected", F.col("n_selected") + F.when(here, F.lit(int(cand["rows"]))).otherwise(F.lit(0)))
        next_levels = dict(levels)
        next_k, published = movable_min_k(after), published_min_k(after)

        def commit() -> DataFrame:
            opened = rows.where(~F.col("selected") & here)
            moved = G.first_rows(opened, keys, "_key", int(cand["rows"])).select("row_id", F.lit(True).alias("_moved"))
            out = rows.drop(*keys).join(moved, "row_id", "left").withColumns({
                "selected": F.col("selected") | F.col("_moved").isNotNull(),
                "published": F.col("published") | (F.col("_moved").isNotNull() & ~F.col("exempt")),
                "batch": F.when(F.col("_moved").isNotNull(), F.lit(batch)).otherwise(F.col("batch"))}).drop("_moved")
            return search.scratch.save(out)
    else:
        next_levels = cand["levels"]
        moved_state, after, stats = refine(search, state, next_levels, batch)
        next_k, published = movable_min_k(after), published_min_k(after)
        cand = {**cand, **stats}

        def commit() -> DataFrame:
            # Rows that left are no longer published; rows that came in are, unless exempt.
            return search.scratch.save(moved_state.withColumn("published", F.col("selected") & ~F.col("exempt")))

    target = options.target_k if options.target_k is not None else published
    certified = search.certify([*history, Snapshot(iteration, next_levels)], int(target))
    if certified is None:
        return None
    gain = loss - certified["loss"]
    cost = math.log(max(current_k - next_k, 2))
    out = {"iteration": iteration, "action": cand["action"], "candidate": cand["candidate"], "rank_score": cand["rank_score"],
           "levels": next_levels, "loss": certified["loss"], "current_k": current_k, "next_k": next_k, "published_min_k": published,
           "target_k": certified["target_k"], "rounds": cand.get("rounds", 0), "row_count": certified["rows"], "utility_gain": gain, "privacy_cost": cost,
           "limit_reached": certified["limit_reached"],
           "certified": certified, "commit": commit}
    if options.score is not None:
        out["score"] = float(options.score(out))
        if not math.isfinite(out["score"]):
            raise ValueError("a score must be finite")
    else:
        out["score"] = {"ratio": gain / cost, "privacy": 1.0 / cost, "utility": gain}[options.policy]
    return out


def candidate_log(spark, result: MinimizeResult) -> DataFrame:
    """One row per certified candidate of a run."""
    return candidate_rows(spark, result.candidates)


def candidate_rows(spark, candidates: Sequence[dict]) -> DataFrame:
    rows = [(c["iteration"], c["action"], str(c["candidate"]), float(c["rank_score"]), int(c["current_k"]), int(c["next_k"]),
             int(c["published_min_k"]), int(c["target_k"]), int(c["row_count"]), float(c["loss"]), float(c["utility_gain"]),
             float(c["privacy_cost"]), float(c["score"]), bool(c["limit_reached"]), bool(c["selected"])) for c in candidates]
    return spark.createDataFrame(rows, "iteration int, action string, candidate string, rank_score double, current_k bigint, next_k bigint, "
                                       "published_min_k bigint, target_k bigint, row_count bigint, validation_loss double, utility_gain double, "
                                       "privacy_cost double, score double, limit_reached boolean, selected boolean")


def iteration_table(spark, result: MinimizeResult) -> DataFrame:
    """One row per committed iteration."""
    rows = [(i["iteration"], i["action"], str(i["candidate"]), {k: int(v) for k, v in i["levels"].items()}, int(i["target_k"]), int(i["row_count"]),
             int(i["suppressed_row_count"]), float(i["coverage_fraction"]), float(i["validation_loss"]), float(i["delta_u"]), bool(i["utility_constraint_met"]))
            for i in result.iterations]
    return spark.createDataFrame(rows, "iteration int, action string, candidate string, levels map<string,int>, target_k bigint, row_count bigint, "
                                       "suppressed_row_count bigint, coverage_fraction double, validation_loss double, delta_u double, utility_constraint_met boolean")


def release_distribution(release: Release, forest: Forest) -> DataFrame:
    return k_distribution_from_histogram(size_histogram(published_classes(release, forest)))


__all__ = ["MinimizeOptions", "MinimizeResult", "minimize", "candidate_log", "iteration_table", "leaf_cells"]
