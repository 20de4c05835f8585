"""Mixed-level releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from minim.checks import query
from minim.checks.classes import MID, MID_CTE, Q, rounded
from minim.checks.sampling import SPLIT_CTE
from minim.checks.tables import PEOPLE_LEVELS, QIS, SEED, people, people_forest
from minim.operators import release as R
from minim.operators.hierarchy import generalize
from minim.operators.sampling import stratified_split
from minim.session import Scratch
from minim.sources.releases import pick_release, release_points, save_release, load_release

SNAPSHOTS = (
    R.Snapshot(-1, {"nation": 2, "segment": 1, "priority": 2, "year": 2}),
    R.Snapshot(0, {"nation": 1, "segment": 1, "priority": 1, "year": 2}),
    R.Snapshot(1, {"nation": 1, "segment": 0, "priority": 1, "year": 1}),
    R.Snapshot(2, {"nation": 0, "segment": 0, "priority": 0, "year": 1}),
)
K = 12

# Level columns of each snapshot, newest first.
STEPS = (
    (2, "nation0", "segment0", "priority0", "year1"),
    (1, "nation1", "segment0", "priority1", "year1"),
    (0, "nation1", "segment1", "priority1", "year2"),
    (-1, "nation2", "segment1", "priority2", "year2"),
)


def release_cte(source: str = "gen") -> str:
    """One pair of CTEs per snapshot: group the remaining rows, keep groups of K, go on."""
    out, left = [], source
    for it, *cols in STEPS:
        name = f"s{it}" if it >= 0 else "last"
        out.append(f"{name} AS (SELECT *, {it} AS snapshot, {', '.join(f'{c} AS {q}_p' for c, q in zip(cols, QIS))} FROM "
                   f"(SELECT *, count(*) OVER (PARTITION BY {', '.join(cols)}) AS cnt FROM {left}) WHERE cnt >= {K})")
        out.append(f"left_{name} AS (SELECT {left}.* FROM {left} ANTI JOIN {name} USING (row_id))")
        left = f"left_{name}"
    names = [f"s{it}" if it >= 0 else "last" for it, *_ in STEPS]
    out.append("rel AS (" + " UNION ALL ".join(
        f"SELECT row_id, snapshot, {', '.join(f'{q}_p' for q in QIS)} FROM {n}" for n in names) + ")")
    out.append(f"suppressed AS (SELECT row_id FROM {left})")
    return ", ".join(out)


FULL = f"{PEOPLE_LEVELS}, {release_cte()}"
P = ", ".join(f"{q}_p AS {q}" for q in QIS)


def release(spark, sf_dir, rows=None):
    forest = people_forest()
    rows = people(spark, sf_dir) if rows is None else rows
    return R.materialize_release(R.leaf_cells(rows, forest), forest, SNAPSHOTS, K)


@query("materialize_release", f"WITH {FULL} SELECT row_id, snapshot, {P} FROM rel")
def materialize_release(spark, sf_dir):
    forest = people_forest()
    rel = release(spark, sf_dir)
    rows = R.release_rows(people(spark, sf_dir), forest, rel).where("snapshot IS NOT NULL")
    named = R.published_text(R.published_nodes(rows, forest, rel.snapshots), forest)
    return named.select("row_id", "snapshot", *QIS)


@query("suppressed_rows", f"""WITH {PEOPLE_LEVELS}, a AS (
  SELECT *, count(*) OVER (PARTITION BY nation0, segment0, priority0, year0) AS c FROM gen)
SELECT row_id FROM a WHERE c < 12""")
def suppressed_rows(spark, sf_dir):
    forest = people_forest()
    rel = R.materialize_release(R.leaf_cells(people(spark, sf_dir), forest), forest, [R.Snapshot(0, {})], K)
    return R.suppressed(R.release_rows(people(spark, sf_dir), forest, rel)).select("row_id")


@query("accepted_groups", f"WITH {FULL} SELECT snapshot, {P}, count(*) AS n FROM rel GROUP BY ALL")
def accepted_groups(spark, sf_dir):
    forest = people_forest()
    return R.published_text(R.accepted_groups(release(spark, sf_dir), forest), forest)


STATS = f"""SELECT CAST({K} AS BIGINT) AS target_k, (SELECT count(*) FROM rel) AS row_count, (SELECT count(*) FROM suppressed) AS suppressed_row_count,
 round((SELECT count(*) FROM rel) / (SELECT count(*) FROM pop), 9) AS coverage_fraction,
 (SELECT count(*) FROM suppressed) = 0 AS full_release, min(k) >= {K} AS privacy_constraint_met, min(k) AS min_k,
 round(quantile_cont(k, 0.01), 9) AS leak_k_p1, round(quantile_cont(k, 0.02), 9) AS leak_k_p2, round(quantile_cont(k, 0.03), 9) AS leak_k_p3,
 round(quantile_cont(k, 0.04), 9) AS leak_k_p4, round(quantile_cont(k, 0.05), 9) AS leak_k_p5, quantile_disc(k, 0.95) AS leak_k_95_percentile,
 (SELECT count(*) FROM cls) AS class_count, (SELECT count(*) FROM cls WHERE k = (SELECT min(k) FROM cls)) AS min_k_class_count FROM per"""


@query("release_stats", f"""WITH {FULL}, per AS (SELECT count(*) OVER (PARTITION BY nation_p, segment_p, priority_p, year_p) AS k FROM rel),
cls AS (SELECT count(*) AS k FROM rel GROUP BY nation_p, segment_p, priority_p, year_p) {STATS}""")
def release_stats(spark, sf_dir):
    return rounded(R.release_stats(release(spark, sf_dir), people_forest()))


@query("assignment_counts", f"""WITH {FULL} SELECT s.snapshot, count(rel.row_id) AS rows
FROM (SELECT unnest([-1, 0, 1, 2]) AS snapshot) s LEFT JOIN rel USING (snapshot) GROUP BY 1""")
def assignment_counts(spark, sf_dir):
    return R.assignment_counts(release(spark, sf_dir))


def split_rows(spark, sf_dir):
    return stratified_split(people(spark, sf_dir), "label", 0.15, 0.15, SEED)


def in_match(it, cols):
    conds = " AND ".join(f"rel.{q}_p IS NOT DISTINCT FROM e.{c}" for q, c in zip(QIS, cols))
    return f"EXISTS (SELECT 1 FROM rel WHERE rel.snapshot = {it} AND {conds})"


EVAL = f"""{PEOPLE_LEVELS}, {SPLIT_CTE}, train AS (SELECT gen.* FROM gen JOIN split USING (row_id) WHERE split = 'train'),
{release_cte('train')}, e AS (SELECT gen.* FROM gen JOIN split USING (row_id) WHERE split = 'val'),
routed AS (SELECT row_id, CASE {' '.join(f'WHEN {in_match(it, cols)} THEN {it}' for it, *cols in STEPS)} END AS hit FROM e)"""


def routed(spark, sf_dir):
    forest = people_forest()
    rows = split_rows(spark, sf_dir)
    rel = release(spark, sf_dir, rows.where("split = 'train'"))
    return R.route_eval(rows.where("split = 'val'"), forest, rel), rel


@query("route_eval", f"WITH {EVAL} SELECT row_id, hit IS NOT NULL AS routed, coalesce(hit, -1) AS snapshot FROM routed")
def route_eval(spark, sf_dir):
    return routed(spark, sf_dir)[0].select("row_id", "routed", "snapshot")


@query("eval_stats", f"""WITH {EVAL} SELECT count(*) AS population, count(*) FILTER (WHERE hit = 2) AS finest_rows,
  count(*) FILTER (WHERE hit IS DISTINCT FROM 2) AS coarser_rows, count(*) FILTER (WHERE hit IS NULL) AS coarsest_release_rows,
  round(count(*) FILTER (WHERE hit IS DISTINCT FROM 2) / count(*), 9) AS coarser_fraction,
  round(count(*) FILTER (WHERE hit IS NULL) / count(*), 9) AS coarsest_release_fraction FROM routed""")
def eval_stats(spark, sf_dir):
    return rounded(R.eval_stats(*routed(spark, sf_dir)))


def leafed(spark, sf_dir):
    """The population with its leaves, joined and looked up once: each release and each check below reads it again."""
    rows = R.ensure_leaves(people(spark, sf_dir), people_forest())
    return Scratch(spark, "leafed").save(rows.drop("total", "balance"))


def saved_release(spark, rows):
    """Four saved releases of `rows`, which are grouped to cells once for all of them."""
    forest = people_forest()
    path = Scratch(spark, "saved").path
    cells = Scratch(spark, "cells").save(R.leaf_cells(rows, forest))
    for upto in (1, 2, 3, 4):
        history = SNAPSHOTS[:upto]
        rel = R.materialize_release(cells, forest, history, K)
        save_release(R.release_rows(rows, forest, rel).where("snapshot IS NOT NULL"), path, history[-1].iteration)
    return path


@query("load_release", f"WITH {FULL} SELECT CAST(2 AS INTEGER) AS iteration, row_id, snapshot FROM rel")
def load_saved(spark, sf_dir):
    return load_release(spark, saved_release(spark, leafed(spark, sf_dir))).select("iteration", "row_id", "snapshot")


@query("release_points", "SELECT unnest([-1, 0, 1, 2]) AS iteration FROM (SELECT 1 FROM orders LIMIT 1)")
def points(spark, sf_dir):
    return release_points(spark.read.parquet(saved_release(spark, leafed(spark, sf_dir))), "all")


@query("rebuild_release", f"WITH {FULL} SELECT row_id, {P}, label FROM rel JOIN pop USING (row_id)")
def rebuild_release(spark, sf_dir):
    forest = people_forest()
    rows = leafed(spark, sf_dir)
    saved = pick_release(spark.read.parquet(saved_release(spark, rows)))
    out = R.rebuild_release(rows, saved, forest, SNAPSHOTS, K)
    return R.published_text(out, forest).select("row_id", *QIS, "label")


# Published: high-value orders above the exempt ones (negative balance).
FLAGS = """f AS (SELECT *, total > 400000 AS selected, total > 400000 AND balance >= 0 AS published, balance < 0 AS exempt FROM pub)"""


def flagged(spark, sf_dir):
    df = generalize(people(spark, sf_dir), people_forest(), MID)
    return df.select("row_id", *QIS, (F.col("total") > 400000).alias("selected"),
                     ((F.col("total") > 400000) & (F.col("balance") >= 0)).alias("published"),
                     (F.col("balance") < 0).alias("exempt"))


CLOSED = f"""{MID_CTE}, {FLAGS}, live AS (SELECT *, bool_or(published) OVER (PARTITION BY {Q}) AS live FROM f),
closed AS (SELECT row_id, {Q}, selected OR live AS selected, published OR (live AND NOT selected AND NOT exempt) AS published, exempt FROM live)"""


@query("close_classes", f"WITH {CLOSED} SELECT row_id, selected, published FROM closed")
def close_classes(spark, sf_dir):
    return R.close_classes(flagged(spark, sf_dir), QIS).select("row_id", "selected", "published")


@query("merge_exempt", f"""WITH {CLOSED} SELECT row_id, exempt AND coalesce(bool_and(published) FILTER (WHERE NOT exempt) OVER (PARTITION BY {Q}), false) AS retained FROM closed""")
def merge_exempt(spark, sf_dir):
    closed = R.close_classes(flagged(spark, sf_dir), QIS)
    return R.merge_exempt(closed, QIS).select("row_id", "retained")


@query("evict_low_k", f"""WITH {MID_CTE}, {FLAGS} SELECT row_id, selected AND (exempt OR count(*) FILTER (WHERE selected AND NOT exempt) OVER (PARTITION BY {Q}) >= 5) AS selected FROM f""")
def evict_low_k(spark, sf_dir):
    return R.evict_low_k(flagged(spark, sf_dir), QIS, 5).select("row_id", "selected")
