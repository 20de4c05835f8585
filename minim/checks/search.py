"""Candidates, scores, gradients, swap, searches and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from minim.checks import query
from minim.checks.classes import MID, MID_CTE, Q, rounded
from minim.checks.tables import PEOPLE_LEVELS, QIS, SEED, people, people_forest, table
from minim.functions import expressions as E
from minim.functions.ordering import seeded_key
from minim.operators import candidates as G
from minim.operators import hierarchy_mondrian as H
from minim.operators import models as L
from minim.operators import removal as D
from minim.operators.analytics import k_grid
from minim.operators.hierarchy import assign_leaves, generalize
from minim.operators.keyed import attach
from minim.operators.release import Snapshot, leaf_cells, node_columns
from minim.operators.sampling import stratified_split
from minim.plans import minimize as S
from minim.plans import removal_search as V
from minim.session import Scratch

# A small linear model over (segment, year) with round weights, so that SQL can repeat it.
SMALL = ("segment", "year")
THETA = L.Linear(((0.5, -0.25, 0.1, 0.0, -0.4, 0.002),), (-4.0,))
GVAL = L.Gradient(((0.1, 0.2, -0.1, 0.05, -0.2, 0.001),), (0.3,), 1.0)
LOW, UP = {"segment": 0, "year": 0}, {"segment": 0, "year": 1}
NAMES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def case(weights):
    return "CASE segment " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in zip(NAMES, weights)) + " END"


# Mean of the integers in the published year node at level 0 and level 1.
YEAR0 = "CASE WHEN year <= 1996 THEN 1995.5 WHEN year <= 1998 THEN 1997.5 WHEN year <= 2000 THEN 1999.5 ELSE 2001.5 END"
YEAR1 = "CASE WHEN year <= 1998 THEN 1996.5 ELSE 2000.5 END"


def scalar(year):
    return (f"(1.0 / (1.0 + exp(-({case(THETA.weights[0][:5])} + 0.002::DOUBLE * {year} - 4.0))) - label)"
            f" * ({case(GVAL.weights[0][:5])} + 0.001::DOUBLE * {year} + 0.3)")


FLAGS = f"total > 300000 AS selected, balance < 0 AND total > 300000 AS exempt, md5('42:' || CAST(row_id AS VARCHAR)) AS h"
STATE = f"""{MID_CTE}, st AS (SELECT pop.row_id, pop.label, pop.year, pop.segment, pub.nation AS c_nation, pub.segment AS c_segment, pub.priority AS c_priority,
  pub.year AS c_year, {FLAGS.replace('total', 'pop.total').replace('balance', 'pop.balance').replace('row_id', 'pop.row_id')} FROM pop JOIN pub USING (row_id))"""
KEYS = [f"{q}__node" for q in QIS]
C = "c_nation, c_segment, c_priority, c_year"


def state(spark, sf_dir):
    rows = generalize(people(spark, sf_dir), people_forest(), MID, keep_raw=True)
    # The state of a search is a written table; every step reads it several times.
    return Scratch(spark, "state").save(rows.select("*", (F.col("total") > 300000).alias("selected"), ((F.col("balance") < 0) & (F.col("total") > 300000)).alias("exempt"),
                       seeded_key(SEED, "row_id").alias("_key"), F.lit(0).alias("batch")))


def small_space():
    forest = people_forest()
    return L.FeatureSpace({a: forest[a] for a in SMALL})


def scalar_column(levels):
    return L.influence_scalar(small_space(), THETA, GVAL, levels, "label")


def renamed(df):
    return df.select(*[F.col(f"{q}__node").alias(q) if f"{q}__node" in df.columns else F.lit(None).alias(q) for q in QIS],
                     *[c for c in df.columns if not c.endswith("__node")])


SQL_KEYS = "c_nation AS nation, c_segment AS segment, c_priority AS priority, c_year AS year"


@query("mean_gradient", f"""WITH {MID_CTE}, r AS (SELECT segment, {YEAR0} AS yv, 1.0 / (1.0 + exp(-({case(THETA.weights[0][:5])} + 0.002::DOUBLE * {YEAR0} - 4.0))) - label AS r FROM pop)
{' UNION ALL '.join(f"SELECT 'segment={n}' AS feature, round(sum(CASE WHEN segment = '{n}' THEN r ELSE 0 END) / count(*), 9) AS value FROM r" for n in NAMES)}
UNION ALL SELECT 'year', round(avg(r * yv), 6) FROM r UNION ALL SELECT 'intercept', round(avg(r), 9) FROM r""")
def mean_gradient(spark, sf_dir):
    space = small_space()
    g = L.mean_gradient(assign_leaves(people(spark, sf_dir), space.forest), space, THETA, LOW, "label")
    rows = [(n, round(v, 6 if n == "year" else 9)) for n, v in zip(space.names, g.weights[0])] + [("intercept", round(g.intercepts[0], 9))]
    return spark.createDataFrame(rows, "feature string, value double")


@query("influence_scalar", f"WITH {MID_CTE} SELECT row_id, round({scalar(YEAR0)}, 9) AS s FROM pop")
def influence_scalar(spark, sf_dir):
    rows = assign_leaves(people(spark, sf_dir), small_space().forest)
    return rows.select("row_id", F.round(scalar_column(LOW), 9).alias("s"))


OPEN = f"""{STATE}, s AS (SELECT *, {scalar(YEAR0)} AS s FROM st), sel AS (SELECT count(*) AS n, avg(s) AS m FROM s WHERE selected),
k AS (SELECT min(c) AS k FROM (SELECT count(*) AS c FROM st WHERE selected AND NOT exempt GROUP BY {C})),
open AS (SELECT *, row_number() OVER (PARTITION BY {C} ORDER BY h) AS rn FROM s WHERE NOT selected), adm AS (SELECT open.* FROM open, k WHERE rn <= k)"""


def admitted(spark, sf_dir):
    rows = state(spark, sf_dir)
    k = rows.where("selected AND NOT exempt").groupBy(*KEYS).count().agg(F.min("count")).first()[0]
    return rows, G.admission_rows(rows, KEYS, "_key", k)


@query("horizontal_candidates", f"WITH {OPEN} SELECT row_id FROM adm")
def horizontal_candidates(spark, sf_dir):
    return admitted(spark, sf_dir)[1].select("row_id")


@query("lga_admission", f"""WITH {OPEN} SELECT {SQL_KEYS}, count(*) AS rows, round((sum(s) - count(*) * max(m)) / (count(*) + max(n)), 12) AS lga_score FROM adm, sel GROUP BY {C}""")
def lga_admission(spark, sf_dir):
    rows, adm = admitted(spark, sf_dir)
    n, mean = G.selected_mean(rows, scalar_column(LOW))
    out = G.lga_admission(adm, KEYS, scalar_column(LOW), n, mean)
    return renamed(out.withColumn("lga_score", F.round("lga_score", 12)))


@query("lga_removal", f"""WITH {STATE}, s AS (SELECT *, {scalar(YEAR0)} AS s FROM st), t AS (SELECT count(*) AS n, sum(s) AS a FROM s)
SELECT {SQL_KEYS}, count(*) AS rows, round(-((count(*) * max(a) / max(n) - sum(s)) / (max(n) - count(*))), 12) AS fast_utility_score FROM s, t GROUP BY {C}""")
def lga_removal(spark, sf_dir):
    out = G.lga_removal(state(spark, sf_dir), KEYS, scalar_column(LOW))
    return renamed(out.withColumn("fast_utility_score", F.round("fast_utility_score", 12)))


@query("lga_change", f"WITH {STATE} SELECT 'year' AS attr, round(avg({scalar(YEAR0)} - {scalar(YEAR1)}), 9) AS lga_score FROM st WHERE selected")
def lga_change(spark, sf_dir):
    change = G.lga_changes(state(spark, sf_dir).where("selected"), {"year": (scalar_column(UP), scalar_column(LOW))})
    return spark.createDataFrame([(a, round(v, 9)) for a, v in change.items()], "attr string, lga_score double")


@query("vertical_candidates", f"WITH {PEOPLE_LEVELS} SELECT a AS attr, l - 1 AS next_level, (SELECT min(c) FROM (SELECT count(*) AS c FROM gen GROUP BY CASE a WHEN 'nation' THEN nation0 ELSE nation1 END, segment0, "
       "CASE a WHEN 'priority' THEN priority0 ELSE priority1 END, CASE a WHEN 'year' THEN year0 ELSE year1 END)) AS min_k FROM (VALUES ('nation', 1), ('priority', 1), ('year', 1)) v(a, l)")
def vertical_candidates(spark, sf_dir):
    parts = None
    for attr, levels in G.vertical_candidates(MID).items():
        pub = generalize(people(spark, sf_dir), people_forest(), levels)
        one = pub.groupBy(*QIS).count().agg(F.min("count").alias("min_k")).select(F.lit(attr).alias("attr"), F.lit(levels[attr]).alias("next_level"), "min_k")
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query("reference_filter", f"""WITH {STATE} SELECT {SQL_KEYS}, count(*) AS rows FROM st GROUP BY {C}
HAVING bool_or((CASE WHEN segment > 'C' THEN 1 ELSE 0 END) = label AND (CASE WHEN year > 1996 THEN 1 ELSE 0 END) <> label AND selected)""")
def reference_filter(spark, sf_dir):
    rows = state(spark, sf_dir).select("*", F.when(F.col("segment") > "C", 1).otherwise(0).alias("_p"), F.when(F.col("year") > 1996, 1).otherwise(0).alias("_e"))
    classes = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows"))
    return renamed(G.reference_filter(classes, rows.where("selected"), KEYS, "label", "_p", "_e"))


# Candidates with ids: one per customer, typed by segment.
CAND = """c AS (SELECT c_mktsegment AS candidate_type, c_custkey AS candidate_id, c_acctbal AS rank_score, count(o_orderkey) AS n, coalesce(sum(o_totalprice), 0) / 1e5 AS gain
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""


def cands(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    return c.join(per, "c_custkey", "left").select(
        F.col("c_mktsegment").alias("candidate_type"), F.col("c_custkey").alias("candidate_id"), F.col("c_acctbal").alias("rank_score"),
        F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("t", F.lit(0.0)) / 1e5).alias("gain"))


@query("top_k_per_type", f"""WITH {CAND} SELECT candidate_type, candidate_id, rank_score FROM (SELECT *, row_number() OVER (PARTITION BY candidate_type ORDER BY rank_score DESC, candidate_id) AS rn FROM c) WHERE rn <= 5""")
def top_k_per_type(spark, sf_dir):
    return G.top_k_per_type(cands(spark, sf_dir), 5).select("candidate_type", "candidate_id", "rank_score")


@query("random_shortlist", f"WITH {CAND} SELECT candidate_type, candidate_id FROM c ORDER BY md5('42:3:' || candidate_type || ':' || CAST(candidate_id AS VARCHAR)) LIMIT 1")
def random_shortlist(spark, sf_dir):
    return G.random_shortlist(cands(spark, sf_dir), SEED, 3).select("candidate_type", "candidate_id")


@query("random_score", f"""WITH {CAND} SELECT candidate_id, round(CAST('0x' || substr(md5('42:' || CAST(n AS VARCHAR) || ':' || candidate_type || ':' || CAST(candidate_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE, 9) AS score FROM c""")
def random_score(spark, sf_dir):
    score = G.random_score(SEED, F.col("n"), F.col("candidate_type"), F.col("candidate_id"))
    return cands(spark, sf_dir).select("candidate_id", F.round(score, 9).alias("score"))


@query("evaluation_pool", f"""WITH {CAND} SELECT candidate_type, candidate_id FROM c WHERE candidate_id IN (SELECT candidate_id FROM c ORDER BY rank_score DESC, candidate_type, candidate_id LIMIT 20)
  OR candidate_id IN (SELECT candidate_id FROM c ORDER BY n DESC, candidate_type, candidate_id LIMIT 20)""")
def evaluation_pool(spark, sf_dir):
    return G.evaluation_pool(cands(spark, sf_dir), ["rank_score", "n"], 20).select("candidate_type", "candidate_id")


@query("score_candidates", f"""WITH {CAND} SELECT candidate_id, round(ln(greatest(30 - n, 2)), 9) AS privacy_cost, round(gain / ln(greatest(30 - n, 2)), 9) AS ratio,
  round(1.0 / ln(greatest(30 - n, 2)), 9) AS privacy, round(gain, 9) AS utility, round(rank_score / ln(greatest(30 - n, 2)), 9) AS influence FROM c WHERE gain > 0""")
def score_candidates(spark, sf_dir):
    now, nxt, gain = F.lit(30), F.col("n"), F.col("gain")
    return cands(spark, sf_dir).where(gain > 0).select(
        "candidate_id", F.round(E.privacy_cost(now, nxt), 9).alias("privacy_cost"),
        *[F.round(E.candidate_score(gain, now, nxt, p, F.col("rank_score")), 9).alias(p) for p in ("ratio", "privacy", "utility", "influence")])


@query("argmax_candidate", f"WITH {CAND} SELECT candidate_id, n FROM c ORDER BY n DESC, candidate_id LIMIT 1")
def argmax_candidate(spark, sf_dir):
    return G.argmax_candidate(cands(spark, sf_dir), "n", "candidate_id").select("candidate_id", "n")


@query("next_k", f"""WITH {STATE}, t AS (SELECT {C}, count(*) FILTER (WHERE selected AND NOT exempt) AS cnt, count(*) FILTER (WHERE NOT selected) AS adm FROM st GROUP BY {C}),
x AS (SELECT a.*, (SELECT min(b.cnt) FROM t b WHERE b.cnt > 0 AND (b.c_nation, b.c_segment, coalesce(b.c_priority, ''), b.c_year) <> (a.c_nation, a.c_segment, coalesce(a.c_priority, ''), a.c_year)) AS o FROM t a)
SELECT {SQL_KEYS}, CASE WHEN cnt + adm > 0 THEN least(o, cnt + adm) ELSE o END AS next_k FROM x""")
def next_k(spark, sf_dir):
    t = state(spark, sf_dir).groupBy(*KEYS).agg(F.count(F.when(F.col("selected") & ~F.col("exempt"), 1)).alias("cnt"), F.count(F.when(~F.col("selected"), 1)).alias("adm"))
    return renamed(G.next_k(t, KEYS, "cnt", "adm"))


@query("extra_swap_in", f"""WITH {STATE}, t AS (SELECT {C}, count(*) FILTER (WHERE NOT selected) AS n_open FROM st GROUP BY {C})
SELECT {SQL_KEYS}, n_open FROM t WHERE n_open > 10 ORDER BY n_open DESC, c_nation, c_segment, c_priority NULLS FIRST, c_year LIMIT 1""")
def extra_swap_in(spark, sf_dir):
    t = state(spark, sf_dir).groupBy(*KEYS).agg(F.count(F.when(~F.col("selected"), 1)).alias("n_open"))
    return renamed(G.extra_swap_in(t, KEYS, 10))


@query("swap_table", f"""WITH {STATE} SELECT {SQL_KEYS}, count(*) FILTER (WHERE selected AND NOT exempt) AS n_selected, count(*) FILTER (WHERE exempt) AS n_exempt,
  count(*) FILTER (WHERE NOT selected) AS n_open, min(h) FILTER (WHERE selected AND NOT exempt) AS first_selected, min(h) FILTER (WHERE NOT selected) AS first_open, min(0) FILTER (WHERE selected AND NOT exempt) AS first_batch, min(h) FILTER (WHERE selected AND NOT exempt) AS first_key
FROM st GROUP BY {C}""")
def swap_table(spark, sf_dir):
    made = G.swap_table(state(spark, sf_dir), KEYS)
    return renamed(made.withColumns({"first_batch": F.col("first_order.batch"), "first_key": F.col("first_order.key")}).drop("first_order"))


def swapped(spark, sf_dir):
    scratch = Scratch(spark, "swap")
    rows = state(spark, sf_dir)
    t = scratch.save(G.swap_table(rows, KEYS))
    moves = G.moves_table(spark, KEYS, ["string"] * len(KEYS), G.swap_classes(t, KEYS, 1))
    return scratch.save(G.apply_moves(rows, t, moves, KEYS))


@query("swap_invariants", f"""WITH {STATE} SELECT count(*) AS rows, count(*) FILTER (WHERE exempt) AS exempt_kept, 0 AS split_classes, TRUE AS converged,
  bit_xor(hash_id) AS ids FROM (SELECT *, row_id * 7919 AS hash_id FROM st)""")
def swap_invariants(spark, sf_dir):
    """After a swap run to its end: no row lost, exempt rows stay, groups move whole, and no open class is larger than the smallest movable one."""
    before, after = state(spark, sf_dir).select("row_id", F.col("selected").alias("was")), swapped(spark, sf_dir)
    both = after.join(before, "row_id")
    free = both.where(~F.col("exempt"))
    split = free.groupBy(*KEYS, "was").agg(F.count_distinct("selected").alias("sides")).where("sides > 1").agg(F.count(F.lit(1)).cast("int").alias("split_classes"))
    sizes = after.where(~F.col("exempt")).groupBy(*KEYS).agg(F.count(F.when(F.col("selected"), 1)).alias("s"), F.count(F.when(~F.col("selected"), 1)).alias("o"))
    ended = sizes.agg((F.min(F.when(F.col("s") > 0, F.col("s"))) >= F.max("o")).alias("converged"))
    totals = both.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("exempt") & F.col("selected"), 1)).alias("exempt_kept"), F.bit_xor(F.col("row_id") * 7919).alias("ids"))
    # One row each.
    return totals.crossJoin(split).crossJoin(ended)


@query("swap_classes")
def swap_classes(spark, sf_dir):
    return swapped(spark, sf_dir).select("row_id", "selected")


@query("stats_after_removal", f"""WITH {MID_CTE}, h AS (SELECT k, count(*) AS c FROM (SELECT count(*) AS k FROM pub GROUP BY {Q}) GROUP BY k),
x AS (SELECT r.k AS rows, h.k, h.c - (h.k = r.k)::BIGINT AS c FROM h r, h)
SELECT rows, min(k) AS next_k, arg_min(c, k) AS next_min_classes FROM x WHERE c > 0 GROUP BY rows""")
def stats_after_removal(spark, sf_dir):
    from minim.operators.classes import retention_classes, size_histogram
    pub = generalize(people(spark, sf_dir), people_forest(), MID)
    return D.stats_after_removal(size_histogram(retention_classes(pub, QIS)))


@query("coarsen_candidates", f"""WITH {PEOPLE_LEVELS}, u AS (
  SELECT 'nation' AS attr, 1 AS from_level, count(*) AS k FROM gen GROUP BY nation2, segment0, priority1, year1
  UNION ALL SELECT 'segment', 0, count(*) FROM gen GROUP BY nation1, segment1, priority1, year1
  UNION ALL SELECT 'priority', 1, count(*) FROM gen GROUP BY nation1, segment0, priority2, year1
  UNION ALL SELECT 'year', 1, count(*) FROM gen GROUP BY nation1, segment0, priority1, year2)
SELECT attr, from_level, from_level + 1 AS to_level, min(k) AS next_k, count(*) FILTER (WHERE k = m) AS next_min_classes, count(*) AS class_count
FROM (SELECT *, min(k) OVER (PARTITION BY attr) AS m FROM u) GROUP BY attr, from_level""")
def coarsen_candidates(spark, sf_dir):
    return D.coarsen_candidates(leaf_cells(people(spark, sf_dir), people_forest()), people_forest(), MID)


EXCH = f"""{STATE}, s AS (SELECT *, {scalar(YEAR0)} AS s FROM st),
act AS (SELECT c_nation || '|' || c_segment || '|' || coalesce(c_priority, '~') || '|' || c_year AS c, count(*) AS rows, sum(s) AS s FROM s WHERE selected GROUP BY 1),
rem AS (SELECT c_nation || '|' || c_segment || '|' || coalesce(c_priority, '~') || '|' || c_year AS c, count(*) AS rows, sum(s) AS s FROM s WHERE NOT selected GROUP BY 1),
t AS (SELECT sum(rows) AS n, sum(s) AS a FROM act),
o AS (SELECT act.*, n, a FROM act, t ORDER BY -((rows * a / n - s) / (n - rows)) DESC, rows, c DESC LIMIT 4),
i AS (SELECT rem.*, -((s - rows * a / n) / (n + rows)) AS sc FROM rem, t),
p AS (SELECT o.c AS oc, i.c AS ic, o.rows AS out_rows, i.rows AS in_rows, o.s AS os, i.s AS si, n, a, row_number() OVER (PARTITION BY o.c ORDER BY sc DESC, i.rows DESC, i.c DESC) AS rn FROM o JOIN i ON i.rows <= o.rows),
q AS (SELECT p.*, least((SELECT min(rows) FROM act WHERE c NOT IN (oc, ic)), in_rows + CASE WHEN oc = ic THEN 0 ELSE coalesce((SELECT rows FROM act WHERE c = ic), 0) END) AS next_k FROM p WHERE rn <= 4)
SELECT oc AS out_class, ic AS in_class, out_rows, in_rows, n - out_rows + in_rows AS next_active_rows, next_k,
  round(-((a - os + si) / (n - out_rows + in_rows) - a / n), 12) AS fast_utility_score FROM q WHERE next_k >= (SELECT min(rows) FROM act)"""


@query("exchange_candidates", f"WITH {EXCH}")
def exchange_candidates(spark, sf_dir):
    rows = state(spark, sf_dir).select(F.concat_ws("|", "nation__node", "segment__node", F.coalesce("priority__node", F.lit("~")), "year__node").alias("c"),
                                       "selected", scalar_column(LOW).alias("_s"))
    sums = [F.count(F.lit(1)).alias("rows"), F.sum("_s").alias("s")]
    act, rem = rows.where("selected").groupBy("c").agg(*sums), rows.where("NOT selected").groupBy("c").agg(*sums)
    out = D.exchange_candidates(act, rem, ["c"], 4)
    return out.select(F.col("out.c").alias("out_class"), F.col("in.c").alias("in_class"), "out_rows", "in_rows", "next_active_rows", "next_k",
                      F.round("fast_utility_score", 12).alias("fast_utility_score"))


@query("exchange_best", f"""WITH {EXCH.split('o AS (')[0]}z AS (SELECT min(rows) AS least FROM act),
p AS (SELECT act.rows AS out_rows, rem.rows AS in_rows, -((a - act.s + rem.s) / (n - act.rows + rem.rows) - a / n) AS score,
  rem.rows + CASE WHEN act.c = rem.c THEN 0 ELSE coalesce(there.rows, 0) END AS grown, act.c AS oc, rem.c AS ic
  FROM act JOIN rem ON rem.rows <= act.rows LEFT JOIN act there ON there.c = rem.c, t),
q AS (SELECT p.*, (SELECT min(rows) FROM act WHERE c <> oc AND c <> ic) AS others FROM p)
SELECT out_rows, in_rows, round(max(score), 12) AS score FROM q, z WHERE least(others, grown) >= least GROUP BY ALL""")
def exchange_best(spark, sf_dir):
    """Without a pool: the best exchange of every pair of sizes, against all pairs of classes."""
    rows = state(spark, sf_dir).select(F.concat_ws("|", "nation__node", "segment__node", F.coalesce("priority__node", F.lit("~")), "year__node").alias("c"),
                                       "selected", scalar_column(LOW).alias("_s"))
    sums = [F.count(F.lit(1)).alias("rows"), F.sum("_s").alias("s")]
    out = D.exchange_candidates(rows.where("selected").groupBy("c").agg(*sums), rows.where("NOT selected").groupBy("c").agg(*sums), ["c"])
    return out.groupBy("out_rows", "in_rows").agg(F.round(F.max("fast_utility_score"), 12).alias("score"))


@query("removal_candidates", f"""WITH {STATE}, s AS (SELECT *, {scalar(YEAR0)} AS s FROM st), t AS (SELECT count(*) AS n, sum(s) AS a FROM s),
c AS (SELECT {SQL_KEYS}, count(*) AS rows, round(-((count(*) * max(a) / max(n) - sum(s)) / (max(n) - count(*))), 12) AS fast_utility_score, max(n) - count(*) AS next_active_rows FROM s, t GROUP BY {C}),
h AS (SELECT rows AS k, count(*) AS m FROM c GROUP BY rows),
x AS (SELECT r.k AS rows, h.k, h.m - (h.k = r.k)::BIGINT AS m FROM h r, h),
e AS (SELECT rows, min(k) AS next_k, arg_min(m, k) AS next_min_classes FROM x WHERE m > 0 GROUP BY rows)
SELECT c.*, next_k, next_min_classes FROM c JOIN e USING (rows)""")
def removal_candidates(spark, sf_dir):
    classes = D.class_table(state(spark, sf_dir).withColumn("n", F.lit(1)), KEYS, scalar_column(LOW))
    out = D.removal_candidates(classes, KEYS)
    return renamed(out.withColumn("fast_utility_score", F.round("fast_utility_score", 12)))


@query("privacy_progress", f"""WITH {CAND} SELECT candidate_id, CASE WHEN n > 10 THEN CAST(n - 10 AS DOUBLE) WHEN n = 10 THEN (40 - 10) / 40.0 END AS progress,
  round(greatest(gain / 0.5, 0.001), 9) AS cost FROM c""")
def privacy_progress(spark, sf_dir):
    return cands(spark, sf_dir).select("candidate_id", E.privacy_progress(F.lit(10), F.col("n"), F.lit(40), F.lit(10)).alias("progress"),
                                       F.round(E.utility_cost(F.col("gain"), 0.5, 0.001), 9).alias("cost"))


@query("apply_membership", f"""WITH {MID_CTE}, big AS (SELECT nation, segment FROM pub GROUP BY ALL HAVING count(*) > 600)
SELECT row_id, total > 250000 AND (nation, segment) NOT IN (SELECT (nation, segment) FROM big) AS active FROM pub""")
def apply_membership(spark, sf_dir):
    pub = generalize(people(spark, sf_dir), people_forest(), MID).withColumn("active", F.col("total") > 250000)
    big = pub.groupBy("nation", "segment").count().where("count > 600")
    return D.apply_membership(pub, ["nation", "segment"], out=big).select("row_id", "active")


@query("tree_model_input", f"""WITH {PEOPLE_LEVELS} SELECT row_id, CASE WHEN year <= 1998 THEN 1.0::DOUBLE ELSE 0.0 END AS "year_cat=1996.5", CASE WHEN year > 1998 THEN 1.0::DOUBLE ELSE 0.0 END AS "year_cat=2000.5",
{', '.join(f'''CASE WHEN priority1 = '{g}' THEN 0.5::DOUBLE ELSE 0.0 END AS "priority={v}"''' for v, g in (('1-URGENT', 'high'), ('2-HIGH', 'high'), ('3-MEDIUM', 'normal'), ('5-LOW', 'normal')))} FROM gen""")
def tree_model_input(spark, sf_dir):
    forest = {a: people_forest()[a] for a in ("year", "priority")}
    return L.tree_model_input(assign_leaves(people(spark, sf_dir), forest), forest, {"year": 1, "priority": 1}, ["row_id"])


@query("leaf_space", f"""WITH {PEOPLE_LEVELS} SELECT row_id, CASE WHEN priority IS NULL THEN '0.0,0.0,0.0,0.0,0.0' WHEN priority1 = 'high' THEN '0.5,0.5,0.0,0.0,1.0' ELSE '0.0,0.0,0.5,0.5,1.0' END AS features FROM gen""")
def leaf_space(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    forest = {"priority": people_forest()["priority"]}
    made = L.leaf_space(assign_leaves(people(spark, sf_dir), forest), forest, {"priority": 1})
    return made.select("row_id", F.array_join(vector_to_array("features").cast("array<string>"), ",").alias("features"))


def vectors(spark, sf_dir):
    forest = people_forest()
    rows = Scratch(spark, "vectors").save(assign_leaves(people(spark, sf_dir), forest).withColumn("snapshot", F.lit(0)))
    space = L.FeatureSpace(forest, ("total", "balance")).fit(rows)
    return space, space.vectors(rows, [Snapshot(0, dict.fromkeys(forest, 0))])


def classified(fitted, made):
    return L.class_probability(fitted, made).select("row_id", F.round("p", 6).alias("p"))


@query("fit_logistic")
def fit_logistic(spark, sf_dir):
    space, made = vectors(spark, sf_dir)
    model = L.fit_logistic(made)
    return spark.createDataFrame(list(zip([*space.names, "intercept"], [*model.weights[0], model.intercepts[0]])), "feature string, weight double")


@query("fit_mlp")
def fit_mlp(spark, sf_dir):
    space, made = vectors(spark, sf_dir)
    return classified(L.fit_mlp(made, space.width), made)


@query("fit_gbt")
def fit_gbt(spark, sf_dir):
    _, made = vectors(spark, sf_dir)
    return classified(L.fit_gbt(made), made)


@query("influence")
def influence(spark, sf_dir):
    forest = people_forest()
    space = L.FeatureSpace({a: forest[a] for a in SMALL})
    rows = Scratch(spark, "influence").save(assign_leaves(people(spark, sf_dir), space.forest).withColumn("snapshot", F.lit(0)))
    space = space.fit(rows)
    model = L.fit_logistic(space.vectors(rows, [Snapshot(0, LOW)]))
    estimate, step = L.influence(rows, rows.where("total > 250000"), rows.where("balance < 0"), space, model, LOW, "label", 0.63)
    return spark.createDataFrame([("loss", estimate), *zip([*space.names, "intercept"], step)], "name string, value double")


_FEATURES = [*((f"segment={n}", f"CASE WHEN segment = '{n}' THEN 1.0 ELSE 0.0 END") for n in NAMES), ("year", "yv"), ("intercept", "1.0")]


@query("second_derivatives", f"""WITH {MID_CTE}, r AS (SELECT segment, {YEAR0} AS yv, 1.0 / (1.0 + exp(-({case(THETA.weights[0][:5])} + 0.002::DOUBLE * {YEAR0} - 4.0))) AS p FROM pop)
{' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round(avg(p * (1 - p) * ({x}) * ({y})), 4) AS value FROM r" for i, (a, x) in enumerate(_FEATURES) for b, y in _FEATURES[i:])}""")
def second_derivatives(spark, sf_dir):
    """The matrix that the influence estimate solves with, from sums per pair of leaves."""
    from minim.operators import lockstep as K
    space = small_space()
    rows = assign_leaves(people(spark, sf_dir), space.forest)
    h = K.hessian(rows, K.level_layout(space, LOW), K.as_params(THETA), THETA.probabilities(L.logits(space, THETA, LOW)), F.lit(1.0))
    names = [*space.names, "intercept"]
    return spark.createDataFrame([(a, b, round(float(h[i, j]), 4)) for i, a in enumerate(names) for j, b in enumerate(names) if j >= i], "a string, b string, value double")


@query("mlp_lga")
def mlp_lga(spark, sf_dir):
    space, made = vectors(spark, sf_dir)
    d = space.width
    hidden = [[((i * 7 + j * 3) % 11 - 5) / 50 for j in range(4)] for i in range(d)]
    layers = [(hidden, [0.0] * 4), ([[0.3], [-0.2], [0.1], [0.4]], [0.0])]
    g = [((i * 5) % 13 - 6) / 100 for i in range(d * 4 + 4 + 4 + 1)]
    scored = L.mlp_gradient_scalar(made, layers, g, "label", ["row_id", "segment"])
    return scored.groupBy("segment").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("s"), 6).alias("s"))


DP_RATE, DP_CLIP, DP_SIGMA = 0.4, 100.0, 1.5


def _digits(key, first):
    """Thirteen hex digits of an md5 key as a number, in SQL."""
    return f"CAST('0x' || substr(md5({key}), {first}, 13) AS BIGINT)"


def _noise(i):
    """The noise of one coordinate, in SQL."""
    key = f"'42:noise:{i}'"
    u, v = (f"(({_digits(key, first)} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)" for first in (1, 14))
    return f"{DP_SIGMA * DP_CLIP}::DOUBLE * sqrt(-2.0::DOUBLE * ln({u})) * cos(2.0::DOUBLE * pi() * {v})"


_DP_ID = "'42:sample:' || CAST(row_id AS VARCHAR)"


@query("dp_gradient_step", f"""WITH {PEOPLE_LEVELS}, whole AS (SELECT {DP_RATE}::DOUBLE * count(*) AS n FROM pop),
r AS (SELECT segment, {YEAR0} AS yv, 1.0 / (1.0 + exp(-({case(THETA.weights[0][:5])} + 0.002::DOUBLE * {YEAR0} - 4.0))) - label AS r
  FROM pop WHERE {_digits(_DP_ID, 1)} / 4503599627370496.0::DOUBLE < {DP_RATE}::DOUBLE),
c AS (SELECT *, least(1.0, {DP_CLIP}::DOUBLE / (abs(r) * sqrt(2.0 + yv * yv))) AS f FROM r)
{' UNION ALL '.join(f"SELECT 'segment={n}' AS feature, round((sum(CASE WHEN segment = '{n}' THEN r * f ELSE 0 END) + {_noise(i)}) / max(n), 6) AS value FROM c, whole" for i, n in enumerate(NAMES))}
UNION ALL SELECT 'year', round((sum(r * f * yv) + {_noise(5)}) / max(n), 4) FROM c, whole
UNION ALL SELECT 'intercept', round((sum(r * f) + {_noise(6)}) / max(n), 6) FROM c, whole
UNION ALL SELECT 'rows', count(*) FROM c""")
def dp_gradient_step(spark, sf_dir):
    """A sample of two fifths, clipped, with noise: sample and noise follow from seeded keys."""
    space = small_space()
    rows = assign_leaves(people(spark, sf_dir), space.forest)
    g, n = L.dp_gradient_step(rows, space, THETA, LOW, "label", rate=DP_RATE, clip=DP_CLIP, sigma=DP_SIGMA, seed=SEED)
    out = [(f, round(v, 4 if f == "year" else 6)) for f, v in zip(space.names, g.weights[0])] + [("intercept", round(g.intercepts[0], 6)), ("rows", float(n))]
    return spark.createDataFrame(out, "feature string, value double")


def split(spark, sf_dir, columns=None):
    """Training, validation and test rows, with all columns or those asked for."""
    rows = people(spark, sf_dir)
    rows = stratified_split(rows.select(*columns) if columns else rows, "label", 0.15, 0.15, SEED)
    return rows.where("split = 'train'"), rows.where("split = 'val'"), rows.where("split = 'test'")


_MINIMIZED: dict = {}


def minimized(spark, sf_dir):
    """The loop to its end with the operator's own options, run once in a session: its result and the options."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MINIMIZED:
        train, val, _ = split(spark, sf_dir)
        options = S.MinimizeOptions(log_path=Scratch(spark, "log").path)
        _MINIMIZED[key] = S.minimize(train, val, people_forest(), "label", options), options
    return _MINIMIZED[key]


@query("minimize")
def minimize(spark, sf_dir):
    # The log as the iterations appended it to storage.
    return spark.read.parquet(minimized(spark, sf_dir)[1].log_path)


_REMOVALS: dict = {}


def removed(spark, sf_dir):
    """The whole loop with the operator's own options, run once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _REMOVALS:
        train, val, _ = split(spark, sf_dir)
        _REMOVALS[key] = V.removal_search(train, val, people_forest(), "label", V.RemovalOptions())
    return _REMOVALS[key]


@query("removal_search")
def removal_search(spark, sf_dir):
    return V.removal_log(spark, removed(spark, sf_dir))


_SPLIT_SIZES = """sizes AS (SELECT n, t, floor(0.15::DOUBLE / 0.85::DOUBLE * (n - t) + 0.5) AS v FROM (
  SELECT n, floor(0.15::DOUBLE * n + 0.5) AS t FROM (SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderstatus = 'F')))"""


@query("minimize_invariants", f"""WITH {_SPLIT_SIZES} SELECT CAST(sum(n - t - v) AS BIGINT) AS rows, 0 AS rising_losses, 0 AS uneven_counts, 0 AS steps_without_choice,
  0 AS choices_without_gain, 0 AS better_left_out, TRUE AS release_holds, TRUE AS end_is_named FROM sizes""")
def minimize_invariants(spark, sf_dir):
    """Of the whole search: no row is lost, losses fall, each step took the best candidate with a gain, the release's classes reach their size."""
    from pyspark.sql import Window
    from minim.operators.classes import size_histogram
    found, options = minimized(spark, sf_dir)
    total = found.state.count()
    steps, log = S.iteration_table(spark, found), spark.read.parquet(options.log_path)
    # One row per iteration.
    before = F.lag("validation_loss").over(Window.orderBy("iteration"))
    falls = steps.withColumn("_before", before).agg(
        F.count(F.when(F.col("validation_loss") >= F.col("_before"), 1)).cast("int").alias("rising_losses"),
        F.count(F.when(F.col("row_count") + F.col("suppressed_row_count") != total, 1)).cast("int").alias("uneven_counts"))
    best = log.groupBy("iteration").agg(F.count(F.when(F.col("selected"), 1)).alias("_chosen"), F.max(F.when(F.col("utility_gain") > 0, F.col("score"))).alias("_best"),
                                        F.max(F.when(F.col("selected"), F.col("score"))).alias("_score"), F.min(F.when(F.col("selected"), F.col("utility_gain"))).alias("_gain"))
    chosen = steps.select("iteration").join(best, "iteration", "left").agg(
        F.count(F.when(F.coalesce("_chosen", F.lit(0)) != 1, 1)).cast("int").alias("steps_without_choice"),
        F.count(F.when(F.col("_gain") <= 0, 1)).cast("int").alias("choices_without_gain"),
        F.count(F.when(F.col("_best") > F.col("_score"), 1)).cast("int").alias("better_left_out"))
    holds = True
    if found.release is not None:
        least = size_histogram(S.published_classes(found.release, people_forest())).agg(F.min("k").alias("k")).first()["k"]
        holds = least >= found.iterations[-1]["target_k"]
    named = {"max_iterations_reached": len(found.iterations) == options.max_iterations, "no_action_available": True,
             "loss_threshold_met": not found.iterations or found.iterations[-1]["delta_u"] <= options.tolerance}
    # One row each.
    return falls.crossJoin(chosen).select(F.lit(total).cast("bigint").alias("rows"), "*", F.lit(holds).alias("release_holds"),
                                          F.lit(named.get(found.termination, False)).alias("end_is_named"))


@query("removal_invariants", f"""WITH {_SPLIT_SIZES} SELECT CAST(sum(n - t - v) AS BIGINT) AS rows, 0 AS steps_without_progress, 0 AS losses_beyond_tolerance,
  TRUE AS privacy_as_logged, TRUE AS end_is_named FROM sizes""")
def removal_invariants(spark, sf_dir):
    """Of the whole search: no row is lost, each step raises min-K or lowers the classes at it within the tolerance, and the last state is as logged."""
    from pyspark.sql import Window
    found = removed(spark, sf_dir)
    log = V.removal_log(spark, found)
    # One row per iteration.
    last = Window.orderBy("iteration")
    progress = F.struct("min_k", -F.col("min_k_class_count"))
    steps = log.withColumn("_before", F.lag(progress).over(last)).agg(
        F.count(F.when(F.col("_before") >= progress, 1)).cast("int").alias("steps_without_progress"),
        F.count(F.when(F.col("validation_loss") > found["threshold"], 1)).cast("int").alias("losses_beyond_tolerance"),
        F.max(F.struct("iteration", "min_k", "min_k_class_count", "active_rows")).alias("_last"),
        F.max(F.col("termination").isin("max_iterations_reached", "no_feasible_candidate", "no_positive_privacy_progress_candidate")).alias("end_is_named"))
    cells = found["cells"]
    sizes = cells.where("active").groupBy(*node_columns(people_forest(), found["levels"])).agg(F.sum("n").alias("k"))
    state = sizes.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.sum("k").alias("n")).agg(F.min(F.struct("k", "c")).alias("_least"), F.sum("n").alias("_active"))
    logged = ((F.col("_last.min_k") == F.col("_least.k")) & (F.col("_last.min_k_class_count") == F.col("_least.c")) & (F.col("_last.active_rows") == F.col("_active")))
    # One row each.
    return cells.agg(F.sum("n").alias("rows")).crossJoin(steps).crossJoin(state).select(
        "rows", "steps_without_progress", "losses_beyond_tolerance", F.coalesce(logged, F.lit(True)).alias("privacy_as_logged"), "end_is_named")


TREE_K = 400
# What trees and their routing read.
TREE_COLUMNS = ("row_id", *QIS, "label")


def fitted(spark, sf_dir, variant=H.MEDIAN):
    train, val, _ = split(spark, sf_dir, TREE_COLUMNS)
    return H.fit_mondrian(train, people_forest(), "label", TREE_K, variant), val


@query("hierarchy_mondrian")
def hierarchy_mondrian(spark, sf_dir):
    return H.node_regions(fitted(spark, sf_dir)[0])


@query("hierarchy_mondrian_infogain")
def hierarchy_mondrian_infogain(spark, sf_dir):
    return H.published_histogram(fitted(spark, sf_dir, H.INFOGAIN)[0])


@query("region_encoding")
def region_encoding(spark, sf_dir):
    return H.encode_regions(fitted(spark, sf_dir)[0])


@query("routing_stats")
def routing_stats(spark, sf_dir):
    tree, val = fitted(spark, sf_dir)
    return H.routing_stats(H.route_split_widening(val, tree), tree.forest)


@query("diagnose_routing")
def diagnose_routing(spark, sf_dir):
    tree, val = fitted(spark, sf_dir)
    return H.diagnose_routing(val, tree)


@query("tree_invariants", f"""WITH {_SPLIT_SIZES} SELECT variant, CAST(sum(n - t - v) AS BIGINT) AS rows, 0 AS small_leaves, 0 AS rows_outside, 0 AS unequal_parents
FROM sizes, (SELECT unnest(['median', 'infogain']) AS variant) GROUP BY variant""")
def tree_invariants(spark, sf_dir):
    """Every training row is in one leaf of at least k rows whose region holds it, and a node's size is the sum of its children's."""
    parts = []
    train, _, _ = split(spark, sf_dir, TREE_COLUMNS)
    for variant in (H.MEDIAN, H.INFOGAIN):
        tree = H.fit_mondrian(train, people_forest(), "label", TREE_K, variant)
        leaves = H.leaf_nodes(tree).select("path", F.col("size").alias("_size"), *H.region_columns(tree.forest))
        placed = attach(tree.cells, leaves, ["path"], "_size")
        inside = reduce(lambda a, b: a & b, [H._contains(tree.forest, a) for a in tree.forest])
        rows = placed.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~F.coalesce(inside, F.lit(False)), F.col("n"))), F.lit(0)).cast("int").alias("rows_outside"))
        small = leaves.agg(F.count(F.when(F.col("_size") < TREE_K, 1)).cast("int").alias("small_leaves"))
        below = (tree.nodes.where(F.col("path").contains("/")).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(F.sum("size").alias("_below")))
        uneven = tree.nodes.join(below, "path").agg(F.count(F.when(F.col("size") != F.col("_below"), 1)).cast("int").alias("unequal_parents"))
        # One row each.
        parts.append(rows.crossJoin(small).crossJoin(uneven).withColumn("variant", F.lit(variant)))
    return parts[0].unionByName(parts[1]).select("variant", "rows", "small_leaves", "rows_outside", "unequal_parents")


@query("routing_invariants", f"""WITH {_SPLIT_SIZES}, s AS (SELECT CAST(sum(v) AS BIGINT) AS rows FROM sizes)
SELECT unnest(['split', 'containment', 'statistics', 'diagnosis']) AS source, rows FROM s""")
def routing_invariants(spark, sf_dir):
    """Each way of routing answers every validation row once, and the statistics and the diagnosis add up to them."""
    tree, val = fitted(spark, sf_dir)
    routed = H.route_split_widening(val, tree)
    stats = H.routing_stats(routed, tree.forest).select(F.lit("statistics").alias("source"), (F.col("leaf_count") + F.col("internal_count") + F.col("root_count")).alias("rows"))
    parts = [routed.agg(F.sum("n").alias("rows")).select(F.lit("split").alias("source"), "rows"),
             H.route_containment(val, tree).agg(F.sum("n").alias("rows")).select(F.lit("containment").alias("source"), "rows"),
             stats, H.diagnose_routing(val, tree).agg(F.sum("rows").alias("rows")).select(F.lit("diagnosis").alias("source"), "rows")]
    return reduce(lambda a, b: a.unionByName(b), parts)


__all__ = ["rounded"]


@query("mondrian_sweep")
def mondrian_sweep(spark, sf_dir):
    from minim.plans.sweep import mondrian_sweep as sweep
    train, val, _ = split(spark, sf_dir)
    # The operator's whole grid.
    return sweep(train, val, people_forest(), "label", sorted(r["k"] for r in k_grid(train).collect()))


@query("mondrian_point", f"""WITH {_SPLIT_SIZES} SELECT 'median' AS variant, CAST(2 AS BIGINT) AS k, CAST(sum(n - t - v) AS BIGINT) AS rows, TRUE AS min_k_holds,
  CAST(sum(v) AS BIGINT) AS routed FROM sizes""")
def mondrian_point(spark, sf_dir):
    """One point of the sweep, K = 2: fitted, published, routed and scored; every row is in it and no class is smaller than K."""
    from minim.plans import sweep as W
    train, val, _ = split(spark, sf_dir)
    scratch = Scratch(spark, "point")
    forest = people_forest()
    train, val = W.encoded(train, forest, "label", scratch), W.encoded(val, forest, "label", scratch)
    space = L.FeatureSpace(forest).fit(train)
    point = W.sweep_point(train, val, forest, "label", space, 2, H.MEDIAN)
    return spark.createDataFrame([(point["variant"], point["k"], point["record_count"], point["min_k"] >= 2, point["routed_count"])],
                                 "variant string, k bigint, rows bigint, min_k_holds boolean, routed bigint")


def released(spark, sf_dir):
    """Published training rows, and evaluation rows routed to the same snapshots."""
    from minim.operators import release as R
    forest = people_forest()
    train, _, test = split(spark, sf_dir)
    snaps = [Snapshot(0, {"nation": 2, "segment": 1, "priority": 2, "year": 2}), Snapshot(1, {"nation": 1, "segment": 0, "priority": 1, "year": 1})]
    rel = R.materialize_release(R.leaf_cells(train, forest), forest, snaps, 25)
    scratch = Scratch(spark, "released")
    published = scratch.save(R.release_rows(train, forest, rel).where("snapshot IS NOT NULL"))
    return published, scratch.save(R.route_eval(test, forest, rel)), L.FeatureSpace(forest).fit(published), rel.snapshots


@query("reconstruction_attack")
def reconstruction_attack(spark, sf_dir):
    from minim.operators.model_attacks import reconstruction_attack as attack
    return attack(*released(spark, sf_dir), {"year": 1.0})


@query("linkage_attack")
def linkage_attack(spark, sf_dir):
    from minim.operators.model_attacks import linkage_attack as attack
    return attack(*released(spark, sf_dir), ["nation", "segment"], ["priority", "year"], {"year": 1.0})
