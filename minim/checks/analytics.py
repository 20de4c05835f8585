"""Comparison of runs. Result rows are derived from the event and order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from minim.checks import query
from minim.checks.classes import rounded
from minim.checks.tables import PEOPLE, people, table
from minim.operators import analytics as N

# A run is (seed = user, method = event type); an iteration is a day of the month.
RUNS = """runs AS (SELECT user_id AS seed, event_type AS method, CAST(day(ts) - 1 AS BIGINT) AS iteration,
  avg(value) AS loss, sum(value) AS seconds, count(*) AS n FROM events GROUP BY ALL)"""
RUN = ["seed", "method"]


def runs(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(
        F.col("user_id").alias("seed"), F.col("event_type").alias("method"),
        (F.dayofmonth("ts") - 1).cast("bigint").alias("iteration")).agg(
        F.avg("value").alias("loss"), F.sum("value").alias("seconds"), F.count(F.lit(1)).alias("n"))


@query("expand_matrix", """SELECT segment, region, priority FROM (SELECT DISTINCT c_mktsegment AS segment FROM customer),
  (SELECT r_name AS region FROM region), (SELECT DISTINCT o_orderpriority AS priority FROM orders)""")
def expand_matrix(spark, sf_dir):
    return N.expand_matrix(spark, {
        "segment": N.axis_values(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")), "segment"),
        "region": N.axis_values(table(spark, sf_dir, "region").select(F.col("r_name").alias("region")), "region"),
        "priority": N.axis_values(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority")), "priority")})


@query("trajectory", "SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS iteration, o_totalprice FROM orders")
def trajectory(spark, sf_dir):
    """A run per customer, its orders numbered without gaps, so that the check passes over every run."""
    numbered = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    df = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), numbered.alias("iteration"), "o_totalprice")
    return N.trajectory(df, ["run_id"], ["o_totalprice"])


@query("trajectory_gaps", f"""WITH {RUNS} SELECT seed, method, count(*) AS rows, count(DISTINCT iteration) AS distinct_iterations,
  min(iteration) AS first, max(iteration) AS last FROM runs GROUP BY seed, method
HAVING min(iteration) <> 0 OR max(iteration) + 1 <> count(*)""")
def trajectory_gaps(spark, sf_dir):
    return N.trajectory_gaps(runs(spark, sf_dir), RUN)


FEASIBLE = f"""{RUNS}, base AS (SELECT user_id AS seed, avg(value) AS baseline FROM events GROUP BY 1),
ok AS (SELECT runs.* FROM runs JOIN base USING (seed) WHERE loss <= baseline - 20),
chosen AS (SELECT seed, method, min(iteration) AS iteration, arg_min(loss, iteration) AS loss FROM ok GROUP BY seed, method)"""


def chosen(spark, sf_dir):
    base = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("seed")).agg(F.avg("value").alias("baseline"))
    return N.first_feasible(runs(spark, sf_dir).join(base, "seed"), RUN, "loss", F.col("baseline") - 20)


@query("first_feasible", f"WITH {FEASIBLE} SELECT seed, method, iteration, round(loss, 9) AS loss FROM chosen")
def first_feasible(spark, sf_dir):
    return chosen(spark, sf_dir).select("seed", "method", "iteration", F.round("loss", 9).alias("loss"))


@query("runtime_to", f"""WITH {FEASIBLE} SELECT runs.seed, runs.method, chosen.iteration, round(sum(seconds), 4) AS seconds, sum(n)::BIGINT AS n,
  round(sum(seconds) + sum(n), 4) AS total_time FROM runs JOIN chosen ON runs.seed = chosen.seed AND runs.method = chosen.method
  AND runs.iteration <= chosen.iteration GROUP BY ALL""")
def runtime_to(spark, sf_dir):
    out = N.runtime_to(runs(spark, sf_dir), chosen(spark, sf_dir), RUN, ["seconds", "n"])
    return out.select("seed", "method", "iteration", F.round("seconds", 4).alias("seconds"), "n", F.round("total_time", 4).alias("total_time"))


@query("cumulative_times", f"""WITH {RUNS} SELECT seed, method, iteration,
  sum(n) OVER (PARTITION BY seed, method ORDER BY iteration)::BIGINT AS cumulative FROM runs""")
def cumulative_times(spark, sf_dir):
    return N.cumulative_times(runs(spark, sf_dir), RUN, "n")


@query("check_matrix", f"""WITH {RUNS}, want AS (SELECT m.method, i.iteration, s.seed FROM (SELECT DISTINCT method FROM runs) m,
  (SELECT unnest(range(30)) AS iteration) i, (SELECT DISTINCT seed FROM runs) s),
seen AS (SELECT method, iteration, seed, sum(n) AS n FROM runs GROUP BY ALL)
SELECT want.method, want.iteration, want.seed, CASE WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS problem, coalesce(n, 0)::BIGINT AS n
FROM want LEFT JOIN seen USING (method, iteration, seed) WHERE n IS NULL OR n > 1""")
def check_matrix(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("method"), (F.dayofmonth("ts") - 1).cast("bigint").alias("iteration"), F.col("user_id").alias("seed"))
    want = N.expand_matrix(spark, {
        "method": N.axis_values(events, "method"), "iteration": list(range(30)), "seed": N.axis_values(events, "seed")})
    return N.check_matrix(events, want, ["method", "iteration", "seed"])


@query("check_reference", "SELECT c_nationkey AS seed, count(DISTINCT c_mktsegment) AS values FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def check_reference(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("seed"), F.col("c_mktsegment").alias("reference"))
    return N.check_reference(df, "seed", "reference")


def binary_round(name, digits):
    """Half up on the double times a power of ten, as the SQL's engine rounds; F.round rounds the double's decimal text, which differs just below a tie."""
    scale = 10.0 ** digits
    return (F.round(F.col(name) * scale) / scale).alias(name)


@query("normalize_to", f"""WITH {RUNS}, b AS (SELECT seed, iteration, seconds AS base FROM runs WHERE method = 'click')
SELECT method, seed, iteration, round(seconds, 4) AS seconds, round(seconds / base, 9) AS relative FROM runs JOIN b USING (seed, iteration)""")
def normalize_to(spark, sf_dir):
    out = N.normalize_to(runs(spark, sf_dir), "click", ["seed", "iteration"], "seconds")
    return out.select("method", "seed", "iteration", binary_round("seconds", 4), binary_round("relative", 9))


@query("aggregate_seeds", f"""WITH {RUNS} SELECT method, iteration, count(loss) AS seeds, round(avg(loss), 9) AS center,
  round(stddev_samp(loss) / sqrt(count(loss)), 9) AS lower, round(stddev_samp(loss) / sqrt(count(loss)), 9) AS upper FROM runs GROUP BY method, iteration""")
def aggregate_seeds(spark, sf_dir):
    out = N.aggregate_seeds(runs(spark, sf_dir), ["method", "iteration"], "loss", "mean", "sem")
    return out.select("method", "iteration", "seeds", *[F.round(c, 9).alias(c) for c in ("center", "lower", "upper")])


@query("aggregate_seeds_median", f"""WITH {RUNS} SELECT method, count(loss) AS seeds, round(median(loss), 9) AS center,
  round(median(loss) - min(loss), 9) AS lower, round(max(loss) - median(loss), 9) AS upper FROM runs GROUP BY method""")
def aggregate_seeds_median(spark, sf_dir):
    out = N.aggregate_seeds(runs(spark, sf_dir), ["method"], "loss", "median", "minmax")
    return out.select("method", "seeds", *[F.round(c, 9).alias(c) for c in ("center", "lower", "upper")])


# Candidates: one per event; the exact gain is its value, the estimates come from its time and payload.
CANDIDATES = """cand AS (SELECT user_id AS seed, CAST(day(ts) AS BIGINT) AS iteration, event_type AS candidate_type, event_id AS candidate_id,
  value AS exact, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS payload, CAST(minute(ts) AS DOUBLE) AS clock FROM events)"""


def candidates(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("seed"), F.dayofmonth("ts").cast("bigint").alias("iteration"), F.col("event_type").alias("candidate_type"),
        F.col("event_id").alias("candidate_id"), F.col("value").alias("exact"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("payload"), F.minute("ts").cast("double").alias("clock"))


def quality_sql(score: str) -> str:
    return f"""SELECT '{score}' AS method, seed, iteration, max(CASE WHEN e = 1 AND s <= 3 THEN 1.0 ELSE 0.0 END) AS hit,
  count(*) FILTER (WHERE e <= 3 AND s <= 3) / 3.0 AS recall FROM (SELECT *, row_number() OVER (PARTITION BY seed, iteration
  ORDER BY {score} DESC, candidate_type, CAST(candidate_id AS VARCHAR)) AS s FROM ranked) GROUP BY seed, iteration"""


@query("ranking_quality", f"""WITH {CANDIDATES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY seed, iteration
  ORDER BY exact DESC, candidate_type, CAST(candidate_id AS VARCHAR)) AS e FROM cand), per AS ({quality_sql('payload')} UNION ALL {quality_sql('clock')}),
seeds AS (SELECT method, seed, avg(hit) AS hit, avg(recall) AS recall FROM per GROUP BY method, seed)
SELECT method, round(avg(hit), 9) AS hit_rate, round(avg(recall), 9) AS recall FROM seeds GROUP BY method""")
def ranking_quality(spark, sf_dir):
    return rounded(N.ranking_quality(candidates(spark, sf_dir), ["payload", "clock"], "exact", 3))


@query("estimation_error", f"""WITH {RUNS}, per AS (SELECT seed, method, avg(abs(loss - 50)) AS u, avg(abs(loss - 50) / n) AS r, sum(seconds) AS t FROM runs GROUP BY seed, method),
b AS (SELECT seed, t AS base FROM per WHERE method = 'view')
SELECT method, round(avg(u), 9) AS utility_mae, round(avg(r), 9) AS rho_mae, round(avg(t / base), 9) AS relative_time FROM per JOIN b USING (seed) GROUP BY method""")
def estimation_error(spark, sf_dir):
    gap = F.abs(F.col("loss") - 50)
    rows = runs(spark, sf_dir).select("seed", "method", gap.alias("utility_error"), (gap / F.col("n")).alias("rho_error"), F.col("seconds").alias("time"))
    out = N.estimation_error(rows, "view")
    return out.select("method", *[F.round(c, 9).alias(c) for c in ("utility_mae", "rho_mae", "relative_time")])


def gap_sql(score: str) -> str:
    return f"""SELECT seed, iteration, '{score}' AS method, candidate_type, candidate_id, round(abs(payload - o_payload), 9) AS utility_gap, round(abs(exact - o_exact), 9) AS rho_gap
FROM (SELECT *, row_number() OVER (PARTITION BY seed, iteration ORDER BY {score} DESC, candidate_type, candidate_id) AS rn FROM cand) JOIN oracle USING (seed, iteration) WHERE rn = 1"""


@query("oracle_gaps", f"""WITH {CANDIDATES}, oracle AS (SELECT seed, iteration, exact AS o_exact, payload AS o_payload FROM (SELECT *, row_number() OVER (
  PARTITION BY seed, iteration ORDER BY exact DESC, candidate_type, candidate_id) AS rn FROM cand) WHERE rn = 1)
{gap_sql('payload')} UNION ALL {gap_sql('clock')}""")
def oracle_gaps(spark, sf_dir):
    return rounded(N.oracle_gaps(candidates(spark, sf_dir), {"payload": "payload", "clock": "clock"}, "exact", "payload"))


# Private-training results: seed = region, method = market segment, x = order priority, and the
# orders without a priority are the non-private control.
DP = PEOPLE + """, dp AS (SELECT n_regionkey AS seed, segment AS method, priority AS x, CASE WHEN priority IS NULL THEN 'sgd' ELSE 'dp' END AS mode,
  avg(total) / 1e5 AS test_logloss, count(*) // 50 AS batches, min(year) AS first_year FROM pop JOIN nation ON n_nationkey = CAST(nation AS INTEGER) GROUP BY 1, 2, 3)"""


def dp_results(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("nation"), F.col("n_regionkey").alias("seed"))
    return people(spark, sf_dir).join(nation, "nation").groupBy("seed", F.col("segment").alias("method"), F.col("priority").alias("x")).agg(
        (F.avg("total") / 1e5).alias("test_logloss"), F.floor(F.count(F.lit(1)) / 50).alias("batches"), F.min("year").alias("first_year")).withColumn(
        "mode", F.when(F.col("x").isNull(), "sgd").otherwise("dp"))


PAIRS = DP + """, pairs AS (SELECT p.seed, p.method, p.x, p.test_logloss AS private_logloss, c.test_logloss AS control_logloss, p.test_logloss - c.test_logloss AS dp_penalty
  FROM dp p JOIN dp c ON p.seed = c.seed AND p.method = c.method WHERE p.mode = 'dp' AND c.mode = 'sgd')"""


@query("dp_pairs", f"WITH {PAIRS} SELECT seed, method, x, round(private_logloss, 9) AS private_logloss, round(control_logloss, 9) AS control_logloss, round(dp_penalty, 9) AS dp_penalty FROM pairs")
def dp_pairs(spark, sf_dir):
    out = N.dp_pairs(dp_results(spark, sf_dir))
    return out.select("seed", "method", "x", *[F.round(c, 9).alias(c) for c in ("private_logloss", "control_logloss", "dp_penalty")])


@query("mode_summary", f"WITH {DP} SELECT mode, method, x, count(*) AS n_seeds, round(avg(test_logloss), 9) AS mean_logloss, round(stddev_samp(test_logloss), 9) AS sd_logloss FROM dp GROUP BY ALL")
def mode_summary(spark, sf_dir):
    out = N.mode_summary(dp_results(spark, sf_dir))
    return out.select("mode", "method", "x", "n_seeds", F.round("mean_logloss", 9).alias("mean_logloss"), F.round("sd_logloss", 9).alias("sd_logloss"))


# Fixed value: the 0.95 quantile of Student's t with four degrees of freedom (five regions).
T95_4 = 2.1318467863266504


@query("paired_upper_bound", f"""WITH {PAIRS}, g AS (SELECT a.x, a.method, a.private_logloss - b.private_logloss AS gap FROM pairs a JOIN pairs b
  ON a.seed = b.seed AND a.x = b.x WHERE b.method = 'BUILDING' AND a.method <> 'BUILDING')
SELECT x, method, count(*) AS n, round(avg(gap), 9) AS mean_gap, round(avg(gap) + {T95_4} * stddev_samp(gap) / sqrt(count(*)), 9) AS upper_bound,
  avg(gap) + {T95_4} * stddev_samp(gap) / sqrt(count(*)) <= 0.2 AS noninferior FROM g GROUP BY x, method""")
def paired_upper_bound(spark, sf_dir):
    out = N.paired_upper_bound(N.dp_pairs(dp_results(spark, sf_dir)), "BUILDING", "private_logloss", 0.95, 0.2)
    return out.select("x", "method", "n", F.round("mean_gap", 9).alias("mean_gap"), F.round("upper_bound", 9).alias("upper_bound"), "noninferior")


@query("check_protocol", f"""WITH {DP}, b AS (SELECT p.*, c.batches AS cb, c.first_year AS cy FROM dp p JOIN dp c ON p.seed = c.seed AND p.method = c.method WHERE p.mode = 'dp' AND c.mode = 'sgd')
SELECT seed, method, x, 'batches' AS field FROM b WHERE batches <> cb UNION ALL SELECT seed, method, x, 'first_year' FROM b WHERE first_year <> cy""")
def check_protocol(spark, sf_dir):
    return N.check_protocol(dp_results(spark, sf_dir), ["batches", "first_year"])


@query("dp_curve", f"""WITH {PAIRS} SELECT method, x, count(*) AS seeds, round(avg(dp_penalty), 9) AS center, round(stddev_samp(dp_penalty), 9) AS lower,
  round(stddev_samp(dp_penalty), 9) AS upper FROM pairs GROUP BY method, x""")
def dp_curve(spark, sf_dir):
    out = N.dp_curve(dp_results(spark, sf_dir))
    return out.select("method", "x", "seeds", *[F.round(c, 9).alias(c) for c in ("center", "lower", "upper")])


@query("curve_rows", f"""WITH {PEOPLE}, alls AS (SELECT segment AS method, nation AS seed, priority AS point, count(*) AS k, max(total) AS k0 FROM pop GROUP BY ALL
  UNION ALL SELECT 'ALL', nation, priority, count(*), max(total) FROM pop GROUP BY nation, priority)
SELECT method, seed, point, k, round(k0, 2) AS k0, round(ln(k0) - ln(k), 9) AS privacy FROM alls""")
def curve_rows(spark, sf_dir):
    df = people(spark, sf_dir)
    aggs = [F.count(F.lit(1)).alias("k"), F.max("total").alias("k0")]
    one = df.groupBy(F.col("segment").alias("method"), F.col("nation").alias("seed"), F.col("priority").alias("point")).agg(*aggs)
    two = df.groupBy(F.lit("ALL").alias("method"), F.col("nation").alias("seed"), F.col("priority").alias("point")).agg(*aggs)
    out = N.curve_rows(one, two, ["k", "k0"], ("k", "k0"))
    return out.select("method", "seed", "point", "k", F.round("k0", 2).alias("k0"), F.round("privacy", 9).alias("privacy"))


@query("check_pilot", f"""WITH {PEOPLE}, r AS (SELECT segment AS variant, nation, year, CASE WHEN priority = '5-LOW' THEN 'test' ELSE 'validation' END AS split FROM pop)
SELECT 'other_split' AS problem, count(*) AS n FROM r WHERE split <> 'validation'
UNION ALL SELECT 'missing_variant', count(*) FROM (SELECT nation, year FROM r WHERE variant IN ('AUTOMOBILE', 'NONE') GROUP BY ALL HAVING count(DISTINCT variant) < 2)""")
def check_pilot(spark, sf_dir):
    rows = people(spark, sf_dir).select(
        F.col("segment").alias("variant"), "nation", "year",
        F.when(F.col("priority") == "5-LOW", "test").otherwise("validation").alias("split"))
    return N.check_pilot(rows, ["AUTOMOBILE", "NONE"], ["nation", "year"])


@query("group_privacy_bound", """WITH m AS (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)),
s AS (SELECT m, list_sum(list_transform(range(0, m), lambda i: exp(i * 0.1::DOUBLE))) AS series FROM m)
SELECT m AS max_rows, round(m * 0.1::DOUBLE, 9) AS person_epsilon, round(1e-5::DOUBLE * series, 9) AS person_delta FROM s""")
def group_privacy_bound(spark, sf_dir):
    return rounded(N.group_privacy_bound(table(spark, sf_dir, "orders"), "o_custkey", 0.1, 1e-5))


@query("k_grid", """WITH n AS (SELECT count(*) AS n FROM orders), p AS (SELECT CAST(2 ** unnest(range(1, 40)) AS BIGINT) AS k UNION SELECT 12 UNION SELECT 235)
SELECT DISTINCT k FROM (SELECT k FROM p, n WHERE k <= n // 2 UNION SELECT n FROM n)""")
def k_grid(spark, sf_dir):
    return N.k_grid(table(spark, sf_dir, "orders"))
