"""Attacks and model metrics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from minim.checks import query
from minim.checks.classes import MID, MID_CTE, rounded
from minim.checks.sampling import SPLIT_CTE
from minim.checks.tables import PEOPLE, PEOPLE_LEVELS, QIS, SEED, people, people_forest
from minim.operators import attacks as A
from minim.operators import metrics as M
from minim.operators.hierarchy import generalize
from minim.operators.sampling import stratified_split


def subsets_sql(sizes):
    parts = []
    for i, s in enumerate(x for m in sizes for x in combinations(QIS, m)):
        parts.append(f"SELECT {i} AS i, {len(s)} AS m, '{','.join(s)}' AS name, count(*) OVER (PARTITION BY {', '.join(s)}) AS k FROM pub")
    return " UNION ALL ".join(parts)


@query("background_knowledge", f"""WITH {MID_CTE}, sizes AS ({subsets_sql((1, 2, 3, 4))}),
per AS (SELECT i, m, name, min(k) AS min_size, max(1.0::DOUBLE / k) AS max_s, avg(1.0::DOUBLE / k) AS mean_s,
  quantile_cont(1.0::DOUBLE / k, 0.95) AS p95_s FROM sizes GROUP BY i, m, name)
SELECT CAST(m AS BIGINT) AS known_attribute_count, count(*) AS subset_count, min(min_size) AS worst_candidate_size, round(max(max_s), 9) AS worst_success_probability,
  arg_min(name, min_size * 1000 + i) AS worst_subset, round(max(mean_s), 9) AS strongest_mean_success_probability,
  arg_max(name, round(mean_s, 12) * 1e6 - i * 1e-9) AS strongest_mean_subset, round(avg(mean_s), 9) AS mean_success_probability_across_subsets,
  round(max(p95_s), 9) AS strongest_p95_success_probability, arg_max(name, round(p95_s, 12) * 1e6 - i * 1e-9) AS strongest_p95_subset,
  round(avg(p95_s), 9) AS p95_success_probability_across_subsets FROM per GROUP BY m""")
def background_knowledge(spark, sf_dir):
    pub = generalize(people(spark, sf_dir), people_forest(), MID)
    return rounded(A.background_knowledge(pub, QIS, (1, 2, 3, 4)))


@query("most_exposed_row", f"""WITH {MID_CTE}, s AS (SELECT row_id, count(*) OVER (PARTITION BY nation, priority, year) AS k FROM pub)
SELECT k, min(row_id) AS worst_row_id FROM s WHERE k = (SELECT min(k) FROM s) GROUP BY k""")
def most_exposed_row(spark, sf_dir):
    pub = generalize(people(spark, sf_dir), people_forest(), MID)
    return A.most_exposed_row(pub, ("nation", "priority", "year"))


def split_pub(spark, sf_dir):
    rows = stratified_split(people(spark, sf_dir), "label", 0.15, 0.15, SEED)
    pub = generalize(rows, people_forest(), MID, keep_raw=True)
    return pub.where("split = 'train'"), pub.where("split = 'test'")


SPLIT = f"""{PEOPLE_LEVELS}, {SPLIT_CTE}, tr AS (SELECT gen.* FROM gen JOIN split USING (row_id) WHERE split = 'train'),
te AS (SELECT gen.* FROM gen JOIN split USING (row_id) WHERE split = 'test')"""


@query("baseline_predictor", f"""WITH {PEOPLE}
SELECT 'priority' AS attr, (SELECT v FROM (SELECT coalesce(priority, '__MISSING__') AS v, count(*) AS n FROM pop GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS prediction
UNION ALL SELECT 'total', CAST(round(avg(total), 2) AS VARCHAR) FROM pop""")
def baseline_predictor(spark, sf_dir):
    df = people(spark, sf_dir)
    one = A.baseline_predictor(df, "priority", False).select(F.lit("priority").alias("attr"), "prediction")
    mean = A.baseline_predictor(df, "total", True)
    return one.unionByName(mean.select(F.lit("total").alias("attr"), F.round("prediction", 2).cast("string").alias("prediction")))


@query("majority_attack", f"""WITH {SPLIT}, seen AS (SELECT nation1, segment0, year1, coalesce(priority, '__MISSING__') AS v, count(*) AS n FROM tr GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nation1, segment0, year1 ORDER BY n DESC, v) AS rn FROM seen) WHERE rn = 1),
base AS (SELECT v AS b FROM (SELECT v, sum(n) AS n FROM seen GROUP BY v) ORDER BY n DESC, v LIMIT 1),
tried AS (SELECT coalesce(te.priority, '__MISSING__') AS truth, coalesce(best.v, b) AS guess, b FROM te LEFT JOIN best USING (nation1, segment0, year1), base)
SELECT count(*) AS rows, round(avg((truth = guess)::INT), 9) AS accuracy, round(avg((truth = b)::INT), 9) AS baseline_accuracy,
  round(avg((truth = guess)::INT) - avg((truth = b)::INT), 9) AS leakage_gap FROM tried""")
def majority_attack(spark, sf_dir):
    train, test = split_pub(spark, sf_dir)
    return rounded(A.majority_attack(train, test, ["nation__node", "segment__node", "year__node"], "priority"))


@query("mean_attack", f"""WITH {SPLIT}, g AS (SELECT nation1, segment0, avg(year) AS guess FROM tr GROUP BY ALL), b AS (SELECT avg(year) AS base FROM tr),
tried AS (SELECT year, coalesce(guess, base) AS guess, base FROM te LEFT JOIN g USING (nation1, segment0), b)
SELECT count(*) AS rows, round(avg((abs(year - guess) <= 1.5)::INT), 9) AS accuracy, round(avg((abs(year - base) <= 1.5)::INT), 9) AS baseline_accuracy,
  round(avg((abs(year - guess) <= 1.5)::INT) - avg((abs(year - base) <= 1.5)::INT), 9) AS leakage_gap FROM tried""")
def mean_attack(spark, sf_dir):
    train, test = split_pub(spark, sf_dir)
    return rounded(A.mean_attack(train, test, ["nation__node", "segment__node"], "year", 1.5))


@query("attack_summary", f"""WITH {PEOPLE}, b AS (
  SELECT 'nation' AS attr, count(*) AS rows, count(DISTINCT nation) AS classes, (SELECT max(n) FROM (SELECT count(*) AS n FROM pop GROUP BY nation)) / count(*) AS accuracy FROM pop
  UNION ALL SELECT 'segment', count(*), count(DISTINCT segment), (SELECT max(n) FROM (SELECT count(*) AS n FROM pop GROUP BY segment)) / count(*) FROM pop
  UNION ALL SELECT 'constant', count(*), 1, 1.0 FROM pop)
SELECT count(*) FILTER (WHERE classes >= 2) AS evaluated, count(*) FILTER (WHERE classes < 2) AS skipped,
  round(avg(accuracy) FILTER (WHERE classes >= 2), 9) AS mean_accuracy, round(1 - avg(accuracy) FILTER (WHERE classes >= 2), 9) AS mean_error FROM b""")
def attack_summary(spark, sf_dir):
    df = people(spark, sf_dir).withColumn("constant", F.lit("x"))
    parts = None
    for attr in ("nation", "segment", "constant"):
        sizes = df.groupBy(attr).agg(F.count(F.lit(1)).alias("n"))
        one = sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"),
                        (F.max("n") / F.sum("n")).alias("accuracy"))
        one = one.select(F.lit(attr).alias("attr"), "rows", "classes", F.lit(False).alias("numeric"), "accuracy")
        parts = one if parts is None else parts.unionByName(one)
    return rounded(A.attack_summary(parts))


# A score between 0 and 1 that the data itself provides.
SCORED = PEOPLE + ", s AS (SELECT label, total / 500000 AS p, CASE WHEN nation < '2' THEN year END AS a, year - 1 AS b FROM pop)"


def scored(spark, sf_dir):
    return people(spark, sf_dir).select(
        "label", (F.col("total") / 500000).alias("p"), F.when(F.col("nation") < "2", F.col("year")).alias("a"),
        (F.col("year") - 1).alias("b"), "segment", "priority", "nation")


@query("log_loss", f"WITH {SCORED} SELECT round(-avg(label * ln(p) + (1 - label) * ln(1 - p)), 6) AS log_loss FROM s")
def log_loss(spark, sf_dir):
    return M.log_loss(scored(spark, sf_dir), "label", "p").select(F.round("log_loss", 6).alias("log_loss"))


@query("log_loss_multiclass", f"""WITH {SCORED} SELECT round(-avg(ln(CASE label WHEN 0 THEN p / 2 ELSE 1 - p END / (p / 2 + p / 2 + (1 - p)))), 6) AS log_loss FROM s""")
def log_loss_multiclass(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("probs", F.array(F.col("p") / 2, 1 - F.col("p"), F.col("p") / 2))
    return M.log_loss_multiclass(df, "label", "probs").select(F.round("log_loss", 6).alias("log_loss"))


@query("model_accuracy", f"WITH {SCORED} SELECT round(avg(((p >= 0.5) = (label = 1))::INT), 9) AS accuracy FROM s")
def model_accuracy(spark, sf_dir):
    return rounded(M.model_accuracy(scored(spark, sf_dir), "label", "p"))


@query("model_accuracy_multiclass", f"WITH {SCORED} SELECT round(avg((CASE WHEN p / 2 >= 1 - p THEN 0 ELSE 1 END = label)::INT), 9) AS accuracy FROM s")
def model_accuracy_multiclass(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("probs", F.array(F.col("p") / 2, 1 - F.col("p"), F.col("p") / 2))
    return rounded(M.model_accuracy_multiclass(df, "label", "probs"))


@query("roc_auc", f"""WITH {PEOPLE}, r AS (SELECT label, rank() OVER (ORDER BY balance) + (count(*) OVER (PARTITION BY balance) - 1) / 2.0 AS rk FROM pop)
SELECT round((sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 9) AS roc_auc FROM r""")
def roc_auc(spark, sf_dir):
    return rounded(M.roc_auc(people(spark, sf_dir), "label", "balance"))


@query("numeric_accuracy", f"WITH {SCORED} SELECT round(avg(CASE WHEN a IS NOT NULL AND abs(a - b) <= 1 THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM s")
def numeric_accuracy(spark, sf_dir):
    return rounded(M.numeric_accuracy(scored(spark, sf_dir), "a", "b", 1.0))


@query("accuracy", f"""WITH {PEOPLE}, s AS (SELECT priority IS NOT DISTINCT FROM CASE WHEN segment > 'C' THEN '1-URGENT' END AS hit FROM pop)
SELECT round(avg(hit::INT), 9) AS accuracy, round(1 - avg(hit::INT), 9) AS error FROM s""")
def accuracy(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("guess", F.when(F.col("segment") > "C", "1-URGENT"))
    return rounded(M.accuracy(df, "priority", "guess"))
