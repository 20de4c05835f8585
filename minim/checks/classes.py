"""Equivalence classes and privacy metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from minim.checks import query
from minim.checks.tables import (
    PARTS, PARTS_QIS, PEOPLE, PEOPLE_LEVELS, QIS, parts, parts_forest, people, people_forest,
)
from minim.functions.ordering import seeded_key
from minim.operators import classes as C
from minim.operators.hierarchy import generalize

MID = {"nation": 1, "segment": 0, "priority": 1, "year": 1}
MID_SQL = "nation1 AS nation, segment0 AS segment, priority1 AS priority, year1 AS year"
TOP = {"nation": 1, "segment": 1, "priority": 1, "year": 2}
TOP_SQL = "nation1 AS nation, segment1 AS segment, priority1 AS priority, year2 AS year"
Q = ", ".join(QIS)


def mid(spark, sf_dir):
    return generalize(people(spark, sf_dir), people_forest(), MID)


MID_CTE = PEOPLE_LEVELS + f""", pub AS (
  SELECT row_id, {MID_SQL}, total, balance, label FROM gen)"""


@query("retention_classes", f"WITH {MID_CTE} SELECT {Q}, count(*) AS k FROM pub GROUP BY ALL")
def retention_classes(spark, sf_dir):
    return C.retention_classes(mid(spark, sf_dir), QIS)


@query("raw_classes", f"WITH {PEOPLE} SELECT {Q}, count(*) AS k FROM pop GROUP BY ALL")
def raw_classes(spark, sf_dir):
    return C.retention_classes(people(spark, sf_dir), QIS)


@query("class_index", f"""WITH {MID_CTE}
SELECT row_id, md5(coalesce(length(nation) || ':' || nation, '~') || coalesce(length(segment) || ':' || segment, '~') ||
       coalesce(length(priority) || ':' || priority, '~') || coalesce(length(CAST(year AS VARCHAR)) || ':' || year, '~')) AS class_id,
       count(*) OVER (PARTITION BY {Q}) AS k
FROM pub""")
def class_index(spark, sf_dir):
    return C.class_index(mid(spark, sf_dir), QIS)


@query("min_k", f"WITH {MID_CTE} SELECT min(k) AS min_k FROM (SELECT count(*) AS k FROM pub GROUP BY {Q})")
def min_k(spark, sf_dir):
    return C.min_k(mid(spark, sf_dir), QIS)


@query("per_record_k", f"WITH {MID_CTE} SELECT row_id, count(*) OVER (PARTITION BY {Q}) AS k FROM pub")
def per_record_k(spark, sf_dir):
    return C.per_record_k(mid(spark, sf_dir).select("row_id", *QIS), QIS).select("row_id", "k")


DISTRIBUTION = """
SELECT min(k) AS leak_k, round(quantile_cont(k, 0.01), 9) AS leak_k_p1,
  round(quantile_cont(k, 0.02), 9) AS leak_k_p2, round(quantile_cont(k, 0.03), 9) AS leak_k_p3,
  round(quantile_cont(k, 0.04), 9) AS leak_k_p4, round(quantile_cont(k, 0.05), 9) AS leak_k_p5,
  quantile_disc(k, 0.95) AS leak_k_95_percentile,
  (SELECT count(*) FROM cls) AS class_count,
  (SELECT count(*) FROM cls WHERE k = (SELECT min(k) FROM cls)) AS min_k_class_count,
  count(*) AS record_count
FROM per"""


def distribution_sql(cte: str, source: str, qis: str = Q) -> str:
    return f"""WITH {cte}, per AS (SELECT count(*) OVER (PARTITION BY {qis}) AS k FROM {source}),
cls AS (SELECT count(*) AS k FROM {source} GROUP BY {qis}){DISTRIBUTION}"""


def rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("k_distribution", distribution_sql(MID_CTE, "pub"))
def k_distribution(spark, sf_dir):
    return rounded(C.k_distribution(mid(spark, sf_dir), QIS))


@query("original_k", distribution_sql(PEOPLE, "pop"))
def original_k(spark, sf_dir):
    return rounded(C.k_distribution(people(spark, sf_dir), QIS))


@query("binned_k_level0", distribution_sql(
    PEOPLE_LEVELS + ", bins AS (SELECT nation0 AS nation, segment, priority, year0 AS year FROM gen)", "bins"))
def binned_k_level0(spark, sf_dir):
    levels = dict.fromkeys(QIS, 0)
    return rounded(C.k_distribution(generalize(people(spark, sf_dir), people_forest(), levels), QIS))


LINE_LEVELS = {"size": 1, "quantity": 0, "type": 1, "returnflag": 0}
LINE_CTE = PARTS + """, pub AS (
  SELECT CASE WHEN size <= 25 THEN '1 ~ 25' ELSE '26 ~ 50' END AS size,
    CAST(CAST(floor((quantity - 1) / 5) AS INTEGER) * 5 + 1 AS VARCHAR) || ' ~ '
      || CAST(CAST(floor((quantity - 1) / 5) AS INTEGER) * 5 + 5 AS VARCHAR) AS quantity,
    CASE WHEN type IN ('SMALL', 'MEDIUM') THEN 'compact' ELSE 'any' END AS type, returnflag
  FROM pop)"""


@query("line_k_distribution", distribution_sql(LINE_CTE, "pub", ", ".join(PARTS_QIS)))
def line_k_distribution(spark, sf_dir):
    return rounded(C.k_distribution(generalize(parts(spark, sf_dir), parts_forest(), LINE_LEVELS), PARTS_QIS))


@query("size_histogram", f"""WITH {MID_CTE}
SELECT k, count(*) AS class_count FROM (SELECT count(*) AS k FROM pub GROUP BY {Q}) GROUP BY k""")
def size_histogram(spark, sf_dir):
    return C.size_histogram(C.retention_classes(mid(spark, sf_dir), QIS))


@query("k_sorted_runs", f"""WITH {MID_CTE}, per AS (
  SELECT k, row_number() OVER (ORDER BY k) AS rk FROM (SELECT count(*) OVER (PARTITION BY {Q}) AS k FROM pub))
SELECT k, min(rk) AS first_rank, max(rk) AS last_rank FROM per GROUP BY k""")
def k_sorted_runs(spark, sf_dir):
    return C.k_sorted(C.size_histogram(C.retention_classes(mid(spark, sf_dir), QIS)))


RISK_SQL = """, ranked AS (
  SELECT risk, row_number() OVER (ORDER BY risk) AS rk FROM (
    SELECT CASE WHEN rel.k IS NULL THEN CAST('-infinity' AS DOUBLE) ELSE 0.0 - ln(rel.k) END AS risk
    FROM pop LEFT JOIN rel USING (row_id)))
SELECT round(risk, 9) AS tail_risk_p99, (SELECT count(*) FROM pop) AS population_size,
       (SELECT count(*) FROM rel) AS released_size
FROM ranked WHERE rk = CAST(ceil(0.99::DOUBLE * (SELECT count(*) FROM pop)) AS BIGINT)"""


@query("tail_risk", f"""WITH {MID_CTE}, per AS (
  SELECT row_id, count(*) OVER (PARTITION BY {Q}) AS k FROM pub),
rel AS (SELECT * FROM per WHERE k >= 20){RISK_SQL}""")
def tail_risk(spark, sf_dir):
    rows = mid(spark, sf_dir).select("row_id", *QIS)
    released = C.per_record_k(rows, QIS).where("k >= 20").select("row_id", "k")
    return rounded(C.tail_risk(people(spark, sf_dir).select("row_id"), released))


@query("original_tail_risk", f"""WITH {PEOPLE}, rel AS (
  SELECT row_id, count(*) OVER (PARTITION BY {Q}) AS k FROM pop){RISK_SQL}""")
def original_tail_risk(spark, sf_dir):
    pop = people(spark, sf_dir)
    released = C.per_record_k(pop.select("row_id", *QIS), QIS).select("row_id", "k")
    return rounded(C.tail_risk(pop.select("row_id"), released))


# Flags derived from the data: high-value orders are selected, negative balances are exempt.
FLAGS = "total > 250000 AS selected, balance < 0 AS exempt"


def flagged(spark, sf_dir):
    return mid(spark, sf_dir).select("*", (F.col("total") > 250000).alias("selected"),
                                     (F.col("balance") < 0).alias("exempt"))


@query("published_sizes", f"""WITH {MID_CTE}, f AS (SELECT *, {FLAGS} FROM pub)
SELECT {Q}, count(*) FILTER (WHERE (selected AND NOT exempt) OR exempt) AS k FROM f GROUP BY {Q}
HAVING count(*) FILTER (WHERE selected AND NOT exempt) > 0""")
def published_sizes(spark, sf_dir):
    return C.published_sizes(flagged(spark, sf_dir), QIS)


@query("subset_class_counts", f"""WITH {MID_CTE}, f AS (SELECT *, {FLAGS} FROM pub)
SELECT {Q}, count(*) AS k FROM f WHERE selected AND NOT exempt GROUP BY {Q}""")
def subset_class_counts(spark, sf_dir):
    return C.subset_class_counts(flagged(spark, sf_dir), QIS, F.col("selected"))


@query("privacy_signature", f"""WITH {MID_CTE}, cls AS (SELECT count(*) AS k FROM pub GROUP BY {Q})
SELECT min(k) AS min_k, -(SELECT count(*) FROM cls WHERE k = (SELECT min(k) FROM cls)) AS neg_min_classes FROM cls""")
def privacy_signature(spark, sf_dir):
    return C.privacy_signature(C.k_distribution(mid(spark, sf_dir), QIS))


@query("privacy_ratio", f"""WITH {PEOPLE_LEVELS}, k0 AS (
  SELECT row_id, count(*) OVER (PARTITION BY {Q}) AS k0 FROM pop),
k1 AS (SELECT row_id, count(*) OVER (PARTITION BY nation1, segment0, priority1, year1) AS k FROM gen)
SELECT k0, k, round(ln(k0) - ln(k), 9) AS privacy_ratio, count(*) AS rows
FROM k0 JOIN k1 USING (row_id) GROUP BY k0, k""")
def privacy_ratio(spark, sf_dir):
    from minim.functions.expressions import privacy_ratio as ratio
    rows = generalize(people(spark, sf_dir), people_forest(), MID, keep_raw=True)
    nodes = [f"{q}__node" for q in QIS]
    both = C.per_record_k(C.per_record_k(rows.select(*QIS, *nodes), QIS, "k0"), nodes, "k")
    return (both.groupBy("k0", "k").agg(F.count(F.lit(1)).alias("rows"))
            .select("k0", "k", F.round(ratio(F.col("k"), F.col("k0")), 9).alias("privacy_ratio"), "rows"))


@query("seeded_order", f"""WITH {PEOPLE}
SELECT row_id, row_number() OVER (ORDER BY md5('42:' || CAST(row_id AS VARCHAR))) - 1 AS row_pos FROM pop""")
def seeded_order(spark, sf_dir):
    from minim.operators.sampling import with_row_pos
    return with_row_pos(people(spark, sf_dir).select("row_id"), 42).select("row_id", "row_pos")


__all__ = ["MID", "MID_CTE", "QIS", "Q", "mid", "rounded", "seeded_key"]
