"""Splits, samples, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from minim.checks import query
from minim.checks.tables import PEOPLE, SEED, people, table
from minim.operators import sampling as P

KEY = "md5('42:' || CAST(row_id AS VARCHAR))"

SPLIT_CTE = f"""ranked AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {KEY}) AS rn,
  count(*) OVER (PARTITION BY label) AS n FROM pop),
quota AS (SELECT DISTINCT label, CAST(floor(0.15::DOUBLE * n + 0.5) AS BIGINT) AS t, n FROM ranked),
quota2 AS (SELECT label, t, CAST(floor((0.15::DOUBLE / (1.0::DOUBLE - 0.15::DOUBLE)) * (n - t) + 0.5) AS BIGINT) AS v FROM quota),
split AS (SELECT row_id, ranked.label, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + v THEN 'val' ELSE 'train' END AS split
  FROM ranked JOIN quota2 ON ranked.label = quota2.label)"""


@query("stratified_split", f"WITH {PEOPLE}, {SPLIT_CTE} SELECT row_id, label, split FROM split")
def stratified_split(spark, sf_dir):
    df = people(spark, sf_dir).select("row_id", "label")
    return P.stratified_split(df, "label", 0.15, 0.15, SEED)


@query("label_covering_sample", """WITH r AS (
  SELECT doc_id, quality * 2 + toxic AS label, md5('42:' || CAST(doc_id AS VARCHAR)) AS h FROM labels),
c AS (SELECT label, count(*) AS n, 20.0 * count(*) / (SELECT count(*) FROM r) AS ideal FROM r GROUP BY label),
q0 AS (SELECT *, least(n, greatest(1, CAST(floor(ideal) AS BIGINT))) AS q FROM c),
-- One unit per label at most is missing after flooring, so the deficit is a single ranking.
q1 AS (SELECT label, q + CASE WHEN row_number() OVER (ORDER BY ideal - q DESC, label)
       <= 20 - (SELECT sum(q) FROM q0) THEN 1 ELSE 0 END AS q FROM q0),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS rn FROM r)
SELECT doc_id, k.label FROM k JOIN q1 ON k.label = q1.label WHERE rn <= q""")
def label_covering_sample(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("label"))
    return P.label_covering_sample(df, "label", 20, SEED, "doc_id")


@query("label_coverage", """SELECT DISTINCT source FROM documents
WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""")
def label_coverage(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1")
    return P.missing_labels(documents, documents.join(toxic, "doc_id", "left_semi"), "source")


@query("folds", f"""WITH {PEOPLE}, r AS (SELECT row_id, row_number() OVER (ORDER BY {KEY}) - 1 AS p, count(*) OVER () AS n FROM pop)
SELECT row_id, CAST(CASE WHEN p < (n % 7) * (n // 7 + 1) THEN p // (n // 7 + 1)
  ELSE n % 7 + (p - (n % 7) * (n // 7 + 1)) // (n // 7) END AS BIGINT) AS fold FROM r""")
def folds(spark, sf_dir):
    return P.fold(people(spark, sf_dir).select("row_id"), 7, None, SEED)


@query("query_sample", f"WITH {PEOPLE} SELECT row_id FROM pop ORDER BY {KEY} LIMIT 100")
def query_sample(spark, sf_dir):
    # The limit is the operator: a random query set of fixed size.
    return P.query_sample(people(spark, sf_dir).select("row_id"), 100, SEED)


@query("first_rows_per_class", f"""WITH {PEOPLE} SELECT row_id, segment, priority FROM (
  SELECT *, row_number() OVER (PARTITION BY segment, priority ORDER BY {KEY}) AS rn FROM pop) WHERE rn <= 37""")
def first_rows_per_class(spark, sf_dir):
    from minim.functions.ordering import seeded_key
    from minim.operators.keyed import first_rows
    rows = people(spark, sf_dir).select("row_id", "segment", "priority", seeded_key(SEED, "row_id").alias("_key"))
    return first_rows(rows, ["segment", "priority"], "_key", 37).drop("_key")
