"""Fixed partitions and Mondrian."""

from __future__ import annotations

from pyspark.sql import functions as F

from minim.checks import query
from minim.checks.classes import rounded
from minim.checks.tables import PARTS, PEOPLE, PEOPLE_LEVELS, QIS, SEED, parts, people, people_forest, table
from minim.operators import mondrian as M
from minim.operators import partitions as U

KEY = "md5('42:' || CAST(row_id AS VARCHAR))"
MONDRIAN_K = 25


@query("partition_sample", f"WITH {PEOPLE} SELECT row_id, row_id AS unit FROM pop")
def partition_sample(spark, sf_dir):
    return U.partition_sample(people(spark, sf_dir).select("row_id"))


@query("partition_random", f"WITH {PEOPLE} SELECT row_id, ntile(64) OVER (ORDER BY {KEY}) - 1 AS unit FROM pop")
def partition_random(spark, sf_dir):
    return U.partition_random(people(spark, sf_dir).select("row_id"), 64, SEED)


@query("rings", f"""WITH {PEOPLE}, p AS (SELECT row_id, segment, percent_rank() OVER (PARTITION BY segment ORDER BY balance) AS pr FROM pop)
SELECT row_id, least(CAST(floor(pr * 5) AS BIGINT), 4) AS ring FROM p""")
def rings(spark, sf_dir):
    df = people(spark, sf_dir).select("row_id", "segment", "balance")
    return U.rings(df, "segment", "balance", 5).select("row_id", "ring")


@query("partition_kmeans_ring")
def partition_kmeans_ring(spark, sf_dir):
    df = people(spark, sf_dir).select("row_id", "total", "balance")
    features = F.array(F.col("total") / 500000.0, F.col("balance") / 10000.0)
    return U.partition_kmeans_ring(df, features, 4, 3, SEED).select("row_id", "unit")


LEAF_ORDER = """coalesce(CAST(nation AS INTEGER) % 5 * 100 + CAST(nation AS INTEGER), 999), segment,
  coalesce(priority, 'Z'), year0"""


@query("partition_leaf_bucket", f"""WITH {PEOPLE_LEVELS}, o AS (
  SELECT row_id, row_number() OVER (ORDER BY {LEAF_ORDER}, {KEY}) - 1 AS i, count(*) OVER () AS n FROM gen)
SELECT row_id, least(i // 40, greatest(n // 40 - 1, 0)) AS unit FROM o""")
def partition_leaf_bucket(spark, sf_dir):
    return U.partition_leaf_bucket(people(spark, sf_dir), people_forest(), 40, SEED).select("row_id", "unit")


@query("validate_partition", f"WITH {PEOPLE} SELECT 0 AS overlapping, 0 AS uncovered, 0 AS unknown FROM pop LIMIT 1")
def validate_partition(spark, sf_dir):
    df = people(spark, sf_dir).select("row_id")
    return U.validate_partition(df, U.partition_random(df, 64, SEED))


@query("validate_faulty_partition", f"""WITH {PEOPLE} SELECT count(*) FILTER (WHERE segment = 'MACHINERY') AS overlapping,
  count(*) FILTER (WHERE segment = 'BUILDING') AS uncovered, count(*) FILTER (WHERE segment = 'FURNITURE') AS unknown FROM pop""")
def validate_faulty_partition(spark, sf_dir):
    """A plan without one segment's rows, with another's in two units, and with a third's under ids that no row has."""
    df = people(spark, sf_dir).select("row_id", "segment")
    units = U.partition_random(df, 64, SEED)
    twice = units.where("segment = 'MACHINERY'").withColumn("unit", F.col("unit") + 64)
    strange = units.where("segment = 'FURNITURE'").withColumn("row_id", -F.col("row_id") - 1)
    plan = units.where("segment <> 'BUILDING'").unionByName(twice).unionByName(strange)
    return U.validate_partition(df, plan)


@query("start_unit", f"""WITH {PEOPLE} SELECT segment AS unit, count(*) AS rows FROM pop GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def start_unit(spark, sf_dir):
    return U.start_unit(people(spark, sf_dir).select("row_id", F.col("segment").alias("unit")))


NUMERIC, CATEGORICAL = ("year", "total"), ("nation", "segment", "priority")


@query("mondrian_invariants", f"WITH {PEOPLE} SELECT count(*) AS covered_once, 0 AS uncovered, true AS all_at_least_k FROM pop")
def mondrian_invariants(spark, sf_dir):
    df = people(spark, sf_dir)
    return M.mondrian_invariants(df, M.mondrian(df, NUMERIC, CATEGORICAL, MONDRIAN_K), MONDRIAN_K)


@query("mondrian")
def mondrian(spark, sf_dir):
    return M.mondrian(people(spark, sf_dir), NUMERIC, CATEGORICAL, MONDRIAN_K).select("row_id", "partition")


MEDIAN_SQL = """, h AS (SELECT quantity, count(*) AS n FROM pop GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY quantity) AS upto, sum(n) OVER () AS total FROM h),
cut AS (SELECT quantity AS cut_at FROM c WHERE upto < total ORDER BY abs(upto - total / 2.0), upto LIMIT 1)"""


@query("mondrian_first_cut", f"""WITH {PARTS} {MEDIAN_SQL}
SELECT CASE WHEN quantity <= cut_at THEN 'L' ELSE 'R' END AS partition, count(*) AS rows, min(quantity) AS lo, max(quantity) AS hi
FROM pop, cut GROUP BY 1""")
def mondrian_first_cut(spark, sf_dir):
    df = parts(spark, sf_dir).select("quantity")
    # A k of a third of the rows allows one cut and no second one.
    out = M.mondrian(df, ("quantity",), (), df.count() // 3)
    return out.groupBy("partition").agg(F.count(F.lit(1)).alias("rows"), F.min("quantity").alias("lo"), F.max("quantity").alias("hi"))


@query("mondrian_recode", f"""WITH {PEOPLE}, s AS (SELECT segment AS partition, avg(year) AS year__pub,
  list_sort(list_distinct(list(priority))) AS priority__pub FROM pop GROUP BY 1)
SELECT row_id, round(year__pub, 9) AS year__pub, array_to_string(priority__pub, ',') AS priority__pub FROM pop JOIN s ON segment = partition""")
def mondrian_recode(spark, sf_dir):
    df = people(spark, sf_dir).withColumn("partition", F.col("segment"))
    out = M.mondrian_recode(df, ["year"], ["priority"])
    return out.select("row_id", F.round("year__pub", 9).alias("year__pub"), F.array_join("priority__pub", ",").alias("priority__pub"))


@query("partition_summary", f"""WITH {PEOPLE} SELECT nation AS partition, count(*) AS size, min(total) AS total__min, max(total) AS total__max,
  round(avg(total), 4) AS total__mean, array_to_string(list_sort(list_distinct(list(segment))), ',') AS segment__values FROM pop GROUP BY nation""")
def partition_summary(spark, sf_dir):
    out = M.partition_summary(people(spark, sf_dir).withColumn("partition", F.col("nation")), ["total"], ["segment"])
    return out.select("partition", "size", "total__min", "total__max", F.round("total__mean", 4).alias("total__mean"),
                      F.array_join("segment__values", ",").alias("segment__values"))


CUSTOMER_SETS = """d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders WHERE o_custkey IS NOT NULL)),
p AS (SELECT DISTINCT o_orderpriority AS partition, CAST(o_custkey AS VARCHAR) AS v FROM orders WHERE o_custkey IS NOT NULL)"""


def _customers(spark, sf_dir):
    """Orders by priority, with the customer as a category of many values."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("partition"), F.col("o_custkey").cast("string").alias("customer"))


@query("partition_value_bits", f"""WITH {CUSTOMER_SETS}
SELECT partition, code // 63 AS chunk, bit_or(1::BIGINT << (code % 63)) AS bits FROM p JOIN d USING (v) GROUP BY 1, 2""")
def partition_value_bits(spark, sf_dir):
    out = M.partition_summary(_customers(spark, sf_dir), [], ["customer"], sets=M.BITS)
    return out.select("partition", F.explode("customer__bits").alias("c")).select("partition", "c.chunk", "c.bits")


@query("partition_set_members", f"""WITH {CUSTOMER_SETS}
SELECT partition, v AS value, 1.0::DOUBLE / count(*) OVER (PARTITION BY partition) AS weight FROM p""")
def partition_set_members(spark, sf_dir):
    df = _customers(spark, sf_dir)
    dictionary = M.value_dictionary(df, "customer")
    return M.set_members(M.value_chunks(df, "customer", dictionary), "customer", dictionary)


__all__ = ["QIS", "rounded"]
