"""Projection, cleaning, encoding and row identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from minim.checks import query
from minim.checks.tables import PEOPLE, QIS, people, table
from minim.operators import clean as K
from minim.sources.domains import compress_runs, qi_domains
from minim.spec import DatasetSpec

ORDERS = DatasetSpec(
    name="orders",
    features=("o_orderpriority", "o_totalprice"),
    qis=("o_orderpriority",),
    numeric=("o_totalprice",),
    label="o_orderstatus",
    label_values={"F": 0, "O": 1, "P": 1},
    sentinels={"o_orderpriority": ("4-NOT SPECIFIED",)},
    entity="o_custkey",
    order_in_entity="o_orderdate",
    string_categories=("o_orderpriority",),
)


@query("select_features", "SELECT o_orderpriority, o_totalprice, o_orderkey FROM orders")
def select_features(spark, sf_dir):
    return K.select_features(table(spark, sf_dir, "orders"), ORDERS, extra=("o_orderkey",))


@query("map_label", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS o_orderstatus FROM orders""")
def map_label(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return K.map_label(df, "o_orderstatus", ORDERS.label_values)


@query("null_sentinels", """SELECT event_id, nullif(nullif(event_type, 'error'), 'signup') AS event_type FROM events""")
def null_sentinels(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    return K.null_sentinels(df, {"event_type": ("error", "signup")})


@query("coerce_numeric", """SELECT event_id, TRY_CAST(props AS DOUBLE) AS props, TRY_CAST(event_type AS DOUBLE) AS event_type,
  TRY_CAST(CASE WHEN user_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value FROM events""")
def coerce_numeric(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        "event_id", "props", "event_type", F.when(F.col("user_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"))
    return K.coerce_numeric(df, ["props", "event_type", "value"])


@query("trim_text", "SELECT doc_id, trim('  ' || text || ' ') AS text, trim(source || '   ') AS source FROM documents")
def trim_text(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"), F.concat("source", F.lit("   ")).alias("source"))
    return K.trim_text(df, ["text", "source"])


@query("category_dictionary", f"""WITH {PEOPLE}, codes AS (
  SELECT 'nation' AS attr, nation AS v FROM pop UNION SELECT 'segment', segment FROM pop
  UNION SELECT 'priority', priority FROM pop UNION SELECT 'year', CAST(year AS VARCHAR) FROM pop)
SELECT attr, v AS category, row_number() OVER (PARTITION BY attr
  ORDER BY TRY_CAST(v AS DOUBLE) IS NULL, TRY_CAST(v AS DOUBLE), v) - 1 AS idx
FROM codes WHERE v IS NOT NULL""")
def category_dictionary(spark, sf_dir):
    return K.category_dictionary(people(spark, sf_dir), QIS)


@query("first_per_entity", """SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def first_per_entity(spark, sf_dir):
    first = K.first_per_entity(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return first.select("user_id", "event_id", "event_type", "value")


@query("limit_after_dedup", """SELECT o_custkey, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
WHERE rn = 1 ORDER BY o_orderkey LIMIT 500""")
def limit_after_dedup(spark, sf_dir):
    # The limit is the operator: the first rows in source order, taken after deduplication.
    first = K.first_per_entity(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return K.limit_rows(first, 500, "o_orderkey").select("o_custkey", "o_orderkey")


@query("dedup_audit", """SELECT count(*) AS input_rows, count(DISTINCT o_custkey) AS unique_rows,
  count(*) - count(DISTINCT o_custkey) AS removed_rows FROM orders""")
def dedup_audit(spark, sf_dir):
    return K.dedup_audit(table(spark, sf_dir, "orders"), "o_custkey")


@query("preprocess", """SELECT nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority, o_totalprice,
  o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
WHERE rn = 1""")
def preprocess(spark, sf_dir):
    return K.preprocess(table(spark, sf_dir, "orders"), ORDERS, "o_orderkey")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


@query("one_hot", f"WITH {PEOPLE} SELECT row_id, " + ", ".join(
    f"CASE WHEN {a} = '{c}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"{a}={c}\""
    for a, cs in (("segment", SEGMENTS), ("priority", PRIORITIES)) for c in cs) + " FROM pop")
def one_hot(spark, sf_dir):
    df = people(spark, sf_dir).select("row_id", "segment", "priority")
    return K.one_hot(df, {"segment": SEGMENTS, "priority": PRIORITIES})


@query("fit_standardizer", f"""WITH {PEOPLE}
SELECT 'total' AS attr, round(avg(total), 4) AS mean, round(stddev_pop(total), 4) AS std FROM pop
UNION ALL SELECT 'balance', round(avg(balance), 4), round(stddev_pop(balance), 4) FROM pop""")
def fit_standardizer(spark, sf_dir):
    out = K.fit_standardizer(people(spark, sf_dir), ["total", "balance"])
    return out.select("attr", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("standardize", f"""WITH {PEOPLE}, s AS (SELECT avg(total) m, stddev_pop(total) d FROM pop)
SELECT row_id, round((total - m) / d, 6) AS total FROM pop, s""")
def standardize(spark, sf_dir):
    df = people(spark, sf_dir).select("row_id", "total")
    return K.standardize(df, K.fit_standardizer(df, ["total"])).select("row_id", F.round("total", 6).alias("total"))


@query("duplicate_ids", """SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def duplicate_ids(spark, sf_dir):
    return K.duplicate_ids(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("overlap_report", """WITH a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R')
SELECT count(*) FILTER (WHERE b.id IS NULL) AS left_only, count(*) FILTER (WHERE a.id IS NULL) AS right_only,
  count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS both
FROM a FULL JOIN b ON a.id = b.id""")
def overlap_report(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("row_id"), "l_returnflag")
    return K.overlap_report(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"))


@query("table_fingerprint")
def table_fingerprint(spark, sf_dir):
    return K.table_fingerprint(people(spark, sf_dir))


@query("qi_domains", f"""WITH {PEOPLE}, codes AS (
  SELECT 'nation' AS attr, 'categorical' AS kind, CAST(nation AS BIGINT) AS c FROM pop UNION SELECT 'year', 'discrete', year FROM pop),
island AS (SELECT *, c - row_number() OVER (PARTITION BY attr ORDER BY c) AS g, count(*) OVER (PARTITION BY attr) AS n FROM codes),
texts AS (SELECT 'segment' AS attr, segment AS v FROM pop UNION SELECT 'priority', priority FROM pop WHERE priority IS NOT NULL)
SELECT attr, kind, any_value(n) AS distinct_values, row_number() OVER (PARTITION BY attr ORDER BY min(c)) - 1 AS position,
  CASE WHEN min(c) = max(c) THEN CAST(min(c) AS VARCHAR) ELSE min(c) || '-' || max(c) END AS run FROM island GROUP BY attr, kind, g
UNION ALL SELECT attr, 'categorical', count(*) OVER (PARTITION BY attr), row_number() OVER (PARTITION BY attr ORDER BY v) - 1, v FROM texts
UNION ALL SELECT 'total', 'continuous', count(DISTINCT total), 0, CAST(min(total) AS VARCHAR) || ' ~ ' || CAST(max(total) AS VARCHAR) FROM pop""")
def qi_domain_export(spark, sf_dir):
    spec = DatasetSpec(name="people", features=("nation", "segment", "priority", "year", "total"),
                       qis=("nation", "segment", "priority", "year", "total"), numeric=("year", "total"),
                       continuous=("total",))
    return qi_domains(people(spark, sf_dir), spec)


@query("compress_runs", """WITH v AS (SELECT DISTINCT o_custkey AS c FROM orders),
g AS (SELECT c, c - row_number() OVER (ORDER BY c) AS island FROM v)
SELECT min(c) AS first_code, max(c) AS last_code,
  CASE WHEN min(c) = max(c) THEN CAST(min(c) AS VARCHAR) ELSE CAST(min(c) AS VARCHAR) || '-' || CAST(max(c) AS VARCHAR) END AS run
FROM g GROUP BY island""")
def runs(spark, sf_dir):
    return compress_runs(table(spark, sf_dir, "orders"), "o_custkey")
