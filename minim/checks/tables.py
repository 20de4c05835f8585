"""The populations the checks run on, built from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minim.operators.clean import null_sentinels
from minim.operators.hierarchy import Hierarchy, Node, flat_hierarchy, nested_hierarchy

QIS = ("nation", "segment", "priority", "year")
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: four quasi-identifiers, two other features, a binary label.

    '4-NOT SPECIFIED' is this table's spelling of a missing priority.
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("row_id"),
        F.col("c_nationkey").cast("string").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("total"),
        F.col("c_acctbal").alias("balance"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
    )
    return null_sentinels(joined, {"priority": ("4-NOT SPECIFIED",)})


PEOPLE = """pop AS (
  SELECT o_orderkey AS row_id, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS priority,
         CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS total, c_acctbal AS balance,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

# The same rows with every quasi-identifier at levels 0, 1 and 2, written out by hand.
PEOPLE_LEVELS = PEOPLE + """, gen AS (
  SELECT pop.*, 'n' || nation AS nation0, 'r' || n_regionkey AS nation1, 'any' AS nation2,
         segment AS segment0, 'any' AS segment1,
         priority AS priority0,
         CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN priority IS NOT NULL THEN 'normal' END AS priority1,
         CASE WHEN priority IS NOT NULL THEN 'any' END AS priority2,
         CASE WHEN year <= 1996 THEN '1995 ~ 1996' WHEN year <= 1998 THEN '1997 ~ 1998'
              WHEN year <= 2000 THEN '1999 ~ 2000' ELSE '2001 ~ 2002' END AS year0,
         CASE WHEN year <= 1998 THEN 'early' ELSE 'late' END AS year1, 'any' AS year2
  FROM pop JOIN nation ON n_nationkey = CAST(nation AS INTEGER))"""


def people_forest() -> dict[str, Hierarchy]:
    regions = {f"r{r}": [] for r in range(5)}
    nodes = [Node("any", None)] + [Node(r, "any") for r in regions]
    nodes += [Node(f"n{n}", f"r{n % 5}", str(n)) for n in range(25)]
    return {
        "nation": Hierarchy("nation", nodes),
        "segment": flat_hierarchy(
            "segment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]),
        "priority": nested_hierarchy(
            "priority", {"high": ["1-URGENT", "2-HIGH"], "normal": ["3-MEDIUM", "5-LOW"]}),
        "year": nested_hierarchy(
            "year", {"early": ["1995 ~ 1996", "1997 ~ 1998"], "late": ["1999 ~ 2000", "2001 ~ 2002"]},
            numeric=True),
    }


PARTS_QIS = ("size", "quantity", "type", "returnflag")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with its part: two interval trees, one uneven tree, one flat tree."""
    lineitem = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    return lineitem.join(part, lineitem.l_partkey == part.p_partkey).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    F.col("l_quantity").cast("int"), F.date_format("l_shipdate", "yyyyMMdd"),
                    F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("row_id"),
        F.col("p_size").alias("size"),
        F.col("l_quantity").alias("quantity"),
        F.col("p_type").alias("type"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_discount") >= 0.05, 1).otherwise(0).alias("label"),
    )


PARTS = """pop AS (
  SELECT p_size AS size, l_quantity AS quantity, p_type AS type, l_returnflag AS returnflag,
         l_extendedprice AS price, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS label
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def fives(attr: str) -> Hierarchy:
    spans = [f"{a} ~ {a + 4}" for a in range(1, 51, 5)]
    return nested_hierarchy(attr, {"1 ~ 25": spans[:5], "26 ~ 50": spans[5:]}, numeric=True)


def parts_forest() -> dict[str, Hierarchy]:
    return {
        "size": fives("size"),
        "quantity": fives("quantity"),
        "type": nested_hierarchy(
            "type", [{"compact": ["SMALL", "MEDIUM"]}, "LARGE", "ECONOMY", "STANDARD", "PROMO"]),
        "returnflag": flat_hierarchy("returnflag", ["A", "N", "R"]),
    }
