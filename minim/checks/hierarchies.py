"""Hierarchies and generalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from minim.checks import query
from minim.checks.classes import MID, MID_CTE, Q, rounded
from minim.checks.tables import (
    PARTS, PEOPLE, PEOPLE_LEVELS, QIS, parts, parts_forest, people, people_forest, table,
)
from minim.operators import hierarchy as H
from minim.operators.clean import stack_columns


def places(spark, sf_dir):
    """Customers under nations under regions: a tree that grows with the table."""
    df = (table(spark, sf_dir, "customer")
          .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
          .select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"),
                  F.col("c_custkey").alias("customer")))
    return H.hierarchy_from_columns(df, "place", ["region", "nation", "customer"])


PLACES = """dim AS (SELECT n_regionkey AS region, n_nationkey AS nation, c_custkey AS customer
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
chain AS (SELECT 'customer:' || customer AS leaf_id, ['customer:' || customer, 'nation:' || nation, 'region:' || region, 'any'] AS path FROM dim)"""


@query("hierarchy_nodes", f"""WITH {PLACES}
SELECT 'place' AS attr, 'any' AS node_id, NULL AS parent, 'root' AS kind, NULL AS value, count(*) AS leaf_count, 0 AS depth, 3 AS height FROM dim
UNION ALL SELECT 'place', 'region:' || region, 'any', 'internal', NULL, count(*), 1, 2 FROM dim GROUP BY region
UNION ALL SELECT 'place', 'nation:' || nation, 'region:' || region, 'internal', NULL, count(*), 2, 1 FROM dim GROUP BY nation, region
UNION ALL SELECT 'place', 'customer:' || customer, 'nation:' || nation, 'leaf', CAST(customer AS VARCHAR), 1, 3, 0 FROM dim""")
def hierarchy_nodes(spark, sf_dir):
    return places(spark, sf_dir)


@query("hierarchy_closure", f"""WITH {PLACES}
SELECT leaf_id, unnest(path) AS ancestor_id, unnest([0, 1, 2, 3]) AS up, unnest([0, 1, 2, 3]) AS height FROM chain""")
def hierarchy_closure(spark, sf_dir):
    return H.hierarchy_closure(places(spark, sf_dir)).select("leaf_id", "ancestor_id", "up", "height")


@query("level_map", f"WITH {PLACES} SELECT 'place' AS attr, leaf_id, path[3] AS target_id FROM chain")
def level_map(spark, sf_dir):
    return H.level_map(H.hierarchy_closure(places(spark, sf_dir)), {"place": 2})


@query("level_map_uneven", f"""WITH {PARTS}, brand AS (SELECT DISTINCT p_brand AS brand, p_type AS type FROM part),
leafs AS (SELECT DISTINCT type FROM brand)
SELECT type AS leaf, CASE WHEN type IN ('SMALL', 'MEDIUM') THEN 'compact' ELSE 'any' END AS target FROM leafs""")
def level_map_uneven(spark, sf_dir):
    tree = parts_forest()["type"]
    df = table(spark, sf_dir, "part").select(F.col("p_type").alias("type")).distinct()
    return df.select(F.col("type").alias("leaf"), H.generalize_value(df, tree, 1).alias("target"))


@query("level_map_uneven_closure", """WITH l AS (SELECT DISTINCT p_type AS leaf FROM part), v AS (SELECT unnest([0, 1, 2]) AS level)
SELECT level, leaf AS leaf_id, CASE WHEN level = 0 THEN leaf WHEN level = 1 AND leaf IN ('SMALL', 'MEDIUM') THEN 'compact' ELSE 'any' END AS target_id FROM l, v
WHERE leaf IN ('SMALL', 'MEDIUM', 'LARGE', 'ECONOMY', 'STANDARD', 'PROMO')""")
def level_map_uneven_closure(spark, sf_dir):
    """The closure of an uneven tree at every level: a leaf right below the root jumps to it. Leaves of the given table only."""
    nodes = H.node_table(spark, {"type": parts_forest()["type"]})
    closure = H.hierarchy_closure(nodes)
    there = table(spark, sf_dir, "part").select(F.col("p_type").alias("value")).distinct()
    leaves = nodes.where("kind = 'leaf'").join(there, "value").select(F.col("node_id").alias("leaf_id"), "value")
    parts = [H.level_map(closure, {"type": v}).join(leaves, "leaf_id").select(F.lit(v).alias("level"), F.col("value").alias("leaf_id"), "target_id") for v in (0, 1, 2)]
    return parts[0].union(parts[1]).union(parts[2])


@query("max_levels", f"WITH {PLACES} SELECT 'place' AS attr, max(len(path)) - 1 AS max_level FROM chain")
def max_levels(spark, sf_dir):
    return H.max_level_table(places(spark, sf_dir))


def spans(spark, sf_dir):
    """An interval tree over part keys: one leaf of ten keys per block, leaves under brands."""
    part = table(spark, sf_dir, "part")
    block = F.floor(F.col("p_partkey") / 10)
    df = part.groupBy(block.alias("block")).agg(F.min("p_brand").alias("brand"))
    nodes = H.hierarchy_from_columns(df, "key", ["brand", "block"])
    lo = (F.col("value").cast("double") * 10)
    return nodes.select("*", F.when(F.col("kind") == "leaf", lo).alias("lo"),
                        F.when(F.col("kind") == "leaf", lo + 9).alias("hi"))


SPANS = """blocks AS (SELECT p_partkey // 10 AS block, min(p_brand) AS brand FROM part GROUP BY 1),
spans AS (SELECT block, brand, block * 10 AS lo, block * 10 + 9 AS hi FROM blocks)"""


@query("numeric_value", f"""WITH {SPANS}, ints AS (SELECT block, brand, unnest(range(lo, hi + 1)) AS v FROM spans)
SELECT 'key' AS attr, 'block:' || block AS node_id, avg(v) AS value FROM ints GROUP BY block
UNION ALL SELECT 'key', 'brand:' || brand, round(avg(v), 9) FROM ints GROUP BY brand
UNION ALL SELECT 'key', 'any', avg(v) FROM ints""")
def numeric_value(spark, sf_dir):
    nodes = spans(spark, sf_dir)
    return rounded(H.numeric_values(H.hierarchy_closure(nodes), nodes.where("kind = 'leaf'")))


@query("category_vector", f"""WITH {PLACES}, pairs AS (SELECT unnest(path) AS node_id, leaf_id FROM chain)
SELECT 'place' AS attr, node_id, leaf_id, round(1.0 / count(*) OVER (PARTITION BY node_id), 9) AS weight FROM pairs""")
def category_vector(spark, sf_dir):
    return rounded(H.category_vectors(H.hierarchy_closure(places(spark, sf_dir))))


@query("assign_leaf_categorical", f"""WITH {PEOPLE_LEVELS} SELECT nation, nation0 AS leaf, count(*) AS n FROM gen GROUP BY ALL""")
def assign_leaf_categorical(spark, sf_dir):
    tree = {"nation": people_forest()["nation"]}
    rows = H.assign_leaves(people(spark, sf_dir), tree)
    leaf = H.at(tree["nation"].leaves, F.col("nation__leaf"), "string")
    return rows.groupBy("nation", leaf.alias("leaf")).agg(F.count(F.lit(1)).alias("n"))


@query("assign_leaf_numeric", f"""WITH {PARTS}, leafs AS (
  SELECT a AS lo, a + 4 AS hi, a || ' ~ ' || (a + 4) AS leaf FROM (SELECT unnest(range(1, 51, 5)) AS a))
SELECT size, leaf, count(*) AS n FROM pop JOIN leafs ON size BETWEEN lo AND hi GROUP BY ALL""")
def assign_leaf_numeric(spark, sf_dir):
    tree = {"size": parts_forest()["size"]}
    rows = H.assign_leaves(parts(spark, sf_dir), tree)
    leaf = H.at(tree["size"].leaves, F.col("size__leaf"), "string")
    return rows.groupBy("size", leaf.alias("leaf")).agg(F.count(F.lit(1)).alias("n"))


@query("interval_range_join", f"""WITH {SPANS} SELECT 'block:' || block AS node_id, count(*) AS n, min(l_partkey) AS first_key
FROM lineitem JOIN spans ON l_partkey BETWEEN lo AND hi GROUP BY ALL""")
def interval_range_join(spark, sf_dir):
    leaves = spans(spark, sf_dir).where("kind = 'leaf'").select("node_id", "lo", "hi")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey")
    return (H.value_ranges(leaves, lines, "l_partkey", 10.0)
            .groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("first_key")))


@query("generalize", f"WITH {MID_CTE} SELECT row_id, {Q} FROM pub")
def generalize(spark, sf_dir):
    return H.generalize(people(spark, sf_dir), people_forest(), MID).select("row_id", *QIS)


@query("generalize_uneven", f"""WITH {PARTS} SELECT CASE WHEN type IN ('SMALL', 'MEDIUM') THEN 'compact' ELSE 'any' END AS type,
  CASE WHEN size <= 25 THEN '1 ~ 25' ELSE '26 ~ 50' END AS size, count(*) AS n FROM pop GROUP BY 1, 2""")
def generalize_uneven(spark, sf_dir):
    out = H.generalize(parts(spark, sf_dir), parts_forest(), {"type": 1, "size": 1})
    return out.groupBy("type", "size").agg(F.count(F.lit(1)).alias("n"))


@query("generalize_value", f"WITH {PEOPLE_LEVELS} SELECT row_id, year1 AS published FROM gen")
def generalize_value(spark, sf_dir):
    df = people(spark, sf_dir)
    return df.select("row_id", H.generalize_value(df, people_forest()["year"], 1).alias("published"))


@query("out_of_domain", f"""WITH {PEOPLE} SELECT 'segment' AS attr, segment AS value, count(*) AS n FROM pop
WHERE segment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') GROUP BY segment
UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM pop WHERE year > 1998 GROUP BY year""")
def out_of_domain(spark, sf_dir):
    forest = {
        "segment": H.flat_hierarchy("segment", ["AUTOMOBILE", "BUILDING", "FURNITURE"]),
        "year": H.nested_hierarchy("year", {"early": ["1995 ~ 1996", "1997 ~ 1998"]}, numeric=True),
    }
    return H.out_of_domain(people(spark, sf_dir), forest)


@query("audit_hierarchy", """WITH dim AS (SELECT DISTINCT p_type AS t, p_brand AS b FROM part),
seen AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS v FROM part)
-- Brands hang under several types: each extra type is a duplicate node id.
SELECT 'brand' AS attr, 'duplicate_leaf' AS rule, count(*) AS n FROM (SELECT b FROM dim GROUP BY b HAVING count(*) > 1)
UNION ALL SELECT 'brand', 'duplicate_node', count(*) FROM (SELECT b FROM dim GROUP BY b HAVING count(*) > 1)
UNION ALL SELECT 'brand', 'uncovered_value', count(*) FROM seen""")
def audit_hierarchy(spark, sf_dir):
    # Built wrongly on purpose: brands are not nested in types, and part sizes are no brands.
    part = table(spark, sf_dir, "part")
    dim = part.select("p_type", "p_brand").distinct()
    top = dim.select(F.lit("any").alias("node_id"), F.lit(None).cast("string").alias("parent"),
                     F.lit("root").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("depth")).distinct()
    middle = dim.select(F.col("p_type").alias("node_id"), F.lit("any").alias("parent"), F.lit("internal").alias("kind"),
                        F.lit(None).cast("string").alias("value"), F.lit(1).alias("depth")).distinct()
    leaves = dim.select(F.col("p_brand").alias("node_id"), F.col("p_type").alias("parent"), F.lit("leaf").alias("kind"),
                        F.col("p_brand").alias("value"), F.lit(2).alias("depth"))
    nodes = top.unionByName(middle).unionByName(leaves).select(F.lit("brand").alias("attr"), "*", (2 - F.col("depth")).alias("height"))
    observed = stack_columns(part.select(F.col("p_size").alias("brand")), ["brand"])
    return H.audit_hierarchy(nodes, observed)


@query("group_lca", f"""WITH {PEOPLE_LEVELS}
SELECT balance, count(*) AS n,
  CASE WHEN count(priority0) = 0 THEN NULL WHEN count(DISTINCT priority0) = 1 THEN min(priority0)
       WHEN count(DISTINCT priority1) = 1 THEN min(priority1) ELSE 'any' END AS priority__lca,
  CASE WHEN count(DISTINCT year0) = 1 THEN min(year0) WHEN count(DISTINCT year1) = 1 THEN min(year1) ELSE 'any' END AS year__lca
FROM gen GROUP BY balance""")
def group_lca(spark, sf_dir):
    forest = people_forest()
    return H.group_ancestors(people(spark, sf_dir), ["balance"], {a: forest[a] for a in ("priority", "year")})


@query("group_information_loss", f"""WITH {PEOPLE_LEVELS}, g AS (
SELECT balance, count(*) AS n,
  CASE WHEN count(priority0) = 0 THEN 0 WHEN count(DISTINCT priority0) = 1 THEN 0 WHEN count(DISTINCT priority1) = 1 THEN 1.0 / 3 ELSE 1 END
  + CASE WHEN count(DISTINCT year0) = 1 THEN 0 WHEN count(DISTINCT year1) = 1 THEN 1.0 / 3 ELSE 1 END AS loss
FROM gen GROUP BY balance)
SELECT balance, n, round(CAST(loss AS DOUBLE), 9) AS loss, round(CAST(loss * n AS DOUBLE), 6) AS total_loss FROM g""")
def group_information_loss(spark, sf_dir):
    forest = people_forest()
    out = H.group_information_loss(people(spark, sf_dir), ["balance"], {a: forest[a] for a in ("priority", "year")})
    return out.select("balance", "n", F.round("loss", 9).alias("loss"), F.round("total_loss", 6).alias("total_loss"))
