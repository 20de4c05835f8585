"""File sources and sinks: given tables written as files by Spark and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from minim.checks import query
from minim.checks.tables import table
from minim.session import Scratch
from minim.sources import files
from minim.spec import DatasetSpec

ORDERS = DatasetSpec(name="orders", features=("o_orderkey", "o_totalprice", "o_orderpriority"), qis=("o_orderpriority",),
                     numeric=("o_orderkey", "o_totalprice"), label="o_orderstatus")

# Buckets of unequal size: one holds half of the rows, each next one half as many.
_BUCKET_SQL = "CAST(floor(log2(o_orderkey % 1024 + 1)) AS INTEGER)"


def _bucketed(spark, sf_dir, columns):
    """Orders as one folder of text rows per bucket, in key order inside."""
    rows = table(spark, sf_dir, "orders").withColumn("bucket", F.floor(F.log2(F.col("o_orderkey") % 1024 + 1)).cast("int"))
    return rows.repartition(16, "bucket").sortWithinPartitions("bucket", "o_orderkey").select("bucket", *columns)


@query("read_xy", f"""SELECT row_number() OVER (ORDER BY {_BUCKET_SQL}::VARCHAR, o_orderkey) - 1 AS row_id,
  CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders""")
def read_xy(spark, sf_dir):
    path = Scratch(spark, "xy").path
    _bucketed(spark, sf_dir, ORDERS.features).write.partitionBy("bucket").option("header", True).csv(f"{path}/x")
    # The label side has the same files in the same order, of other sizes in bytes.
    _bucketed(spark, sf_dir, ["o_custkey", "o_orderstatus"]).write.partitionBy(
        "bucket").option("header", True).csv(f"{path}/y")
    out = files.read_xy(spark, f"{path}/x/*", f"{path}/y/*", ORDERS)
    return out.select("row_id", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


@query("read_labelled_csv", f"""SELECT row_number() OVER (ORDER BY {_BUCKET_SQL}::VARCHAR, o_orderkey) - 1 AS row_id,
  CAST(o_orderkey AS DOUBLE) AS o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderpriority, o_orderstatus
FROM orders""")
def read_labelled_csv(spark, sf_dir):
    path = Scratch(spark, "csv").path
    price = F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice")
    rows = _bucketed(spark, sf_dir, ["o_orderkey", price, "o_orderpriority", "o_orderstatus"])
    rows.write.partitionBy("bucket").option("header", True).option("sep", ";").csv(path)
    out = files.read_labelled_csv(spark, f"{path}/*", ORDERS)
    return out.select("row_id", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


@query("read_arff", """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, CAST(o_orderkey AS DOUBLE) AS "order key",
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE '@' || o_orderpriority END AS priority, o_totalprice AS price FROM orders""")
def read_arff(spark, sf_dir):
    """Data lines begin with `@` or with the missing mark; header, comments and data are files in name order."""
    path = Scratch(spark, "arff").path
    orders = table(spark, sf_dir, "orders")
    head = ["% orders", "@relation orders", "@attribute priority {a,'b c'}", "@ATTRIBUTE 'order key' numeric", "@attribute price real", "", "@DATA"]
    # One row of the given table carries the header, so that it is a file of its own.
    one = orders.limit(1).select(F.explode(F.array(*[F.lit(x) for x in head])).alias("value"))
    one.coalesce(1).write.text(f"{path}/0")
    priority = F.when(F.col("o_orderkey") % 11 == 0, "?").otherwise(F.concat(F.lit("'@"), "o_orderpriority", F.lit("'")))
    line = F.concat_ws(",", priority, F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"))
    value = F.when(F.col("o_orderkey") % 100 == 0, F.array(F.lit("% a comment"), line)).otherwise(F.array(line))
    (orders.repartitionByRange(7, "o_orderkey").sortWithinPartitions("o_orderkey").select(F.explode(value).alias("value"))
     .write.text(f"{path}/1"))
    return files.read_arff(spark, f"{path}/*").select("row_id", "order key", "priority", "price")


@query("read_hierarchies", """WITH node AS (
  SELECT 'any' AS node_id, NULL AS parent, NULL AS value UNION ALL SELECT 'r' || r_regionkey, 'any', NULL FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CAST(n_nationkey AS VARCHAR) FROM nation)
SELECT 'nation' AS attr, node_id, parent, value FROM node""")
def read_hierarchies(spark, sf_dir):
    """The nation tree, written as one JSON document by Spark."""
    path = Scratch(spark, "trees").path
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    regions = region.select(F.struct(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("any").alias("parent"), F.lit(None).cast("string").alias("value")).alias("n"))
    nations = nation.select(F.struct(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"),
                                     F.col("n_nationkey").cast("string").alias("value")).alias("n"))
    root = region.limit(1).select(F.struct(F.lit("any").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("value")).alias("n"))
    # A hierarchy has a bounded number of nodes.
    nodes = root.union(regions).union(nations).agg(F.collect_list("n").alias("nodes"))
    (nodes.select(F.to_json(F.struct(F.struct(F.struct("nodes").alias("nation")).alias("trees")), {"ignoreNullFields": "false"}).alias("value"))
     .coalesce(1).write.text(path))
    name = [r[0] for r in spark.read.text(path).select("_metadata.file_path").distinct().collect()]
    spec = DatasetSpec(name="t", features=("nation",), qis=("nation",), string_categories=("nation",))
    # The reader tells JSON by the name of the path.
    spark.read.text(name[0]).coalesce(1).write.text(f"{path}.json")
    found, _ = files.read_hierarchies(spark, f"{path}.json", spec)
    return found.select("attr", "node_id", "parent", "value")


@query("read_results", """SELECT o_orderpriority AS method, CAST(count(*) AS VARCHAR) AS k, 'csv' AS seed FROM orders GROUP BY 1
UNION ALL SELECT o_orderstatus, CAST(count(*) AS VARCHAR), 'jsonl' FROM orders GROUP BY 1
UNION ALL SELECT c_mktsegment, CAST(count(*) AS VARCHAR), NULL FROM customer GROUP BY 1""")
def read_results(spark, sf_dir):
    path = Scratch(spark, "results").path
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")

    def counted(df, by):
        return df.groupBy(F.col(by).alias("method")).agg(F.count(F.lit(1)).cast("string").alias("k"))

    files.write_rows(counted(orders, "o_orderpriority").withColumn("seed", F.lit("csv")), f"{path}/a.csv", "csv")
    files.write_rows(counted(orders, "o_orderstatus").withColumn("seed", F.lit("jsonl")), f"{path}/b.jsonl", "jsonl")
    files.write_rows(counted(customer, "c_mktsegment"), f"{path}/c.json", "json")
    return files.read_results(spark, [f"{path}/a.csv", f"{path}/b.jsonl", f"{path}/c.json"]).select("method", "k", "seed")


@query("write_rows", """SELECT f.format, c_custkey, c_name, c_acctbal FROM customer,
  (SELECT unnest(['parquet', 'csv', 'json', 'jsonl', 'jsonl']) AS format) f""")
def write_rows(spark, sf_dir):
    """Every format; JSON lines are appended to, the others never over existing rows."""
    path = Scratch(spark, "rows").path
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    for fmt in ("parquet", "csv", "json", "jsonl", "jsonl"):
        files.write_rows(rows, f"{path}/{fmt}", fmt)
    parts = None
    for fmt in ("parquet", "csv", "json", "jsonl"):
        reader = spark.read.schema(rows.schema)
        back = reader.option("header", True).csv(f"{path}/csv") if fmt == "csv" else reader.parquet(f"{path}/{fmt}") if fmt == "parquet" else reader.json(f"{path}/{fmt}")
        back = back.select(F.lit(fmt).alias("format"), "*")
        parts = back if parts is None else parts.union(back)
    return parts
