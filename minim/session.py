"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Planner settings the package relies on. Partition counts and memory stay with the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the Python call site of every column expression dominates plan building.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "minim", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package defaults; `conf` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return share_package(builder.getOrCreate())


def share_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it: the same path on every node, or installed there.

    Functions of a module travel to the workers by name, and a worker's path is not the driver's `sys.path`.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: `spark.checkpoint.dir`, else a folder in the warehouse, which is shared as well."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables of one job, written to the shared folder as Parquet.

    A written table cuts the lineage for good: losing an executor costs a re-read and not a replay
    of every earlier pass. Columnar files also keep column pruning and size estimates, which a
    checkpointed row set does not.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.path = f"{scratch_root(spark).rstrip('/')}/{job}-{uuid.uuid4().hex}"
        self._count = 0
        self._places: dict[int, tuple[DataFrame, str]] = {}

    def save(self, df: DataFrame, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write `df` once and return a reader of the written rows."""
        target = f"{self.path}/{self._count:05d}"
        self._count += 1
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(target)
        table = self.spark.read.schema(df.schema).parquet(target)
        self._places[id(table)] = (table, target)
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that `save` returned and that nothing will read again; others and None are passed over."""
        for table in tables:
            _, target = self._places.pop(id(table), (None, None))
            if target:
                delete_path(self.spark, target)

    def replace(self, old: DataFrame | None, df: DataFrame) -> DataFrame:
        """Save `df`, made from `old`, and delete `old`."""
        table = self.save(df)
        self.drop(old)
        return table


def cut_lineage(df: DataFrame, job: str = "cut") -> DataFrame:
    """Write `df` to the shared folder and read it back."""
    return Scratch(df.sparkSession, job).save(df)
