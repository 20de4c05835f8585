"""Saved releases: one Parquet table of assignments per run, partitioned by iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("iteration", "row_id", "snapshot")
FINAL = "final"
ALL = "all"


def save_release(release: DataFrame, path: str, iteration: int) -> None:
    """Append one release `(row_id, snapshot)` to the run's table."""
    (release.select("row_id", "snapshot", F.lit(int(iteration)).alias("iteration"))
     .write.mode("append").partitionBy("iteration").parquet(path))


def check_fields(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"saved release lacks {missing}")
    return df


def load_release(spark: SparkSession, path: str, iteration: int | None = None) -> DataFrame:
    """One saved release: the given iteration, or the last one. Other partitions are not read."""
    return pick_release(check_fields(spark.read.parquet(path)), iteration)


def pick_release(saved: DataFrame, iteration: int | None = None) -> DataFrame:
    if iteration is None:
        last = saved.agg(F.max("iteration").alias("_last"))
        # One row.
        return saved.join(F.broadcast(last), F.col("iteration") == F.col("_last")).drop("_last")
    return saved.where(F.col("iteration") == int(iteration))


def release_points(saved: DataFrame, selection: str | list[int] = FINAL) -> DataFrame:
    """Iterations to evaluate: the final one, all of them, or a list that must exist."""
    points = saved.select("iteration").distinct()
    if selection == ALL:
        return points
    if selection == FINAL:
        return points.agg(F.max("iteration").alias("iteration"))
    wanted = sorted({int(i) for i in selection})
    # An unknown iteration fails when the points are read.
    listed = saved.sparkSession.createDataFrame([(i,) for i in wanted], f"iteration {saved.schema['iteration'].dataType.simpleString()}")
    found = listed.join(points.withColumn("_seen", F.lit(True)), "iteration", "left")
    return found.select(
        F.when(F.col("_seen"), F.col("iteration"))
        .otherwise(F.raise_error(F.concat(F.lit("no such iteration: "), F.col("iteration").cast("string")))
                   .cast("bigint")).alias("iteration"))
