"""Observed quasi-identifier domains."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minim.operators.clean import normalize_code_text, stack_columns
from minim.operators.keyed import dense_index
from minim.spec import DatasetSpec


def qi_domains(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The domain of each QI as rows: `(attr, kind, distinct_values, position, run)`.

    A continuous QI has one row, `min ~ max`. Another has a row per value in order: numbers by size, anything else by text;
    consecutive whole numbers are one row, `first-last`. Text categories are never read as numbers. Domains of any
    size are rows of a distributed table; nothing is collected into a list.
    """
    listed = [q for q in spec.qis if q not in spec.continuous]
    parts = []
    if listed:
        codes = stack_columns(df.select(*[normalize_code_text(F.col(q)).alias(q) for q in listed]), listed)
        codes = codes.where(F.col("value").isNotNull()).distinct()
        number = F.when(~F.col("attr").isin(*spec.string_categories), F.col("value").try_cast("double")) if spec.string_categories \
            else F.col("value").try_cast("double")
        codes = codes.withColumn("_number", number)
        whole = F.col("_number").isNotNull() & (F.col("_number") == F.floor("_number"))
        kinds = codes.groupBy("attr").agg(
            F.count(F.lit(1)).alias("distinct_values"), F.every(F.col("_number").isNotNull()).alias("_numeric"), F.every(whole).alias("_whole"))
        # One row per quasi-identifier.
        codes = codes.join(F.broadcast(kinds), "attr")
        name = F.when(F.col("attr").isin(*spec.numeric), "discrete").otherwise("categorical") if spec.numeric else F.lit("categorical")
        codes = codes.withColumn("kind", name)
        keys = ["attr", "kind", "distinct_values"]
        runs = _runs(codes.where("_whole").select(*keys, F.col("_number").cast("bigint").alias("c")), keys, "c", ["attr"])
        runs = runs.select(*keys, "_i", "run")
        order = F.when(F.col("_numeric"), F.col("_number"))
        plain = dense_index(codes.where("not _whole").select(*keys, order.alias("_order"), "value"), ["attr"], ["_order", "value"], "_i")
        parts.append(runs.unionByName(plain.select(*keys, "_i", F.col("value").alias("run"))).withColumnRenamed("_i", "position"))
    for q in spec.qis:
        if q in spec.continuous:
            # Grouped twice, so that no single task holds all distinct values.
            parts.append(
                df.where(F.col(q).isNotNull()).groupBy(q).agg(F.lit(1).alias("one"))
                .agg(F.count(F.lit(1)).alias("distinct_values"), F.min(q).alias("lo"), F.max(q).alias("hi"))
                .select(F.lit(q).alias("attr"), F.lit("continuous").alias("kind"), "distinct_values", F.lit(0).cast("bigint").alias("position"),
                        F.concat_ws(" ~ ", F.col("lo").cast("string"), F.col("hi").cast("string")).alias("run")))
    return reduce(DataFrame.unionByName, parts)


def _runs(codes: DataFrame, keys: Sequence[str], column: str, group: Sequence[str]) -> DataFrame:
    """Runs of consecutive integers in distinct `codes`: `(keys..., _i, first_code, last_code, run)`.

    A code starts a run when its predecessor is absent and ends one when its successor is. The i-th start of a group
    belongs to the i-th end, so both are numbered and joined.
    """
    named = codes.withColumnRenamed(column, "c")
    starts = named.join(named.select(*group, (F.col("c") + 1).alias("c")), [*group, "c"], "left_anti")
    ends = named.join(named.select(*group, (F.col("c") - 1).alias("c")), [*group, "c"], "left_anti")
    first = dense_index(starts, group, ["c"], "_i").select(*keys, "_i", F.col("c").alias("first_code"))
    last = dense_index(ends, group, ["c"], "_i").select(*group, "_i", F.col("c").alias("last_code"))
    text = F.col("first_code").cast("string")
    run = F.when(F.col("first_code") == F.col("last_code"), text).otherwise(F.concat_ws("-", text, F.col("last_code").cast("string")))
    return first.join(last, [*group, "_i"]).withColumn("run", run)


def compress_runs(df: DataFrame, column: str) -> DataFrame:
    """Runs of consecutive integer codes: `(first_code, last_code, run)` with run as `1-3` or `5`."""
    codes = df.where(F.col(column).isNotNull()).select(F.col(column).cast("bigint").alias("c")).distinct()
    return _runs(codes, [], "c", []).select("first_code", "last_code", "run")
