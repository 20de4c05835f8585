"""Keyed joins, ranks and running sums that hold when one key owns a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minim.functions.ordering import bucket_digits, key_bucket
from minim.session import Scratch

# The keys broadcast ahead of a keyed join. The number is fixed, so the broadcast cannot grow;
# and a key outside the HEAVY_KEYS largest owns at most 1/HEAVY_KEYS of the rows.
HEAVY_KEYS = 1000
SCATTER = 1024
# A window over this many rows of one group stays well inside one task.
WINDOW_ROWS = 1_000_000


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """`left.k <=> right.k` for every key."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def attach(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str,
    how: str = "left",
) -> DataFrame:
    """Join per-key columns of `table` (unique on `keys`) onto `rows`, NULL matching NULL.

    `weight` is the column of `table` that grows with the rows of the key. Rows of the heaviest
    keys are answered from a broadcast of at most `HEAVY_KEYS` entries and then scattered over
    the shuffle, so no task receives a heavy key. `weight` comes back with the other columns.
    """
    if how not in ("left", "inner"):
        raise ValueError("attach joins left or inner")
    keys = list(keys)
    if not keys:
        return rows.crossJoin(F.broadcast(table.limit(1)))
    values = [c for c in table.columns if c not in keys]
    light = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                         F.struct(*values).alias("_light"), F.lit(0).alias("_light_slot"))
    heavy = (
        table.orderBy(F.desc(weight), *keys).limit(HEAVY_KEYS)
        .select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.struct(*values).alias("_heavy"))
    )
    on_heavy = reduce(lambda a, b: a & b,
                      [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    marked = (
        rows.join(F.broadcast(heavy), on_heavy, "left")
        .drop(*[f"_h_{k}" for k in keys])
        .withColumn("_slot", F.when(F.col("_heavy").isNotNull(),
                                    F.lit(1) + F.pmod(F.xxhash64(*rows.columns), F.lit(SCATTER)))
                    .otherwise(F.lit(0)))
    )
    on_light = reduce(lambda a, b: a & b,
                      [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    joined = marked.join(light, on_light & (F.col("_slot") == F.col("_light_slot")), "left")
    found = F.coalesce(F.col("_heavy"), F.col("_light"))
    out = joined.withColumn("_found", found)
    if how == "inner":
        out = out.where(F.col("_found").isNotNull())
    return out.select(*rows.columns, *[F.col("_found")[v].alias(v) for v in values])


def attach_small(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, entries: int) -> DataFrame:
    """`attach` for a written table of known length: one broadcast join while it is short."""
    if entries > HEAVY_KEYS:
        return attach(rows, table, keys, weight)
    named = table.select(*[F.col(k).alias(f"_s_{k}") for k in keys],
                         *[c for c in table.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys])
    return rows.join(F.broadcast(named), cond, "left").drop(*[f"_s_{k}" for k in keys])


def rank_by_key(
    rows: DataFrame, group: Sequence[str], key: str, name: str = "rank", digits: int | None = None,
) -> DataFrame:
    """0-based rank of each row by a seeded key, within `group` (or over all rows).

    Ranks come from counts of the key's leading digits plus a rank inside one bucket. A bucket is
    a slice of the uniform key, so a group of any size is spread over all tasks.
    """
    if digits is None:
        digits = bucket_digits(rows.count())
    group = list(group)
    bucketed = rows.withColumn("_bucket", key_bucket(F.col(key), digits))
    counts = bucketed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most 16**digits rows per group.
    before = (Window.partitionBy(*group).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_bucket").orderBy(key)
    ranked = bucketed.withColumn("_inside", F.row_number().over(inside) - F.lit(1))
    cond = reduce(lambda a, b: a & b,
                  [F.col(g).eqNullSafe(F.col(f"_o_{g}")) for g in group]
                  + [F.col("_bucket") == F.col("_o_bucket")])
    offsets = offsets.select(*[F.col(g).alias(f"_o_{g}") for g in group],
                             F.col("_bucket").alias("_o_bucket"), "_before")
    return (
        ranked.join(offsets, cond, "left")
        .select(*rows.columns, (F.col("_before") + F.col("_inside")).cast("bigint").alias(name))
    )


def quota_bounds(
    rows: DataFrame, group: Sequence[str], key: str | Column, quotas: DataFrame, quota: str,
    digits: int | None = None, part: str | None = None, bucket: Column | None = None,
) -> DataFrame:
    """The key of the `quota`-th row of each group, in key order: `(group..., quota, bound)`.

    `quotas` has one row per group, or several told apart by the column `part`, which comes back too: all are found in the
    same pass. `bound` is NULL for a quota of 0. A row is among the first `quota` of its group exactly when `key <= bound`.
    Only counts and the rows of one bucket per quota are shuffled; the rows themselves stay where they are.

    Where the rows hold their key's place already, `bucket` gives it (in key order) and `key` may be an expression: it is only made for the rows
    of the buckets with a bound. The quotas must be few then, as those buckets are broadcast.
    """
    if digits is None and bucket is None:
        digits = bucket_digits(rows.count())
    group = list(group)
    parts = [part] if part else []
    if bucket is None:
        slim = rows.select(*group, key).withColumn("_bucket", key_bucket(F.col(key), digits))
    else:
        slim = rows.withColumn("_bucket", bucket)
    counts = slim.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = (Window.partitionBy(*group).orderBy("_bucket")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumn("_upto", F.sum("_n").over(upto))
    counts = counts.withColumn("_all", F.max("_upto").over(Window.partitionBy(*group)))
    wanted = quotas.select(*[F.col(g).alias(f"_q_{g}") for g in group], *parts,
                           F.col(quota).cast("bigint").alias("_quota"))
    cond = reduce(lambda a, b: a & b,
                  [F.col(g).eqNullSafe(F.col(f"_q_{g}")) for g in group], F.lit(True))
    crossing = (
        counts.join(wanted, cond, "inner")
        # A quota above the group size asks for all its rows.
        .withColumn("_quota", F.least("_quota", "_all"))
        .where((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota")))
        .select(*[F.col(g).alias(f"_c_{g}") for g in group], *parts, F.col("_bucket").alias("_c_bucket"),
                (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_place"))
    )
    cond = reduce(lambda a, b: a & b,
                  [F.col(g).eqNullSafe(F.col(f"_c_{g}")) for g in group]
                  + [F.col("_bucket") == F.col("_c_bucket")])
    place = Window.partitionBy(*group, *parts).orderBy("_bound")
    bounds = (
        slim.join(crossing if bucket is None else F.broadcast(crossing), cond, "inner")
        .withColumn("_bound", F.col(key) if isinstance(key, str) else key)
        .withColumn("_rn", F.row_number().over(place))
        .where(F.col("_rn") == F.col("_place"))
        .select(*[F.col(g).alias(f"_b_{g}") for g in group], *[F.col(p).alias(f"_b_{p}") for p in parts], F.col("_bound").alias("bound"))
    )
    cond = reduce(lambda a, b: a & b,
                  [F.col(f"_q_{g}").eqNullSafe(F.col(f"_b_{g}")) for g in group] + [F.col(p) == F.col(f"_b_{p}") for p in parts], F.lit(True))
    return wanted.join(bounds, cond, "left").select(
        *[F.col(f"_q_{g}").alias(g) for g in group], *parts, F.col("_quota").alias(quota), "bound")


def first_rows(
    rows: DataFrame, group: Sequence[str], key: str, limit: int, sizes: DataFrame | None = None,
) -> DataFrame:
    """The first `min(size, limit)` rows of every group in key order.

    Groups within the limit pass whole, with no rank. Only groups above it need a bound, and
    there are at most N / limit of them.
    """
    group = list(group)
    if sizes is None:
        sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    over = sizes.where(F.col("_size") > limit).withColumn("_limit", F.lit(int(limit)))
    marked = attach(rows, over.select(*group, "_size"), group, "_size")
    large = marked.where(F.col("_size").isNotNull()).drop("_size")
    total = over.agg(F.sum("_size")).first()[0] or 0
    bounds = quota_bounds(large, group, key, over, "_limit", bucket_digits(total)).withColumnRenamed("bound", "_bound")
    # One row per large group on both sides; the group's size says which groups are heavy.
    weighed = bounds.join(over.select(*[F.col(g).alias(f"_w_{g}") for g in group], "_size"),
                          reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_w_{g}")) for g in group], F.lit(True)))
    flagged = attach(rows, weighed.select(*group, "_bound", "_size"), group, "_size")
    return (flagged.where(F.col("_bound").isNull() | (F.col(key) <= F.col("_bound")))
            .select(*rows.columns))


def global_index(
    rows: DataFrame, order: Sequence[str], name: str = "index", partitions: int | None = None,
) -> DataFrame:
    """0-based position of each row in a total order over all rows.

    Rows are range-partitioned on the full order (end it with a unique column, so equal leading
    keys can be split), numbered inside their partition, and shifted by the sizes of the
    partitions before. The numbered rows are written once: a second evaluation of a range
    partitioning may cut elsewhere.
    """
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = (
        rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_inside", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    cut = Scratch(spark, "index").save(cut)
    # One row per partition: bounded by the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        cut.join(F.broadcast(offsets), "_part")
        .select(*rows.columns, (F.col("_before") + F.col("_inside")).cast("bigint").alias(name))
    )


def dense_index(table: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """0-based position within `group`; `order` must be total.

    A table within `WINDOW_ROWS` is numbered by a window. A longer one is numbered across range
    partitions, and each group is shifted to start at 0.
    """
    group = list(group)
    if table.count() <= WINDOW_ROWS:
        w = Window.partitionBy(*group).orderBy(*order)
        return table.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    indexed = global_index(table, [*group, *order], "_at")
    if not group:
        return indexed.withColumnRenamed("_at", name)
    starts = indexed.groupBy(*group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    return (attach(indexed, starts, group, "_rows")
            .select(*table.columns, (F.col("_at") - F.col("_first")).alias(name)))


def running_sums(
    table: DataFrame, group: Sequence[str], order: str, values: Sequence[str], rows_per_group: int,
) -> DataFrame:
    """Cumulative sums `<value>_upto` and totals `<value>_total` within `group`, in `order`.

    `rows_per_group` is a measured bound. Within `WINDOW_ROWS` a plain window does; beyond it the
    table is range-partitioned on (group, order), so one group spans many tasks.
    """
    group = list(group)
    upto = Window.unboundedPreceding, Window.currentRow
    if rows_per_group <= WINDOW_ROWS:
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(*upto)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return table.select("*", *[F.sum(v).over(w).alias(f"{v}_upto") for v in values],
                            *[F.sum(v).over(whole).alias(f"{v}_total") for v in values])
    spark = table.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = Scratch(spark, "running").save(
        table.repartitionByRange(parts, *group, order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part", *group).orderBy(order).rowsBetween(*upto)
    local = cut.select("*", *[F.sum(v).over(w).alias(f"_in_{v}") for v in values])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("_part", *group).agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
        .select(F.col("_part").alias("_o_part"), *[F.col(g).alias(f"_o_{g}") for g in group],
                *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_off_{v}")
                  for v in values],
                *[F.sum(f"_s_{v}").over(Window.partitionBy(*group)).alias(f"_all_{v}") for v in values])
    )
    cond = reduce(lambda a, b: a & b,
                  [F.col(g).eqNullSafe(F.col(f"_o_{g}")) for g in group]
                  + [F.col("_part") == F.col("_o_part")])
    return local.join(offsets, cond, "left").select(
        *table.columns, *[(F.col(f"_in_{v}") + F.col(f"_off_{v}")).alias(f"{v}_upto") for v in values],
        *[F.col(f"_all_{v}").alias(f"{v}_total") for v in values])
