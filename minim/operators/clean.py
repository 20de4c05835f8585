"""Projection, cleaning and encoding of raw columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minim.operators.keyed import dense_index
from minim.spec import DatasetSpec

MAX_CATEGORIES = 200_000


def select_features(df: DataFrame, spec: DatasetSpec, extra: Sequence[str] = ()) -> DataFrame:
    """Features in their fixed order, then `extra` columns; a missing column is an error."""
    missing = [c for c in (*spec.features, *extra) if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the input: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in (*spec.features, *extra)])


def map_label(df: DataFrame, column: str, mapping: Mapping, check: bool = True) -> DataFrame:
    """Label text to int. With `check`, an unknown label fails the job on the task that meets it."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    mapped = table[F.trim(F.col(column).cast("string"))]
    if check:
        message = F.concat(F.lit(f"unknown label in {column}: "), F.coalesce(F.col(column).cast("string"), F.lit("NULL")))
        mapped = F.coalesce(mapped, F.raise_error(message).cast("int"))
    return df.withColumn(column, mapped.cast("int"))


def null_sentinels(df: DataFrame, sentinels: Mapping[str, Iterable[str]]) -> DataFrame:
    """Per-column sentinel texts to NULL."""
    return df.withColumns({
        c: F.when(~F.trim(F.col(c).cast("string")).isin(*sorted(bad)), F.col(c))
        for c, bad in sentinels.items()})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN to NULL in floating columns: the two would form separate groups."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double; text that is no number, and NaN, become NULL."""
    out = {}
    for c in columns:
        number = F.trim(F.col(c).cast("string")).try_cast("double")
        out[c] = F.when(~F.isnan(number), number)
    return df.withColumns(out)


def trim_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.trim(F.col(c).cast("string")) for c in columns})


def normalize_code_text(column: Column) -> Column:
    """`'1.0'` -> `'1'`; other text stays."""
    text = F.trim(column.cast("string"))
    number = F.when(text.rlike(r"^[+-]?\d+(\.\d*)?([eE][+-]?\d+)?$"), text.cast("double"))
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(column.cast("string"))


def stack_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns to rows `(keep..., attr, value)` with values as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.attr", "_p.value")


def category_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted code dictionary of the whole table: `(attr, category, idx)`.

    Numeric codes sort by value, before texts. Distinct values are found before they are ranked,
    so only dictionaries are numbered and never the rows.
    """
    codes = stack_columns(df.select(*[normalize_code_text(F.col(c)).alias(c) for c in columns]), columns)
    distinct = codes.where(F.col("value").isNotNull()).distinct()
    number = F.col("value").try_cast("double")
    keyed = distinct.select("attr", F.col("value").alias("category"), number.isNull().alias("_text"), number.alias("_number"))
    return dense_index(keyed, ["attr"], ["_text", "_number", "category"], "idx").select("attr", "category", "idx")


def first_per_entity(df: DataFrame, entity: str, order: str, source_order: str | None = None) -> DataFrame:
    """Earliest record of each entity.

    `min_by` keeps one candidate per entity and task before the shuffle, so an entity with a
    third of all rows costs no more than any other. Ties in `order` go to the first in source
    order, or by all columns when the source has none.
    """
    rest = [source_order] if source_order else [c for c in df.columns if c not in (entity, order)]
    record = F.struct(*df.columns)
    key = F.struct(order, *rest)
    return df.groupBy(entity).agg(F.min_by(record, key).alias("_r")).select("_r.*")


def limit_rows(df: DataFrame, n: int | None, source_order: str) -> DataFrame:
    """The first n rows in source order; the limit follows deduplication."""
    return df if n is None else df.orderBy(source_order).limit(int(n))


def dedup_audit(df: DataFrame, entity: str) -> DataFrame:
    """Input rows, entities, and rows a deduplication removes.

    Entities are counted by grouping twice: a distinct count in one final task would be a funnel.
    """
    return (
        df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n").alias("input_rows"), F.count(F.lit(1)).alias("unique_rows"))
        .withColumn("removed_rows", F.col("input_rows") - F.col("unique_rows"))
    )


def one_hot(df: DataFrame, dictionary: Mapping[str, Sequence[str]], drop: bool = True) -> DataFrame:
    """Indicator columns `<attr>=<category>` on a fixed dictionary; an unknown code is all zeros."""
    size = sum(len(v) for v in dictionary.values())
    if size > MAX_CATEGORIES:
        raise ValueError(f"{size} indicator columns exceed {MAX_CATEGORIES}")
    codes = {a: normalize_code_text(F.col(a)) for a in dictionary}
    out = [F.col(c) for c in df.columns if not (drop and c in dictionary)]
    for attr, categories in dictionary.items():
        out += [F.when(codes[attr] == str(c), 1.0).otherwise(0.0).alias(f"{attr}={c}") for c in categories]
    return df.select(*out)


def fit_standardizer(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population mean and deviation per column: `(attr, mean, std)`, zero deviation as 1."""
    one = df.agg(*[f for c in columns for f in (
        F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"))])
    triples = F.array(*[F.struct(
        F.lit(c).alias("attr"), F.col(f"{c}__mean").alias("mean"),
        F.when(F.col(f"{c}__std") > 0, F.col(f"{c}__std")).otherwise(1.0).alias("std")) for c in columns])
    return one.select(F.explode(triples).alias("t")).select("t.*")


def standardize(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """Apply frozen means and deviations (one row per column of the table)."""
    stats = {r["attr"]: (r["mean"], r["std"]) for r in fitted.collect()}
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


# ---- row identity ---------------------------------------------------------------------------

def duplicate_ids(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    return (df.groupBy(row_id).agg(F.count(F.lit(1)).alias("n"))
            .where((F.col("n") > 1) | F.col(row_id).isNull()))


def assert_unique(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    if not duplicate_ids(df, row_id).isEmpty():
        raise ValueError(f"{row_id} is not unique")
    return df


def assert_subset(inner: DataFrame, outer: DataFrame, row_id: str = "row_id") -> None:
    if not inner.join(outer, row_id, "left_anti").isEmpty():
        raise ValueError("rows outside the reference set")


def assert_disjoint(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> None:
    if not left.join(right, row_id, "left_semi").isEmpty():
        raise ValueError("row sets overlap")


def overlap_report(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Ids on the left only, on the right only, and on both sides, in one shuffle."""
    sides = (left.select(row_id, F.lit(1).alias("l"), F.lit(0).alias("r"))
             .unionByName(right.select(row_id, F.lit(0).alias("l"), F.lit(1).alias("r")))
             .groupBy(row_id).agg(F.max("l").alias("l"), F.max("r").alias("r")))
    return sides.agg(
        F.count(F.when((F.col("l") == 1) & (F.col("r") == 0), 1)).alias("left_only"),
        F.count(F.when((F.col("l") == 0) & (F.col("r") == 1), 1)).alias("right_only"),
        F.count(F.when((F.col("l") == 1) & (F.col("r") == 1), 1)).alias("both"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free hash of a table: row count and a sum of row hashes.

    The hash is widened before it is summed, so no row count overflows it. Column order counts.
    """
    row = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row).cast("string").alias("hash_sum"))


def preprocess(df: DataFrame, spec: DatasetSpec, source_order: str, limit: int | None = None) -> DataFrame:
    """Clean one raw table as its spec says: deduplicate, limit, null, coerce, trim, map, project."""
    out = df
    if spec.entity:
        out = first_per_entity(out, spec.entity, spec.order_in_entity, source_order)
    out = limit_rows(out, limit, source_order)
    if spec.sentinels:
        out = null_sentinels(out, spec.sentinels)
    out = coerce_numeric(out, spec.numeric)
    out = trim_text(out, [c for c in spec.string_categories if c in out.columns])
    if spec.label_values:
        out = map_label(out, spec.label, spec.label_values)
    return select_features(out, spec, extra=(source_order, spec.label))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
