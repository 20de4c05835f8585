"""File sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minim.operators.clean import assert_unique, nan_to_null
from minim.operators.hierarchy import Forest, Hierarchy, Node, node_table
from minim.spec import DatasetSpec


def with_position(df: DataFrame, name: str = "row_id") -> DataFrame:
    """0-based position of each row over the files in name order, for files that carry no key.

    A split's rows keep their order in one task, but splits are dealt to tasks by size, so task numbers are no file order.
    Rows are numbered inside their split and shifted by the rows of the splits before, by file name and offset. `df` must
    come straight from a file reader (rows may be filtered).
    """
    marked = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_at"))
    # One row per input split.
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (marked.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
              .select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (marked.join(splits, ["_file", "_block"])
            .withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first")).cast("bigint"))
            .drop("_file", "_block", "_at", "_first", "_before"))


def _rows_per_file(df: DataFrame) -> list[int]:
    """Rows of each file, in name order."""
    counts = df.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return [r["n"] for r in counts.orderBy("f").collect()]


def read_xy(spark: SparkSession, x_path: str, y_path: str, spec: DatasetSpec, key: str | None = None) -> DataFrame:
    """Feature file and label file as one table; joined on `key`, or by line position without one.

    Without a key both sides must hold as many rows, file by file where they have as many files.
    """
    x = spark.read.option("header", True).schema(_csv_schema(spark, x_path, ",", spec.numeric)).csv(x_path)
    y = spark.read.option("header", True).csv(y_path)
    missing = [c for c in spec.features if c not in x.columns]
    if missing:
        raise ValueError(f"{x_path}: missing columns {missing}")
    label = spec.label if spec.label in y.columns else y.columns[-1]
    if key:
        assert_unique(x, key)
        assert_unique(y, key)
        y = y.select(key, F.col(f"`{label}`").alias(spec.label))
        joined = x.join(y, key)
        return nan_to_null(joined.withColumnRenamed(key, spec.row_id))
    x_rows, y_rows = _rows_per_file(x), _rows_per_file(y)
    if sum(x_rows) != sum(y_rows) or len(x_rows) == len(y_rows) and x_rows != y_rows:
        raise ValueError(f"{x_path} and {y_path} do not pair: rows per file {x_rows[:10]} and {y_rows[:10]}")
    x = with_position(x, spec.row_id)
    y = with_position(y, spec.row_id).select(spec.row_id, F.col(f"`{label}`").alias(spec.label))
    return nan_to_null(x.join(y, spec.row_id))


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    first = spark.read.option("encoding", "UTF-8").text(path).first()
    if first is None or not first[0].strip():
        raise ValueError(f"{path}: empty header")
    names = [n.strip().strip('"') for n in first[0].lstrip("﻿").split(sep)]
    if any(not n for n in names):
        raise ValueError(f"{path}: empty column name")
    if len(set(names)) != len(names):
        raise ValueError(f"{path}: duplicate column names")
    return names


def _csv_schema(spark: SparkSession, path: str, sep: str, numeric: Sequence[str]) -> T.StructType:
    return T.StructType([
        T.StructField(n, T.DoubleType() if n in numeric else T.StringType())
        for n in _header(spark, path, sep)])


def read_labelled_csv(spark: SparkSession, path: str, spec: DatasetSpec, sep: str = ";") -> DataFrame:
    """Delimited text with a target column and, possibly, a byte-order mark.

    Numbers that do not parse become NULL; a missing column is an error.
    """
    schema = _csv_schema(spark, path, sep, spec.numeric)
    missing = [c for c in (*spec.features, spec.label) if c not in schema.names]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    df = (spark.read.option("header", True).option("sep", sep).option("quote", '"')
          .option("enforceSchema", True).schema(schema).csv(path))
    return nan_to_null(with_position(df, spec.row_id))


def read_arff(spark: SparkSession, path: str, row_id: str = "row_id") -> DataFrame:
    """An ARFF table with row ids: names and types from the header, rows parsed by the CSV expression.

    `%` starts a comment line, values may be quoted with `'`, `?` is missing. The header ends at the first `@data` line;
    what follows is data, whatever it starts with.
    """
    text = F.trim("value")
    lines = with_position(spark.read.text(path).where(~text.startswith("%") & (text != "")), "_line")
    start = lines.where(F.lower(text).startswith("@data")).agg(F.min("_line")).first()[0]
    if start is None:
        raise ValueError(f"{path}: no @data line")
    fields = []
    for row in lines.where((F.col("_line") < start) & F.lower(text).startswith("@attribute")).orderBy("_line").collect():
        rest = row["value"].strip()[len("@attribute"):].strip()
        if rest[0] in "'\"":
            name, kind = rest[1:].split(rest[0], 1)
        else:
            name, kind = rest.split(None, 1)
        numeric = kind.strip().lower().split()[0] in ("numeric", "real", "integer")
        fields.append(T.StructField(name.strip(), T.DoubleType() if numeric else T.StringType()))
    if not fields:
        raise ValueError(f"{path}: no @attribute lines")
    options = {"sep": ",", "quote": "'", "nullValue": "?", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    parsed = F.from_csv("value", _ddl(fields), options).alias("r")
    return lines.where(F.col("_line") > start).select(parsed, (F.col("_line") - start - 1).alias("_row")).select("r.*", F.col("_row").alias(row_id))


def _ddl(fields) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def load_trees(spark: SparkSession, path: str) -> Mapping:
    """The `trees` mapping of a hierarchy file in any store: JSON, or YAML where a YAML reader is installed."""
    text = spark.read.option("wholetext", True).text(path).first()[0].lstrip("\ufeff")
    if path.endswith(".json"):
        return json.loads(text)["trees"]
    try:
        import yaml
    except ImportError as error:
        raise ImportError("reading YAML hierarchies needs the yaml module; use JSON instead") from error
    return yaml.safe_load(text)["trees"]


def read_hierarchies(spark: SparkSession, path: str, spec: DatasetSpec) -> tuple[DataFrame, Forest]:
    """One tree per quasi-identifier, as a node table and as the driver's bounded copy."""
    trees = load_trees(spark, path)
    missing = [q for q in spec.qis if q not in trees]
    if missing:
        raise KeyError(f"no hierarchy for {missing}")
    forest = {
        q: Hierarchy(q, [Node(str(n["id"]), None if n.get("parent") is None else str(n["parent"]),
                              None if n.get("value") is None else str(n["value"]))
                         for n in trees[q]["nodes"]],
                     numeric=q in spec.numeric, string_codes=q in spec.string_categories)
        for q in spec.qis}
    return node_table(spark, forest), forest


def _is_json_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line that is not blank is a whole object, as the JSON sink writes them."""
    line = spark.read.text(path).where(F.trim("value") != "").first()
    text = line[0].strip() if line else ""
    return text.startswith("{") and text.endswith("}")


def read_results(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Result rows from CSV, JSON (arrays or objects) and JSON-lines files, by column name.

    CSV headers must be non-empty and unique.
    """
    parts = []
    for path in paths:
        if path.endswith(".csv"):
            names = _header(spark, path, ",")
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
            parts.append(spark.read.option("header", True).schema(schema).csv(path))
        elif path.endswith(".jsonl"):
            parts.append(spark.read.json(path))
        elif path.endswith(".json"):
            parts.append(spark.read.option("multiLine", not _is_json_lines(spark, path)).json(path))
        else:
            raise ValueError(f"{path}: unknown result format")
    if not parts:
        raise ValueError("no result files")
    if any(not p.columns for p in parts):
        raise ValueError("a result file has no rows")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_rows(df: DataFrame, path: str, fmt: str = "parquet", append: bool = False) -> None:
    """Write rows as parquet, csv, json or (appending) jsonl; never over existing rows."""
    if fmt not in ("parquet", "csv", "json", "jsonl"):
        raise ValueError(f"unknown format {fmt!r}")
    mode = "append" if append or fmt == "jsonl" else "errorifexists"
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt in ("json", "jsonl"):
        writer.json(path)
    else:
        writer.parquet(path)
