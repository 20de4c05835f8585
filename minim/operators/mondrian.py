"""Plain Mondrian partitioning and its recodings.

Rows are first collapsed to cells (distinct QI values with a count): every cut depends on cells
alone. All open partitions are cut in one pass, so the number of passes is the depth of the tree
and not the number of partitions. A partition of at most `LOCAL_ROWS` rows leaves the passes: all of
these are cut to the end in one shuffle, each by one task, so the passes only follow the depth above them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minim.operators.keyed import HEAVY_KEYS, WINDOW_ROWS, attach, attach_small, dense_index, running_sums
from minim.session import Scratch

# Passes whose cuts are joined from memory before the cells are written again.
PASSES_PER_WRITE = 3
# Rows, and so cells, of a partition that one task cuts to the end.
LOCAL_ROWS = 100_000
VALUES, BITS = "values", "bits"
# Codes per chunk of a value set: the bits of a long without its sign.
CHUNK = 63


def frequency_ranks(cells: DataFrame, attr: str) -> DataFrame:
    """`(attr, rank)`: categories by falling frequency, ties by value; NULL takes a rank as well."""
    counts = cells.groupBy(attr).agg(F.sum("n").alias("_n")).select(
        attr, (-F.col("_n")).alias("_order"), F.col(attr).isNull().alias("_null"))
    ranked = dense_index(counts, [], ["_order", "_null", attr], "_rank")
    return ranked.select(attr, F.col("_rank").cast("double").alias("_rank"))


def _finite(key: Column) -> Column:
    return F.when(key < F.lit(float("inf")), key)


def _finish(names: Sequence[str], numeric: int, scale: Sequence[float], k: int):
    """Cut one small partition to the end: an Arrow table of its cells to `(names..., partition)`, by the rule of the passes."""
    names = list(names)

    def finish(table):
        import numpy as np
        import pyarrow as pa
        n = table["n"].to_numpy()
        keys = table["_keys"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(n), len(scale))
        turns = np.empty(len(n), dtype=object)
        todo = [(np.arange(len(n)), table["partition"][0].as_py())]
        while todo:
            cells, path = todo.pop()
            turns[cells] = path
            weight = n[cells]
            total = int(weight.sum())
            if total < 2 * k:
                continue
            width = []
            for a, span in enumerate(scale):
                key = keys[cells, a]
                if a < numeric:
                    key = key[key < np.inf]
                    reach = float(key.max() - key.min()) if len(key) else 0.0
                    # NaN, from infinite ends, is the largest number to Spark.
                    width.append(float("inf") if reach != reach or reach == span == np.inf else reach / span if span > 0 or span != span else 0.0)
                else:
                    width.append(len(np.unique(key)) / span)
            if max(width) <= 0:
                continue
            for a in sorted(range(len(scale)), key=lambda a: (-width[a], a)):
                key = keys[cells, a]
                order = np.argsort(key, kind="stable")
                key, upto = key[order], np.cumsum(weight[order])
                ends = np.flatnonzero(key[1:] != key[:-1])
                ends = ends[(upto[ends] >= k) & (total - upto[ends] >= k)]
                if len(ends):
                    # The first of equal distances has the fewest rows on its left.
                    at = ends[np.argmin(np.abs(upto[ends] - total / 2.0))]
                    todo += [(cells[order[:at + 1]], path + "L"), (cells[order[at + 1:]], path + "R")]
                    break
        return pa.table([*[table[c] for c in names], pa.array(turns, pa.string())], names=[*names, "partition"])

    return finish


def mondrian_cells(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], k: int,
    scratch: Scratch | None = None, max_passes: int = 10_000,
) -> DataFrame:
    """Partition of every cell: `(qis..., n, partition)`.

    Widest normalized QI first (numeric before categorical on ties), cut between distinct values
    nearest the middle with both sides at least k; a QI without a legal cut is passed over.
    `partition` is the path of L/R turns; its text order is the depth-first order of leaves.
    """
    if k < 1:
        raise ValueError("k must be positive")
    qis = [*numeric, *categorical]
    if not qis:
        raise ValueError("at least one quasi-identifier is needed")
    scratch = scratch or Scratch(df.sparkSession, "mondrian")
    cells = df.groupBy(*qis).agg(F.count(F.lit(1)).alias("n"))
    cells = scratch.save(cells)
    # NaN is missing and takes no part in a range.
    known = {q: F.when(~F.isnan(F.col(q).cast("double")), F.col(q).cast("double")) for q in numeric}
    ends = cells.agg(*[f(known[q]).alias(f"{n}_{q}") for q in numeric
                       for n, f in (("lo", F.min), ("hi", F.max))], F.sum("n").alias("rows"))
    ends = ends.first().asDict()
    if not ends["rows"]:
        raise ValueError("the table is empty")
    if ends["rows"] < k:
        raise ValueError("fewer rows than k")
    keyed, scale = cells, []
    for q in numeric:
        value = F.col(q).cast("double")
        keyed = keyed.withColumn(f"_k_{q}", F.when(value.isNull() | F.isnan(value), float("inf")).otherwise(value))
        scale.append((ends[f"hi_{q}"] or 0.0) - (ends[f"lo_{q}"] or 0.0))
    for q in categorical:
        ranks = frequency_ranks(cells, q)
        ranked = attach(keyed, ranks.select(q, "_rank", (-F.col("_rank")).alias("_often")), [q], "_often")
        keyed = ranked.withColumn(f"_k_{q}", F.when(F.col(q).isNull(), -1.0).otherwise(F.col("_rank"))).drop("_rank", "_often")
        scale.append(float(cells.select(q).distinct().count()))
    # The longest list of distinct keys any window below can meet.
    widest = cells.count()
    if widest > WINDOW_ROWS:
        widest = max(cells.select(q).distinct().count() for q in qis)
    state = keyed.select(*qis, "n", F.array(*[F.col(f"_k_{q}") for q in qis]).alias("_keys"),
                         F.lit("").alias("partition"), F.lit(ends["rows"] > LOCAL_ROWS).alias("_open"), F.lit(ends["rows"] <= LOCAL_ROWS).alias("_local"))
    written = state = scratch.save(state)
    scales = F.array(*[F.lit(float(s)) for s in scale])
    is_numeric = F.col("attr") < len(numeric)
    # Cuts since the rows were last written: a few short tables that later passes join in memory.
    waiting: list[DataFrame] = []
    for _ in range(max_passes if ends["rows"] > LOCAL_ROWS else 0):
        keys = state.where("_open").select("partition", "n", F.posexplode("_keys").alias("attr", "key"))
        histogram = keys.groupBy("partition", "attr", "key").agg(F.sum("n").alias("n"))
        upto = running_sums(histogram, ["partition", "attr"], "key", ["n"], widest)
        legal = (F.col("n_upto") >= k) & (F.col("n_total") - F.col("n_upto") >= k)
        distance = F.abs(F.col("n_upto") - F.col("n_total") / 2.0)
        span = F.get(scales, F.col("attr"))
        reach = F.max(_finite(F.col("key"))) - F.min(_finite(F.col("key")))
        per_attr = upto.groupBy("partition", "attr").agg(
            F.min_by(F.when(legal, F.struct("key", "n_upto")),
                     F.when(legal, F.struct(distance, F.col("n_upto")))).alias("cut"),
            reach.alias("_reach"), F.count(F.lit(1)).alias("_distinct"), F.max("n_total").alias("rows"))
        width = (F.when(is_numeric, F.when(span > 0, F.coalesce(F.col("_reach"), F.lit(0.0)) / span).otherwise(0.0))
                 .otherwise(F.col("_distinct") / span))
        has_cut = F.col("cut").isNotNull()
        cuts = (
            per_attr.withColumn("width", width).groupBy("partition").agg(
                F.max("width").alias("_widest"), F.max("rows").alias("rows"),
                F.max_by(F.when(has_cut, F.struct("attr", "cut")),
                         F.when(has_cut, F.struct("width", -F.col("attr")))).alias("_cut"))
            .where((F.col("_widest") > 0) & F.col("_cut").isNotNull())
            .select("partition", "rows", F.col("_cut.attr").alias("_attr"), F.col("_cut.cut.key").alias("_at"),
                    F.col("_cut.cut.n_upto").alias("_left"))
        )
        cuts = scratch.save(cuts)
        entries = cuts.count()
        if entries == 0:
            break
        moved = attach_small(state, cuts, ["partition"], "rows", entries)
        left = F.get("_keys", F.col("_attr")) <= F.col("_at")
        turn = F.when(left, "L").otherwise("R")
        small = F.when(left, F.col("_left")).otherwise(F.col("rows") - F.col("_left")) <= LOCAL_ROWS
        # A partition without a cut is closed: no later cut bears its name.
        is_cut = F.col("_attr").isNotNull()
        state = moved.select(
            *qis, "n", "_keys", (is_cut & ~small).alias("_open"), (F.col("_local") | (is_cut & small)).alias("_local"),
            F.when(is_cut, F.concat("partition", turn)).otherwise(F.col("partition")).alias("partition"))
        waiting.append(cuts)
        if entries > HEAVY_KEYS or len(waiting) == PASSES_PER_WRITE:
            written = state = scratch.replace(written, state)
            scratch.drop(*waiting)
            waiting = []
    else:
        if ends["rows"] > LOCAL_ROWS:
            raise RuntimeError("too many passes")
    closed = state.select(*qis, "n", "partition")
    finish = _finish([*qis, "n"], len(numeric), scale, k)
    local = state.where("_local").select(*qis, "n", "_keys", "partition").groupBy("partition").applyInArrow(finish, closed.schema)
    out = scratch.replace(written, state.where("NOT _local").select(*qis, "n", "partition").unionByName(local))
    scratch.drop(cells, *waiting)
    return out


def mondrian(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], k: int) -> DataFrame:
    """Rows with their `partition`; every partition has at least k rows."""
    cells = mondrian_cells(df, numeric, categorical, k)
    return attach(df, cells, [*numeric, *categorical], "n").drop("n")


def mondrian_recode(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], partition: str = "partition", sets: str = VALUES) -> DataFrame:
    """Local recoding: partition mean for numbers, the set of distinct values for categories.

    A category's published value is its sorted value list, each with weight 1 / length. With
    `sets="bits"` it is the list's bitmap (`value_bitmaps`), so that a row carries bits and no strings.
    """
    summary = partition_summary(df, numeric, categorical, partition, sets)
    table = summary.select(
        partition, "size",
        *[F.coalesce(F.col(f"{q}__mean"), F.lit(0.0)).alias(f"{q}__pub") for q in numeric],
        *[F.col(f"{q}__{sets}").alias(f"{q}__pub") for q in categorical])
    return attach(df, table, [partition], "size").drop("size")


def partition_summary(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], partition: str = "partition", sets: str = VALUES) -> DataFrame:
    """Per partition: size, min/max/mean of numbers, and the distinct values of categories.

    `sets="values"` returns sorted lists `<attr>__values`, for dictionaries of a size that a row can
    hold; `sets="bits"` returns `<attr>__bits`, a bit for each dictionary entry.
    """
    if sets not in (VALUES, BITS):
        raise ValueError(f"sets must be {VALUES!r} or {BITS!r}")
    aggs = [F.count(F.lit(1)).alias("size")]
    for q in numeric:
        aggs += [F.min(q).cast("double").alias(f"{q}__min"), F.max(q).cast("double").alias(f"{q}__max"),
                 F.avg(q).alias(f"{q}__mean")]
    if sets == VALUES:
        aggs += [F.sort_array(F.collect_set(q)).alias(f"{q}__values") for q in categorical]
    out = df.groupBy(partition).agg(*aggs)
    for q in categorical if sets == BITS else ():
        bits = value_bitmaps(df, q, value_dictionary(df, q), partition).withColumnRenamed(partition, "_set_of")
        out = out.join(bits, F.col(partition).eqNullSafe(F.col("_set_of")), "left").drop("_set_of")
        out = out.withColumn(f"{q}__bits", F.coalesce(f"{q}__bits", F.array().cast(bits.schema[f"{q}__bits"].dataType)))
    return out


def value_dictionary(df: DataFrame, attr: str) -> DataFrame:
    """The distinct values of a category: `value`, `code` (0-based, in value order) and `n` rows. NULL has no code."""
    counts = df.where(F.col(attr).isNotNull()).groupBy(F.col(attr).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    scratch = Scratch(df.sparkSession, "dictionary")
    return scratch.save(dense_index(scratch.save(counts), [], ["value"], "code"))


def value_chunks(df: DataFrame, attr: str, dictionary: DataFrame, partition: str = "partition") -> DataFrame:
    """The set of values per partition as rows `(partition, chunk, bits)`, `CHUNK` codes a chunk.

    Chunks are or-ed before and after the shuffle, and strings only meet the dictionary. A partition of NULLs only has no row.
    """
    pairs = df.where(F.col(attr).isNotNull()).groupBy(partition, attr).agg(F.count(F.lit(1)).alias("_rows"))
    codes = dictionary.select(F.col("value").alias(attr), "code", F.col("n").alias("_weight"))
    coded = attach(pairs, codes, [attr], "_weight", how="inner")
    bit = F.expr(f"shiftleft(1L, cast(code % {CHUNK} as int))")
    return coded.groupBy(partition, F.floor(F.col("code") / CHUNK).alias("chunk")).agg(F.bit_or(bit).alias("bits"))


def value_bitmaps(df: DataFrame, attr: str, dictionary: DataFrame, partition: str = "partition") -> DataFrame:
    """`value_chunks` with the chunks of a partition in one row, as `<attr>__bits`: (chunk, bits) in order.

    A partition that holds a dictionary of a million values is 16,000 chunks.
    """
    chunks = value_chunks(df, attr, dictionary, partition)
    return chunks.groupBy(partition).agg(F.sort_array(F.collect_list(F.struct("chunk", "bits"))).alias(f"{attr}__bits"))


def set_members(bitmaps: DataFrame, attr: str, dictionary: DataFrame, partition: str = "partition") -> DataFrame:
    """A set's values as rows `(partition, value, weight)`, the weight being 1 / number of values.

    `bitmaps` comes from `value_bitmaps`, or is the rows of `value_chunks`. A set is counted from its chunks and not beside
    them: a chunk that carried its whole set along would make the rows grow with the square of the dictionary.
    """
    chunks = bitmaps
    if f"{attr}__bits" in bitmaps.columns:
        chunks = bitmaps.select(partition, F.explode(f"{attr}__bits").alias("_c")).select(partition, "_c.chunk", "_c.bits")
    chunks = Scratch(bitmaps.sparkSession, "chunks").save(chunks)
    sizes = chunks.groupBy(partition).agg(F.sum(F.bit_count("bits")).alias("_size"), F.count(F.lit(1)).alias("_chunks"))
    sized = attach(chunks, sizes, [partition], "_chunks")
    places = F.filter(F.sequence(F.lit(0), F.lit(CHUNK - 1)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    codes = sized.select(partition, "_size", "chunk", F.explode(places).alias("_bit"))
    coded = codes.select(partition, "_size", (F.col("chunk") * CHUNK + F.col("_bit")).alias("code"))
    named = attach(coded, dictionary, ["code"], "n", how="inner")
    return named.select(partition, "value", (F.lit(1.0) / F.col("_size")).alias("weight"))


def mondrian_invariants(rows: DataFrame, assigned: DataFrame, k: int, row_id: str = "row_id") -> DataFrame:
    """One row: rows covered exactly once, rows missing, and whether every partition has k rows."""
    # Read twice below; the assignment itself is a join of all rows.
    assigned = Scratch(assigned.sparkSession, "assigned").save(assigned.select(row_id, "partition"))
    seen = assigned.groupBy(row_id).agg(F.count(F.lit(1)).alias("n"), F.count("partition").alias("p"))
    cover = rows.select(row_id).join(seen, row_id, "left").agg(
        F.count(F.when((F.col("n") == 1) & (F.col("p") == 1), 1)).alias("covered_once"),
        F.count(F.when(F.col("n").isNull() | (F.col("p") == 0), 1)).alias("uncovered"))
    sizes = assigned.groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
    return cover.join(F.broadcast(sizes.agg((F.min("n") >= k).alias("all_at_least_k"))))
