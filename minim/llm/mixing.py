"""Operator 6: a token budget divided over a tree of document groups, and each leaf's token prefix of seeded epochs.

DataFrame functions only. The budget goes down the tree level by level: siblings share it by weight; one whose documents do not
suffice (its tokens times `max_epochs`) is filled, and what it lacks goes to its siblings by weight. A parent never gets more than its
children hold, so a shortage reaches an ancestor's siblings only when all siblings are full. All amounts are whole tokens; the
fractions that division leaves (fewer tokens than siblings) stay unassigned.

A leaf passes its documents as often as its budget allows. Each epoch has its own seeded order; the last is cut at the budget, inside a
document if need be. Only group sums and one slice of each leaf are shuffled; a leaf of any size is spread over slices.

Defined results: a null text counts no tokens and a null group value is the group ''; documents without tokens take a part of 0;
rows with the same doc_id in a leaf share a place in the order, as do those without one; where the cut falls among them, a number under which they are
written tells them apart, so that no budget is passed; a weight of 0 excludes a group; an empty table gives an empty mix. Other columns are kept aside by `mix` and kept by `select_mix`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minim.functions.ordering import bucket_digits, key_bucket, seeded_key
from minim.session import Scratch

PATH = ("domain", "lang", "source")
DOMAINS = 4
SEED = 17
ROWS_PER_SLICE = 1_000
# Leaves up to this number are broadcast; more are joined.
LEAVES = 20_000


def n_words(text: str | Column = "text") -> Column:
    """Runs of characters outside space, tab, newline, vertical tab, form feed and carriage return."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def domain_of(source: str = "source") -> Column:
    """The domain of a source: its number modulo DOMAINS."""
    number = F.regexp_extract(source, r"(\d+)$", 1).try_cast("bigint")
    return F.concat(F.lit("domain"), F.coalesce(F.pmod(number, F.lit(DOMAINS)), F.lit(0)).cast("string"))


def grouped(documents: DataFrame, path: Sequence[str] = PATH) -> DataFrame:
    """`documents` with the columns of the tree, null replaced by ''; a missing `domain` is made from the source."""
    if "domain" in path and "domain" not in documents.columns:
        documents = documents.withColumn("domain", domain_of())
    return documents.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in path})


def _weight(name: str, weights: Mapping[str, int]) -> Column:
    """The weight of a group by its name at this level; 1 where none is given."""
    out = F.lit(1)
    for value, weight in weights.items():
        out = F.when(F.col(name) == value, F.lit(int(weight))).otherwise(out)
    return out.cast("bigint")


def divide(leaves: DataFrame, budget: Column, path: Sequence[str], weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """`budget` of every leaf, for `leaves` of `path..., available`; one row per leaf."""
    path = list(path)
    levels = leaves.withColumn("_cap", F.col("available") * max_epochs)
    for depth in range(len(path), 0, -1):
        # Bottom-up: what each group can hold; a weight of 0 holds nothing.
        own = F.when(_weight(path[depth - 1], weights.get(path[depth - 1], {})) > 0, F.col("_cap")).otherwise(F.lit(0))
        levels = levels.withColumn(f"_cap{depth}", own)
        levels = levels.withColumn("_cap", own if depth == len(path) else F.col(f"_cap{depth}"))
        if depth > 1:
            inside = Window.partitionBy(*path[:depth - 1])
            # Each group counts once: by its first leaf.
            first = F.row_number().over(Window.partitionBy(*path[:depth]).orderBy(*path)) == 1
            levels = levels.withColumn("_once", F.when(first, F.col(f"_cap{depth}")).otherwise(F.lit(0)))
            levels = levels.withColumn("_cap", F.sum("_once").over(inside)).drop("_once")
    tree = levels.drop("_cap")
    shares = None
    for depth in range(1, len(path) + 1):
        group, parent = path[:depth], path[:depth - 1]
        nodes = tree.groupBy(*group).agg(F.max(f"_cap{depth}").alias("_cap"))
        if shares is None:
            total = F.sum("_cap").over(Window.partitionBy())
            nodes = nodes.withColumn("_budget", F.least(budget.cast("bigint"), total))
        else:
            nodes = nodes.join(shares, parent)
        nodes = nodes.withColumn("_w", _weight(path[depth - 1], weights.get(path[depth - 1], {})))
        ratio = F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")).otherwise(F.lit(float("inf")))
        among = Window.partitionBy(*parent).orderBy(ratio, path[depth - 1])
        filled = F.coalesce(F.sum("_cap").over(among.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        weight = F.sum("_w").over(among.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        # Full when its part of what is left by the fuller siblings is all that it holds; whole numbers only.
        nodes = nodes.withColumn("_full", (F.col("_w") > 0) & ((F.col("_budget") - filled) * F.col("_w") >= F.col("_cap") * weight))
        whole = Window.partitionBy(*parent)
        held = F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(F.lit(0))).over(whole)
        rest = F.sum(F.when(F.col("_full"), F.lit(0)).otherwise(F.col("_w"))).over(whole)
        nodes = nodes.withColumns({"_held": held, "_rest": rest})
        part = F.when(F.col("_full"), F.col("_cap")).otherwise(
            F.coalesce(F.expr("((_budget - _held) * _w) div nullif(_rest, 0)"), F.lit(0)))
        shares = nodes.select(*group, part.alias("_budget"))
    return tree.select(*path, "available").join(shares.withColumnRenamed("_budget", "budget"), path)


def _crossing(ordered: DataFrame, path: Sequence[str], key: str, digits: int) -> DataFrame:
    """Per leaf of `path..., key (hex), n_tokens, _rest`: the key at which the running sum of tokens reaches `_rest`, as `(path..., key, _left, _rows)`.

    `_left` is what the rows of that key may still take, and `_rows` how many they are.
    """
    path = list(path)
    ordered = ordered.withColumn("_slice", key_bucket(F.col(key), digits))
    slices = ordered.groupBy(*path, "_slice", "_rest").agg(F.sum("n_tokens").alias("_tokens"))
    # At most 16**digits rows per leaf.
    upto = F.sum("_tokens").over(Window.partitionBy(*path).orderBy("_slice"))
    crossing = (slices.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_tokens"))
                .where("_before < _rest and _upto >= _rest").select(*path, "_slice", "_before"))
    inside = _join_leaves(ordered, crossing, [*path, "_slice"], "inner")
    places = inside.groupBy(*path, "_slice", "_rest", "_before", key).agg(F.sum("n_tokens").alias("_tokens"), F.count(F.lit(1)).alias("_rows"))
    upto = F.col("_before") + F.sum("_tokens").over(Window.partitionBy(*path, "_slice").orderBy(key))
    return (places.withColumn("_upto", upto).withColumn("_start", F.col("_upto") - F.col("_tokens"))
            .where("_start < _rest and _upto >= _rest").select(*path, key, (F.col("_rest") - F.col("_start")).alias("_left"), "_rows"))


def _leaf_prefixes(rows: DataFrame, leaves: DataFrame, path: Sequence[str], seed: int, scratch: Scratch) -> DataFrame:
    """Adds `epochs, cut, cut_tokens, tie, tie_tokens` to `leaves`: whole passes, the last place of the part pass with its tokens, and the
    same among the rows of that place where they are several."""
    path = list(path)
    digits = bucket_digits(rows.count(), ROWS_PER_SLICE)
    leaves = leaves.withColumn("epochs", F.expr("coalesce(budget div nullif(available, 0), 0)"))
    leaves = leaves.withColumn("_rest", F.col("budget") - F.col("epochs") * F.col("available"))
    ordered = _join_leaves(rows, leaves.where("_rest > 0").select(*path, "epochs", "_rest"), path, "inner").withColumn("_place", place(seed))
    cut = scratch.save(_crossing(ordered, path, "_place", digits).select(*path, F.col("_place").alias("cut"), F.col("_left").alias("cut_tokens"), "_rows"))
    shared = cut.where("_rows > 1").select(*path, "cut", F.col("cut_tokens").alias("_rest"))
    out = [F.lit(None).cast("string").alias("tie"), F.lit(None).cast("bigint").alias("tie_tokens")]
    made = leaves.join(cut.drop("_rows"), path, "left")
    if not shared.isEmpty():
        among = _join_leaves(ordered.drop("_rest"), shared, path, "inner").where(F.col("_place") == F.col("cut"))
        ties = _crossing(among, path, "_tie", digits).select(*path, F.col("_tie").alias("tie"), F.col("_left").alias("tie_tokens"))
        made, out = made.join(ties, path, "left"), ["tie", "tie_tokens"]
    return made.select(*path, "available", "budget", "epochs", "cut", "cut_tokens", *out)


def _join_leaves(rows: DataFrame, leaves: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join a leaf table: broadcast while it is known to be short."""
    small = leaves.limit(LEAVES + 1).count() <= LEAVES
    return rows.join(F.broadcast(leaves) if small else leaves, list(keys), how)


def place(seed: int) -> Column:
    """A document's place in the order of the leaf's part pass."""
    return seeded_key(seed, F.col("epochs"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def budgets(
    rows: DataFrame, path: Sequence[str] = PATH, weights: Mapping[str, Mapping[str, int]] | None = None, share: tuple[int, int] = (1, 2),
    max_epochs: int = 3, seed: int = SEED,
) -> DataFrame:
    """The leaves with `available, budget, epochs, cut, cut_tokens, tie, tie_tokens`, for `rows` of `path..., doc_id, n_tokens`
    and, if they were written with it, `_tie` (`tie_key`).

    The budget of the whole mix is `share` (a fraction) of all tokens.
    """
    scratch = Scratch(rows.sparkSession, "mix")
    if "_tie" not in rows.columns:
        rows = scratch.save(rows.withColumn("_tie", tie_key()))
    leaves = scratch.save(rows.groupBy(*path).agg(F.sum("n_tokens").alias("available")))
    total = leaves.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("t")).first()["t"]
    shared = scratch.save(divide(leaves, F.lit(total * share[0] // share[1]), path, weights or {}, max_epochs))
    return scratch.save(_leaf_prefixes(rows, shared, path, seed, scratch))


def tie_key() -> Column:
    """A number for each row, as a uniform hex key; the rows must be written with it, as it is another one when they are made again."""
    return F.md5(F.monotonically_increasing_id().cast("string"))


def _taken(seed: int) -> Column:
    """Tokens that a row gives to the part pass."""
    at = place(seed)
    among = (F.when(F.col("tie").isNull(), F.least("n_tokens", "cut_tokens")).when(F.col("_tie") < F.col("tie"), F.col("n_tokens"))
             .when(F.col("_tie") == F.col("tie"), F.least("n_tokens", "tie_tokens")).otherwise(F.lit(0)))
    return F.when(at < F.col("cut"), F.col("n_tokens")).when(at == F.col("cut"), among).otherwise(F.lit(0)).cast("bigint")


def mix(
    documents: DataFrame, path: Sequence[str] = PATH, weights: Mapping[str, Mapping[str, int]] | None = None, share: tuple[int, int] = (1, 2),
    max_epochs: int = 3, seed: int = SEED,
) -> DataFrame:
    """What the mix takes of every document: `doc_id, path..., n_tokens, epochs, prefix_tokens, total_tokens`."""
    rows = Scratch(documents.sparkSession, "mix-rows").save(
        grouped(documents, path).select("doc_id", *path, n_words().alias("n_tokens"), tie_key().alias("_tie")))
    leaves = budgets(rows, path, weights, share, max_epochs, seed)
    out = _join_leaves(rows, leaves, path, "left").withColumn("prefix_tokens", _taken(seed))
    return out.select("doc_id", *path, "n_tokens", "epochs", "prefix_tokens",
                      (F.col("epochs") * F.col("n_tokens") + F.col("prefix_tokens")).alias("total_tokens"))


def select_mix(
    documents: DataFrame, path: Sequence[str] = PATH, weights: Mapping[str, Mapping[str, int]] | None = None, share: tuple[int, int] = (1, 2),
    seed: int = SEED,
) -> DataFrame:
    """The rows of `documents` in a mix of at most one epoch, whole: a document cut by its leaf's budget stays."""
    own = {c: f"_mix_{c}" for c in path}
    scratch = Scratch(documents.sparkSession, "mix-rows")
    # The input travels as one struct, so none of its names can clash.
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_mix_row")
    rest = {c: F.col(f"`{c}`").alias(c) for c in dict.fromkeys(["doc_id", "text", *path]) if c in documents.columns}
    named = documents.select(whole, *rest.values(), *(["source"] if "source" in documents.columns and "source" not in rest else []))
    tagged = grouped(named, path).select("doc_id", "_mix_row", *[F.col(c).alias(own[c]) for c in path], n_words().alias("n_tokens"))
    columns = ["doc_id", *own.values(), "n_tokens"]
    weights = {own[c]: w for c, w in (weights or {}).items()}
    rows = scratch.save(tagged.select(*columns, tie_key().alias("_tie")))
    leaves = budgets(rows, list(own.values()), weights, share, 1, seed)
    at = place(seed)
    taken = (at < F.col("cut")) | ((at == F.col("cut")) & F.col("tie").isNull())
    if not leaves.where("tie IS NOT NULL").isEmpty():
        # Rows that share a place at a cut: they are told apart by a number, with which all rows are written once more.
        tagged = scratch.save(tagged.withColumn("_tie", tie_key()))
        leaves = budgets(tagged.select(*columns, "_tie"), list(own.values()), weights, share, 1, seed)
        taken = taken | ((at == F.col("cut")) & (F.col("_tie") <= F.col("tie")))
    chosen = _join_leaves(tagged, leaves, list(own.values()), "inner").where((F.col("epochs") > 0) | taken)
    return chosen.select("_mix_row.*")
