"""Operator 3: balanced label propagation of linked documents, and gapless places inside shards.

Documents with the same link (here: equal texts) should share a shard. All start in a seeded shard. Documents of one link in one shard
are alike, so the state is one row per (link, shard) with a count. Each round joins every row with the shard where most of the link's
documents are and which has room, and moves it there as far as the shard's quota goes, largest gain first. A move goes
only towards more neighbours, so rounds end. A link larger than a shard fills it and then gathers in the next one.

Law `rows`: shard sizes in documents differ by at most one. Linked documents never exceed a shard's capacity and the others, which cut no
edge, fill what is left by rank, so the law holds exactly whenever the rounds stop.

Defined results: a null text is an empty one and empty texts are equal; a null doc_id is a document like others; repeated rows are
equal texts, each with its own slot (rows that share a doc_id are ordered by a number under which they are written); an empty table gives an empty result;
columns other than doc_id and text are not looked at, whatever their names, but `place_documents` replaces `shard` and `slot`.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minim.functions.ordering import bucket_digits, seeded_key
from minim.operators.keyed import attach, rank_by_key, running_sums
from minim.session import Scratch

SHARDS = 40
ROWS_PER_SLICE = 10_000


def text_nodes(documents: DataFrame, extra: Sequence[str] = (), seed: int = 3) -> DataFrame:
    """`doc_id, size, text_crc32, link, order, extra...`: one row per document; `link` is the same for equal texts."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("link"),
        seeded_key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order"), *extra)


def _per_shard(cells: DataFrame, n_shards: int) -> list[int]:
    """Documents in each shard: `n_shards` rows reach the driver."""
    found = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [int(found.get(s, 0)) for s in range(n_shards)]


def _at(values: list[int], index: str):
    """`values[index]` as a column."""
    return F.element_at(F.array(*[F.lit(int(v)).cast("bigint") for v in values]), F.col(index).cast("int") + 1)


def propagate(cells: DataFrame, capacity: list[int], scratch: Scratch, max_rounds: int | None = None) -> DataFrame:
    """Move `cells` (`link, shard, n`) towards their neighbours' shards; returns cells within `capacity`.

    Every move takes documents to a shard with more of their link, or as many under a larger tie, so the sum of squared cells grows or
    the ties do, and the rounds end by themselves; `max_rounds` ends them before that.
    """
    n_shards = len(capacity)
    for _ in count() if max_rounds is None else range(max_rounds):
        held = _per_shard(cells, n_shards)
        room = [max(0, c - h) for c, h in zip(capacity, held, strict=True)]
        ranked = cells.withColumn("gain", F.struct("n", F.xxhash64("link", "shard").alias("tie"), "shard"))
        best = ranked.where(_at(room, "shard") > 0).groupBy("link").agg(F.max("gain").alias("best"))
        wanted = (ranked.join(best, "link").where(F.col("best") > F.col("gain"))
                  .select("link", "shard", "n", F.col("best.shard").alias("to"),
                          F.struct((-F.col("best.n")).alias("most"), (-F.col("n")).alias("n"), "link", "shard").alias("order")))
        wanted = scratch.save(wanted)
        asked = wanted.count()
        if not asked:
            break
        queued = running_sums(wanted, ["to"], "order", ["n"], asked)
        moved = queued.select("link", "shard", "to", F.least(
            F.col("n"), F.greatest(F.lit(0).cast("bigint"), _at(room, "to") - F.col("n_upto") + F.col("n"))).alias("m")).where("m > 0")
        moved = scratch.save(moved)
        changes = moved.select("link", "shard", (-F.col("m")).alias("n")).union(moved.select("link", F.col("to").alias("shard"), F.col("m").alias("n")))
        cells = scratch.replace(cells, cells.select("link", "shard", "n").union(changes).groupBy("link", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
        scratch.drop(wanted, moved)
    held = _per_shard(cells, n_shards)
    if all(h <= c for h, c in zip(held, capacity, strict=True)):
        return cells
    # Only where nearly all documents are linked: the smallest cells of a full shard give way.
    queued = running_sums(cells.withColumn("order", F.struct((-F.col("n")).alias("n"), "link")), ["shard"], "order", ["n"], cells.count())
    kept = F.least(F.col("n"), F.greatest(F.lit(0).cast("bigint"), _at(capacity, "shard") - F.col("n_upto") + F.col("n")))
    return scratch.save(queued.select("link", "shard", kept.alias("n")).where("n > 0"))


def balanced_shards(nodes: DataFrame, n_shards: int = SHARDS, max_rounds: int | None = None) -> DataFrame:
    """`nodes` (with `link` and `order`, a seeded hex key) plus `shard` and `slot` under the law `rows`."""
    scratch = Scratch(nodes.sparkSession, "shards")
    columns = nodes.columns
    nodes = scratch.save(nodes.withColumn("_row", F.monotonically_increasing_id()))
    # One key per row: rows of one doc_id, or of none, would all lie in one slice.
    repeated = scratch.save(nodes.groupBy("order").agg(F.count(F.lit(1)).alias("_same")).where("_same > 1"))
    if not repeated.isEmpty():
        order = F.when(F.col("_same").isNotNull(), F.md5(F.concat_ws(":", "order", "_row"))).otherwise(F.col("order"))
        nodes = scratch.replace(nodes, attach(nodes, repeated, ["order"], "_same").withColumn("order", order))
    nodes = nodes.select(*columns)
    total = nodes.count()
    digits = bucket_digits(total, ROWS_PER_SLICE)
    capacity = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    sizes = nodes.groupBy("link").agg(F.count(F.lit(1)).alias("_linked")).where("_linked > 1")
    marked = scratch.save(attach(nodes, sizes, ["link"], "_linked"))
    linked = marked.where("_linked is not null")
    start = F.pmod(F.xxhash64("order"), F.lit(n_shards)).cast("int")
    cells = scratch.save(linked.groupBy("link", start.alias("shard")).agg(F.count(F.lit(1)).alias("n")))
    cells = propagate(cells, capacity, scratch, max_rounds)
    # A link's documents take its cells by rank; at most `n_shards` cells per link.
    upto = F.sum("n").over(Window.partitionBy("link").orderBy("shard"))
    bounds = (cells.withColumn("upto", upto).groupBy("link")
              .agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("_cells"), F.sum("n").alias("_kept")))
    ranked = rank_by_key(linked.drop("_linked"), ["link"], "order", "_rank", digits)
    shard = F.filter("_cells", lambda c: c["upto"] > F.col("_rank"))
    placed = scratch.save(attach(ranked, bounds, ["link"], "_kept").withColumn("shard", F.get(shard, F.lit(0))["shard"]).select(*columns, "shard"))
    held = _per_shard(cells, n_shards)
    gaps, upto_gap = [], 0
    for c, h in zip(capacity, held, strict=True):
        upto_gap += c - h
        gaps.append(upto_gap)
    free = marked.where("_linked is null").select(*columns).union(placed.where("shard is null").select(*columns))
    free = rank_by_key(scratch.save(free), [], "order", "_rank", digits)
    # The first shard whose gap ends beyond the rank.
    full = sum((F.lit(g) <= F.col("_rank")).cast("int") for g in gaps)
    everyone = placed.where("shard is not null").union(free.withColumn("shard", full).select(*columns, "shard"))
    # Free documents come to shards in the order of `order`; slots follow another key, so that no slice of a shard is larger than others.
    everyone = scratch.save(everyone.withColumn("_slot", F.md5("order")))
    scratch.drop(repeated, marked, cells, placed)
    return rank_by_key(everyone, ["shard"], "_slot", "slot", digits).drop("_slot")


def shard_documents(documents: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """`doc_id, size, text_crc32, law, shard, slot, grown_shard` of every document, equal texts being linked."""
    placed = balanced_shards(text_nodes(documents), n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


def place_documents(documents: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """`documents` with `shard` and `slot`, columns of these names being replaced; equal texts are linked.

    Texts move once, in the join with their places. Rows equal in doc_id and text are told apart by a number; then the rows are written once more
    with it, which is done only where there are such rows.
    """
    documents = documents.drop("shard", "slot")
    columns = documents.columns
    scratch = Scratch(documents.sparkSession, "places")
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc")
    keys = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_link")]
    # The input travels as one struct, so none of its names can clash.
    texts = documents.select(row, *keys)
    if not documents.select(*keys).groupBy("_id", "_link").count().where("count > 1").isEmpty():
        texts = scratch.save(texts.withColumn("_copy", F.monotonically_increasing_id()))
        nodes = text_nodes(texts.select(F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"), "_copy"), ["_copy"])
        places = balanced_shards(nodes, n_shards).select("_copy", "shard", "slot")
        return texts.join(places, "_copy").select("_doc.*", "shard", "slot")
    places = balanced_shards(text_nodes(documents), n_shards)
    places = places.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("link").alias("_link"), "shard", "slot")
    return texts.join(scratch.save(places), ["_id", "_link"]).select("_doc.*", "shard", "slot")


def edge_cut(placed: DataFrame) -> DataFrame:
    """`links, cut`: linked pairs of neighbours (all documents of a link with its largest cell) and those in other shards."""
    cells = placed.groupBy("text_crc32", "size", "shard").agg(F.count(F.lit(1)).alias("n"))
    links = cells.groupBy("text_crc32", "size").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where("n > 1")
    return links.agg(F.sum("n").alias("links"), F.sum(F.col("n") - F.col("most")).alias("cut"))
