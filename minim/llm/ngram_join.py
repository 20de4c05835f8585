"""Operator 9: documents linked by the Jaccard similarity of their word n-grams, as components.

A document's distinct n-grams are ordered rare first, by a fixed-size table of corpus counts and then by hash. Two documents that link
share an n-gram among the first few of both (the prefix), so candidates meet on prefix n-grams only. Length, positional and
suffix filters test a candidate from numbers alone; what passes is verified once, exactly, on the two whole sets.

Equal sets are one class first. A class that shares a prefix n-gram with thousands of others is not paired with all of them: each n-gram
tests its documents against one hub, links are joined to components, and only documents outside the largest component of
an n-gram go on, against a new hub or, once few are left or hubs find no more, against all documents of other components. Two documents are left untested
only if they are in one component already, so components are exact. The links found connect every component;
they are not all pairs.

Defined results: A-Z are lower-cased; null, empty or wordless texts have no n-grams and are components of their own; fewer words than
the width are one n-gram; rows with a null doc_id are left out of the join; equal rows are one class; of rows that share
doc_id but not text each is placed by its own text; empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minim.llm.graph import components
from minim.llm.texts import as_bytes, byte_lists, mix, partitions_of, shingle_sets, small_batches
from minim.session import Scratch

# Counters of the n-gram counts: 8 bytes each in a task, 1 byte each where they are used, at any corpus size.
COUNTER_BITS = 22
_BLOCK = 1 << 14
_SHARE = 16
STAR_ROUNDS = 6
# Partners of a hub that are held against one copy of its set.
PARTNERS = 500
# While star rounds still find links, the last step waits until it joins at most this many pairs for each candidate row.
PAIRS_PER_ROW = 16
# Bits of the filter that picks the documents whose sets are needed: 64 a row, in at most 131,072 rows.
PICK_BITS = 23


@dataclass(frozen=True)
class Rule:
    """Documents link when den * intersection >= num * union of their `width`-word shingles."""

    width: int = 5
    num: int = 8
    den: int = 10

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-self.num * n // self.den) + 1

    def overlap(self, n: Column, m: Column) -> Column:
        """The least intersection of two linked sets of n and m."""
        return F.ceil((n + m) * self.num / F.lit(self.num + self.den)).cast("int")


def _count_blocks(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        waiting: list[np.ndarray] = []
        size = 0
        for _, texts in byte_lists(batches, 0):
            h = (shingle_sets(texts, rule.width)[0] >> np.uint64(64 - COUNTER_BITS)).astype(np.int32)
            waiting.append(h)
            size += len(h)
            if size > 1 << 21:
                counts += np.bincount(np.concatenate(waiting), minlength=1 << COUNTER_BITS)
                waiting, size = [], 0
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=1 << COUNTER_BITS)
        blocks = counts.reshape(-1, _BLOCK)
        used = np.flatnonzero(blocks.any(1))
        if len(used):
            packed = [_pack(blocks[b]) for b in used]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])
    return run


def _pack(block: np.ndarray) -> bytes:
    """Places and values of the counters in use, compressed."""
    at = np.flatnonzero(block)
    return zlib.compress(at.astype(np.uint16).tobytes() + block[at].tobytes(), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(packed)
    n = len(raw) // 10
    return np.frombuffer(raw, np.uint16, n), np.frombuffer(raw, np.int64, n, 2 * n)


def _add_blocks(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(_BLOCK, np.int64)
    for packed in table["counts"].to_pylist():
        at, n = _unpack(packed)
        total[at] += n
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([_pack(total)], pa.binary())})


def rarity(documents: DataFrame, rule: Rule) -> np.ndarray:
    """How frequent an n-gram is, by the leading bits of its hash: 2**COUNTER_BITS steps of a logarithmic scale.

    Counts cover all documents. Tasks hand on compressed blocks of counters, summed in two levels; the table that reaches the driver has a fixed size.
    """
    tasks = documents.select(as_bytes().alias("text")).mapInArrow(_count_blocks(rule), "block int, counts binary")
    tasks = tasks.withColumn("share", F.spark_partition_id() % _SHARE)
    summed = tasks.groupBy("block", "share").applyInArrow(_add_blocks, "block int, counts binary")
    summed = summed.groupBy("block").applyInArrow(_add_blocks, "block int, counts binary")
    out = np.zeros((1 << COUNTER_BITS) // _BLOCK * _BLOCK, np.uint8).reshape(-1, _BLOCK)
    for row in summed.collect():
        at, n = _unpack(bytes(row["counts"]))
        out[row["block"], at] = np.minimum(np.rint(np.log2(n + 1.0) * 6), 255).astype(np.uint8)
    return out.reshape(-1)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _ids(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes().alias("text"))


def _described(documents: DataFrame, rule: Rule, rare) -> DataFrame:
    """Per document: set size, 128-bit set key, 16 counts of its hashes by leading bits, and the prefix, rare first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of = rare.value
        for rows, texts in byte_lists(batches, 1):
            h, offset = shingle_sets(texts, rule.width)
            n = np.diff(offset)
            doc = np.repeat(np.arange(len(n)), n)
            keys = []
            for salt in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)):
                upto = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(mix(h ^ salt), out=upto[1:])
                keys.append(pa.array(_signed(upto[offset[1:]] - upto[offset[:-1]])))
            bins = np.minimum(np.bincount(doc * 16 + (h >> np.uint64(60)).astype(np.int64), minlength=16 * len(n)).reshape(-1, 16), 255).astype(np.uint8)
            halves = np.ascontiguousarray(bins).view(np.int64)
            h = h[np.lexsort((h, order_of[h >> np.uint64(64 - COUNTER_BITS)], doc))]
            at = np.arange(len(h)) - np.repeat(offset[:-1], n)
            taken = at < rule.prefix(n)[doc]
            upto = np.append(0, np.cumsum(np.bincount(doc[taken], minlength=len(n))))
            prefix = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(_signed(h[taken])))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n, pa.int32()), *keys, pa.array(halves[:, 0]), pa.array(halves[:, 1]), prefix],
                ["doc_id", "n", "k1", "k2", "s1", "s2", "prefix"])

    return _ids(documents).mapInArrow(run, "doc_id long, n int, k1 long, k2 long, s1 long, s2 long, prefix array<long>")


def _sets(documents: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """`node, grams` (ascending hashes as bytes) of the nodes, and of the documents that the bit filter takes for one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in byte_lists(batches, 1):
            h, offset = shingle_sets(texts, rule.width)
            packed = pa.array([h[a:b].tobytes() for a, b in zip(offset[:-1], offset[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), packed], ["node", "grams"])

    bit = F.pmod(F.xxhash64("node"), F.lit(1 << PICK_BITS))
    words = (nodes.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_bits")))
    marked = _ids(documents).withColumn("_bit", F.pmod(F.xxhash64("doc_id"), F.lit(1 << PICK_BITS)))
    near = marked.join(F.broadcast(words), F.shiftright("_bit", 6) == F.col("_word")).where(F.expr("(shiftright(_bits, cast(_bit & 63 as int)) & 1) = 1"))
    return near.select("doc_id", "text").mapInArrow(run, "node long, grams binary")


def _verified(rule: Rule):
    """Rows `(hub, bucket, node, own, grams)`, sorted, to `(u, v, linked)`: the hub's sets come first and every other set is held against them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sets = None, []
        for batch in batches:
            u, v, linked = [], [], []
            for hub, bucket, node, own, grams in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if here != (hub, bucket):
                    here, sets = (hub, bucket), []
                y = np.frombuffer(grams, np.uint64)
                if own:
                    # Rows that share a doc_id give it several sets.
                    sets.append(y)
                    continue
                both = [len(np.intersect1d(x, y, assume_unique=True)) for x in sets]
                u.append(min(hub, node))
                v.append(max(hub, node))
                linked.append(any(rule.den * c >= rule.num * (len(x) + len(y) - c) for x, c in zip(sets, both, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(linked, pa.bool_())], ["u", "v", "linked"])
    return run


def _distance(left: str, right: str) -> Column:
    """A lower bound of the sets' symmetric difference: by sixteen ranges of the hash."""
    out = F.lit(0)
    for half in ("s1", "s2"):
        for shift in range(0, 64, 8):
            a, b = (F.shiftrightunsigned(F.col(f"{side}.{half}"), shift).bitwiseAND(F.lit(255)) for side in (left, right))
            out = out + F.abs(a - b)
    return out


def _passes(rule: Rule) -> Column:
    """Whether two documents that meet in an n-gram, structs x and y, may link: the length, positional and suffix filters.

    The positional filter takes the n-gram for the first that both share. Where it is not, the bound is too low and the pair may
    be refused; it passes where they share the first one, if it can link at all.
    """
    n, m = F.col("x.n"), F.col("y.n")
    least = rule.overlap(n, m)
    length = (n * rule.den >= m * rule.num) & (m * rule.den >= n * rule.num)
    place = F.least(n - F.col("x.pos"), m - F.col("y.pos"))
    return length & (place >= least) & (_distance("x", "y") <= n + m - 2 * least)


def _distinct(pairs: DataFrame) -> DataFrame:
    """The distinct `u < v` of pairs of structs x, y."""
    return pairs.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).where("u < v").distinct()


def _meeting(classes: DataFrame, rule: Rule) -> DataFrame:
    """`node, n, s1, s2, pos, gram`: the prefix n-grams in which a class may meet another.

    A row stays if its n-gram has other rows and enough n-grams follow in its document for the smallest partner possible there. Most
    rows end here, so what only the others need is joined after.
    """
    grams = classes.select("node", "n", F.posexplode("_of.prefix").alias("pos", "gram"))
    gram = Window.partitionBy("gram")
    met = grams.withColumns({"_met": F.count(F.lit(1)).over(gram), "_least": F.min("n").over(gram)}).where("_met > 1")
    partner = F.greatest(F.col("_least"), F.ceil(F.col("n") * rule.num / F.lit(rule.den)).cast("int"))
    met = met.where(F.col("n") - F.col("pos") >= rule.overlap(F.col("n"), partner))
    met = met.withColumn("_met", F.count(F.lit(1)).over(gram)).where("_met > 1").drop("_met", "_least")
    # A node has as many rows as its prefix at most.
    return met.join(classes.select("node", "n", "_of.s1", "_of.s2"), ["node", "n"]).select("node", "n", "s1", "s2", "pos", "gram")


def _verify(pairs: DataFrame, documents: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """`u, v, linked` of each pair; only the sets of its documents are built, once each.

    Of a pair the node with more pairs is the hub. Its partners are dealt into buckets of about PARTNERS by their hash; a bucket gets the hub's set
    once and each partner's set, so that a hub of millions of pairs is copied per bucket and not per pair, and no task gets all of them.
    """
    sides = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("pairs"))
    marked = pairs
    for side in ("u", "v"):
        degree = sides.select(F.col("node").alias(f"_{side}"), F.col("pairs").alias(f"_{side}_pairs"))
        marked = marked.join(degree, F.col(side) == F.col(f"_{side}")).drop(f"_{side}")
    larger = F.col("_u_pairs") >= F.col("_v_pairs")
    hub, node = F.when(larger, F.col("u")).otherwise(F.col("v")), F.when(larger, F.col("v")).otherwise(F.col("u"))
    buckets = F.ceil(F.greatest("_u_pairs", "_v_pairs") / F.lit(PARTNERS))
    marked = marked.select(hub.alias("hub"), F.pmod(F.xxhash64(node), buckets).alias("bucket"), node.alias("node"))
    asked = marked.select("hub", "bucket", "node", F.lit(False).alias("own")).union(
        marked.select("hub", "bucket", F.col("hub").alias("node"), F.lit(True).alias("own")).distinct())
    # Written, so that its size is known: sets are only moved for a join with it where it is large.
    asked = scratch.save(asked)
    sets = _sets(documents, asked.select("node").distinct(), rule)
    both = (asked.join(sets, "node").select("hub", "bucket", "node", "own", "grams")
            .repartition(partitions_of(pairs), "hub", "bucket").sortWithinPartitions("hub", "bucket", F.desc("own")))
    small_batches(pairs.sparkSession, 100)
    # A partner of several sets has a row for each.
    found = scratch.save(both.mapInArrow(_verified(rule), "u long, v long, linked boolean").groupBy("u", "v").agg(F.max("linked").alias("linked")))
    scratch.drop(asked)
    return found


def _node() -> Column:
    return F.struct("node", "n", "pos", "s1", "s2")


def _star(rows: DataFrame, salt: int) -> DataFrame:
    """Pairs of each n-gram's hub with its rows of other components.

    The hub is the row with the fewest rarer n-grams before this one, the likeliest centre of near copies; rows that meet in
    several n-grams mostly find the same hub.
    """
    order = F.struct("pos", F.xxhash64(F.lit(salt), F.col("node")).alias("order"), _node().alias("it"), F.col("component").alias("of"))
    hub = F.min(F.when(F.col("minor"), order)).over(Window.partitionBy("gram"))
    return (rows.withColumn("_hub", hub).where(F.col("_hub.of") != F.col("component"))
            .select(F.col("_hub.it").alias("x"), _node().alias("y")))


def _unresolved(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """The rows of n-grams that lie in several components; `minor` outside the largest, `total` rows of the n-gram."""
    if found is None:
        named = rows.withColumn("component", F.col("node"))
        return named.withColumn("minor", F.lit(True)).withColumn("total", F.lit(0).cast("bigint"))
    named = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    gram = Window.partitionBy("gram")
    named = named.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("gram", "component")))
    named = named.withColumns({"total": F.count(F.lit(1)).over(gram), "_major": F.max(F.struct("_size", "component")).over(gram)})
    return (named.withColumn("_apart", F.col("total") > F.col("_major._size")).where("_apart")
            .withColumn("minor", F.col("component") != F.col("_major.component")).drop("_size", "_major", "_apart"))


def ngram_classes(documents: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`(members, links, found)`: each document's class and set size, the verified links of classes, and the component of linked classes."""
    spark = documents.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ngrams")
    rare = spark.sparkContext.broadcast(rarity(documents, rule))
    described = scratch.save(_described(documents, rule, rare))
    filled = described.where("n > 0")
    classes = filled.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("s1", "s2", "prefix"), "doc_id").alias("_of"))
    classes = scratch.save(classes)
    # Most of a prefix is in no other document: such rows end here.
    rows = scratch.save(_meeting(classes, rule))
    most = PAIRS_PER_ROW * rows.count()
    tested: list[DataFrame] = []
    found, progress = None, True
    for salt in range(STAR_ROUNDS + 1):
        left = _unresolved(rows, found)
        last = False
        if found is not None:
            left = scratch.save(left)
            cost = left.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("minor"), F.col("total"))).alias("pairs")).first()
            if not cost["rows"]:
                break
            last = salt == STAR_ROUNDS or not progress or cost["pairs"] <= most
        if last:
            x = left.where("minor").select("gram", _node().alias("x"), F.col("component").alias("_a"))
            y = left.select(F.col("gram").alias("_gram"), _node().alias("y"), F.col("component").alias("_b"), F.col("minor").alias("_m"))
            # Two minor rows meet once. The filters stand in the join, so what they refuse is no row.
            meet = (F.col("_a") != F.col("_b")) & (~F.col("_m") | (F.col("x.node") < F.col("y.node")))
            pairs = x.join(y, (F.col("gram") == F.col("_gram")) & meet & _passes(rule)).select("x", "y")
        else:
            pairs = _star(left, salt).where(_passes(rule))
        pairs = _distinct(pairs)
        for done in tested:
            pairs = pairs.join(done.select("u", "v"), ["u", "v"], "left_anti")
        pairs = scratch.save(pairs)
        tested.append(_verify(pairs, documents, rule, scratch))
        scratch.drop(left, pairs)
        links = reduce(DataFrame.union, [t.where("linked").select("u", "v") for t in tested])
        progress = not tested[-1].where("linked").isEmpty()
        found = components(links, scratch)
        if last:
            break
    members = scratch.save(described.select("doc_id", "n", "k1", "k2").join(classes.select("k1", "k2", "n", "node"), ["k1", "k2", "n"], "left"))
    scratch.drop(described, classes, rows)
    return members, links, found


def ngram_components(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """`doc_id, n_shingles, component_id` of every document; a component is named by its smallest doc_id."""
    members, _, found = ngram_classes(documents, rule)
    return (members.join(found, "node", "left")
            .select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id")))


def keep_first(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """The rows of `documents` that are the smallest doc_id of their component; of rows equal in doc_id and text one stays, a null doc_id stays.

    Of rows that differ in other columns only, the one with the smallest hash of all columns stays.
    """
    scratch = Scratch(documents.sparkSession, "ngram-keep")
    members, _, found = ngram_classes(documents, rule)
    gone = members.join(found, "node", "left").where(F.coalesce("component", "node", "doc_id") != F.col("doc_id"))
    gone = scratch.save(gone.select(F.col("doc_id").alias("_gone")).distinct())
    # The input travels as one struct, so none of its names can clash.
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_doc"))
    kept = rows.join(gone, F.col("_doc.doc_id").cast("bigint") == F.col("_gone"), "left_anti")
    if members.groupBy("doc_id", "k1", "k2", "n").count().where("count > 1").isEmpty():
        return kept.select("_doc.*")
    # Each task keeps one row per text, so that a row that is repeated often moves once from each.
    named = kept.where("_doc.doc_id IS NOT NULL").select(F.col("_doc.doc_id").alias("_id"), F.md5(F.coalesce("_doc.text", F.lit("")).cast("binary")).alias("_text"),
                                                         F.col("_doc.text").isNull().alias("_null"), "_doc", F.xxhash64("_doc").alias("_order"))
    first = named.groupBy("_id", "_text", "_null").agg(F.min_by("_doc", "_order").alias("_doc"))
    return first.select("_doc").unionByName(kept.where("_doc.doc_id IS NULL")).select("_doc.*")
