"""Hard negatives: per anchor and positive, the best-scored rows of other labels just below the positive.

A row is `(vec_id, embedding, label)`; a component x counts as floor(256 x), and a score is the integer inner product. Anchors are a stated set of
rows. An anchor's positives are its first `positives` other rows of its label, by score descending and then id; a positive of score p opens the
window `low * p <= 100 * score <= high * p`, and its negatives are the first `negatives` rows of another label in it.

Rows are packed into blocks once. Every anchor block meets every row block: a stated query set against all rows. The first pass keeps an
anchor's best positives per task, the second its first rows per window, as the windows are known by then: what a task sends on is bounded by its anchors,
and nothing is lost, as the first few of all rows are among the first few of each part. Both passes pack a pair into 25 bytes that sort as (anchor,
descending score, positives first, id); the pairs are dealt by anchor and sorted inside the partitions, and an iterator reads them in that order, opens a
window at each positive, emits negatives and closes what is full or out of reach. It holds one anchor's open windows and never its rows.
Pairs of the score of a positive come after it, whatever their ids, as a window holds its own score.

Rows with a null id, label or vector, or with a null, NaN or infinite component take no part. Vectors of different lengths meet on
their common components; an empty one scores 0 with all. An anchor is its id: rows of that id are not "other" rows; of several
rows with one anchor id the one with the smallest label and vector asks. Equal (id, score) pairs of an anchor count once. Scores are exact at any
size; what passes 64 bits is cut to the ends of a long in the result. Windows of positives below 0 are empty, as low * p > high * p there. An empty table
or one without anchors gives an empty result. Columns beyond the three are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minim.llm.texts import partitions_of, small_batches
from minim.session import Scratch

#: Rows of a block; with 64 small components a block is about half a megabyte.
BLOCK = 4096
#: Components of a block, whatever the length of a vector.
BLOCK_CELLS = 1 << 20
#: Anchor blocks whose running state a task holds before it sends it on.
OPEN_BLOCKS = 8
POSITIVE, NEGATIVE = b"\0", b"\1"
_EXACT = 2**53
_BIAS = 1 << 127
_BLOCK_SCHEMA = "ids binary, labels binary, sizes binary, cells binary, kind string"
_BLOCK_ARROW = pa.schema([("ids", pa.binary()), ("labels", pa.binary()), ("sizes", pa.binary()), ("cells", pa.binary()), ("kind", pa.string())])
_PAIR_ARROW = pa.schema([("key", pa.binary())])


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """`(vec_id, embedding, label)` of the rows that take part: components as whole doubles floor(256 x)."""
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 256).cast("double"))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    # floor() of a double goes through a long; beyond 2^62 / 256 a double is whole already.
    large = F.transform(F.col(vector), lambda x: F.when(F.abs(x.cast("double")) < 2.0**54, F.floor(x.cast("double") * 256).cast("double"))
                        .otherwise(x.cast("double") * 256))
    chosen = F.when(F.exists(F.col(vector), lambda x: F.abs(x.cast("double")) >= 2.0**54), large).otherwise(scaled)
    label = F.col(label) if isinstance(label, str) else label
    return (rows.select(F.col(key).cast("bigint").alias("vec_id"), chosen.alias("embedding"), label.cast("bigint").alias("label"), finite.alias("_ok"))
            .where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND _ok").drop("_ok"))


class Block:
    """Rows with equal treatment: ids, labels and a matrix, padded with zeros to the longest vector."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, cells: np.ndarray):
        self.ids, self.labels, self.cells = ids, labels, cells

    @classmethod
    def unpack(cls, row: dict) -> Block:
        ids = np.frombuffer(row["ids"], np.int64)
        sizes = np.frombuffer(row["sizes"], np.int32)
        flat = np.frombuffer(row["cells"], row["kind"])
        width = int(sizes.max(initial=0))
        cells = np.zeros((len(ids), width))
        cells[np.arange(width) < sizes[:, None]] = flat
        return cls(ids, np.frombuffer(row["labels"], np.int64), cells)

    def scores(self, other: Block) -> np.ndarray:
        """Inner products, as 64-bit integers or, where they may not fit a double, as Python integers."""
        width = min(self.cells.shape[1], other.cells.shape[1])
        a, b = self.cells[:, :width], other.cells[:, :width]
        top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
        if top < _EXACT:
            return (a @ b.T).astype(np.int64)
        whole = np.frompyfunc(int, 1, 1)
        return np.dot(whole(a), whole(b).T) if width else np.zeros((len(a), len(b)), object)


def _packed(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> dict:
    kind = next((k for k, m in (("<i2", 2**15 - 1), ("<i4", 2**31 - 1)) if np.abs(flat).max(initial=0) <= m), "<f8")
    return {"ids": ids.astype(np.int64).tobytes(), "labels": labels.astype(np.int64).tobytes(), "sizes": sizes.astype(np.int32).tobytes(),
            "cells": flat.astype(kind).tobytes(), "kind": kind}


def pack_blocks(rows: DataFrame) -> DataFrame:
    """Rows `(vec_id, embedding, label)` as blocks of at most `BLOCK` rows and about `BLOCK_CELLS` components."""
    def pack(batches):
        held, cells = [], 0

        def block():
            flat = np.concatenate([h[3] for h in held])
            return pa.RecordBatch.from_pylist([_packed(*[np.concatenate([h[i] for h in held]) for i in range(3)], flat)], _BLOCK_ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(vectors.offsets.to_numpy())
            ids, labels = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            if held and (sum(len(h[0]) for h in held) + len(ids) > BLOCK or cells + len(flat) > BLOCK_CELLS):
                yield block()
                held, cells = [], 0
            held.append((ids, labels, sizes, flat))
            cells += len(flat)
        if held:
            yield block()

    return rows.mapInArrow(pack, _BLOCK_SCHEMA)


def pack_pair(anchor: int, score: int, kind: bytes, other: int) -> bytes:
    """A pair as bytes whose order is (anchor, score descending, positives first, id)."""
    return ((anchor + (1 << 63)).to_bytes(8, "big") + (_BIAS - 1 - score).to_bytes(16, "big") + kind + (other + (1 << 63)).to_bytes(8, "big"))


def unpack_pair(key: bytes) -> tuple[int, int, bytes, int]:
    return (int.from_bytes(key[:8], "big") - (1 << 63), _BIAS - 1 - int.from_bytes(key[8:24], "big"), key[24:25],
            int.from_bytes(key[25:], "big") - (1 << 63))


def _first(scores: np.ndarray, ids: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """The first `limit` distinct (-score, id), sorted."""
    if len(ids) > 4 * limit and scores.dtype != object:
        # All of the rows at the score of the last one that can be needed stay, and equal pairs count once.
        distinct = limit
        while True:
            least = np.partition(scores, len(scores) - min(distinct, len(scores)))[len(scores) - min(distinct, len(scores))]
            at = np.flatnonzero(scores >= least)
            pairs = {(-int(s), int(i)) for s, i in zip(scores[at], ids[at])} if len(at) <= 64 else None
            if pairs is None:
                order = np.lexsort((ids[at], -scores[at]))
                s, i = scores[at][order], ids[at][order]
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
                pairs = {(-int(x), int(y)) for x, y in zip(s[new][:limit], i[new][:limit])}
            if len(pairs) >= limit or len(at) == len(scores):
                return sorted(pairs)[:limit]
            distinct *= 4
    return sorted({(-int(s), int(i)) for s, i in zip(scores, ids)})[:limit]


def _merge(held: list, more: list, limit: int) -> list:
    return sorted({*held, *more})[:limit] if more else held


def _paired(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Every anchor block beside every row block: packed blocks, so the pairs are few, and no side is sent whole to a task unless Spark finds it small."""
    left = rows.select(F.struct("ids", "labels", "sizes", "cells", "kind").alias("r"))
    return left.crossJoin(anchors.select(F.struct(*anchors.columns).alias("a"), F.xxhash64("ids").alias("at")))


def _emit(state: dict, kinds) -> Iterator[pa.RecordBatch]:
    keys = [pack_pair(a, -s, kind, i) for a, held in state.items() for kind, pairs in kinds(held) for s, i in pairs]
    for at in range(0, len(keys), 10_000):
        yield pa.record_batch([pa.array(keys[at:at + 10_000], pa.binary())], schema=_PAIR_ARROW)


def _search(pairs: DataFrame, visit, kinds) -> DataFrame:
    """Run `visit(anchor block row, anchor block, row block, state)` over block pairs; states are sent on when many anchor blocks are open."""
    def scan(batches):
        state: dict[int, dict] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["at"] not in state and len(state) >= OPEN_BLOCKS:
                    for held in state.values():
                        yield from _emit(held, kinds)
                    state = {}
                visit(row["a"], Block.unpack(row["a"]), Block.unpack(row["r"]), state.setdefault(row["at"], {}))
        for held in state.values():
            yield from _emit(held, kinds)

    return pairs.mapInArrow(scan, "key binary")


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs of one anchor in one partition, sorted by their packed keys."""
    anchor = F.substring(F.col("key"), 1, 8)
    return pairs.repartition(partitions_of(pairs), anchor).sortWithinPartitions("key").select("key")


def _streamed(keys: Iterator[bytes]) -> Iterator[tuple[int, Iterator[tuple[int, bytes, int]]]]:
    """The pairs of sorted keys by anchor, equal keys once, one at a time."""
    current, before = None, None

    def of_anchor():
        nonlocal current, before
        anchor = current[0]
        while current is not None and current[0] == anchor:
            yield current[1:]
            before, current = current, next(source, None)
            while current is not None and current == before:
                current = next(source, None)

    source = (unpack_pair(k) for k in keys)
    current = next(source, None)
    while current is not None:
        anchor = current[0]
        mine = of_anchor()
        yield anchor, mine
        for _ in mine:
            pass


def _keys(batches) -> Iterator[bytes]:
    for batch in batches:
        yield from batch.column(0).to_pylist()


def _long(value: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, value))


def first_positives(anchors: DataFrame, rows: DataFrame, positives: int) -> DataFrame:
    """`(vec_id, scores, ids)`: each anchor's first positives, best first; scores as decimal texts, which hold any size."""
    def visit(_, a, r, state):
        scores = a.scores(r)
        for i, (anchor, label) in enumerate(zip(a.ids.tolist(), a.labels)):
            at = np.flatnonzero((r.labels == label) & (r.ids != anchor))
            if len(at):
                state[anchor] = _merge(state.get(anchor, []), _first(scores[i, at], r.ids[at], positives), positives)

    def read(batches):
        out = {"vec_id": [], "scores": [], "ids": []}
        for anchor, pairs in _streamed(_keys(batches)):
            kept = []
            for score, _, other in pairs:
                kept.append((score, other))
                if len(kept) == positives:
                    break
            out["vec_id"].append(anchor)
            out["scores"].append([str(s) for s, _ in kept])
            out["ids"].append([i for _, i in kept])
            if len(out["vec_id"]) >= 5000:
                yield pa.RecordBatch.from_pydict(out, schema)
                out = {"vec_id": [], "scores": [], "ids": []}
        yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("vec_id", pa.int64()), ("scores", pa.list_(pa.string())), ("ids", pa.list_(pa.int64()))])
    found = _search(_paired(anchors, rows), visit, lambda held: [(POSITIVE, held)])
    return _dealt(found).mapInArrow(read, "vec_id bigint, scores array<string>, ids array<bigint>")


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """`(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`; `is_anchor` is a condition on `vec_id`."""
    spark = rows.sparkSession
    small_batches(spark, 1000)
    scratch = Scratch(spark, "negatives")
    taking = usable(rows, key, vector, label)
    blocks = scratch.save(pack_blocks(taking))
    asking = scratch.save(taking.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v"))
                          .select("vec_id", F.col("v.embedding").alias("embedding"), F.col("v.label").alias("label")))
    first = scratch.save(pack_blocks(asking))
    found = scratch.save(first_positives(first, blocks, positives))
    # Anchors with their windows, packed again; an anchor without positives has no windows and asks no more.
    asked = scratch.save(_pack_with_windows(asking.join(found, "vec_id")))
    scratch.drop(first, found, asking)

    def visit(row, a, r, state):
        scores = a.scores(r)
        for i, (anchor, label_) in enumerate(zip(a.ids.tolist(), a.labels)):
            wanted = _windows(row["windows"][i]["scores"], low, high)
            if not wanted:
                continue
            held = state.setdefault(anchor, {"positives": [(-int(s), p) for s, p in zip(row["windows"][i]["scores"], row["windows"][i]["ids"])], "windows": {}})
            mine = scores[i]
            other = r.labels != label_
            for p in wanted:
                at = np.flatnonzero(other & (mine * 100 >= p * low) & (mine * 100 <= p * high)) if _fits(mine, p) else np.array(
                    [j for j in np.flatnonzero(other) if p * low <= 100 * int(mine[j]) <= p * high], int)
                if len(at):
                    held["windows"][p] = _merge(held["windows"].get(p, []), _first(mine[at], r.ids[at], negatives), negatives)

    def kinds(held):
        return [(POSITIVE, held["positives"]), (NEGATIVE, sorted({x for w in held["windows"].values() for x in w}))]

    def read(batches):
        out: list[tuple] = []
        for anchor, pairs in _streamed(_keys(batches)):
            open_: list[list] = []
            for score, kind, other in pairs:
                if kind == POSITIVE:
                    open_.append([score, other, 0])
                    continue
                # Scores fall: a window whose low end is above this one is done, as is a full one.
                open_ = [w for w in open_ if w[2] < negatives and low * w[0] <= 100 * score]
                for w in open_:
                    if 100 * score <= high * w[0]:
                        w[2] += 1
                        out.append((anchor, w[1], w[2], other, _long(w[0]), _long(score)))
            if len(out) >= 5000:
                yield _result(out)
                out = []
        yield _result(out)

    pairs = _search(_paired(asked, blocks), visit, kinds)
    return _dealt(pairs).mapInArrow(
        read, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


_RESULT = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()),
                     ("positive_score", pa.int64()), ("negative_score", pa.int64())])


def _result(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_RESULT)
    return pa.record_batch([pa.array(list(c), t.type) for c, t in zip(columns, _RESULT)], schema=_RESULT)


def _windows(scores: list[str], low: int, high: int) -> list[int]:
    """Distinct positive scores whose window is not empty."""
    return sorted({int(s) for s in scores if low * int(s) <= high * int(s)})


def _fits(scores: np.ndarray, p: int) -> bool:
    return scores.dtype != object and abs(p) < 2**53


def _pack_with_windows(rows: DataFrame) -> DataFrame:
    """Anchor blocks as of `pack_blocks`, with the positives of each anchor beside them."""
    window = "array<struct<scores:array<string>,ids:array<bigint>>>"
    arrow = pa.schema([*_BLOCK_ARROW, ("windows", pa.list_(pa.struct([("scores", pa.list_(pa.string())), ("ids", pa.list_(pa.int64()))])))])

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1)
            made = _packed(batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False),
                           np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy(zero_copy_only=False))
            made["windows"] = [{"scores": s, "ids": i} for s, i in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_pylist([made], arrow)

    return rows.select("vec_id", "embedding", "label", "scores", "ids").mapInArrow(pack, _BLOCK_SCHEMA + f", windows {window}")
