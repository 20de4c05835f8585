"""Operator 4: lines repeated across documents, dropped by keep bitmaps.

Every long enough line becomes a row (128-bit key hash, doc_id, text key, position). The rows are range-partitioned and sorted on
all of these, so the lines of a frequent key are spread over several partitions; each partition streams once, and the first
document of a key owns it. Only a partition's first key can have begun earlier: one summary row per partition settles
those. The result is one compressed bitmap per changed document; texts are shuffled only when bitmaps are applied to them.

Defined results: a null or empty text has one empty line; a null doc_id takes no part and its row keeps all lines; rows with
the same doc_id are one document for ownership, each text with a bitmap of its own; equal rows share a bitmap; empty tables give empty
tables. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minim.llm.texts import as_bytes, byte_lists, partitions_of, small_batches
from minim.session import Scratch

MIN_CHARS = 10
_LINE = "h1 long, h2 long, doc_id long, text_key long, position int"
_FOUND = _LINE + ", part int, kind int"
# Rows of the streamed result: a line to drop, a line of the partition's first key, and the partition's summary.
_DROP, _FIRST, _HEAD, _TAIL = 0, 1, 2, 3


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
                            as_bytes().alias("text"))


def line_rows(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line whose key (ASCII white space stripped, A-Z lower-cased) has `min_chars` code points or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in byte_lists(batches, 2):
            digests, row, position = [], [], []
            for i, text in enumerate(texts):
                for p, line in enumerate(text.split(b"\n")):
                    key = line.strip().lower()
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode(errors="replace")) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        row.append(i)
                        position.append(p)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), rows.column(0).take(at), rows.column(1).take(at), pa.array(position, pa.int32())],
                                             ["h1", "h2", "doc_id", "text_key", "position"])

    small_batches(documents.sparkSession)
    return _keyed(documents.where(F.col("doc_id").isNotNull())).mapInArrow(run, _LINE)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted partition: the lines after a key's first document, and what its neighbours must know."""
    carried = first = None
    part = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, text, pos, parts = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        part = int(parts[0])
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if carried is not None and (h1[0], h2[0]) == carried[:2]:
            new[0] = False
        begins = np.flatnonzero(new)
        run = np.cumsum(new)
        owner = np.append(doc[:0], [carried[2] if carried is not None else 0])
        owner = np.concatenate([owner, doc[begins]])[run]
        if first is None:
            first = (h1[0], h2[0], doc[0])
            yield _found([(*first, 0, 0, part, _HEAD)])
        head = (h1 == first[0]) & (h2 == first[1])
        out = np.flatnonzero(head | (doc != owner))
        if len(out):
            kind = np.where(head[out], _FIRST, _DROP).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (h1, h2, doc, text, pos, parts)] + [pa.array(kind)], _NAMES)
        carried = (h1[-1], h2[-1], owner[-1])
    if carried is not None:
        yield _found([(*carried, 0, 0, part, _TAIL)])


_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _found(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.int32()] * 3
    return pa.RecordBatch.from_arrays([pa.array([int(r[i]) for r in rows], t) for i, t in enumerate(types)], _NAMES)


def dropped_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """`doc_id, text_key, position` of every line that a smaller doc_id holds too."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "lines")
    lines = scratch.save(line_rows(documents, min_chars))
    order = ["h1", "h2", "doc_id", "text_key", "position"]
    spread = (lines.repartitionByRange(partitions_of(documents), *order).sortWithinPartitions(*order)
              .withColumn("part", F.spark_partition_id()))
    found = scratch.save(spread.mapInArrow(_stream, _FOUND))
    # Two rows per partition come to the driver; an owner is handed on along partitions that share a key.
    ends: dict[int, dict[int, tuple]] = {}
    for r in found.where(F.col("kind") >= _HEAD).collect():
        ends.setdefault(r["part"], {})[r["kind"]] = (r["h1"], r["h2"], r["doc_id"])
    owners, before = [], None
    for part in sorted(ends):
        head, tail = ends[part][_HEAD], ends[part][_TAIL]
        owner = before[2] if before and before[:2] == head[:2] else head[2]
        owners.append((part, owner))
        before = (*tail[:2], owner if tail[:2] == head[:2] else tail[2])
    settled = spark.createDataFrame(owners, "part int, owner long")
    rows = found.where(F.col("kind") <= _FIRST).join(F.broadcast(settled), "part")
    return rows.where((F.col("kind") == _DROP) | (F.col("doc_id") != F.col("owner"))).select("doc_id", "text_key", "position")


def _bitmap(positions: np.ndarray) -> bytes:
    # Whole bytes: the bits after the last dropped line keep theirs.
    keep = np.ones(int(positions.max()) // 8 * 8 + 8, bool)
    keep[positions] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def keep_bitmaps(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """`doc_id, text_key, n_dropped, keep`: one row per document that loses lines.

    `keep` is zlib-compressed, one bit per line, set for a line that stays; lines beyond its end stay. A document without a
    row keeps all lines.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.asarray(p, np.int64)) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(p) for p in found], pa.int64()), pa.array([_bitmap(p) for p in found], pa.binary())],
                                             ["doc_id", "text_key", "n_dropped", "keep"])

    lists = dropped_lines(documents, min_chars).groupBy("doc_id", "text_key").agg(F.collect_list("position").alias("positions"))
    return lists.mapInArrow(run, "doc_id long, text_key long, n_dropped long, keep binary")


def kept_lines(text: bytes, keep: bytes | None) -> list[bytes]:
    """The lines of `text` that a bitmap keeps."""
    lines = text.split(b"\n")
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return [line for i, line in enumerate(lines) if i >= len(bits) or bits[i]]


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`doc_id, n_lines, n_dropped, kept_sha256, text` of every row, `text` being the lines that stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in byte_lists(batches, 1):
            left = [kept_lines(t, k) for t, k in zip(texts, rows.column(2).to_pylist(), strict=True)]
            n = [t.count(b"\n") + 1 for t in texts]
            joined = [b"\n".join(x) for x in left]
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array(n, pa.int64()), pa.array([a - len(x) for a, x in zip(n, left, strict=True)], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in joined], pa.string()), pa.array(joined, pa.binary())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256", "text"])

    small_batches(documents.sparkSession)
    joined = _keyed(documents).join(bitmaps.select("doc_id", "text_key", "keep"), ["doc_id", "text_key"], "left")
    done = joined.select("doc_id", "text", "keep").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, text binary")
    return done.withColumn("text", F.col("text").cast("string"))
