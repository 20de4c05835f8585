"""Operator 7: unigram token counts by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a space and a word. The best segmentation of a string into vocabulary pieces maximizes the sum of piece scores; the best
score up to a place depends on the characters before it only, so pre-tokens with a common prefix share those scores. Each slice of
texts inserts its distinct pre-tokens into a trie (sorted, a node per new prefix) and scores all nodes of a depth at once: the best of
the pieces that end there, from the node's ancestors. The node where a pre-token ends holds its token count; a document's count is the
sum over its words. Texts stay where they are; nothing is shuffled.

The vocabulary is a file of `base64(piece) rank` lines. It has ranks and no probabilities, so a piece's score is the logarithm of
its share under Zipf's law, 1 / (rank + 2.7). A byte that is no piece of its own counts as one token, 10 below the worst score.

Defined results: null and empty texts have no tokens; a null doc_id stays null; repeated rows are counted each; of segmentations
with equal scores the one with the shorter last piece is taken, at every place; an empty table gives an empty result. Other columns
are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minim.llm.texts import _BYTE, Words, as_bytes, byte_lists, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SLICE = 4 << 20
# Longer pre-tokens share little and are scored one by one.
DEPTH = 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_FILTER = 20


@dataclass
class Vocabulary:
    """Pieces by length: sorted hashes with scores, and a bit table of all hashes."""

    pieces: dict[bytes, float]

    def __post_init__(self) -> None:
        self.unknown = min(self.pieces.values(), default=0.0) - 10.0
        for b in range(256):
            self.pieces.setdefault(bytes([b]), self.unknown)
        # A piece with white space behind its first byte is in no pre-token.
        self.inner_lengths = sorted({len(p) for p in self.pieces if not any(c in b" \t\n\v\f\r" for c in p[1:])})
        self.screen = np.zeros(1 << _FILTER, bool)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in self.inner_lengths:
            own = [p for p in self.pieces if len(p) == n]
            rows = np.frombuffer(b"".join(own), np.uint8).reshape(-1, n)
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = h * _MULTIPLIER + _BYTE[rows[:, k]]
            order = np.argsort(h)
            self.by_length[n] = (h[order], np.array([self.pieces[p] for p in own])[order])
            self.screen[h >> np.uint64(64 - _FILTER)] = True
        self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(DEPTH, *self.inner_lengths), _MULTIPLIER)]))

    def scores(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces of `n` bytes, and the scores of those."""
        keys, scores = self.by_length[n]
        maybe = np.flatnonzero(self.screen[h >> np.uint64(64 - _FILTER)])
        at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
        real = keys[at] == h[maybe]
        return maybe[real], scores[at[real]]

    def count(self, token: bytes) -> int:
        """Tokens of one string, place by place."""
        best, counts = [0.0], [0]
        sizes = self.inner_lengths
        for end in range(1, len(token) + 1):
            top, n = -np.inf, 0
            for size in sizes:
                if size > end:
                    break
                score = self.pieces.get(token[end - size:end])
                if score is not None and best[end - size] + score > top:
                    top, n = best[end - size] + score, counts[end - size] + 1
            best.append(top)
            counts.append(n)
        return counts[-1]


def load_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Vocabulary:
    """Read a rank file on the driver; a vocabulary has a fixed size."""
    lines = [r[0].split() for r in spark.read.text(path).collect()] if "://" in path else [x.split() for x in Path(path).read_text().splitlines()]
    ranks = {base64.b64decode(x[0]): int(x[1]) for x in lines if len(x) == 2}
    total = np.log(sum(1.0 / (r + 2.7) for r in ranks.values()))
    return Vocabulary({p: float(-np.log(r + 2.7) - total) for p, r in ranks.items()})


def trie_counts(tokens: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Token counts of byte rows `tokens` (zero-padded, lexicographically sorted, distinct) of the given lengths."""
    n, width = tokens.shape
    shared = np.zeros(n, np.int64)
    if n > 1:
        same = tokens[1:] == tokens[:-1]
        shared[1:] = np.where(same.all(1), width, same.argmin(1))
    # node[d][i]: the node of the first d bytes of token i; node 0 is the root.
    node = [np.zeros(n, np.int64)]
    hashes, best, counts = [np.zeros(1, np.uint64)], [np.zeros(1)], [np.zeros(1, np.int64)]
    result = np.zeros(n, np.int64)
    for depth in range(1, int(lengths.max(initial=0)) + 1):
        deep = lengths >= depth
        begins = deep & (shared < depth)
        # A node is named by its order among the nodes of its depth; the first token below it stands for it.
        first = np.flatnonzero(begins)
        node.append(np.cumsum(begins) - 1)
        up = node[depth - 1][first]
        h = hashes[depth - 1][up] * _MULTIPLIER + _BYTE[tokens[first, depth - 1]]
        top, count = np.full(len(first), -np.inf), np.zeros(len(first), np.int64)
        for size in vocabulary.inner_lengths:
            if size > depth:
                break
            above = node[depth - size][first]
            piece = h - hashes[depth - size][above] * vocabulary.power[size]
            real, score = vocabulary.scores(piece, size)
            total = best[depth - size][above[real]] + score
            better = total > top[real]
            at = real[better]
            top[at] = total[better]
            count[at] = counts[depth - size][above[at]] + 1
        hashes.append(h)
        best.append(top)
        counts.append(count)
        ends = np.flatnonzero(lengths == depth)
        result[ends] = count[node[depth][ends]]
    return result


def count_tokens(texts: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """`(words, tokens)` of each text."""
    w = Words(texts)
    if not len(w.starts):
        return w.counts, np.zeros(len(texts), np.int64)
    _, place, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    start, length = w.starts[place], (w.ends - w.starts)[place] + 1
    counts = np.zeros(len(place), np.int64)
    short = np.flatnonzero(length <= DEPTH)
    width = int(length[short].max(initial=1))
    rows = w.buf[np.minimum(start[short, None] + np.arange(width - 1)[None, :], len(w.buf) - 1)]
    rows = np.concatenate([np.full((len(short), 1), 32, np.uint8), np.where(np.arange(1, width)[None, :] < length[short, None], rows, 0)], 1)
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").reshape(-1), kind="stable")
    counts[short[order]] = trie_counts(rows[order], length[short][order], vocabulary)
    for i in np.flatnonzero(length > DEPTH):
        counts[i] = vocabulary.count(b" " + w.buf[start[i]:start[i] + length[i] - 1].tobytes())
    upto = np.append(0, np.cumsum(counts[which]))
    return w.counts, upto[w.offset[1:]] - upto[w.offset[:-1]]


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """`doc_id, n_words, n_tokens` of every document."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in byte_lists(_joined(batches), 1, SLICE):
            words, tokens = count_tokens(texts, shared.value)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    small_batches(spark)
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes().alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about a slice: more texts share a trie."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= SLICE:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, size = [], 0
    if size:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
