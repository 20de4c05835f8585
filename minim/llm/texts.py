"""Words, lines and shingles of many texts at once, as numpy arrays over UTF-8 bytes.

A word is a run of bytes outside space, tab, newline, vertical tab, form feed and carriage return. Texts
travel as `binary` columns: nothing is decoded, so odd code points cannot break a batch, and `bytes.split()`,
`bytes.strip()` and `bytes.lower()` mean exactly these bytes and A-Z. Hashes are 64 bits wide unless a
function says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minim.session import share_package

SLICE_BYTES = 2 << 20
CHUNK = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = []


def as_bytes(text: str | Column = "text") -> Column:
    """The text as bytes, empty for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text, F.lit("")).cast("binary")


def small_batches(spark: SparkSession, rows: int = 200) -> None:
    """Arrow batches of few rows, as their size follows the longest texts and not the row count; workers find this package."""
    share_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, CHUNK + 1)
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[:] = both
    return _POWERS


def slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most `limit` bytes together, or one longer text."""
    upto = np.cumsum(lengths + 1)
    at = 0
    while at < len(lengths):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + limit, side="right")))
        yield at, end
        at = end


def byte_lists(batches: Iterator, column: int, limit: int = SLICE_BYTES) -> Iterator[tuple]:
    """Slices `(batch, texts)` of Arrow batches, `texts` being the bytes of one binary column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).to_pylist()
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        for a, b in slices(lengths, limit):
            yield batch.slice(a, b - a), texts[a:b]


class Words:
    """The words of a list of texts: `starts`, `ends` (bytes in `buf`), `doc` and the first word of each text."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        joined = b" ".join(texts) + b" "
        self.buf = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.doc_end = np.cumsum(lengths + 1) - 1
        self.doc_start = self.doc_end - lengths
        space = SPACE[self.buf]
        word = ~space
        first = word.copy()
        first[1:] &= space[:-1]
        last = space.copy()
        last[0] = False
        last[1:] &= word[:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last)
        self.offset = np.append(np.searchsorted(self.starts, self.doc_start), len(self.starts))
        self.counts = np.diff(self.offset)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            base = int(self.starts[at])
            end = max(at + 1, int(np.searchsorted(self.ends, base + CHUNK, side="right")))
            seg = self.buf[base:int(self.ends[end - 1])]
            power, inverse = _powers(len(seg) + 1)
            upto = np.zeros(len(seg) + 1, np.uint64)
            np.cumsum(_BYTE[seg] * power[:len(seg)], out=upto[1:])
            s, e = self.starts[at:end] - base, self.ends[at:end] - base
            out[at:end] = mix((upto[e] - upto[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = end
        return out


def windows(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every `width` words in a row that lie in one text, and the index of the first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = words[:n] * _STEP[0]
    for k in range(1, width):
        h = h + words[k:n + k] * _STEP[k % 64] + np.uint64(k)
    at = np.flatnonzero(doc[:n] == doc[width - 1:])
    return mix(h[at]), at


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: `(hashes, offsets)`, hashes ascending within a text.

    A text with 1 to width - 1 words has its whole word sequence as its one shingle; without words it has none.
    """
    w = Words([t.lower() for t in texts])
    words = w.hashes()
    h, at = windows(words, w.doc, width)
    doc = w.doc[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(few):
        extra = [mix((words[w.offset[d]:w.offset[d + 1]] * _STEP[:w.counts[d]]).sum(keepdims=True) + np.uint64(7919 * w.counts[d])) for d in few]
        h, doc = np.concatenate([h, *extra]), np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))
