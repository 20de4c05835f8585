"""Operator 2: benchmark passages in documents, by SimHash of item-sized windows.

Words are lower-cased (A-Z). For every length of a benchmark item, each window of that many words has a 64-bit SimHash of its 5-word shingles.
The fingerprint is cut into five blocks; two fingerprints within RADIUS bits differ in at most RADIUS // 5 bits of some
block, and the index holds every block of every item with that many bits changed, so a look-up of the five blocks finds all
items within the radius. Each candidate is then verified exactly: shingles weighted by how often they occur, the sum of
the smaller weights over the sum of the larger ones, against `similarity`.

A text of fewer words than an item has no window of its length. Its whole word sequence is the one window then, and is verified without a
fingerprint against the items that share a shingle with it, found in a list of the items' shingles.

A window that shares no shingle with an item of its length has similarity 0; only the others are fingerprinted, which a bit table of
the items' shingles tells ahead. Documents never move: the index of one block of items travels to the tasks. A block has a
bounded number of items and words; a larger benchmark is worked off block by block, each over all documents.

Defined results: items and documents that are null, empty or without words match nothing; an item of fewer than 5 words is one
shingle and matches only itself; repeated items match each on their own, repeated documents too; a null doc_id is kept as null; an empty
benchmark finds nothing. Other columns are not looked at, and are kept by `drop_contaminated`.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minim.llm.texts import Words, as_bytes, byte_lists, mix, small_batches, windows

WIDTH = 5
SIMILARITY = (8, 10)
RADIUS = 19
# (shift, bits) of the five blocks of a fingerprint.
CUTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
ITEM_BLOCK = 2_000
WORD_BLOCK = 1_000_000
_SCREEN_BITS = 22
_RUN = 4096
_INDEXES: dict[str, Index] = {}


@dataclass
class Index:
    """A block of items: their shingles, fingerprints and the multi-index; built once in each worker."""

    items: list[tuple[int, bytes]]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def build(self) -> Index:
        w = Words([t.lower() for _, t in self.items])
        words = w.hashes()
        self.length = w.counts
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        shingle, of_length, prints = [], [], []
        for i, n in enumerate(self.length):
            own = words[w.offset[i]:w.offset[i + 1]]
            h = windows(own, np.zeros(n, np.int64), min(WIDTH, int(n)))[0] if n else own
            self.grams.append(np.unique(h, return_counts=True))
            shingle.append(self.grams[-1][0])
            of_length.append(np.full(len(shingle[-1]), n, np.int64))
            prints.append(simhash(h, [0], len(h))[0] if n else 0)
        self.prints = np.array(prints, np.uint64)
        flat = np.unique(np.stack([np.concatenate([*shingle, np.empty(0, np.uint64)]), np.concatenate([*of_length, np.empty(0, np.int64)]).astype(np.uint64)], 1), axis=0)
        self.shingles, self.lengths = flat[:, 0], flat[:, 1].astype(np.int64)
        # Items by shingle, for texts that are shorter than an item; items of one shingle have no shorter text with a shingle.
        many = [i for i, n in enumerate(self.length) if n > WIDTH]
        posted = np.concatenate([np.empty(0, np.uint64), *(self.grams[i][0] for i in many)])
        weight = np.concatenate([np.empty(0, np.int64), *(self.grams[i][1] for i in many)])
        poster = np.repeat(np.array(many, np.int64), [len(self.grams[i][0]) for i in many])
        by = np.argsort(posted, kind="stable")
        self.posted, self.weight, self.poster = posted[by], weight[by], poster[by]
        self.longest = int(max(self.length, default=0))
        self.screen = np.zeros(1 << _SCREEN_BITS, bool)
        self.screen[self.shingles >> np.uint64(64 - _SCREEN_BITS)] = True
        keys, owners = [], []
        real = np.flatnonzero(self.length > 0)
        for b in range(len(CUTS)):
            near = self.block(self.prints[real], b)[:, None] ^ changes(CUTS[b][1], RADIUS // len(CUTS))[None, :]
            keys.append(composed(np.repeat(self.length[real], near.shape[1]), b, near.reshape(-1)))
            owners.append(np.repeat(real, near.shape[1]))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        return self

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        shift, bits = CUTS[b]
        return (prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)

    def find(self, prints: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`(window, item)` of all items of a window's length within RADIUS of its fingerprint."""
        pairs = []
        for b in range(len(CUTS)):
            key = composed(length, b, self.block(prints, b))
            low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            window = np.repeat(np.arange(len(key)), high - low)
            at = np.arange(len(window)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
            pairs.append(window * len(self.items) + self.owners[at])
        found = np.unique(np.concatenate(pairs))
        window, item = found // len(self.items), found % len(self.items)
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[near], item[near]

    def similarity(self, shingles: np.ndarray, item: int) -> tuple[int, int]:
        """Sums of the smaller and of the larger weights of a window's and an item's shingles."""
        own, weight = self.grams[item]
        seen, times = np.unique(shingles, return_counts=True)
        at = np.minimum(np.searchsorted(own, seen), len(own) - 1)
        both = int(np.minimum(times, weight[at])[own[at] == seen].sum())
        return both, int(times.sum() + weight.sum()) - both


@lru_cache(maxsize=None)
def changes(bits: int, most: int) -> np.ndarray:
    """All masks of at most `most` set bits among `bits`."""
    return np.array([sum(1 << b for b in chosen) for k in range(most + 1) for chosen in itertools.combinations(range(bits), k)], np.uint64)


def composed(length: np.ndarray, b: int, key: np.ndarray) -> np.ndarray:
    return (length.astype(np.uint64) << np.uint64(20)) | np.uint64(b << 16) | key.astype(np.uint64)


def simhash(shingles: np.ndarray, starts, width: int) -> np.ndarray:
    """Fingerprints of the windows of `width` shingles from each of the ascending, gapless `starts`."""
    first, last = int(starts[0]), int(starts[-1])
    bits = np.unpackbits(mix(shingles[first:last + width] ^ np.uint64(0x9E3779B97F4A7C15)).view(np.uint8).reshape(-1, 8), axis=1)
    upto = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=upto[1:])
    ones = upto[width:] - upto[:-width]
    return np.packbits(2 * ones > width, axis=1).view(np.uint64).reshape(-1)


def matches(texts: list[bytes], index: Index, similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """`(text, item, first word, words, similarity)`: the best window of each item found in each text, the first of equals."""
    w = Words([t.lower() for t in texts])
    words = w.hashes()
    best: dict[tuple[int, int], tuple] = {}
    for width in sorted({min(WIDTH, int(n)) for n in index.length if n}):
        h, at = windows(words, w.doc, width)
        place = np.full(len(words), -1, np.int64)
        place[at] = np.arange(len(at))
        seen = np.flatnonzero(index.screen[h >> np.uint64(64 - _SCREEN_BITS)])
        low, high = np.searchsorted(index.shingles, h[seen], "left"), np.searchsorted(index.shingles, h[seen], "right")
        seed = np.repeat(at[seen], high - low)
        if width == WIDTH:
            _shorter(np.unique(w.doc[seed]), w, h, place, index, similarity, best)
        entry = np.arange(len(seed)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        for n in np.unique(index.lengths[entry]):
            if min(WIDTH, int(n)) != width:
                continue
            size = int(n) - width + 1
            mine = np.unique(seed[index.lengths[entry] == n])
            starts = np.unique((mine[:, None] - np.arange(size)[None, :]).reshape(-1)) if size <= _RUN else _spread(mine, size)
            starts = starts[(starts >= 0) & (starts + n <= len(words))]
            starts = starts[w.doc[starts] == w.doc[starts + n - 1]]
            if not len(starts):
                continue
            gaps = np.flatnonzero(np.diff(starts) != 1) + 1
            for run in np.split(starts, gaps):
                for a in range(0, len(run), _RUN):
                    _search(run[a:a + _RUN], int(n), size, h, place, w.doc, index, similarity, best)
    return [(doc, item, int(start - w.offset[doc]), n, -less) for (doc, item), (less, start, n) in sorted(best.items())]


def _spread(seeds: np.ndarray, size: int) -> np.ndarray:
    """All starts of windows of `size` shingles that hold a seed, for long windows."""
    parts, done = [], -1
    for s in seeds.tolist():
        parts.append(np.arange(max(s - size + 1, done + 1), s + 1))
        done = s
    return np.concatenate(parts)


def _search(starts, n, size, h, place, doc, index, similarity, best) -> None:
    """Looks up one gapless run of windows and keeps the best verified window per text and item."""
    grams = place[starts]
    prints = simhash(h, grams, size)
    window, item = index.find(prints, np.full(len(prints), n, np.int64))
    for k, i in zip(window.tolist(), item.tolist(), strict=True):
        both, union = index.similarity(h[grams[k]:grams[k] + size], i)
        if similarity[1] * both >= similarity[0] * union:
            entry = (-both / union, int(starts[k]), n)
            where = (int(doc[starts[k]]), i)
            if where not in best or entry < best[where]:
                best[where] = entry


def _shorter(docs, w, h, place, index, similarity, best) -> None:
    """Compares each of `docs` as a whole with the items of more words than it has."""
    for doc in docs[w.counts[docs] < index.longest].tolist():
        n, first = int(w.counts[doc]), int(w.offset[doc])
        size = n - WIDTH + 1
        seen, times = np.unique(h[place[first]:place[first] + size], return_counts=True)
        low, high = np.searchsorted(index.posted, seen, "left"), np.searchsorted(index.posted, seen, "right")
        at = np.arange(int((high - low).sum())) - np.repeat(np.cumsum(high - low) - high, high - low)
        item, common = index.poster[at], np.minimum(np.repeat(times, high - low), index.weight[at])
        # The similarity is at most the ratio of the lengths.
        near = (index.length[item] > n) & (similarity[1] * size >= similarity[0] * (index.length[item] - WIDTH + 1))
        both = np.bincount(item[near], common[near], len(index.items)).astype(np.int64)
        union = size + index.length - WIDTH + 1 - both
        for i in np.flatnonzero((both > 0) & (similarity[1] * both >= similarity[0] * union)).tolist():
            best[doc, i] = (-int(both[i]) / int(union[i]), first, n)


def item_blocks(benchmark: DataFrame, items: int = ITEM_BLOCK, words: int = WORD_BLOCK) -> Iterator[Index]:
    """The benchmark in blocks of at most `items` items and about `words` words, one at a time on the driver."""
    block, size = [], 0
    for row in benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint"), as_bytes()).toLocalIterator():
        text = bytes(row[1])
        n = len(text.split())
        if block and (len(block) == items or size + n > words):
            yield Index(block)
            block, size = [], 0
        block.append((int(row[0]), text))
        size += n
    if block:
        yield Index(block)


def _ready(index: Index) -> Index:
    if index.key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[index.key] = index.build()
    return _INDEXES[index.key]


def contaminated(documents: DataFrame, benchmark: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """`doc_id, item_id, first_word, n_words, similarity`: a row for each document and benchmark item found in it."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes().alias("text"))
    schema = "doc_id long, item_id long, first_word long, n_words long, similarity double"

    def finder(index: Index):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = _ready(shared.value)
            for part, texts in byte_lists(batches, 1):
                found = matches(texts, ready, similarity)
                if found:
                    doc, item, first, n, score = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(doc, pa.int64())), pa.array([ready.items[i][0] for i in item], pa.int64()), pa.array(first, pa.int64()),
                         pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "item_id", "first_word", "n_words", "similarity"])
        return run

    out = documents.sparkSession.createDataFrame([], schema)
    for index in item_blocks(benchmark):
        out = out.union(rows.mapInArrow(finder(index), schema))
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of `documents` in which no benchmark item is found."""
    small_batches(documents.sparkSession)
    names = documents.columns

    def cleaner(index: Index):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = _ready(shared.value)
            for batch in batches:
                text = batch.column(names.index("text")).fill_null("").cast(pa.binary())
                keyed = pa.RecordBatch.from_arrays([text, pa.array(range(batch.num_rows), pa.int64())], ["text", "row"])
                for part, texts in byte_lists([keyed], 0):
                    keep = np.ones(len(texts), bool)
                    keep[[m[0] for m in matches(texts, ready, similarity)]] = False
                    yield batch.take(part.column(1).filter(pa.array(keep)))
        return run

    for index in item_blocks(benchmark):
        documents = documents.mapInArrow(cleaner(index), documents.schema)
    return documents
