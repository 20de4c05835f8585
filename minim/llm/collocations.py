"""Phrase collocations per language, counted by weighted acyclic automata over words.

A text, A-Z in lower case, is cut at `. , ; : ! ?` and line ends into pieces, and a piece at spaces and tabs into words. `n` counts the words of a
language, f(phrase) the places of a phrase inside pieces. A candidate is a phrase of 2 or 3 words with a = f(phrase) >= `least`. A cut after k words gives l and r,
the counts of its two parts, and floor(10^6 a^2 / (l r)); the lowest cut counts, the smallest k among equals. A candidate goes if a longer
candidate that holds its words in a row has at least `share` percent of its count.

How it is counted:

1. Sketch: a task hashes the word pairs of some megabytes of text at a time, and ranges of hashes are summed; the pairs that may have `least` places set bits
   of a filter of a fixed size. It only ever lets too much through. The same pass counts words and draws the bounds of prefix ranges.
2. Shards: a task again takes some megabytes, numbers the words in byte order, sorts the phrases of 1 to 3 words, and builds a count transducer from
   them in that order (`Automaton`): a state is a prefix, an arc a word, a state's weight the count of the phrase that leads to it. A pair the filter
   rejects has fewer than `least` places, and so has every phrase around it: neither is built. The transducer is cut at the bounds, a piece a range.
3. Union: the pieces of a prefix range are united, weights of equal paths summed, and paths below `least` dropped.
4. Composition: a candidate's parts have at least its count, so each lies in some range's automaton. A range asks for the parts of its
   candidates, each once, by an automaton of requests cut at the same bounds; the range composes it with its own and sends the weights back.

Counts and scores are exact: Python integers beyond 64 bits, words told apart by their bytes. A hot word or pair is one arc of a shard, and a hot
prefix is cut by the second word, so no task owns it. The filter's size is fixed: with more frequent pairs than bits the shards grow and no result changes.

A null text counts as empty, a null language is `und`, an empty text adds nothing. Words of any length and characters are kept; repeated rows count
again, whatever their ids; ties are ranked by phrase. An empty table gives an empty result. Only text and language are read, so other columns are not in the way.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minim.llm.texts import Words, as_bytes, mix, partitions_of, small_batches, windows
from minim.session import Scratch

#: Bytes of text that a task counts at once.
SHARD_BYTES = 4 << 20
#: Bits of the filter of frequent pairs: 16 MB, whatever the input.
FILTER_BITS = 1 << 27
#: Parts of the hash space; each sets its own piece of the filter.
HASH_PARTS = 256
#: Rows drawn for the bounds of prefix ranges, and transducer paths that a range is meant to take in.
BOUND_SAMPLE = 20_000
RANGE_PATHS = 600_000
PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", 10, 11, 12, 13]] = True
GAP = PIECE.copy()
GAP[[9, 32]] = True


class Pieces(Words):
    """The words of texts, and the piece that each lies in."""

    def __init__(self, texts: list[bytes]):
        # The end leaves room to read eight bytes from any place.
        joined = b"\n".join(texts).lower() + b"\n" * 9
        self.buf = np.frombuffer(joined, np.uint8)
        gap = GAP[self.buf]
        word = ~gap
        first = word.copy()
        first[1:] &= gap[:-1]
        last = gap.copy()
        last[0] = False
        last[1:] &= word[:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last)
        self.piece = np.cumsum(PIECE[self.buf], dtype=np.int32)[self.starts]
        self.joined = joined
        self.hash = self.hashes()

    def numbered(self) -> tuple[np.ndarray, list[bytes]]:
        """Number of each word among the distinct ones in byte order, and those."""
        _, at, which = np.unique(self.hash, return_index=True, return_inverse=True)
        size = self.ends - self.starts
        # Words of one hash must agree in length and in their first and last eight bytes; else they are told apart by their bytes.
        same = size == size[at][which]
        for part in (self._first(size), np.where(size > 8, self._at(self.ends - 8), 0)):
            same &= part == part[at][which]
        if not same.all():
            return self._by_bytes()
        found = [self.joined[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]
        order = sorted(range(len(found)), key=found.__getitem__)
        rank = np.empty(len(found), np.int64)
        rank[order] = np.arange(len(found))
        return rank[which], [found[i] for i in order]

    def _at(self, place: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on."""
        return np.ndarray(len(self.joined) - 7, "<u8", self.joined, strides=(1,))[np.maximum(place, 0)]

    def _first(self, size: np.ndarray) -> np.ndarray:
        """The first eight bytes of each word, or all of a shorter one."""
        kept = np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * np.clip(size, 1, 8).astype(np.uint64))
        return self._at(self.starts) & kept

    def _by_bytes(self) -> tuple[np.ndarray, list[bytes]]:
        words = [self.joined[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]
        distinct = sorted(set(words))
        number = {w: i for i, w in enumerate(distinct)}
        return np.fromiter((number[w] for w in words), np.int64, len(words)), distinct


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """First place of each run of equal keys."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new)


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts or summed weights."""
    if not len(keys):
        return np.empty(0, keys.dtype), np.empty(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        at = _runs(keys)
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    at = _runs(keys)
    return keys[at], np.add.reduceat(weights, at)


class Automaton:
    """A count transducer over words, its states in the order of their paths.

    `words` are the arc labels, ascending. Level d holds the paths of d words: `up[d]` is the state a path leaves, as its place in the level above,
    `label[d]` its last word and `weight[d]` its count, 0 where it only leads on.
    """

    def __init__(self, words: list[bytes], up: Sequence[np.ndarray], label: Sequence[np.ndarray], weight: Sequence[np.ndarray]):
        self.words, self.up, self.label, self.weight = words, list(up), list(label), list(weight)

    @classmethod
    def build(cls, words: list[bytes], levels: Sequence[tuple[np.ndarray, np.ndarray]]) -> Automaton:
        """From sorted paths: `levels[d - 1]` holds the distinct paths of d words as numbers in base len(words), ascending, with their weights.

        The paths come in order, so a prefix ends where the next one begins and each level's states close in one sweep. Prefixes that have no
        weight of their own become states of weight 0.
        """
        base = max(len(words), 1)
        keys, weights = [k for k, _ in levels], [w for _, w in levels]
        for d in range(len(levels) - 1, 0, -1):
            above = keys[d] // base
            above = above[_runs(above)] if len(above) else above
            lacking = above[~_contains(keys[d - 1], above)]
            if len(lacking):
                both = np.concatenate([keys[d - 1], lacking])
                order = np.argsort(both, kind="stable")
                keys[d - 1] = both[order]
                weights[d - 1] = np.concatenate([weights[d - 1], np.zeros(len(lacking), np.int64)])[order]
        up = [np.zeros(len(keys[0]), np.int32)] + [np.searchsorted(keys[d - 1], keys[d] // base).astype(np.int32) for d in range(1, len(keys))]
        return cls(words, up, [(k % base).astype(np.int32) for k in keys], weights)

    def keys(self, numbers: np.ndarray | None = None, base: int | None = None) -> list[np.ndarray]:
        """The paths of each level as numbers, with the words renumbered if asked."""
        base = base or max(len(self.words), 1)
        out: list[np.ndarray] = []
        for up, label in zip(self.up, self.label):
            own = label.astype(np.int64) if numbers is None else numbers[label]
            out.append(own if not out else out[-1][up] * base + own)
        return out

    def paths(self, level: int) -> list[tuple[bytes, ...]]:
        """The paths of a level (from 0) as word tuples, in order."""
        if level == 0:
            return [(self.words[i],) for i in self.label[0].tolist()]
        above = self.paths(level - 1)
        return [(*above[u], self.words[i]) for u, i in zip(self.up[level].tolist(), self.label[level].tolist())]

    def pack(self) -> bytes:
        joined = b"\n".join(self.words)
        arrays = []
        for up, label, weight in zip(self.up, self.label, self.weight):
            # States come in order, so the arcs of each can be told by how many there are; counts are small as a rule.
            wide = "<i8" if weight.max(initial=0) > 2**31 - 1 else "<i4" if weight.max(initial=0) > 255 else "<u1"
            arrays.append((up, label, weight.astype(wide)))
        head = np.array([len(self.words), len(joined), len(arrays), *[x for u, _, w in arrays for x in (len(u), w.dtype.itemsize)]], "<i8")
        return b"".join([head[:3].tobytes(), head[3:].tobytes(), joined, *[a.tobytes() for arrs in arrays for a in
                         (np.diff(arrs[0], prepend=np.int32(0)).astype(np.int32), arrs[1].astype(np.int32), arrs[2])]])

    @classmethod
    def unpack(cls, data: bytes) -> Automaton:
        count, size, depth = np.frombuffer(data, "<i8", 3).tolist()
        shape = np.frombuffer(data, "<i8", 2 * depth, 24).tolist()
        at = 24 + 16 * depth
        words = data[at:at + size].split(b"\n") if count else []
        at += size
        up, label, weight = [], [], []
        for d in range(depth):
            n, wide = shape[2 * d], shape[2 * d + 1]
            up.append(np.cumsum(np.frombuffer(data, "<i4", n, at), dtype=np.int32))
            label.append(np.frombuffer(data, "<i4", n, at + 4 * n))
            weight.append(np.frombuffer(data, {1: "<u1", 4: "<i4", 8: "<i8"}[wide], n, at + 8 * n).astype(np.int64))
            at += 8 * n + wide * n
        return cls(words, up, label, weight)

    def cut(self, bounds: Sequence[tuple[bytes, bytes]]) -> Iterator[tuple[int, Automaton]]:
        """The parts of the paths between bounds, which are ascending word pairs; part i holds the paths from bound i - 1 on."""
        base = max(len(self.words), 1)
        keys = self.keys()
        first, exact, second = [], [], []
        number = {w: i for i, w in enumerate(self.words)}
        for a, b in bounds:
            first.append(_place(self.words, number, a))
            exact.append(a in number)
            second.append(_place(self.words, number, b) if a in number else 0)
        f, e, s = np.array(first, np.int64), np.array(exact, bool), np.array(second, np.int64)
        edges = []
        for d, k in enumerate(keys):
            # A path of one word stands before the pairs that begin with it.
            at = np.searchsorted(k, f + e if d == 0 else (f * base + s) * base ** (d - 1))
            edges.append(np.concatenate([[0], at, [len(k)]]))
        spans = np.diff(np.array(edges), axis=1)
        for i in np.flatnonzero(spans.sum(axis=0)):
            part = []
            for k, w, edge in zip(keys, self.weight, edges):
                span, held = k[edge[i]:edge[i + 1]], w[edge[i]:edge[i + 1]]
                some = held > 0
                part.append((span[some], held[some]))
            if not any(len(k) for k, _ in part):
                continue
            yield int(i), _renumbered(self.words, base, part)


def _contains(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of `wanted` are in the ascending `table`."""
    at = np.searchsorted(table, wanted)
    return (at < len(table)) & (table[np.minimum(at, len(table) - 1)] == wanted) if len(table) else np.zeros(len(wanted), bool)


def _place(words: list[bytes], number: dict[bytes, int], word: bytes) -> int:
    return number[word] if word in number else bisect_right(words, word)


def _renumbered(words: list[bytes], base: int, levels: Sequence[tuple[np.ndarray, np.ndarray]]) -> Automaton:
    """An automaton with only the words that its paths use."""
    digits = [[(k // base**p) % base for p in range(d, -1, -1)] for d, (k, _) in enumerate(levels)]
    used = np.unique(np.concatenate([x for level in digits for x in level]))
    new = len(used)
    made = []
    for level, (_, w) in zip(digits, levels):
        key = np.zeros(len(w), np.int64)
        for x in level:
            key = key * new + np.searchsorted(used, x)
        made.append((key, w))
    return Automaton.build([words[i] for i in used.tolist()], made)


def union(parts: Sequence[Automaton], least: int = 1, depth: int = 3) -> Automaton:
    """All paths of the parts, weights of equal ones summed; paths of fewer than `least` are left out."""
    words = sorted({w for p in parts for w in p.words})
    if len(words) ** depth >= 2**63:
        raise OverflowError("too many words in one prefix range")
    base = max(len(words), 1)
    number = {w: i for i, w in enumerate(words)}
    keyed = [p.keys(np.fromiter((number[w] for w in p.words), np.int64, len(p.words)), base) for p in parts]
    levels = []
    for d in range(depth):
        have = [(k[d], p.weight[d]) for k, p in zip(keyed, parts) if len(k) > d]
        key, weight = _counted(np.concatenate([k for k, _ in have]), np.concatenate([w for _, w in have])) if have else (np.empty(0, np.int64),) * 2
        levels.append((key[weight >= least], weight[weight >= least]))
    return _renumbered(words, base, levels) if words else Automaton.build([], levels)


def compose(counts: Automaton, asked: Automaton) -> list[np.ndarray]:
    """Per level of `asked`, the weight in `counts` of each of its paths, 0 where there is none: both are followed arc by arc, a level at a time."""
    number = {w: i for i, w in enumerate(counts.words)}
    label_of = np.fromiter((number.get(w, -1) for w in asked.words), np.int64, len(asked.words))
    out, state = [], None
    base = max(len(counts.words), 1)
    for d in range(len(asked.label)):
        arc = label_of[asked.label[d]] if len(asked.words) else np.empty(0, np.int64)
        come = np.zeros(len(arc), np.int64) if d == 0 else state[asked.up[d]]
        have = counts.up[d].astype(np.int64) * base + counts.label[d] if d < len(counts.label) else np.empty(0, np.int64)
        wanted = come * base + arc
        at = np.searchsorted(have, wanted)
        hit = (arc >= 0) & (come >= 0) & _contains(have, wanted)
        state = np.where(hit, at, -1)
        weight = counts.weight[d] if d < len(counts.label) else np.empty(0, np.int64)
        out.append(np.where(hit, weight[np.minimum(at, max(len(weight) - 1, 0))], 0) if len(weight) else np.zeros(len(arc), np.int64))
    return out


# ---- passes over the texts -----------------------------------------------------------------

def _shards(batches, limit: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, `limit` bytes at a time; batches have columns `lang, text`."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text) + 1
            if size >= limit:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _languages(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), as_bytes().alias("text"))


def _pair_hashes(words: Pieces, lang: str) -> np.ndarray:
    """Hash of each pair of neighbouring words of a piece, and the place of its first word."""
    return windows(words.hash ^ np.uint64(hash_text(lang)), words.piece, 2)


def hash_text(text: str) -> int:
    """A 64-bit hash that is the same in all processes."""
    import xxhash

    return xxhash.xxh64_intdigest(text.encode())


_SKETCH = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _sketch(limit: int):
    """Rows of pair hashes per hash range (`part` >= 0), words per language (-1) and drawn word pairs (-2)."""
    def run(batches):
        for lang, texts in _shards(batches, limit):
            words = Pieces(texts)
            rows = [{"part": -1, "lang": lang, "n": len(words.starts), "hashes": None, "counts": None}]
            hashes, at = _pair_hashes(words, lang)
            if len(hashes):
                some = at[np.linspace(0, len(at) - 1, min(len(at), 256)).astype(np.int64)]
                for i in some.tolist():
                    pair = [words.joined[words.starts[j]:words.ends[j]] for j in (i, i + 1)]
                    rows.append({"part": -2, "lang": lang, "n": 0, "hashes": pair[0], "counts": pair[1]})
            key, count = _counted(hashes)
            edges = np.searchsorted(key, np.arange(1, HASH_PARTS, dtype=np.uint64) * np.uint64(2**64 // HASH_PARTS))
            for part, (k, c) in enumerate(zip(np.split(key, edges), np.split(count, edges))):
                if len(k):
                    rows.append({"part": part, "lang": None, "n": len(k), "hashes": k.tobytes(), "counts": c.astype(np.uint32).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, _SKETCH)

    return run


def _bits(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """Three places of each hash in a piece of the filter."""
    return [(mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 2**64 - 1)) % np.uint64(size)).astype(np.int64) for k in (1, 2, 3)]


def _filter_piece(least: int, size: int):
    """Rows `(part, hashes, counts)`, sorted by part, to `(part, bits)`, `size` bits each."""
    schema = pa.schema([("part", pa.int32()), ("bits", pa.binary())])

    def piece(part: int, held: list[tuple[np.ndarray, np.ndarray]]):
        key, count = _counted(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]).astype(np.int64))
        bits = np.zeros(size, bool)
        for place in _bits(key[count >= least], size):
            bits[place] = True
        return pa.RecordBatch.from_pylist([{"part": part, "bits": np.packbits(bits).tobytes()}], schema)

    def run(batches):
        part, held, size_held = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if part is not None and row["part"] != part:
                    yield piece(part, held)
                    held, size_held = [], 0
                part = row["part"]
                held.append((np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["counts"], np.uint32)))
                size_held += len(held[-1][0])
                if size_held > 4_000_000:
                    # Sums of what has come so far take the place of the rows.
                    key, count = _counted(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]).astype(np.int64))
                    held, size_held = [(key, np.minimum(count, least).astype(np.uint32))], 0
        if part is not None:
            yield piece(part, held)

    return run


class PairFilter:
    """Pairs that may be frequent."""

    def __init__(self, pieces: dict[int, bytes], size: int):
        self.size = size
        self.bits = np.zeros((HASH_PARTS, self.size // 8), np.uint8)
        for part, bits in pieces.items():
            self.bits[part] = np.frombuffer(bits, np.uint8)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        part = (hashes // np.uint64(2**64 // HASH_PARTS)).astype(np.int64)
        out = np.ones(len(hashes), bool)
        for place in _bits(hashes, self.size):
            out &= (self.bits[part, place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
        return out


_BLOB = pa.schema([("target", pa.int32()), ("source", pa.int32()), ("lang", pa.string()), ("automaton", pa.binary())])
_BLOB_SQL = "target int, source int, lang string, automaton binary"


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_BLOB.names, r)) for r in rows], _BLOB)


def shard_automaton(texts: list[bytes], lang: str, likely: PairFilter) -> Automaton:
    """Counts of the words of some texts and of the pairs and triples that can be frequent."""
    words = Pieces(texts)
    number, distinct = words.numbered()
    base = max(len(distinct), 1)
    if base**3 >= 2**63:
        # More than two million distinct words in one shard: half the texts at a time.
        half = len(texts) // 2
        if not half:
            raise OverflowError("too many words in one text")
        return union([shard_automaton(texts[:half], lang, likely), shard_automaton(texts[half:], lang, likely)])
    hashes, at = _pair_hashes(words, lang)
    at = at[likely.passes(hashes)]
    pair = np.zeros(len(number), bool)
    pair[at] = True
    triple = np.flatnonzero(pair[:-1] & pair[1:]) if len(pair) > 1 else np.empty(0, np.int64)
    levels = [_counted(number), _counted(number[at] * base + number[at + 1] if len(at) else np.empty(0, np.int64)),
              _counted((number[triple] * base + number[triple + 1]) * base + number[triple + 2] if len(triple) else np.empty(0, np.int64))]
    return Automaton.build(distinct, levels)


def _grouped(batches) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one target at a time, from rows sorted by target."""
    target, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if target is not None and row["target"] != target:
                yield target, held
                held = []
            target = row["target"]
            held.append(row)
    if target is not None:
        yield target, held


def _by_target(rows: DataFrame, ranges: int) -> DataFrame:
    return rows.repartition(max(ranges, 1), "target").sortWithinPartitions("target", "lang", "source")


def _cut(automaton: Automaton, lang: str, bounds: list[tuple[str, bytes, bytes]]) -> Iterator[tuple[int, Automaton]]:
    """Parts of an automaton by range; the bounds of other languages lie before or behind all of it."""
    low = bisect_right(bounds, (lang, b"", b""))
    mine = [b[1:] for b in bounds[low:] if b[0] == lang]
    for i, part in automaton.cut(mine):
        yield low + i, part


def _parts(a: Automaton, d: int) -> Iterator[tuple[tuple[bytes, ...], int, int, list[tuple[tuple[bytes, ...], tuple[bytes, ...]]]]]:
    """Candidates of `d + 1` words: `(path, place, count, cuts)`."""
    for i, (path, count) in enumerate(zip(a.paths(d), a.weight[d].tolist())):
        if count:
            yield path, i, count, [(path[:k], path[k:]) for k in range(1, d + 1)]


def _requests(bounds):
    """Each range's automaton once more, and what it asks of all ranges: the parts of its candidates, each once."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, source = Automaton.unpack(row["automaton"]), row["target"]
                wanted = {p for d in (1, 2) for _, _, _, cuts in _parts(a, d) for cut in cuts for p in cut}
                yield _blobs([(t, source, row["lang"], part.pack()) for t, part in _cut(_of_paths(wanted), row["lang"], bounds)])
    return run


def _of_paths(paths: set[tuple[bytes, ...]]) -> Automaton:
    """An automaton of weight 1 on each path."""
    words = sorted({w for p in paths for w in p})
    base = max(len(words), 1)
    number = {w: i for i, w in enumerate(words)}
    levels = []
    for d in range(1, 4):
        keys = []
        for p in paths:
            if len(p) == d:
                k = 0
                for w in p:
                    k = k * base + number[w]
                keys.append(k)
        levels.append((np.sort(np.array(keys, np.int64)), np.ones(len(keys), np.int64)))
    return Automaton.build(words, levels)


def _answers(batches):
    """Requests (source >= 0) beside the counts (source -1) of a range: the requests again, with the counts as weights, to where they came from."""
    counts: dict[tuple[int, str], Automaton] = {}
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            key = (row["target"], row["lang"])
            if row["source"] < 0:
                counts = {key: Automaton.unpack(row["automaton"])}
                continue
            asked = Automaton.unpack(row["automaton"])
            if key in counts:
                found = compose(counts[key], asked)
                asked.weight = [np.where(w > 0, f, 0) for w, f in zip(asked.weight, found)]
                out.append((row["source"], row["target"], row["lang"], asked.pack()))
        if out:
            yield _blobs(out)


_SCORED = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("words", pa.int32()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()),
                     ("score", pa.int64())])


def _scores(batches):
    """Candidates of each range with the lowest cut, from the range's counts (source -1) and the answers to its requests."""
    def scored(lang: str, counts: Automaton, weight: dict[tuple[bytes, ...], int]):
        rows = []
        for d in (1, 2):
            for path, _, a, cuts in _parts(counts, d):
                # The first of equal scores is that of the smallest k.
                score, left, right = min(((10**6 * a * a // (weight[x] * weight[y]), weight[x], weight[y]) for x, y in cuts), key=lambda s: s[0])
                rows.append((lang, b" ".join(path), d + 1, a, left, right, score))
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_pylist([dict(zip(_SCORED.names, r)) for r in rows[at:at + 10_000]], _SCORED)

    for _, rows in _grouped(batches):
        for lang in dict.fromkeys(r["lang"] for r in rows):
            counts, weight = None, {}
            for row in rows:
                if row["lang"] != lang:
                    continue
                a = Automaton.unpack(row["automaton"])
                if row["source"] < 0:
                    counts = a
                    continue
                for d in range(3):
                    weight.update((p, w) for p, w in zip(a.paths(d), a.weight[d].tolist()) if w)
            yield from scored(lang, counts, weight)


def counted_ranges(documents: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, list, int]:
    """The united automata `(target, source = -1, lang, automaton)`, words per language, the bounds and the number of ranges."""
    spark = documents.sparkSession
    small_batches(spark, 200)
    texts = _languages(documents)
    limit, size = SHARD_BYTES, FILTER_BITS // HASH_PARTS
    sketch = scratch.save(texts.mapInArrow(_sketch(limit), "part int, lang string, n bigint, hashes binary, counts binary"))
    n_words = scratch.save(sketch.where("part = -1").groupBy("lang").agg(F.sum("n").alias("n")))
    pairs = sketch.where("part >= 0")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    pieces = (pairs.select("part", "hashes", "counts").repartition(min(HASH_PARTS, partitions_of(pairs)), "part").sortWithinPartitions("part")
              .mapInArrow(_filter_piece(least, size), "part int, bits binary"))
    # FILTER_BITS / 8 bytes in all.
    likely = spark.sparkContext.broadcast(PairFilter({r["part"]: bytes(r["bits"]) for r in pieces.collect()}, size))
    ranges = max(partitions_of(texts), -(-total // RANGE_PATHS))
    drawn = sketch.where("part = -2").select("lang", "hashes", "counts", F.xxhash64("lang", "hashes", "counts").alias("at"))
    # About BOUND_SAMPLE of all drawn pairs by their hashes, so that the tasks together send no more than that.
    share = min(1.0, BOUND_SAMPLE / max(drawn.count(), 1))
    drawn = drawn.where(F.pmod("at", F.lit(1 << 30)) < int(share * (1 << 30))).drop("at").distinct().limit(4 * BOUND_SAMPLE).collect()
    drawn = sorted({(r["lang"], bytes(r["hashes"]), bytes(r["counts"])) for r in drawn})
    # More ranges than drawn pairs would be empty ones.
    ranges = min(ranges, len(drawn) + 1)
    bounds = [drawn[i * len(drawn) // ranges] for i in range(1, ranges)]
    bounds = sorted(set(bounds))

    def shards(batches):
        for lang, held in _shards(batches, limit):
            made = [(t, -1, lang, part.pack()) for t, part in _cut(shard_automaton(held, lang, likely.value), lang, bounds)]
            for at in range(0, len(made), 64):
                yield _blobs(made[at:at + 64])

    def unite(batches):
        for target, rows in _grouped_languages(batches):
            yield _blobs([(target, -1, lang, a.pack()) for lang, a in rows])

    def _grouped_languages(batches):
        """United automata per (target, language); what has come so far is united whenever it has grown large."""
        key, held, size = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                now = (row["target"], row["lang"])
                if key is not None and now != key:
                    yield key[0], [(key[1], union(held, least))]
                    held, size = [], 0
                key = now
                held.append(Automaton.unpack(row["automaton"]))
                size += len(row["automaton"])
                if size > 8 << 20:
                    held, size = [union(held)], 0
        if key is not None:
            yield key[0], [(key[1], union(held, least))]

    made = _by_target(texts.mapInArrow(shards, _BLOB_SQL), len(bounds) + 1)
    united = scratch.save(made.mapInArrow(unite, _BLOB_SQL))
    scratch.drop(sketch)
    return united, n_words, bounds, len(bounds) + 1


def scored_candidates(documents: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """`(lang, phrase, words, a, l, r, score)` of every candidate, as a written table, and `(lang, n)`."""
    spark = documents.sparkSession
    united, n_words, bounds, ranges = counted_ranges(documents, least, scratch)
    asked = united.mapInArrow(_requests(bounds), _BLOB_SQL)
    answers = _by_target(united.unionByName(asked), ranges).mapInArrow(_answers, _BLOB_SQL)
    scored = scratch.save(_by_target(united.unionByName(answers), ranges).mapInArrow(
        _scores, "lang string, phrase binary, words int, a bigint, l bigint, r bigint, score bigint"))
    scratch.drop(united)
    return scored.withColumn("phrase", F.col("phrase").cast("string")), n_words


def _outermost(scored: DataFrame, share: int) -> DataFrame:
    """Candidates without those that a longer one covers."""
    words = F.split("phrase", " ")
    inner = F.array(*[F.concat_ws(" ", F.get(words, F.lit(i)), F.get(words, F.lit(i + 1))) for i in (0, 1)])
    covers = (scored.where("words = 3").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    return (scored.join(covers, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(share).cast("decimal(20,0)") * F.col("a")))
            .drop("longer"))


def top_collocations(documents: DataFrame, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """`(lang, rank, phrase, a, l, r, n, score)`: the first `top` candidates of each language by score and count, then phrase."""
    scratch = Scratch(documents.sparkSession, "collocations")
    scored, n_words = scored_candidates(documents, least, scratch)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold most candidates: each of its parts gives its own first ones, which hold the language's.
    kept = _outermost(scored, share).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(n_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
