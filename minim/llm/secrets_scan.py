"""Operator 10: secrets by fixed patterns, and by a battery of randomness tests under false-discovery control.

Base spans are the matches of three patterns. Every run of at least CANDIDATE letters, digits and + / _ = - outside them is a
candidate, also what base spans leave of a longer run. Its encoding is the smallest alphabet that holds all its symbols, and three tests compare it with ordinary strings of
that alphabet, whose symbol frequencies and class changes are counted over all texts of the corpus:

- uniformity: the chi-squared statistic of the symbol counts, as the number of equal pairs; ordinary strings repeat symbols more often;
- runs: changes between lower case, upper case, digits and marks; ordinary strings change rarely;
- serial correlation of neighbouring symbol values.

A string that any test tells from uniform draws of its alphabet (LIMIT standard deviations) is structured and has the p-value 1. For the
others, uniformity and runs give one p-value each for "ordinary", combined by Fisher's method. Short strings
have wide null distributions, so length enters each p-value; and the Benjamini-Hochberg bound is taken within strata of alphabet and
length, so that the many short strings do not hide the long ones. A stratum's histogram of p-values is bounded, and so is what reaches
the driver; texts are never shuffled.

Defined results: null and empty texts have no spans and the digest of the empty string; a null doc_id stays null; repeated rows are scanned each
(and count in the corpus each); an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minim.llm.texts import as_bytes, byte_lists, small_batches
from minim.session import Scratch

# The patterns of the base kinds, and the least length of their matches (of the value for assign).
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_ASSIGN_VALUE, _ACCESS_LENGTH = 12, 18
KINDS = ("assign", "access", "hex", "random")

# The shortest strings that the battery can still tell from ordinary ones, as short as the values of assign.
CANDIDATE = 12
FALSE_SHARE = 0.01
_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE)
_DIGITS, _LOWER, _UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets from small to large; the first that holds all symbols is the encoding. "=" only pads and is no symbol.
ALPHABETS = {
    "decimal": _DIGITS, "hex": _DIGITS + b"abcdef", "HEX": _DIGITS + b"ABCDEF", "base32": _UPPER + b"234567", "base36": _LOWER + _DIGITS,
    "BASE36": _UPPER + _DIGITS, "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + b"+/", "base64url": _UPPER + _LOWER + _DIGITS + b"-_",
    "mixed": _UPPER + _LOWER + _DIGITS + b"+/-_",
}
_NAMES = tuple(ALPHABETS)
_VALUE = np.full((len(_NAMES), 256), -1, np.int16)
for _i, _name in enumerate(_NAMES):
    _VALUE[_i, np.frombuffer(ALPHABETS[_name], np.uint8)] = np.arange(len(ALPHABETS[_name]))
_CLASS = np.full(256, 3, np.int8)
for _i, _of in enumerate((_LOWER, _UPPER, _DIGITS)):
    _CLASS[np.frombuffer(_of, np.uint8)] = _i
_LARGEST = max(map(len, ALPHABETS.values()))
# Length bands of the strata, and steps of -log10 p in a histogram.
BANDS = (16, 20, 24, 32, 48, 64, 96, 160)
_STEPS, _PER_TEN = 400, 10
#: Standard deviations from what uniform symbols give, beyond which a string is structured.
LIMIT = 3.3
_SIZE = np.array([len(a) for a in ALPHABETS.values()], float)
# How often neighbours of a uniform string differ in class.
_TURNS = np.array([1 - (np.bincount(_CLASS[np.frombuffer(a, np.uint8)], minlength=4) / len(a) @ (np.bincount(_CLASS[np.frombuffer(a, np.uint8)], minlength=4) / len(a)))
                   for a in ALPHABETS.values()])


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """`(start, kind, end)` in bytes, sorted: leftmost matches per kind that do not overlap."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_VALUE]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidate_spans(text: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of encoding symbols, in bytes; what base spans leave of a run counts where it is long enough. One walk over both sorted lists."""
    taken: list[list[int]] = []
    for start, _, end in base:
        if taken and start <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    out, i = [], 0
    for start, end in (m.span() for m in _RUN.finditer(text)):
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        at, j = start, i
        while j < len(taken) and taken[j][0] < end:
            if taken[j][0] - at >= CANDIDATE:
                out.append((at, taken[j][0]))
            at = max(at, taken[j][1])
            j += 1
        if end - at >= CANDIDATE:
            out.append((at, end))
    return out


def _marks(text: bytes, offsets: list[int]) -> dict[int, int]:
    """Code points before each byte offset."""
    if text.isascii():
        return {o: o for o in offsets}
    out, at, n = {}, 0, 0
    for o in sorted(set(offsets)):
        n += sum((b & 0xC0) != 0x80 for b in text[at:o]) if o - at < 64 else int(((np.frombuffer(text[at:o], np.uint8) & 0xC0) != 0x80).sum())
        out[o], at = n, o
    return out


def battery(strings: list[bytes]) -> dict[str, np.ndarray]:
    """Per string: alphabet, symbols, equal pairs, class changes and the serial correlation's z."""
    n = len(strings)
    buf = np.frombuffer(b"".join(strings), np.uint8)
    size = np.fromiter(map(len, strings), np.int64, n)
    owner = np.repeat(np.arange(n), size)
    mark = buf != ord("=")
    buf, owner = buf[mark], owner[mark]
    size = np.bincount(owner, minlength=n)
    alphabet = np.full(n, len(_NAMES) - 1)
    for i in range(len(_NAMES) - 2, -1, -1):
        alphabet[np.bincount(owner, _VALUE[i, buf] < 0, n) == 0] = i
    value = _VALUE[alphabet[owner], buf].astype(np.int64)
    seen = np.bincount(owner * _LARGEST + value, minlength=n * _LARGEST).reshape(n, _LARGEST)
    pairs = (seen * (seen - 1)).sum(1)
    joined = owner[1:] == owner[:-1]
    kind = _CLASS[buf]
    changes = np.bincount(owner[1:][joined], (kind[1:] != kind[:-1])[joined], n).astype(np.int64)
    some = np.maximum(size, 1)
    mean = np.bincount(owner, value, n) / some
    off = value - mean[owner]
    spread = np.bincount(owner, off * off, n)
    serial = np.bincount(owner[1:][joined], (off[1:] * off[:-1])[joined], n) / np.where(spread > 0, spread, 1)
    z = np.where(spread > 0, serial * np.sqrt(some), math.inf)
    return {"alphabet": alphabet, "size": size, "pairs": pairs, "changes": changes, "z": z}


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """-ln of the upper tail of the normal distribution, exact enough far out."""
    z = np.maximum(z, -8.0)
    t = 1.0 / (1.0 + 0.2316419 * np.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    log_upper = -z * z / 2 - 0.5 * math.log(2 * math.pi) + np.log(poly)
    return np.where(z >= 0, -log_upper, -np.log1p(-np.minimum(np.exp(log_upper), 0.5)))


class Ordinary:
    """The null distributions: frequencies of each alphabet's symbols, and the share of neighbours of different classes."""

    def __init__(self, symbols: np.ndarray, changes: float, places: float):
        share = symbols / np.maximum(symbols.sum(1, keepdims=True), 1)
        self.s2, self.s3 = (share**2).sum(1), (share**3).sum(1)
        self.rate = (changes + 1.0) / (places + 2.0)

    def evidence(self, alphabet, size, pairs, changes, z) -> np.ndarray:
        """-log10 of the combined p-value of each string being ordinary."""
        n, s2, s3 = size.astype(float), self.s2[alphabet], self.s3[alphabet]
        var = 2 * n * (n - 1) * (s2 - s2**2) + 4 * n * (n - 1) * (n - 2) * (s3 - s2**2)
        uniform = _normal_tail((n * (n - 1) * s2 - pairs) / np.sqrt(np.maximum(var, 1e-9)))
        rate = self.rate
        width = np.sqrt(np.maximum((n - 1) * rate * (1 - rate), 0.25))
        runs = _normal_tail((changes - 0.5 - (n - 1) * rate) / width)
        m, turns = _SIZE[alphabet], _TURNS[alphabet]
        repeats = (pairs - n * (n - 1) / m) / np.sqrt(np.maximum(2 * n * (n - 1) * (1 / m - 1 / m**2), 1e-9))
        stiff = ((n - 1) * turns - changes) / np.sqrt(np.maximum((n - 1) * turns * (1 - turns), 0.25))
        structured = (repeats > LIMIT) | (stiff > LIMIT) | (np.abs(z) > LIMIT)
        # Fisher: the sum of two -ln p is a gamma variable of shape 2.
        total = uniform + runs
        log_p = -total + np.log1p(total)
        return np.where(structured, 0.0, np.maximum(-log_p / math.log(10), 0.0))


def _stratum(alphabet: np.ndarray, size: np.ndarray) -> np.ndarray:
    return alphabet * (len(BANDS) + 1) + np.searchsorted(np.array(BANDS), size, side="right")


_SCAN = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, starts array<int>, ends array<int>, "
         "alphabet array<int>, size array<int>, pairs array<long>, changes array<int>, z array<double>")
_SCAN_NAMES = [c.split()[0] for c in _SCAN.split(", ")]
_LISTS = _SCAN_NAMES[6:]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int32()] * 4 + [pa.int64(), pa.int32(), pa.float64()]
    for rows, texts in byte_lists(batches, 1):
        counts, bases, strings, lists = [], [], [], []
        for text in texts:
            base = base_spans(text)
            more = candidate_spans(text, base)
            at = _marks(text, [o for s, _, e in base for o in (s, e)] + [o for span in more for o in span])
            counts.append([sum(k == kind for _, k, _ in base) for kind in range(3)])
            bases.append(",".join(f"{KINDS[k]}:{at[s]}:{at[e]}" for s, k, e in base))
            strings += [text[s:e] for s, e in more]
            lists.append([(at[s], at[e]) for s, e in more])
        tests = battery(strings)
        offsets = pa.array(np.append(0, np.cumsum([len(x) for x in lists])), pa.int32())
        flat = [np.array([p[k] for x in lists for p in x], np.int64) for k in (0, 1)] + [tests[c] for c in _LISTS[2:]]
        columns = [pa.ListArray.from_arrays(offsets, pa.array(c, t)) for c, t in zip(flat, types, strict=True)]
        n = np.array(counts, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), *(pa.array(c) for c in n.T), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in bases]), pa.array(bases, pa.string()), *columns],
            _SCAN_NAMES)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    lists = {c: batch.column(batch.schema.get_field_index(c)) for c in _LISTS}
    return np.append(0, np.cumsum(pa.compute.list_value_length(lists["size"]).to_numpy(zero_copy_only=False))), {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how often each byte value occurs, then (as 256 and 257) neighbouring symbols and those of different classes."""
    counts = np.zeros(258, np.int64)
    symbol = _VALUE[-1] >= 0
    for _, texts in byte_lists(batches, 0):
        buf = np.frombuffer(b" ".join(texts), np.uint8)
        counts[:256] += np.bincount(buf, minlength=256)
        kind = np.where(symbol[buf], _CLASS[buf], -1)
        both = (kind[1:] >= 0) & (kind[:-1] >= 0)
        counts[256] += both.sum()
        counts[257] += (both & (kind[1:] != kind[:-1])).sum()
    yield pa.RecordBatch.from_arrays([pa.array(range(258), pa.int32()), pa.array(counts)], ["at", "n"])


def ordinary_strings(texts: DataFrame) -> Ordinary:
    """The null distributions, counted over all of the corpus's texts (one column of bytes)."""
    rows = texts.mapInArrow(_byte_counts, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(258)
    for r in rows:
        counts[r["at"]] = r["n"]
    symbols = np.zeros((len(_NAMES), _LARGEST))
    for i, name in enumerate(_NAMES):
        own = np.frombuffer(ALPHABETS[name], np.uint8)
        symbols[i, :len(own)] = counts[own]
    return Ordinary(symbols, counts[257], counts[256])


def thresholds(scanned: DataFrame, ordinary: Ordinary, false_share: float = FALSE_SHARE) -> np.ndarray:
    """The least evidence (in histogram steps) of a discovery in each stratum, by Benjamini-Hochberg."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, c = _flat(batch)
            step = np.minimum(ordinary.evidence(c["alphabet"], c["size"], c["pairs"], c["changes"], c["z"]) * _PER_TEN, _STEPS).astype(np.int64)
            key, n = np.unique(_stratum(c["alphabet"], c["size"]) * (_STEPS + 1) + step, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    strata = len(_NAMES) * (len(BANDS) + 1)
    counts = np.zeros((strata, _STEPS + 1))
    for r in scanned.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        counts[r["key"] // (_STEPS + 1), r["key"] % (_STEPS + 1)] = r["n"]
    beyond = counts[:, ::-1].cumsum(1)[:, ::-1]
    # A step's p-values are at most that of its lower end.
    p = 10.0 ** (-np.arange(_STEPS + 1) / _PER_TEN)
    passes = (counts.sum(1)[:, None] * p[None, :] <= false_share * beyond) & (beyond > 0)
    return np.where(passes.any(1), passes.argmax(1), _STEPS + 1)


def secret_scan(documents: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """`doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans` of every document; offsets in code points."""
    small_batches(documents.sparkSession)
    scratch = Scratch(documents.sparkSession, "secrets")
    text = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes().alias("text"))
    scanned = scratch.save(text.mapInArrow(_scanned, _SCAN))
    ordinary = ordinary_strings(text.select("text"))
    least = thresholds(scanned, ordinary, false_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offset, c = _flat(batch)
            step = np.minimum(ordinary.evidence(c["alphabet"], c["size"], c["pairs"], c["changes"], c["z"]) * _PER_TEN, _STEPS).astype(np.int64)
            hit = step >= least[_stratum(c["alphabet"], c["size"])]
            spans, n = [], []
            for i, base in enumerate(batch.column(5).to_pylist()):
                at = np.arange(offset[i], offset[i + 1])[hit[offset[i]:offset[i + 1]]]
                more = [(int(c["starts"][k]), 3, int(c["ends"][k])) for k in at]
                own = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                spans.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(own + more)))
                n.append(len(more))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64()), batch.column(4), pa.array(spans, pa.string())],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return scanned.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
