"""Statistics of whole texts: base counts of the quality rules and the features of both quality models."""

from __future__ import annotations

import numpy as np

from minim.llm.texts import SPACE, Words, mix, windows

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word_chars", "std_word_bytes", "symbol_share", "upper_share", "digit_share", "punct_share", "bang_share",
    "non_ascii_share", "byte_entropy", "distinct_share", "top_word_share", "adjacent_share", "repeat_share", "dup_line_share",
    "words_per_line", "short_word_share", "capital_share", "stop_share", "mark_tail_share",
)
WINDOW = 5
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_PUNCT = np.frombuffer(b".,;:!?()'\"-", np.uint8)
_BANG = np.frombuffer(b"!?", np.uint8)
_IS = np.zeros((3, 256), bool)
_IS[0, 65:91] = True
_IS[1, np.frombuffer(b".,;:!?", np.uint8)] = True
_IS[2, _SYMBOLS] = True
_IS[2, _BANG] = True


def _duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    seen: set[bytes] = set()
    filled = 0
    for line in text.split(b"\n"):
        if line and line.strip():
            filled += 1
            seen.add(line)
    return filled, filled - len(seen)


def _by_doc(values: np.ndarray, offset: np.ndarray) -> np.ndarray:
    upto = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=upto[1:])
    return upto[offset[1:]] - upto[offset[:-1]]


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """`(base, features)` with one row per text; an empty text has zeros in both."""
    n = len(texts)
    w = Words(texts)
    words = w.hashes()
    # Counts of every byte value per text.
    seen = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts]) if n else np.zeros((0, 256), np.int64)
    chars = seen.sum(1) - seen[:, 0x80:0xC0].sum(1)
    word_chars = chars - seen[:, SPACE].sum(1)
    symbols = seen[:, _SYMBOLS].sum(1)
    lines = np.array([_duplicate_lines(t) for t in texts], np.int64).reshape(n, 2)

    at_doc = w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, same, times = np.unique(mix(words ^ at_doc), return_inverse=True, return_counts=True)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, w.doc, times[same])
    distinct = _by_doc(1.0 / times[same], w.offset)
    adjacent = np.zeros(len(words), bool)
    adjacent[1:] = (words[1:] == words[:-1]) & (w.doc[1:] == w.doc[:-1])
    h, at = windows(words, w.doc, WINDOW)
    _, same, times = np.unique(mix(h ^ at_doc[at]), return_inverse=True, return_counts=True)
    again = at[times[same] > 1]
    cover = np.zeros(len(words) + WINDOW + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    repeated = np.rint(_by_doc(np.cumsum(cover)[:len(words)] > 0, w.offset)).astype(np.int64)

    base = np.stack([w.counts, word_chars, symbols, lines[:, 1], repeated], 1).astype(np.int64)
    some_words, some_chars = np.maximum(w.counts, 1), np.maximum(word_chars, 1)
    length = (w.ends - w.starts).astype(np.float64)
    mean_len = _by_doc(length, w.offset) / some_words
    spread = np.sqrt(np.maximum(_by_doc(length * length, w.offset) / some_words - mean_len**2, 0))
    share = seen / np.maximum(seen.sum(1, keepdims=True), 1)
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    head, tail = w.buf[w.starts], w.buf[w.ends - 1]
    features = np.stack([
        np.log1p(w.counts), word_chars / some_words, spread, symbols / some_chars, seen[:, 65:91].sum(1) / some_chars,
        seen[:, 48:58].sum(1) / some_chars, seen[:, _PUNCT].sum(1) / some_chars, seen[:, _BANG].sum(1) / some_chars,
        (seen[:, 0xC0:].sum(1)) / some_chars, entropy, distinct / some_words, top / some_words, _by_doc(adjacent, w.offset) / some_words,
        repeated / some_words, lines[:, 1] / np.maximum(lines[:, 0], 1), w.counts / np.maximum(lines[:, 0], 1),
        _by_doc(length <= 3, w.offset) / some_words, _by_doc(_IS[0, head], w.offset) / some_words, _by_doc(length == 1, w.offset) / some_words,
        _by_doc(_IS[2, tail], w.offset) / some_words,
    ], 1).astype(np.float64)
    return base, features
