"""Collocations against a plain count: languages, ties, odd texts, cut ranges, small shards, a full filter; automata by themselves."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from minim.llm import collocations
from minim.llm.collocations import Automaton, Pieces, compose, top_collocations, union

CUT = re.compile(rb"[.,;:!?\x0a-\x0d]")


def plain(rows, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in CUT.split((text or "").encode().lower()):
            words = [w for w in piece.replace(b"\t", b" ").split(b" ") if w]
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in candidates.items():
            for inner in ({p[:2], p[1:]} if len(p) == 3 else ()):
                longest[inner] = max(longest[inner], a)
        scored = []
        for p, a in candidates.items():
            if p in longest and 100 * longest[p] >= share * a:
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, b" ".join(p), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, lang, 1.0, "x", 2) for i, (lang, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, score double, phrase string, n long").repartition(3)
    return sorted(tuple(r) for r in top_collocations(df, **options).collect())


def corpus(rng, n=120, words="new york city of the in was river stone high school a b c d e f g".split()):
    def text():
        parts = []
        for _ in range(rng.randrange(1, 60)):
            parts.append(rng.choice(["New York City", "high school", "river stone", "in the", *words, "odd" + str(rng.randrange(40))]))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "; "]))
        return "".join(parts)
    return [(rng.choice(["en", "en", "en", "de", None]), text()) for _ in range(n)]


ODD = [(None, None), ("en", ""), ("en", " \n"), ("xx", "one"), ("a\nb", "line end lang " * 12), ("en", "ünï cödé " * 11), ("en", "control\x01 \x01mark " * 12),
       ("en", "w" * 3000 + " " + "v" * 3000 + " " + "w" * 3000), ("", "no language " * 10), ("en", "same same same same same same same same same same same same"),
       ("en", "a\x00b a\x00b " * 6)]


@pytest.mark.parametrize("shard,paths,bits", [(8 << 20, 1_500_000, 1 << 27), (300, 40, 1 << 14), (2000, 200, 1 << 12)])
def test_agrees_with_a_plain_count(spark, monkeypatch, shard, paths, bits):
    """One shard and one range; many small ones; a filter so full that it lets most pairs through."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    monkeypatch.setattr(collocations, "RANGE_PATHS", paths)
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    rows = corpus(random.Random(shard)) + ODD + [("fr", "mille fois " * 30_000)]
    want = plain(rows)
    assert len(want) > 20 and run(spark, rows) == want


def test_options_and_hot_pairs(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_BYTES", 1000)
    rows = corpus(random.Random(5), 60) + [("en", "the same words again")] * 300
    assert run(spark, rows, least=3, share=80, top=7) == plain(rows, 3, 80, 7)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [("en", None), (None, "")]) == []


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(Pieces, "hashes", lambda self: np.zeros(len(self.starts), np.uint64))
    number, words = Pieces([b"b a c b", b"abcdefgh1 abcdefgh2"]).numbered()
    assert words == [b"a", b"abcdefgh1", b"abcdefgh2", b"b", b"c"] and number.tolist() == [3, 0, 4, 3, 1, 2]


def automaton(counts):
    words = sorted({w for p in counts for w in p})
    number = {w: i for i, w in enumerate(words)}
    levels = []
    for d in (1, 2, 3):
        some = sorted((sum(number[w] * len(words)**(d - 1 - i) for i, w in enumerate(p)), c) for p, c in counts.items() if len(p) == d)
        levels.append((np.array([k for k, _ in some], np.int64), np.array([c for _, c in some], np.int64)))
    return Automaton.build(words, levels)


def listed(a):
    return {p: w for d in range(3) for p, w in zip(a.paths(d), a.weight[d].tolist()) if w}


def some_counts(rng, n=200):
    words = [bytes([97 + rng.randrange(6)]) * rng.randrange(1, 3) for _ in range(12)] + [b"a\x01", b"zz"]
    return {tuple(rng.choice(words) for _ in range(rng.randrange(1, 4))): rng.choice([1, 7, 300, 10**10]) for _ in range(n)}


@pytest.mark.parametrize("seed", range(4))
def test_automata(seed):
    rng = random.Random(seed)
    one, two = some_counts(rng), some_counts(rng)
    a, b = automaton(one), automaton(two)
    assert listed(a) == one and listed(Automaton.unpack(a.pack())) == one
    both = Counter(one)
    both.update(two)
    assert listed(union([a, b])) == dict(both)
    assert listed(union([a, b], 8)) == {p: c for p, c in both.items() if c >= 8}
    found = compose(a, b)
    assert {p: f for d in range(3) for p, f, w in zip(b.paths(d), found[d].tolist(), b.weight[d].tolist()) if w and f} == {p: one[p] for p in two if p in one}
    bounds = sorted({(rng.choice([b"a", b"ab", b"cc", b"q", b"zzz", b""]), rng.choice([b"a", b"b", b"zz", b"zzzz"])) for _ in range(6)})
    pieces = list(a.cut(bounds))
    assert {p: (i, w) for i, part in pieces for p, w in listed(part).items()} == {
        p: (sum(bound <= p[:2] if len(p) > 1 else bound[0] < p[0] for bound in bounds), w) for p, w in one.items()}
    assert union([]).paths(0) == []
