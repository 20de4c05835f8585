"""Token counts against place-by-place scoring and all segmentations, and odd inputs."""

import functools

import numpy as np

from minim.llm.token_counts import Vocabulary, count_tokens, load_vocabulary, token_counts


def test_best_of_all_segmentations(spark):
    vocabulary = load_vocabulary(spark)

    @functools.cache
    def best(token):
        """(score, -tokens) over every segmentation."""
        if not token:
            return 0.0, 0
        return max((s + vocabulary.pieces[token[k:]], n - 1) for k in range(len(token)) if token[k:] in vocabulary.pieces for s, n in [best(token[:k])])

    for word in (b" the", b" thoughtful", b" internationalization", "  ünïcödé".encode()[1:], b" xqzjk", b" 12345678"):
        score, n = best(word)
        assert abs(score - best(word)[0]) < 1e-9 and vocabulary.count(word) == -n


def test_trie_agrees_with_single_strings(spark, texts):
    vocabulary = load_vocabulary(spark)
    data = [(t or "").encode() for t in texts] + [b"a" * 300 + b" " + bytes(range(33, 255)), b"x\x00y \x00"]
    words, tokens = count_tokens(data, vocabulary)
    memo = functools.cache(lambda w: vocabulary.count(b" " + w))
    assert words.tolist() == [len(t.split()) for t in data]
    assert tokens.tolist() == [sum(map(memo, t.split())) for t in data]


def test_own_vocabulary():
    small = Vocabulary({b" a": -1.0, b"b": -1.5, b" ab": -2.6, b"bb": -2.0, b" ": -3.0})
    words, tokens = count_tokens([b"abb a\tq", b""], small)
    # " a"+"bb" scores -3.0; " a" alone; " " and the unknown q.
    assert words.tolist() == [3, 0] and tokens.tolist() == [2 + 1 + 2, 0]
    assert np.isclose(small.unknown, -13.0)


def test_odd_inputs(spark, documents, empty):
    rows = token_counts(documents).collect()
    assert len(rows) == documents.count() and {r["n_tokens"] for r in rows if r["n_words"] == 0} == {0}
    assert token_counts(empty).count() == 0
