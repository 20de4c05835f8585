"""Components against brute force: near copies, hot groups with stragglers, filters, odd inputs."""

import random
from collections import defaultdict

import pytest

from conftest import sentence
from minim.llm import ngram_join
from minim.llm.ngram_join import Rule, keep_first, ngram_classes, ngram_components


def grams(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)}


def plain(rows, rule):
    sets = [grams(t, rule.width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rule.den * both >= rule.num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = defaultdict(lambda: 1 << 62)
    for i, (k, _) in enumerate(rows):
        low[root(i)] = min(low[root(i)], k)
    return sorted((k, len(sets[i]), low[root(i)]) for i, (k, _) in enumerate(rows))


def run(spark, rows, rule):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(df, rule).collect())


def corpus(rng):
    texts = [sentence(rng, rng.randrange(2, 120)) for _ in range(60)]
    for t in list(texts[:30]):
        words = t.split()
        for _ in range(rng.randrange(4)):
            near = list(words)
            for _ in range(rng.randrange(1, 5)):
                near[rng.randrange(len(near))] = f"new{rng.randrange(99)}"
            texts.append(" ".join(near))
    texts += [None, "", "  ", "one", "ONE", "one two", "a b c", "a b c d", "x " * 50, "x " * 60]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rule", [Rule(), Rule(3, 90, 100), Rule(2, 5, 10)])
def test_agrees_with_brute_force(spark, rule):
    rows = corpus(random.Random(rule.width))
    assert run(spark, rows, rule) == plain(rows, rule)


@pytest.mark.parametrize("limit,partners", [(0, 500), (2, 7)])
def test_hot_groups(spark, monkeypatch, limit, partners):
    """Hundreds of near copies of one text, some beyond the threshold of most others; both ways to end the search, hubs of one bucket and of many."""
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ROW", limit)
    monkeypatch.setattr(ngram_join, "PARTNERS", partners)
    rng = random.Random(9)
    base = sentence(rng, 60).split()
    rows = []
    for i in range(160):
        near = list(base)
        for _ in range(rng.randrange(0, 4)):
            near[rng.randrange(len(near))] = f"new{rng.randrange(999)}"
        rows.append((i, " ".join(near)))
    rows += [(500 + i, " ".join(base)) for i in range(100)] + [(900 + i, sentence(rng, 40)) for i in range(40)]
    rule = Rule(3, 90, 100)
    assert run(spark, rows, rule) == plain(rows, rule)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, links, _ = ngram_classes(df, rule)
    sets = {k: grams(t, 3) for k, t in rows}
    tested = [(r["u"], r["v"]) for r in links.collect()]
    assert len(tested) == len(set(tested))
    assert all(100 * len(sets[u] & sets[v]) >= 90 * len(sets[u] | sets[v]) for u, v in tested)


def test_keep_first(spark):
    rows = corpus(random.Random(77))
    kept = keep_first(spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, node int"))
    assert kept.columns == ["doc_id", "text", "node"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in plain(rows, Rule())})


def test_odd_inputs(spark, documents, empty):
    rows = sorted({(r["doc_id"], r["text"]) for r in documents.collect()})
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(documents).collect()}
    assert found == set(plain(rows, Rule()))
    assert ngram_components(documents).count() == documents.count()
    # One of the two equal rows and the smallest of each group.
    assert sorted(r["doc_id"] for r in keep_first(documents).collect()) == sorted({c for _, _, c in plain(rows, Rule())})
    assert ngram_components(empty).count() == 0 and keep_first(empty).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in ngram_components(nameless).collect()] == [(1, 2, 1)]
    assert keep_first(nameless).count() == 3


def test_keep_first_keeps_columns_and_one_of_equal_rows(spark):
    rows = [(1, "a b c d e f", i, i, i) for i in range(30)] + [(2, "A b c d e f", 7, 7, 7), (None, "a b c d e f", 8, 8, 8), (None, None, 9, 9, 9), (3, None, 1, 1, 1), (3, "", 2, 2, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _place long, _gone long, _doc long").repartition(3)
    first = [sorted(map(tuple, keep_first(d).collect()), key=repr) for d in (docs, docs.repartition(5))]
    assert first[0] == first[1] and len(first[0]) == 5 and all(len(set(r[2:])) == 1 for r in first[0])
    assert sorted(r[0] for r in first[0] if r[0]) == [1, 3, 3]
