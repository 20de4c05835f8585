"""Benchmark passages: against all windows by brute force, blocks of items, the radius guarantee, odd inputs."""

import random
from collections import Counter

import numpy as np

from conftest import sentence
from minim.llm import decontamination as D


def plain(text, item):
    words, own = text.encode().lower().split(), item.encode().lower().split()
    width = min(5, len(own))
    if not own:
        return 0.0
    target = Counter(tuple(own[i:i + width]) for i in range(len(own) - width + 1))
    best = 0.0
    for s in range(len(words) - len(own) + 1):
        win = words[s:s + len(own)]
        seen = Counter(tuple(win[i:i + width]) for i in range(len(own) - width + 1))
        best = max(best, sum((seen & target).values()) / sum((seen | target).values()))
    return best


def cases():
    rng = random.Random(2)
    items = [sentence(rng, n) for n in (3, 4, 5, 6, 12, 20, 31, 31, 60)] + ["", "   ", "go go go go go go go go go"]
    texts = ["", "word"]
    for item in items:
        words = item.split()
        for change in (0, 1, 2, 5):
            near = list(words)
            for k in range(min(change, len(near))):
                near[-1 - k] = f"new{k}"
            texts.append(sentence(rng, 30) + " " + " ".join(near).upper() + " \n" + sentence(rng, 25))
    return texts, items


def test_agrees_with_all_windows(spark, monkeypatch):
    texts, items = cases()
    expected = {(i, j): s for i, t in enumerate(texts) for j, x in enumerate(items) if (s := plain(t, x)) >= 0.8}
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.contaminated(documents, benchmark).collect()}
    assert found.keys() == expected.keys() and len(expected) > 15
    assert all(abs(found[k] - expected[k]) < 1e-12 for k in found)
    monkeypatch.setattr(D, "ITEM_BLOCK", 4)
    blocks = list(D.item_blocks(benchmark, 4))
    assert len(blocks) == 3
    kept = {r["doc_id"] for r in D.drop_contaminated(documents, benchmark).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in expected}


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    index = D.Index([(i, " ".join(f"w{i}x{k}" for k in range(20)).encode()) for i in range(30)]).build()
    for _ in range(300):
        item = int(rng.integers(30))
        flips = rng.choice(64, int(rng.integers(D.RADIUS + 1)), replace=False)
        near = index.prints[item] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if len(flips) else index.prints[item]
        window, found = index.find(np.array([near], np.uint64), np.array([20]))
        assert item in found.tolist()
        assert all(bin(int(near) ^ int(index.prints[i])).count("1") <= D.RADIUS for i in found)


def test_odd_inputs(spark, documents, empty, texts):
    benchmark = spark.createDataFrame([(1, texts[2]), (2, texts[2]), (3, None), (None, texts[4]), (4, "")], "item_id long, text string")
    found = D.contaminated(documents, benchmark).collect()
    holding = sum(plain(t or "", texts[2]) >= 0.8 for t in texts if len(t or "") < 10_000)
    assert {r["item_id"] for r in found} == {1, 2} and len(found) == 2 * holding
    nothing = spark.createDataFrame([], benchmark.schema)
    assert D.contaminated(documents, nothing).count() == 0 and D.contaminated(empty, benchmark).count() == 0
    assert D.drop_contaminated(documents, nothing).count() == documents.count()
    assert D.drop_contaminated(documents, benchmark).schema == documents.schema


def test_texts_shorter_than_an_item(spark):
    """Against the whole word sequence, by brute force, where a text has fewer words than an item."""
    rng = random.Random(4)
    items = [sentence(rng, n) for n in (4, 5, 6, 9, 10, 14, 24, 40, 80)] + ["go " * 40, sentence(rng, 40)]
    items[-1] = " ".join(items[7].split()[:35] + items[-1].split()[:5])
    texts = []
    for item in items:
        words = item.split()
        for lost in (1, 2, 3, 6, 7, 8, len(words) // 5, len(words) // 2):
            texts += [" ".join(words[lost:]).upper(), " \n".join(words[:-lost]), " ".join(words[lost // 2:len(words) - lost // 2 - 1])]
        texts += [" ".join(words[:20] + ["new"] + words[21:-1]), item + " one more"]

    def similarity(text, item):
        words, own = text.lower().split(), item.lower().split()
        if len(words) >= len(own):
            return plain(text, item)
        seen, target = (Counter(tuple(x[i:i + 5]) for i in range(len(x) - 4)) for x in (words, own))
        return sum((seen & target).values()) / max(1, sum((seen | target).values()))

    expected = {(i, j): s for i, t in enumerate(texts) for j, x in enumerate(items) if (s := similarity(t, x)) >= 0.8}
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = D.contaminated(documents, benchmark).collect()
    shorter = {(i, j) for i, j in expected if len(texts[i].split()) < len(items[j].split())}
    assert len(shorter) > 40
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 12) for r in found} == {k: round(s, 12) for k, s in expected.items()}
    assert all((r["first_word"], r["n_words"]) == (0, len(texts[r["doc_id"]].split())) for r in found if (r["doc_id"], r["item_id"]) in shorter)
    kept = {r["doc_id"] for r in D.drop_contaminated(documents, benchmark).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in expected}
