"""Quality rules and classifier: base counts against plain Python, order of the trees, held-out accuracy, odd inputs."""

import random
import re
import zlib

import numpy as np
import pytest

from minim.llm import boosting
from minim.llm.doc_stats import BASE, FEATURES, statistics
from minim.llm.quality import FALLING, KEEP_AT, keep_quality, quality_classifier, quality_rules

SF = "/root/testdata/sf0.01"


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 5)} if len(grams) < 2000 else set()
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_base_counts():
    rng = random.Random(1)
    texts = ["", " ", "a b c d e a b c d e a", "x\nx\n x\nx", "#a |b é中 <>", "a b c d e f"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(30)]
    texts += ["\n".join(rng.choice(["p q", "r", "", " "]) for _ in range(12)) for _ in range(10)]
    base, features = statistics([t.encode() for t in texts])
    assert base.tolist() == [plain_base(t) for t in texts]
    assert np.isfinite(features).all() and features.shape == (len(texts), len(FEATURES))


def test_trees_follow_monotone_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.4 * np.sin(9 * x[:, 0]) + 0.3 * x[:, 1] + 0.2 * rng.random(3000)) > 0.8).astype(float)
    model = boosting.fit(x, y, monotone={0: 1}, trees=30)
    grid = np.repeat(rng.random((40, 3)), 50, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 50), 40)
    assert (np.diff(model.score(grid).reshape(40, 50), axis=1) >= -1e-12).all()
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    free = boosting.fit(x, y, trees=30)
    assert ((free.score(x) > 0.5) == y).mean() > 0.9


def test_constant_models():
    assert boosting.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((2, 2))).tolist() == [0.5, 0.5]
    assert boosting.fit(np.ones((8, 2)), np.ones(8)).score(np.zeros((1, 2)))[0] == pytest.approx(0.9)


def test_held_out_accuracy(spark):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality_classifier(documents, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) > 40 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows) > 0.9
    rules = {r["doc_id"]: r for r in quality_rules(documents, labels).collect()}
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    for i in list(text)[:150]:
        plain = plain_base(text[i])
        if plain[0] < 2000:
            assert [rules[i][c] for c in BASE] == plain
        assert rules[i]["base_failed"] == (rules[i]["n_words"] < 10 or 100 * rules[i]["n_repeat_words"] > 20 * rules[i]["n_words"])
        assert rules[i]["kept"] == (not rules[i]["base_failed"] and rules[i]["score"] >= KEEP_AT)
    assert set(FALLING) <= set(FEATURES)


def test_odd_inputs(spark, documents, empty):
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0, None) for i in range(30)] + [(3, 0, 1), (None, 1, 0), (5, None, 0), (999, 1, 0), (6, 7, 0)],
                                   "doc_id long, quality int, toxic int")
    nobody = spark.createDataFrame([], labels.schema)
    n = documents.count()
    assert quality_classifier(documents, labels).count() == n and quality_rules(documents, labels).count() == n
    assert {r["score"] for r in quality_classifier(documents, nobody).collect()} == {0.5}
    assert quality_rules(empty, labels).count() == 0 and quality_classifier(empty, nobody).count() == 0
    kept = keep_quality(documents, nobody)
    assert kept.schema == documents.schema and kept.count() == n
    null_id = documents.selectExpr("cast(null as long) as doc_id", "text")
    assert [r["held_out"] for r in quality_classifier(null_id, labels).collect()] == [False] * n
