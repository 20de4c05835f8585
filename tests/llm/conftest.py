"""Small documents with every odd case, for all operators."""

import random

import pytest

WORDS = "alpha beta gamma delta the of and river stone cloud winter garden market signal copper".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    base = [sentence(rng, rng.randrange(20, 90)) for _ in range(40)]
    near = [t + " " + sentence(rng, 1) for t in base[:8]]
    lines = ["A shared line of text here\n" + t + "\n  a SHARED line of text here\t" for t in base[10:16]]
    long = [sentence(rng, 30_000)]
    odd = [None, "", " ", "\n\n", "one", "one two", "one two", "ünï cödé 中文 \x0b tail", base[0], base[0], "a b  c"]
    return base + near + lines + long + odd


@pytest.fixture(scope="session")
def documents(spark, texts):
    """Extra columns with names that the operators use themselves; two rows that are equal."""
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t or ""), 1.5, "x", 7) for i, t in enumerate(texts)]
    rows.append(rows[3])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, link string, shard int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark, documents):
    return spark.createDataFrame([], documents.schema)
