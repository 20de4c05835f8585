"""Line dedup against plain Python, with keys that span partitions, and odd inputs."""

import hashlib
import random
from collections import defaultdict

from minim.llm.line_dedup import apply_bitmaps, dropped_lines, keep_bitmaps

BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 10 and i is not None:
                holders[key_of(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key_of(x)) < 10 or len(holders[key_of(x)]) < 2 or min(holders[key_of(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(documents):
    rows = apply_bitmaps(documents, keep_bitmaps(documents)).collect()
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows), key=str)


def test_agrees_with_plain_python(spark):
    rng = random.Random(4)
    pool = [f"Common line number {k} ÄÖ" for k in range(12)] + ["short", "exactly10c", "  exactly10C\x0b", "中文中文中文中文中", "中文中文中文中文中文", ""]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own line {i} {k} of many" for k in range(rng.randrange(12)))) for i in range(150)]
    # One line in every document: its rows fill several range partitions.
    rows += [(1000 + i, "the very same line\nthe very same line\n" + f"row number {i} here") for i in range(600)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert run(documents) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert dropped_lines(documents).count() == sum(r[2] for r in plain(rows))


def test_odd_inputs(spark, documents, empty):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert run(documents) == plain(rows)
    assert run(empty) == []
    rows = [(None, "a line that repeats"), (7, "a line that repeats"), (7, "A line that repeats\nx"), (3, "a line that repeats \n\n"), (None, None)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)
