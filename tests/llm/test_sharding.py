"""Shards: the law, gapless slots, few cut edges, links larger than a shard, odd inputs."""

import zlib
from collections import Counter, defaultdict

from minim.llm.sharding import balanced_shards, edge_cut, place_documents, shard_documents, text_nodes


def check(rows, n_shards):
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(n_shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_links_stay_together(spark):
    rows = [(i, f"single {i}") for i in range(700)] + [(1000 + i, f"copies {i // 4}") for i in range(200)] + [(2000 + i, "the hot text") for i in range(300)]
    placed = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 10)
    out = placed.collect()
    check(out, 10)
    shards = defaultdict(Counter)
    for r in out:
        shards[r["text_crc32"]][r["shard"]] += 1
    hot = shards[zlib.crc32(b"the hot text")]
    # 300 copies need three shards of 120; the smaller groups are whole but for the few that meet a full shard.
    assert sum(sorted(hot.values())[-3:]) >= 290
    assert sum(len(v) > 1 for k, v in shards.items() if k != zlib.crc32(b"the hot text")) <= 3
    assert edge_cut(placed).first()["cut"] < 220
    assert all(r["size"] == len(dict(rows)[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(dict(rows)[r["doc_id"]].encode()) for r in out)


def test_all_documents_linked(spark):
    rows = [(i, f"text {i % 7}") for i in range(103)]
    check(shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect(), 10)
    nodes = text_nodes(spark.createDataFrame(rows, "doc_id long, text string"))
    check(balanced_shards(nodes, 10, max_rounds=0).collect(), 10)


def test_odd_inputs(spark, documents, empty):
    rows = shard_documents(documents).collect()
    assert len(rows) == documents.count()
    check(rows, 40)
    assert shard_documents(empty).count() == 0
    assert {r["size"] for r in rows if r["text_crc32"] == 0} == {16}
    placed = place_documents(documents, 5)
    assert placed.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "link", "shard", "slot"] and placed.count() == documents.count()
    check(placed.collect(), 5)
    nameless = documents.selectExpr("cast(null as long) as doc_id", "text")
    check(place_documents(nameless, 5).collect(), 5)


def test_repeated_rows_and_clashing_columns(spark):
    """Copies that differ in other columns stay each with their own values, under names that the operator uses itself."""
    rows = [(i % 40 if i % 3 else None, f"text {i % 4}", i, i, i, i, i, i) for i in range(300)]
    names = "doc_id long, text string, _id long, _link long, _copy long, _doc long, _row long, order long"
    placed = place_documents(spark.createDataFrame(rows, names).repartition(4), 7)
    assert placed.columns == [*(c.split()[0] for c in names.split(", ")), "shard", "slot"]
    out = placed.collect()
    check(out, 7)
    assert sorted((tuple(r)[:8] for r in out), key=repr) == sorted(rows, key=repr)


def test_a_third_of_the_rows_without_an_id(spark):
    rows = [(None, f"t {i}") for i in range(400)] + [(i, f"u {i}") for i in range(800)]
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 9).collect()
    check(out, 9)
    assert len(out) == 1200
