"""The numbered queries and the pipeline on the smallest tables, each stage against what it must keep."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, connect
from minim.llm.ngram_join import Rule
from test_decontamination import plain as similarity
from test_ngram_join import plain as plain_components

SF = "/root/testdata/sf0.001"


def test_all_numbers_are_registered():
    names = entry.queries()
    assert sorted({int(n[2:].split("_")[0]) for n in names if n.startswith("op")}) == list(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op4_line_dedup", "op5_warc", "op6_mixing", "op9_ngram_jaccard", "op11_hard_negatives", "op12_collocations", "op13_url_filters"])
def test_agrees_with_sql(spark, name):
    assert compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    items = [t for t, in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stage(spark, docs, SF)
        after = docs.collect()
        sizes.append(len(after))
        kept = {r["doc_id"] for r in after}
        assert docs.columns[:len(columns)] == columns and len(kept) == len(after)
        if name == "near_copies":
            assert kept == {c for _, _, c in plain_components(before, Rule())}
        if name == "decontaminate":
            for i, t in before:
                hit = any(x in t or similarity(t, x) >= 0.8 for x in items if set(x.split()[:20]) & set(t.split()) or x in t) if len(t) < 3000 else any(x in t for x in items)
                assert not (hit and i in kept), i
                if len(t) < 3000 and not hit:
                    assert i in kept
        if name == "shard":
            assert kept == {i for i, _ in before} and max(r["shard"] for r in after) <= 39
        docs = spark.createDataFrame(after, docs.schema)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.4 * sizes[0]
    run = corpus_pipeline.run(spark, SF)
    assert run.count() == sizes[-1]
