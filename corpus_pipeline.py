"""From documents to training shards: quality, near duplicates, benchmark passages, mix, shards.

Each stage takes what its predecessor kept, as written Parquet, and returns the rows it keeps with all columns of `documents`; the last one
adds `shard` and `slot`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from minim.llm.decontamination import drop_contaminated
from minim.llm.mixing import select_mix
from minim.llm.ngram_join import Rule, keep_first
from minim.llm.quality import keep_quality
from minim.llm.queries import MIX_WEIGHTS, table
from minim.llm.sharding import place_documents
from minim.session import Scratch

#: Words of a shingle and the least Jaccard similarity of near copies.
NEAR = Rule(width=5, num=8, den=10)
#: The mix takes this part of all tokens that arrive.
MIX_SHARE = (4, 5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies."""
    return keep_first(docs, NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fill the budgets of their domain, language and source."""
    return select_mix(docs, weights=MIX_WEIGHTS, share=MIX_SHARE)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its place in it."""
    return place_documents(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The classifier and the fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between two stages is written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
