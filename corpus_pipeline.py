"""A corpus in five stages: rules, near copies, leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again for the next. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import Scratch, table
from gridloom.llm.decontaminate import clean_documents
from gridloom.llm.mixing import mixed_documents
from gridloom.llm.ngram_join import one_of_each_group
from gridloom.llm.quality_rules import Cascade
from gridloom.llm.sharding import place


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return Cascade.fit(docs).filter(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that the domains' tokens reach their target shares; none is lost."""
    return mixed_documents(docs, table(spark, sf_dir, "labels"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot, in contiguous shards of near-equal bytes."""
    return place(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: SQL has no counterpart for the join's components and the fitted rates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage_{k}")
        if k:
            scratch.drop(f"stage_{k - 1}")
    return docs
