"""From raw documents to sharded training data, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents; the last adds each row's shard and slot.

Every stage takes tables with nulls in any column, empty and very long texts, ties,
repeated rows, more columns of any name, and no rows, and none collects rows of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm.common import materialize
from lamina.llm.decontamination import drop_contaminated
from lamina.llm.jaccard import drop_near_duplicates
from lamina.llm.mixing import mixed_rows, plan_mix
from lamina.llm.quality import keep_good
from lamina.llm.sharding import shard_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score 0.5 or more), with all their
    columns. A null text counts as empty and gets the model's bias; equal texts share their
    fate; without labels of both classes every score is the share of label 1, or 0.5."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more): that with the
    smallest doc_id, nulls last, then the smallest hash of its text. Of repeated rows one
    stays; texts without words (null, empty) are copies of nothing and all stay."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. A null or empty text holds none, an
    empty benchmark drops nothing, and equal texts share their fate."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is a source of its own; a
    document without words takes nothing from its target and comes as often as its block;
    of repeated rows as many come as are taken."""
    return mixed_rows(docs, plan_mix(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, in all its columns, with its shard and slot; columns of those names are
    replaced. Repeated rows get places of their own; nulls are values like any other."""
    return shard_table(docs, 40)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: SQL can't express the trained classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k + 1}")
    return docs
