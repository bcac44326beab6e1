"""Corpus pipeline over ``documents``: filter, deduplicate, decontaminate, mix, shard.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before kept.
All but the last return the columns of ``docs``. Its result is written as Parquet and
read again as the next stage's ``docs``. Cases such as nulls, ties and empty tables are
defined by the operators that the stages call.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from visitorlens.llm import decontaminate, mixing, quality_rules, shards, simhash
from visitorlens.llm.common import table

N_SHARDS = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the certified cutoffs of their language."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the row with the least id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark."""
    return decontaminate.drop_contained(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's weight asks; every row at least once."""
    return mixing.mix_sources(docs).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard and slot."""
    return shards.shard_rows(docs, N_SHARDS)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

# Shingle hashes by XXH64 and the permutations have no equivalent in SQL; the pipeline is
# tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last one.

    Results between stages are written below ``spark.checkpoint.dir``, which all
    executors share; only where that is not set, as in tests, in a temporary folder. They
    stay there, since the result is read from them: delete the folder when it is no longer
    needed.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="stages-")
    folder = f"{shared.rstrip('/')}/stages-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
