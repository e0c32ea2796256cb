"""The corpus pipeline: quality, near-duplicates, benchmark passages, mixing, shards.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame;
all but the last return the columns of ``documents``. ``run`` writes each stage's rows to the shared
folder and reads them again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenhand.llm.common import table, written
from evenhand.llm.decontam import decontaminated
from evenhand.llm.extendible_shards import with_shards
from evenhand.llm.minhash_dedup import deduplicated
from evenhand.llm.mixing import mix
from evenhand.llm.quality import fit, scored

#: Rows whose quality score is lower go.
LEAST_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")), least=LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity of 0.8 or more)."""
    return deduplicated(docs, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of domains, languages and sources, each once at most."""
    return mix(docs, max_epochs=1)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return with_shards(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A learned classifier can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
