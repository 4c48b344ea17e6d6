"""From raw documents to a training mix: five stages, each over all rows its predecessor kept.

1. quality rules: failing lines go, and documents that fail or lose too much;
2. near-dedup: of each group of near copies (five-word Jaccard of 0.8 or more) the least doc_id stays;
3. suffix-array dedup: bytes of 100-byte strings that stand earlier go, and documents with nothing left;
4. benchmark decontamination: documents in which a test item is found go;
5. mixing: how many copies of each remaining document meet the sources' weights.

Stages 1 to 4 return the columns of ``documents``. Every stage's result is written
to the shared folder and read again, so a lost executor costs at most a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenlog.llm.common import cut, table
from lumenlog.llm.decontam import decontaminate
from lumenlog.llm.mixing import mix
from lumenlog.llm.nearcopies import dedup
from lumenlog.llm.quality import clean
from lumenlog.llm.suffix import rewrite


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rewrite(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Suffix sorting and dependent draws have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
