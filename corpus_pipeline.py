"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayframe.llm.queries import table
from assayframe.llm.stages import decontaminated, encoded, language, near_duplicates, sanitised
from assayframe.session import scratch

STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("sanitised", sanitised),
    ("encoded", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}-{name}")
        docs = spark.read.parquet(f"{path}/{k}-{name}")
    return docs


#: SQL expresses none of the stages but decontamination's counting; the tests hold every stage against brute force.
ORACLE_SQL = None
