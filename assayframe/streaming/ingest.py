"""Grading records as a stream: repeats are dropped within a watermark, and running summaries are kept.

The records are those of assayframe.sources.records with a time of grading. First wins,
as in the batch queries, as long as repeats come within the delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayframe.session import shared_dir

SCORES = "arm string, case_id bigint, family_id string, dimension string, score int, judge_pass int, graded_at timestamp"


def score_stream(spark: SparkSession, path: str, schema: str = SCORES, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def first_gradings(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Primary gradings, one an arm, case and dimension; the state of a key is let go after the delay."""
    return stream.where("judge_pass = 0").withWatermark("graded_at", delay).dropDuplicatesWithinWatermark(["arm", "case_id", "dimension"])


def windowed_stats(stream: DataFrame, window: str = "1 hour") -> DataFrame:
    """n, total and unscorable entries by arm, dimension and window of grading; partial sums, so the state has a row a group."""
    s = F.col("score")
    return stream.groupBy(F.window("graded_at", window).alias("w"), "arm", "dimension").agg(F.count(s).alias("n"), F.sum(s).alias("total"), F.count_if(s.isNull()).alias("unscorable_n")).select("w.start", "arm", "dimension", "n", "total", "unscorable_n")


def append_parquet(stream: DataFrame, path: str, name: str) -> StreamingQuery:
    """Takes what is there, appends it to path and ends; the next call goes on from there."""
    where = f"{shared_dir(stream.sparkSession)}/assayframe/streams/{name}"
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", where).outputMode("append").trigger(availableNow=True).start()
