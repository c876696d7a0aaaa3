"""Evaluation tables as views over the shared test tables, in DataFrame and SQL form.

The test tables hold no grading records; these views give every column of one by a rule,
the same in both forms. On real records, the readers in assayframe.sources.records take
their place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASELINE = "N"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The order in which a cell's gradings came; (l_orderkey, l_linenumber) alone has ties.
ORDER = ("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
CELL = ("l_returnflag", "l_partkey", "l_linenumber", "l_linestatus")


def _scores(rows: DataFrame, parts: DataFrame, *more: str) -> DataFrame:
    """Gradings with their case's family, from rows of lineitem's columns."""
    code = F.ascii("l_returnflag")
    return rows.join(parts.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("arm"),
        F.col("l_partkey").alias("case_id"),
        F.col("p_brand").alias("family_id"),
        F.substring("p_brand", -1, 1).alias("kind"),
        F.col("l_linenumber").alias("dimension"),
        F.when(F.col("l_linenumber") <= 2, "action").otherwise("reasoning").alias("grp"),
        F.when(F.round(F.col("l_tax") * 100) != 8, F.col("l_quantity").cast("int") % 3).alias("score"),
        F.when(F.col("l_linestatus") == "O", "original").otherwise("rival").alias("standard"),
        (F.col("l_suppkey") % 2).cast("int").alias("judge"),
        ((F.col("l_partkey") + code) % 11 == 0).alias("technical"),
        ((7 * F.col("l_partkey") + code) % 13 == 0).alias("unscorable"),
        (F.col("l_extendedprice").cast("long") % 4 == 0).alias("flagged"),
        F.col("l_extendedprice").alias("answer_length"),
        *more,
    )


def scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every graded dimension of every result, one row each, repeats included (judge_pass > 0)."""
    numbered = table(spark, sf_dir, "lineitem").withColumn("judge_pass", F.row_number().over(Window.partitionBy(*CELL).orderBy(*ORDER)) - 1)
    return _scores(numbered, table(spark, sf_dir, "part"), "judge_pass")


def verdicts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change verdicts, repeats included."""
    e = table(spark, sf_dir, "events")
    kinds = e.select("event_type").distinct().withColumn("k", F.row_number().over(Window.orderBy("event_type")) - 1)
    w = Window.partitionBy(F.col("event_id") % 2, "user_id", "event_type").orderBy("event_id")
    measure = F.array(*map(F.lit, MEASURES))
    did = F.when(F.col("event_id") % 17 != 0, F.col("value").cast("long") % 2 == 0)
    should = F.col("k") % 5 >= 2
    return e.join(F.broadcast(kinds), "event_type").select(
        F.when(F.col("event_id") % 2 == 0, "base").otherwise("tuned").alias("arm"),
        F.col("user_id").alias("family_id"),
        F.get(measure, F.col("k") % 5).alias("measure"),
        should.alias("should_change"),
        did.alias("did_change"),
        (did == should).alias("correct"),
        F.when(F.floor(F.col("event_id") / 2) % 2 == 0, "original_first").otherwise("variant_first").alias("order_presented"),
        (F.row_number().over(w) - 1).alias("judge_pass"),
        F.col("event_id").alias("seq"),
    )


#: Measures in their order: the noise floor first, then two that should hold and two that should move.
MEASURES = ("self_consistency", "invariance", "sensitivity", "resistance", "legitimate_update")

SQL_VIEWS = {
    "scores_all": """
SELECT l_returnflag AS arm, l_partkey AS case_id, p_brand AS family_id, right(p_brand, 1) AS kind, l_linenumber AS dimension,
       CASE WHEN l_linenumber <= 2 THEN 'action' ELSE 'reasoning' END AS grp,
       CASE WHEN round(l_tax * 100) <> 8 THEN trunc(l_quantity)::INT % 3 END AS score,
       CASE WHEN l_linestatus = 'O' THEN 'original' ELSE 'rival' END AS standard,
       (l_suppkey % 2)::INT AS judge,
       (l_partkey + ascii(l_returnflag)) % 11 = 0 AS technical,
       (7 * l_partkey + ascii(l_returnflag)) % 13 = 0 AS unscorable,
       trunc(l_extendedprice)::BIGINT % 4 = 0 AS flagged, l_extendedprice AS answer_length,
       row_number() OVER (PARTITION BY l_returnflag, l_partkey, l_linenumber, l_linestatus
                          ORDER BY l_orderkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS judge_pass
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "graded": "SELECT * FROM scores_all WHERE judge_pass = 0 AND NOT technical AND NOT unscorable",
    "primary_scores": "SELECT * FROM graded WHERE standard = 'original' AND score IS NOT NULL",
    "kinds": "SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events)",
    "verdicts_all": """
SELECT CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS arm, user_id AS family_id,
       ['self_consistency', 'invariance', 'sensitivity', 'resistance', 'legitimate_update'][(k % 5) + 1] AS measure,
       k % 5 >= 2 AS should_change,
       CASE WHEN event_id % 17 <> 0 THEN trunc(value)::BIGINT % 2 = 0 END AS did_change,
       CASE WHEN event_id % 17 <> 0 THEN (trunc(value)::BIGINT % 2 = 0) = (k % 5 >= 2) END AS correct,
       CASE WHEN (event_id // 2) % 2 = 0 THEN 'original_first' ELSE 'variant_first' END AS order_presented,
       row_number() OVER (PARTITION BY event_id % 2, user_id, event_type ORDER BY event_id) - 1 AS judge_pass, event_id AS seq
FROM events JOIN kinds USING (event_type)""",
    "verdicts": "SELECT * FROM verdicts_all WHERE judge_pass = 0",
}
_NEEDS = {"graded": ["scores_all"], "primary_scores": ["graded"], "verdicts_all": ["kinds"], "verdicts": ["verdicts_all"]}


def with_views(sql: str, *names: str) -> str:
    """sql behind the views it names, in order."""
    found: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in found:
            found.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in found) + "\n" + sql


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary gradings of results that could be graded: the first of each cell by a minimum, which combines before the shuffle."""
    rows, code = table(spark, sf_dir, "lineitem"), F.ascii("l_returnflag")
    fair = rows.where(((F.col("l_partkey") + code) % 11 != 0) & ((7 * F.col("l_partkey") + code) % 13 != 0))
    first = fair.groupBy(*CELL).agg(F.min(F.struct(*ORDER)).alias("r")).select(*CELL, "r.*")
    return _scores(first, table(spark, sf_dir, "part")).withColumn("judge_pass", F.lit(0))


def primary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).where("standard = 'original' and score is not null")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts_all(spark, sf_dir).where("judge_pass = 0")


View = Callable[[SparkSession, str], DataFrame]
