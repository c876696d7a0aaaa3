"""Queries of what runs keep in files, and of the plans, arms and graders that they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.operators import arms as A
from assayframe.operators import comparison as C
from assayframe.plans.registry import query
from assayframe.plans.scores import PAIRS_SQL, _dimension_pairs, _with
from assayframe.session import scratch
from assayframe.sources import adapters as V
from assayframe.sources import records as I
from assayframe.sources import run_records as RR
from assayframe.sources.adapters import table, with_views


@query("SELECT conv_id || '.' || turn AS prompt_id, CASE WHEN turn % 2 = 0 THEN 'tuned' ELSE role END AS model, text FROM conversations WHERE text IS NOT NULL")
def answers_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Answers written elsewhere, every second of which names no model."""
    rows = table(spark, d, "conversations").where("text is not null")
    path = scratch(spark, "answers")
    I.write_records(rows.select(F.concat_ws(".", "conv_id", "turn").alias("prompt_id"), F.when(F.col("turn") % 2 != 0, F.col("role")).alias("model"), "text"), path)
    return I.read_answers(spark, path, "tuned")


@query("SELECT 'r' || (doc_id % 2) AS run_id, coalesce(lang, 'none') AS stage, 'second' AS at, '{\"n\": ' || count(*) || '}' AS payload FROM documents GROUP BY ALL")
def recorded_stages(spark: SparkSession, d: str) -> DataFrame:
    """What stages of two runs have said, of which the later write holds. A stage is a language."""
    counts = table(spark, d, "documents").groupBy(F.concat(F.lit("r"), (F.col("doc_id") % 2).cast("string")).alias("run"), F.coalesce("lang", F.lit("none")).alias("stage")).agg(F.count("*").alias("n")).collect()
    path = scratch(spark, "run-record")
    for at, less in (("first", 1), ("second", 0)):
        for r in counts:
            RR.record_stage(spark, path, r["run"], r["stage"], {"n": r["n"] - less}, at)
    return RR.run_record(spark, path)


@query("SELECT r_regionkey, '{\"id\":' || r_regionkey || ',\"names\":{\"r\":\"' || r_name || '\",\"none\":null},\"nations\":[' || (SELECT string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) || ']}' AS record FROM region")
def records_as_json(spark: SparkSession, d: str) -> DataFrame:
    """Nested rows as JSON objects, nulls kept."""
    nations = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("nations"))
    rows = table(spark, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    nested = rows.select(F.col("r_regionkey").alias("id"), F.struct(F.col("r_name").alias("r"), F.lit(None).cast("string").alias("none")).alias("names"), "nations")
    return nested.select(F.col("id").alias("r_regionkey"), F.to_json(F.struct("id", "names", "nations"), {"ignoreNullFields": "false"}).alias("record"))


@query("SELECT n_regionkey AS region, count(*) AS nations, list_sort(list(n_name)) AS names FROM nation GROUP BY n_regionkey")
def document_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document over many lines, with all regions in it."""
    one = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    whole = one.agg(F.sort_array(F.collect_list(F.struct(F.col("n_regionkey").alias("region"), "names"))).alias("regions"))
    path = scratch(spark, "document")
    whole.select(F.to_json(F.struct("regions"), {"pretty": "true"}).alias("value")).coalesce(1).write.text(path)
    read = I.read_document(spark, path).select(F.explode("regions").alias("r"))
    return read.select("r.region", F.size("r.names").cast("long").alias("nations"), "r.names")


@query("SELECT doc_id // 50 AS page, doc_id AS row_idx, text FROM documents WHERE doc_id // 50 % 4 <> 3 AND text IS NOT NULL")
def paged_rows(spark: SparkSession, d: str) -> DataFrame:
    """A dataset kept in pages of fifty rows, every fourth of which is broken off and gives none."""
    docs = table(spark, d, "documents").where("text is not null")
    row = F.struct(F.col("doc_id").alias("row_idx"), F.struct(F.col("doc_id").cast("string").alias("id"), "text").alias("row"))
    pages = docs.groupBy(F.floor(F.col("doc_id") / 50).alias("page")).agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("value"))
    path = scratch(spark, "pages")
    broken = pages.select("page", F.when(F.col("page") % 4 == 3, F.substr("value", F.lit(1), F.length("value") - 9)).otherwise(F.col("value")).alias("value"))
    # A file for each page.
    broken.repartition("page").write.partitionBy("page").text(path)
    return I.read_pages(spark, path).select(F.floor(F.col("row_idx") / 50).alias("page"), "row_idx", "text")


@query(with_views(
    """, j AS (SELECT arm, judge, bool_or(judge_pass = 0 AND judge < case_id % 3) AS of_record, bool_or(judge_pass > 0) AS repeats FROM (SELECT arm || '.' || (case_id % 50) AS arm, judge + case_id % 2 AS judge, judge_pass, case_id FROM scores_all) GROUP BY ALL)
SELECT a.arm, a.judge AS first, b.judge AS second FROM j a JOIN j b ON a.arm = b.arm AND a.of_record AND b.repeats AND NOT b.of_record""", "scores_all"))
def judge_pair_rows(spark: SparkSession, d: str) -> DataFrame:
    """Graders of record with those that only graded again, by arm and slice."""
    i = F.col("case_id")
    rows = V.scores_all(spark, d).select(F.concat_ws(".", "arm", (i % 50).cast("string")).alias("arm"), (F.col("judge") + i % 2).alias("judge"), "judge_pass", i)
    seen = rows.groupBy("arm", "judge").agg(F.bool_or((F.col("judge_pass") == 0) & (F.col("judge") < i % 3)).alias("of_record"), F.bool_or(F.col("judge_pass") > 0).alias("repeats"))
    marked = seen.select("arm", "judge", F.inline(F.array(F.struct(F.lit(False).alias("later"), F.col("of_record").alias("holds")), F.struct(F.lit(True).alias("later"), F.col("repeats").alias("holds"))))).where("holds")
    return A.judge_pair_rows(marked, ["arm"], later=F.col("later"))


@query(_with(PAIRS_SQL, "dimension, kind", "primary_scores").replace("\nSELECT arm, dimension, kind, n,", "\n, ch AS (SELECT arm, dimension, kind, n,") + ") SELECT arm, dimension, kind, delta, row_number() OVER (PARTITION BY arm ORDER BY coalesce(delta, 0), dimension, kind) AS position FROM ch")
def changes_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Changes as a report lists them: what was lost first. There are as many rows as slices."""
    from pyspark.sql import Window

    slices = C.change(_dimension_pairs(spark, d), ["dimension", "kind"])
    order = Window.partitionBy("arm").orderBy(F.coalesce("delta", F.lit(0.0)), "dimension", "kind")
    return slices.select("arm", "dimension", "kind", "delta", F.row_number().over(order).alias("position"))


_PLAN_SQL = "p AS (SELECT 'k' || (p_size % 7) AS kind, 't' || (p_partkey % 9) AS task, sum(p_size % 5 - 2)::BIGINT AS n FROM part WHERE p_partkey % 9 <> 4 GROUP BY ALL), r AS (SELECT DISTINCT 't' || (s_suppkey % 12) AS task, 'd' || (s_suppkey % 12 + s_nationkey % 2 * 12) AS dimension FROM supplier)"
PLAN_KINDS, PLAN_DIMENSIONS = tuple(f"k{i}" for i in range(5)), tuple(f"d{i}" for i in range(26))
_DIMENSIONS_SQL = f"v AS (SELECT unnest([{', '.join(repr(x) for x in PLAN_DIMENSIONS)}]) AS dimension), c AS (SELECT dimension, sum(n)::BIGINT AS cases FROM (SELECT task, sum(n) AS n FROM p WHERE n > 0 GROUP BY task) JOIN r USING (task) GROUP BY dimension), q AS (SELECT dimension, cases IS NOT NULL AS reachable, coalesce(cases, 0) AS cases FROM v LEFT JOIN c USING (dimension))"


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i, s = F.col("p_partkey"), F.col("s_suppkey")
    plan = table(spark, d, "part").where(i % 9 != 4).groupBy(F.concat(F.lit("k"), (F.col("p_size") % 7).cast("string")).alias("kind"), F.concat(F.lit("t"), (i % 9).cast("string")).alias("task")).agg(F.sum(F.col("p_size") % 5 - 2).alias("n"))
    reach = table(spark, d, "supplier").select(F.concat(F.lit("t"), (s % 12).cast("string")).alias("task"), F.concat(F.lit("d"), (s % 12 + F.col("s_nationkey") % 2 * 12).cast("string")).alias("dimension"))
    return plan, reach.distinct()


@query(f"WITH {_PLAN_SQL}, {_DIMENSIONS_SQL} SELECT * FROM q")
def planned_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Which dimensions a plan's tasks can score, and with how many cases."""
    return A.planned_dimensions(*_plan(spark, d), PLAN_DIMENSIONS)


@query(f"""WITH {_PLAN_SQL}, {_DIMENSIONS_SQL} SELECT DISTINCT 'known_kind' AS rule, kind AS detail FROM p WHERE kind NOT IN ({', '.join(repr(x) for x in PLAN_KINDS)}) UNION ALL SELECT 'count_not_negative', kind || '/' || task FROM p WHERE n < 0
UNION ALL SELECT 'has_control', '' WHERE (SELECT coalesce(sum(n), 0) FROM p WHERE kind = 'k9') = 0 UNION ALL SELECT 'dimension_in_reach', dimension FROM q WHERE NOT reachable""")
def plan_violations(spark: SparkSession, d: str) -> DataFrame:
    return A.plan_violations(*_plan(spark, d), PLAN_KINDS, PLAN_DIMENSIONS, control="k9")


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'base=' || o_custkey || ', tuned = x=' || o_orderstatus || ',' WHEN 1 THEN 'a=1,a=2' WHEN 2 THEN 'a=,b=1' WHEN 3 THEN 'just a name' ELSE 'only=' || o_orderkey END AS spec FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'base>' || regexp_extract(spec, 'base=([0-9]+)', 1) || ';tuned>x=' || regexp_extract(spec, 'x=(.*),$', 1) WHEN 4 THEN 'only>' || split_part(spec, '=', 2) END AS arms FROM s""")
def arm_specs(spark: SparkSession, d: str) -> DataFrame:
    """Arms as they are named on a command line, null where the naming is wrong."""
    i = F.col("o_orderkey")
    spec = (
        F.when(i % 5 == 0, F.concat(F.lit("base="), F.col("o_custkey").cast("string"), F.lit(", tuned = x="), "o_orderstatus", F.lit(","))).when(i % 5 == 1, "a=1,a=2").when(i % 5 == 2, "a=,b=1").when(i % 5 == 3, "just a name")
        .otherwise(F.concat(F.lit("only="), i.cast("string")))
    )
    told = A.parsed_arms(spec)
    return table(spark, d, "orders").select(i, F.array_join(F.transform(F.map_entries(told), lambda e: F.concat_ws(">", e["key"], e["value"])), ";").alias("arms"))


@query("SELECT l_orderkey, l_linenumber, 's' || (l_suppkey % 5) AS grader FROM lineitem WHERE l_suppkey % 5 = l_partkey % 5")
def self_graded(spark: SparkSession, d: str) -> DataFrame:
    """Gradings whose grader wrote what it graded, which no comparison may use."""
    writer, grader = (F.concat(F.lit("s"), (F.col(c) % 5).cast("string")) for c in ("l_partkey", "l_suppkey"))
    return table(spark, d, "lineitem").where(writer == grader).select("l_orderkey", "l_linenumber", grader.alias("grader"))
