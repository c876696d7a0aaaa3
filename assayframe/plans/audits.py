"""Queries of a run's audits: what was lost and why, examples and lists of ids cut to a bound, agreement of repeats, and order effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayframe.functions import stats
from assayframe.operators import aggregates as A
from assayframe.operators import comparison as C
from assayframe.operators import similarity as S
from assayframe.plans.registry import query
from assayframe.plans.scores import DOD_SQL, GAPS_SQL, LF_SQL, _dimension_pairs, _four_cells, _with, mean_sql
from assayframe.plans.scores import PAIRS_SQL
from assayframe.plans.texts import LEXICAL
from assayframe.plans.verdicts import CAPABILITY_SQL, capability
from assayframe.session import cut
from assayframe.sources import adapters as V
from assayframe.sources.adapters import table, with_views

# Results, a row each: what became of it, and how many of its dimensions the grader failed on or found inapplicable.
RESULTS_SQL = """, res AS (SELECT arm, case_id, any_value(family_id) AS family_id, bool_or(technical) AS technical, bool_or(unscorable) AND NOT bool_or(technical) AS unscorable, max(answer_length) AS len,
   count(*) FILTER (score IS NULL AND flagged) AS failed, count(*) FILTER (score IS NULL AND NOT flagged) AS inapplicable, count(score) AS scored
   FROM scores_all WHERE judge_pass = 0 AND standard = 'original' GROUP BY arm, case_id)
"""
LONG_ANSWER = 90_000


def results(spark: SparkSession, d: str) -> DataFrame:
    null = F.col("score").isNull()
    return (
        V.scores_all(spark, d)
        .where("judge_pass = 0 and standard = 'original'")
        .groupBy("arm", "case_id")
        .agg(
            F.first("family_id").alias("family_id"), F.bool_or("technical").alias("technical"), (F.bool_or("unscorable") & ~F.bool_or("technical")).alias("unscorable"), F.max("answer_length").alias("len"),
            F.count_if(null & F.col("flagged")).alias("failed"), F.count_if(null & ~F.col("flagged")).alias("inapplicable"), F.count("score").alias("scored"),
        )
    )


_LOST = "technical OR unscorable"
_IDS = "SELECT arm, array_to_string(list(case_id ORDER BY case_id), ',') AS ids FROM (SELECT arm, case_id, row_number() OVER (PARTITION BY arm ORDER BY case_id) AS rn FROM res WHERE {what}) WHERE rn <= 8 GROUP BY arm"


@query(
    with_views(
        RESULTS_SQL
        + f""", u AS ({_IDS.format(what="unscorable")}), t AS ({_IDS.format(what="technical")}), l AS ({_IDS.format(what=f"len > {LONG_ANSWER}")})
SELECT res.arm, count(*) AS results, count(*) FILTER (NOT ({_LOST})) AS graded, count(*) FILTER (unscorable) AS unscorable_n, count(*) FILTER (technical) AS technical_n,
       count(*) FILTER (NOT ({_LOST}) AND scored = 0) AS no_scores, count(*) FILTER (len > {LONG_ANSWER}) AS truncated, count(*) FILTER (len > {LONG_ANSWER} AND ({_LOST})) AS truncated_and_lost,
       sum(failed)::BIGINT AS judging_failures, sum(inapplicable)::BIGINT AS inapplicable_dimensions, any_value(u.ids) AS unscorable_cases, any_value(t.ids) AS technical_cases, any_value(l.ids) AS truncated_cases
FROM res LEFT JOIN u ON u.arm = res.arm LEFT JOIN t ON t.arm = res.arm LEFT JOIN l ON l.arm = res.arm GROUP BY res.arm""",
        "scores_all",
    )
)
def integrity_details(spark: SparkSession, d: str) -> DataFrame:
    """What each arm lost, counted, with the first eight cases of each loss."""
    # Read once: the counts and the three lists go by it.
    r = cut(results(spark, d))
    lost, long = F.col("technical") | F.col("unscorable"), F.col("len") > LONG_ANSWER
    counts = r.groupBy("arm").agg(
        F.count("*").alias("results"), F.count_if(~lost).alias("graded"), F.count_if("unscorable").alias("unscorable_n"), F.count_if("technical").alias("technical_n"), F.count_if(~lost & (F.col("scored") == 0)).alias("no_scores"),
        F.count_if(long).alias("truncated"), F.count_if(long & lost).alias("truncated_and_lost"), F.sum("failed").alias("judging_failures"), F.sum("inapplicable").alias("inapplicable_dimensions"),
    )
    for name, what in (("unscorable_cases", F.col("unscorable")), ("technical_cases", F.col("technical")), ("truncated_cases", long)):
        ids = A.first_rows(r.where(what), ["arm"], ["case_id"], 8, name, F.col("case_id").cast("string"))
        counts = counts.join(F.broadcast(ids.withColumn(name, F.array_join(name, ","))), "arm", "left")
    return counts


_REASON = "CASE case_id % 7 WHEN 0 THEN 'empty answer' WHEN 1 THEN 'no answer was produced' WHEN 2 THEN 'no answer was produced' ELSE 'judge call failed ' || case_id % 7 END"


@query(
    with_views(
        RESULTS_SQL
        + f""", k AS (SELECT arm, {_REASON} AS reason, count(*) AS n, min(case_id) AS first_seen FROM res WHERE technical GROUP BY ALL)
SELECT arm, reason, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY n DESC, first_seen) AS rank FROM k) WHERE rank <= 5""",
        "scores_all",
    )
)
def top_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The five commonest reasons of technical failures of each arm, of equally common ones the first seen."""
    i = F.col("case_id") % 7
    reason = F.when(i == 0, "empty answer").when(i <= 2, "no answer was produced").otherwise(F.concat(F.lit("judge call failed "), i.cast("string")))
    rows = results(spark, d).where("technical").select("arm", reason.alias("reason"), "case_id")
    return A.top_by_count(rows, ["arm"], "reason", "case_id", 5)


@query(
    with_views(
        """, v AS (SELECT arm, measure, family_id % 3 AS variant, count(*) AS n FROM verdicts GROUP BY ALL), h AS (SELECT arm, measure, array_to_string(list(variant || ':' || n ORDER BY variant), ',') AS variants FROM v GROUP BY ALL),
w AS (SELECT arm, measure, seq, row_number() OVER (PARTITION BY arm, measure ORDER BY seq) AS rn FROM verdicts WHERE NOT correct), e AS (SELECT arm, measure, array_to_string(list(seq ORDER BY seq), ',') AS wrong FROM w WHERE rn <= 4 GROUP BY ALL)
SELECT h.arm, h.measure, h.variants, e.wrong FROM h LEFT JOIN e ON e.arm = h.arm AND e.measure = h.measure""",
        "verdicts",
    )
)
def behaviour_examples(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts by variant, and the first four wrong ones, of each arm and measure."""
    v = V.verdicts(spark, d)
    counts = v.groupBy("arm", "measure", (F.col("family_id") % 3).alias("variant")).agg(F.count("*").alias("n"))
    spread = counts.groupBy("arm", "measure").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("variant", "n"))), lambda s: F.concat_ws(":", s["variant"].cast("string"), s["n"].cast("string"))), ",").alias("variants"))
    wrong = A.first_rows(v.where("not correct"), ["arm", "measure"], ["seq"], 4, "wrong", F.col("seq").cast("string"))
    return spread.join(wrong.withColumn("wrong", F.array_join("wrong", ",")), ["arm", "measure"], "left")


_FLAGS = {"overapplied": "l_suppkey % 5 = 0", "unacceptable": "l_suppkey % 7 = 0", "missed": "l_suppkey % 3 = 0"}
_FLAGGED_SQL = f"""WITH f AS (SELECT l_returnflag AS arm, l_partkey AS case_id, any_value(p_brand) AS family_id, 'kind' || any_value(right(p_brand, 1)) AS kind, {", ".join(f"bool_or({c}) AS {n}" for n, c in _FLAGS.items())}, bool_or(l_linenumber = 1) AS with_rule
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
s AS (SELECT arm, 'all' AS scope, family_id, case_id, overapplied, unacceptable, missed, with_rule FROM f UNION ALL SELECT arm, kind, family_id, case_id, overapplied, unacceptable, missed, with_rule FROM f),
g AS (SELECT arm, scope, count(*) AS eligible_cases, count(DISTINCT family_id) AS eligible_families, count(*) FILTER (with_rule) AS with_rule_n, {", ".join(f"count(*) FILTER ({n}) AS {n}_cases, round(count(*) FILTER ({n}) / count(*)::DOUBLE, 6) AS {n}_rate" for n in _FLAGS)} FROM s GROUP BY ALL)
SELECT * FROM g UNION ALL SELECT DISTINCT arm, 'negative_control', 0, 0, 0, {", ".join("0, NULL" for _ in _FLAGS)} FROM f"""


@query(_FLAGGED_SQL)
def flag_families(spark: SparkSession, d: str) -> DataFrame:
    """Three families of rule breaks by arm over all cases and by kind, in one pass; the negative controls' scope is there even without cases."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    cases = rows.groupBy(F.col("l_returnflag").alias("arm"), F.col("l_partkey").alias("case_id")).agg(
        F.first("p_brand").alias("family_id"), F.concat(F.lit("kind"), F.substring(F.first("p_brand"), -1, 1)).alias("kind"), *(F.bool_or(F.expr(c)).alias(n) for n, c in _FLAGS.items()), F.bool_or(F.col("l_linenumber") == 1).alias("with_rule")
    )
    parts = [x for n in _FLAGS for x in (F.count_if(n).alias(f"{n}_cases"), A.rate(F.count_if(n), F.count("*")).alias(f"{n}_rate"))]
    sets = cases.groupingSets([["arm"], ["arm", "kind"]], "arm", "kind").agg(F.count("*").alias("eligible_cases"), F.countDistinct("family_id").alias("eligible_families"), F.count_if("with_rule").alias("with_rule_n"), *parts, F.grouping("kind").alias("_all"))
    found = sets.withColumn("scope", F.when(F.col("_all") == 1, "all").otherwise(F.col("kind"))).drop("_all", "kind")
    always = cases.select("arm").distinct().withColumn("scope", F.lit("negative_control"))
    counts = [c for c in found.columns if c not in ("arm", "scope") and not c.endswith("_rate")]
    return found.unionByName(always.join(found, ["arm", "scope"], "left_anti"), allowMissingColumns=True).fillna(0, counts)


@query(
    with_views(
        """, j AS (SELECT r.arm, CASE WHEN r.judge_pass = 1 THEN 'same judge' ELSE 'second judge' END AS scope, p.family_id, r.seq, p.did_change AS a, r.did_change AS b
  FROM (SELECT * FROM verdicts_all WHERE judge_pass = 0 AND did_change IS NOT NULL) p JOIN (SELECT * FROM verdicts_all WHERE judge_pass > 0 AND did_change IS NOT NULL) r ON p.arm = r.arm AND p.family_id = r.family_id AND p.measure = r.measure),
f AS (SELECT arm, scope, array_to_string(list(seq || ':' || a || ' -> ' || b ORDER BY seq), ',') AS flipped FROM (SELECT *, row_number() OVER (PARTITION BY arm, scope ORDER BY seq) AS rn FROM j WHERE a <> b) WHERE rn <= 6 GROUP BY ALL)
SELECT j.arm, j.scope, count(*) AS pairs, count(*) FILTER (a = b) AS agree, round(count(*) FILTER (a = b) / count(*)::DOUBLE, 6) AS rate, count(DISTINCT family_id) AS families, any_value(f.flipped) AS flipped
FROM j LEFT JOIN f ON f.arm = j.arm AND f.scope = j.scope GROUP BY j.arm, j.scope""",
        "verdicts_all",
    )
)
def verdict_flips(spark: SparkSession, d: str) -> DataFrame:
    """How repeats agree with the verdict of record, by the same and by a second judge, with the first six flips."""
    v = V.verdicts_all(spark, d).where("did_change is not null")
    first = v.where("judge_pass = 0").select("arm", "family_id", "measure", F.col("did_change").alias("a"))
    scope = F.when(F.col("judge_pass") == 1, "same judge").otherwise("second judge").alias("scope")
    both = v.where("judge_pass > 0").join(first, ["arm", "family_id", "measure"]).select("arm", scope, "family_id", "seq", "a", F.col("did_change").alias("b"))
    same = F.col("a") == F.col("b")
    counts = both.groupBy("arm", "scope").agg(F.count("*").alias("pairs"), F.count_if(same).alias("agree"), A.rate(F.count_if(same), F.count("*")).alias("rate"), F.countDistinct("family_id").alias("families"))
    told = F.concat(F.col("seq").cast("string"), F.lit(":"), F.col("a").cast("string"), F.lit(" -> "), F.col("b").cast("string"))
    flips = A.first_rows(both.where(~same), ["arm", "scope"], ["seq"], 6, "flipped", told)
    return counts.join(F.broadcast(flips.withColumn("flipped", F.array_join("flipped", ","))), ["arm", "scope"], "left")


_AUTHOR_SQL = DOD_SQL.format(**GAPS_SQL, row="(s.standard = 'rival')::INT", source="(SELECT * FROM graded WHERE score IS NOT NULL)")


@query(
    with_views(f", {LF_SQL}, x AS ({_AUTHOR_SQL.strip()})", "graded")
    + """SELECT arm, grp, n, gap_first AS gap_original, gap_second AS gap_rival, 0 - difference AS shrinkage, narrower AS narrower_under_rival, wider AS wider_under_rival, n - narrower - wider AS level,
  round(CASE WHEN narrower + wider > 0 THEN least(1, 2 * (SELECT sum(exp(a.v - b.v - c.v - (narrower + wider) * ln(2))) FROM range(0, 100000) r(i), lf a, lf b, lf c
        WHERE r.i <= least(narrower, wider) AND a.i = narrower + wider AND b.i = r.i AND c.i = narrower + wider - r.i)) END, 6) AS p, n < 20 AS small FROM x"""
)
def author_shrinkage(spark: SparkSession, d: str) -> DataFrame:
    """How much of an arm's gap is lost under the rival standard, with a sign test over the cases."""
    cells = _four_cells(V.graded(spark, d), F.col("standard") == "rival")
    p = stats.sign_test_p(F.col("narrower"), F.col("wider"))
    return cells.select(
        "arm", "grp", "n", F.col("gap_first").alias("gap_original"), F.col("gap_second").alias("gap_rival"), (0 - F.col("difference")).alias("shrinkage"), F.col("narrower").alias("narrower_under_rival"),
        F.col("wider").alias("wider_under_rival"), (F.col("n") - F.col("narrower") - F.col("wider")).alias("level"), F.round(p, 6).alias("p"), (F.col("n") < C.SMALL_N).alias("small"),
    )


@query(
    with_views(
        """, s AS (SELECT arm, family_id % 5 AS kind, count(correct) AS decided, count(*) FILTER (correct) AS correct_n, count(*) - count(correct) AS undecided, count(DISTINCT family_id) AS families FROM verdicts GROUP BY ALL)
SELECT *, round(correct_n / nullif(decided, 0)::DOUBLE, 6) AS rate FROM s""",
        "verdicts",
    )
)
def family_kind_verdicts(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("correct")
    out = V.verdicts(spark, d).groupBy("arm", (F.col("family_id") % 5).alias("kind")).agg(F.count(ok).alias("decided"), F.count_if(ok).alias("correct_n"), F.count_if(ok.isNull()).alias("undecided"), F.countDistinct("family_id").alias("families"))
    return out.withColumn("rate", A.rate(F.col("correct_n"), F.nullif("decided", F.lit(0))))


@query(f"""WITH c AS ({CAPABILITY_SQL}), f AS (SELECT arm, family, array_to_string(list(check_id ORDER BY check_id), ',') AS failures FROM (SELECT *, row_number() OVER (PARTITION BY arm, family ORDER BY check_id) AS rn FROM c WHERE NOT passed AND NOT technical) WHERE rn <= 6 GROUP BY ALL)
SELECT c.arm, c.family, count(*) FILTER (technical) AS unknown_n, any_value(f.failures) AS failures FROM c LEFT JOIN f ON f.arm = c.arm AND f.family = c.family GROUP BY c.arm, c.family""")
def capability_failures(spark: SparkSession, d: str) -> DataFrame:
    """The first six failed checks of each arm and family, and how many checks say nothing."""
    rows = capability(spark, d)
    failed = A.first_rows(rows.where("not passed and not technical"), ["arm", "family"], ["check_id"], 6, "failures", F.col("check_id").cast("string"))
    return rows.groupBy("arm", "family").agg(F.count_if("technical").alias("unknown_n")).join(failed.withColumn("failures", F.array_join("failures", ",")), ["arm", "family"], "left")


@query(f"WITH {LEXICAL} SELECT array_to_string(list(case_id ORDER BY z DESC, case_id), ',') AS flagged FROM (SELECT case_id, round(similarity, 6) AS z FROM r WHERE similarity >= 0.45 ORDER BY z DESC, case_id LIMIT 8)")
def flagged_ids(spark: SparkSession, d: str) -> DataFrame:
    """The eight cases most like the corpus, of those over the threshold."""
    found = S.best_jaccard(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id").where(F.col("similarity") >= S.LEXICAL_THRESHOLD)
    z = F.round("similarity", 6)
    top = found.select((-z).alias("z"), "case_id").orderBy("z", "case_id").limit(8)
    return top.agg(F.sort_array(F.collect_list(F.struct("z", "case_id"))).alias("t")).select(F.nullif(F.array_join(F.transform("t", lambda s: s["case_id"].cast("string")), ","), F.lit("")).alias("flagged"))


# Three shapes of a result's checks: a value each, an object each, or a list.
_PAYLOAD_SQL = """WITH p AS (SELECT event_type AS arm, user_id AS family_id, event_id % 3 AS shape, value > 20 AS ok, event_id % 11 = 0 AS bad FROM events),
l AS (SELECT arm, family_id, 'length' AS "check", ok AS passed, false AS error FROM p WHERE shape = 0 UNION ALL SELECT arm, family_id, 'length', CASE WHEN NOT bad THEN ok END, bad FROM p WHERE shape = 1
  UNION ALL SELECT arm, family_id, 'length', CASE WHEN NOT bad THEN ok END, bad FROM p WHERE shape = 2 UNION ALL SELECT arm, family_id, 'length#2', NOT ok, false FROM p WHERE shape = 2)
SELECT arm, "check", count(*) FILTER (NOT error) AS n, count(*) FILTER (passed AND NOT error) AS passed_n, round(count(*) FILTER (passed AND NOT error) / nullif(count(*) FILTER (NOT error), 0)::DOUBLE, 6) AS rate, count(*) FILTER (error) AS errors, count(DISTINCT family_id) AS families FROM l GROUP BY ALL"""


@query(_PAYLOAD_SQL)
def check_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Checks recorded in three shapes, as one table; checks that could not run are no failures."""
    ok, bad = F.col("value") > 20, F.col("event_id") % 11 == 0
    entry = F.concat(F.lit('{"kind":"length","passed":'), F.when(bad, "null").otherwise(ok.cast("string")), F.lit(',"error":'), bad.cast("string"), F.lit("}"))
    payload = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"length":'), ok.cast("string"), F.lit("}")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"length":'), entry, F.lit("}")))
        .otherwise(F.concat(F.lit('{"checks":['), entry, F.lit(',{"check":"length#2","passed":'), (~ok).cast("string"), F.lit("}]}")))
    )
    rows = table(spark, d, "events").select(F.col("event_type").alias("arm"), F.col("user_id").alias("family_id"), payload.alias("deterministic"))
    return A.check_stats(A.check_rows(rows, "deterministic", ["arm", "family_id"]), ["arm"])


_ZERO_SQL = """, dims AS (SELECT arm, dimension, count(*) AS zc FROM primary_scores WHERE score = 0 GROUP BY ALL),
z AS (SELECT p.arm, p.case_id, any_value(family_id) AS family_id, array_to_string(list(p.dimension ORDER BY p.dimension), ',') AS zero_dimensions, count(*) AS zeros, arg_max(p.dimension, (zc, p.dimension)) AS lead_dimension, max(zc) AS lead_count
      FROM primary_scores p JOIN dims USING (arm, dimension) WHERE score = 0 GROUP BY p.arm, p.case_id),
s AS (SELECT arm, family_id, count(*) - 1 AS other_zeros FROM z GROUP BY ALL), o AS (SELECT case_id, list_sort(list(DISTINCT arm)) AS arms FROM z GROUP BY case_id),
e AS (SELECT z.*, s.other_zeros, array_to_string(list_filter(o.arms, lambda a: a <> z.arm), ',') AS also_failed_by FROM z JOIN s ON s.arm = z.arm AND s.family_id = z.family_id JOIN o ON o.case_id = z.case_id),
r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY lead_count DESC, lead_dimension, zeros DESC, other_zeros DESC, case_id) > 12 // (SELECT count(DISTINCT arm) FROM primary_scores) AS late FROM e),
k AS (SELECT * FROM r ORDER BY late, lead_count DESC, lead_dimension, zeros DESC, other_zeros DESC, arm, case_id LIMIT 12)
SELECT arm, case_id, zero_dimensions, lead_dimension, other_zeros, also_failed_by, row_number() OVER (ORDER BY lead_count DESC, lead_dimension, zeros DESC, other_zeros DESC, arm, case_id) AS rank, (SELECT count(*) FROM e) - (SELECT count(*) FROM k) AS omitted FROM k"""


@query(with_views(_ZERO_SQL, "primary_scores"))
def worst_cases(spark: SparkSession, d: str) -> DataFrame:
    """Results with zeros, the commonest pattern first, each arm having its share of the places; how many of the family and which arms fail too."""
    p = V.primary_scores(spark, d)
    rows = cut(p.where("score = 0").select("arm", "case_id", "family_id", "dimension"))
    counts = rows.groupBy("arm", "dimension").agg(F.count("*").alias("zc"))  # as many as arms times dimensions
    lead = F.max(F.struct("zc", "dimension"))
    z = cut(rows.join(F.broadcast(counts), ["arm", "dimension"]).groupBy("arm", "case_id").agg(F.first("family_id").alias("family_id"), F.sort_array(F.collect_list("dimension")).alias("dims"), F.count("*").alias("zeros"), lead.alias("lead")))
    siblings = z.groupBy("arm", "family_id").agg((F.count("*") - 1).alias("other_zeros"))
    arms = z.groupBy("case_id").agg(F.sort_array(F.collect_set("arm")).alias("arms"))
    e = z.join(siblings, ["arm", "family_id"]).join(arms, "case_id").select(
        "arm", "case_id", F.array_join("dims", ",").alias("zero_dimensions"), "zeros", F.col("lead.dimension").alias("lead_dimension"), F.col("lead.zc").alias("lead_count"), "other_zeros", F.array_join(F.array_remove("arms", F.col("arm")), ",").alias("also_failed_by")
    )
    order = [F.desc("lead_count"), F.col("lead_dimension"), F.desc("zeros"), F.desc("other_zeros"), F.col("arm"), F.col("case_id")]
    best, n = A.quota_top_k(cut(e), "arm", order, 12), z.count()
    return best.select("arm", "case_id", "zero_dimensions", "lead_dimension", "other_zeros", "also_failed_by", "rank", F.lit(n - min(n, 12)).cast("long").alias("omitted"))


MEASURE_RANK = {"resistance": 0, "invariance": 1, "self_consistency": 2}


@query(
    with_views(
        f"""SELECT arm, measure, row_number() OVER (PARTITION BY arm ORDER BY CASE measure {" ".join(f"WHEN '{m}' THEN {i}" for m, i in MEASURE_RANK.items())} ELSE 999 END, measure) AS position, n FROM (SELECT arm, measure, count(*) AS n FROM verdicts GROUP BY ALL)""",
        "verdicts",
    )
)
def vocabulary_order(spark: SparkSession, d: str) -> DataFrame:
    """Measures in the order of a vocabulary, unknown ones last by name."""
    counts = V.verdicts(spark, d).groupBy("arm", "measure").agg(F.count("*").alias("n"))
    return counts.withColumn("position", F.row_number().over(Window.partitionBy("arm").orderBy(*A.ordinal("measure", list(MEASURE_RANK)))))


_ORDERS = ("original_first", "variant_first")


@query(
    with_views(
        """, c AS (SELECT coalesce(arm, 'all') AS arm, count(correct) FILTER (order_presented = 'original_first') AS n1, count(*) FILTER (correct AND order_presented = 'original_first') AS c1, count(correct) FILTER (order_presented = 'variant_first') AS n2,
 count(*) FILTER (correct AND order_presented = 'variant_first') AS c2, count(did_change) FILTER (order_presented = 'original_first') AS m1, count(*) FILTER (did_change AND order_presented = 'original_first') AS d1,
 count(did_change) FILTER (order_presented = 'variant_first') AS m2, count(*) FILTER (did_change AND order_presented = 'variant_first') AS d2 FROM verdicts GROUP BY GROUPING SETS ((arm), ()))
SELECT arm, n1 + n2 AS decided, round(c1 / n1::DOUBLE - c2 / n2::DOUBLE, 6) AS correct_gap, round(d1 / m1::DOUBLE - d2 / m2::DOUBLE, 6) AS change_gap, greatest(n1, n2) - least(n1, n2) <= greatest(2, 0.25 * greatest(n1, n2)) AS balanced FROM c""",
        "verdicts",
    )
)
def position_balance(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between the orders of presentation, and whether these are balanced: apart by at most two or a quarter."""
    cells = []
    for i, o in enumerate(_ORDERS, 1):
        here = F.col("order_presented") == o
        cells += [F.count(F.when(here, F.col("correct"))).alias(f"n{i}"), F.count_if(here & F.col("correct")).alias(f"c{i}"), F.count(F.when(here, F.col("did_change"))).alias(f"m{i}"), F.count_if(here & F.col("did_change")).alias(f"d{i}")]
    c = V.verdicts(spark, d).groupingSets([["arm"], []], "arm").agg(*cells)
    gap = lambda a, b: F.round(F.try_divide(F.col(f"{a}1").cast("double"), F.col(f"{b}1")) - F.try_divide(F.col(f"{a}2").cast("double"), F.col(f"{b}2")), 6)
    most = F.greatest("n1", "n2")
    return c.select(F.coalesce("arm", F.lit("all")).alias("arm"), (F.col("n1") + F.col("n2")).alias("decided"), gap("c", "n").alias("correct_gap"), gap("d", "m").alias("change_gap"), (most - F.least("n1", "n2") <= F.greatest(F.lit(2.0), 0.25 * most)).alias("balanced"))


@query(with_views("SELECT arm, measure, order_presented, count(*) AS n FROM verdicts GROUP BY ALL", "verdicts"))
def order_by_measure(spark: SparkSession, d: str) -> DataFrame:
    return V.verdicts(spark, d).groupBy("arm", "measure", "order_presented").agg(F.count("*").alias("n"))


@query(
    with_views(
        """SELECT p.arm, p.dimension, count(*) AS pairs, count(*) FILTER (p.flagged = r.flagged) AS same_flags, round(count(*) FILTER (p.flagged = r.flagged) / count(*)::DOUBLE, 6) AS rate
FROM (SELECT * FROM scores_all WHERE judge_pass = 0) p JOIN (SELECT * FROM scores_all WHERE judge_pass = 1) r ON p.arm = r.arm AND p.case_id = r.case_id AND p.dimension = r.dimension AND p.standard = r.standard GROUP BY ALL""",
        "scores_all",
    )
)
def flag_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = V.scores_all(spark, d).where("judge_pass <= 1")
    both = rows.groupBy("arm", "case_id", "dimension", "standard").agg(*(F.bool_or(F.when(F.col("judge_pass") == k, F.col("flagged"))).alias(f"f{k}") for k in (0, 1))).where("f1 is not null")
    same = F.count_if(F.col("f0") == F.col("f1"))
    return both.groupBy("arm", "dimension").agg(F.count("*").alias("pairs"), same.alias("same_flags"), A.rate(same, F.count("*")).alias("rate"))


_CLAUSES = ("too short: 3 words", "too long, by half", "lost a fact", "too short, barely")


@query(f"SELECT trim(split_part(split_part([{', '.join(repr(c) for c in _CLAUSES)}][(event_id % 4) + 1], ':', 1), ',', 1)) AS reason, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1")
def premium_rejections(spark: SparkSession, d: str) -> DataFrame:
    """Rejected recasts by the first clause of the reason."""
    told = F.get(F.array(*map(F.lit, _CLAUSES)), (F.col("event_id") % 4).cast("int"))
    clause = F.trim(F.split_part(F.split_part(told, F.lit(":"), F.lit(1)), F.lit(","), F.lit(1)))
    return table(spark, d, "events").where("event_id % 3 = 0").groupBy(clause.alias("reason")).agg(F.count("*").alias("n"))


@query(
    _with(PAIRS_SQL, "dimension, kind", "primary_scores").replace("\nSELECT arm, dimension, kind, n,", "\n, ch AS (SELECT arm, dimension, kind, n,")
    + ") SELECT arm, arg_min(dimension || '/' || kind, (delta, dimension, kind)) AS worst_slice, min(delta) AS worst_delta FROM ch WHERE n >= 5 GROUP BY arm"
)
def worst_slice(spark: SparkSession, d: str) -> DataFrame:
    """The slice of each arm that lost most against the baseline, of those with five units."""
    slices = C.change(_dimension_pairs(spark, d), ["dimension", "kind"]).where("n >= 5")
    worst = F.min(F.struct("delta", "dimension", "kind"))
    return slices.groupBy("arm").agg(worst.alias("w")).select("arm", F.concat(F.col("w.dimension").cast("string"), F.lit("/"), F.col("w.kind")).alias("worst_slice"), F.col("w.delta").alias("worst_delta"))


@query("""WITH s AS (SELECT lower(trim(coalesce(nullif(CASE o_orderkey % 6 WHEN 0 THEN ' Original' WHEN 1 THEN '' WHEN 2 THEN 'RIVAL ' WHEN 3 THEN NULL WHEN 4 THEN 'third' ELSE 'draft' END, ''), 'original'))) AS standard FROM orders),
c AS (SELECT standard, CASE WHEN standard IN ('original', 'rival') THEN standard ELSE 'excluded' END AS used, count(*) AS n FROM s GROUP BY ALL)
SELECT used, sum(n)::BIGINT AS n, CASE WHEN used = 'excluded' THEN array_to_string(list(standard || ' x' || n ORDER BY n DESC, standard)[:4], ', ') END AS note FROM c GROUP BY used""")
def standards_used(spark: SparkSession, d: str) -> DataFrame:
    """Results by standard: originals, rivals, and what names another, which no table uses and a note tells of."""
    said = F.array(F.lit(" Original"), F.lit(""), F.lit("RIVAL "), F.lit(None).cast("string"), F.lit("third"), F.lit("draft"))
    standard = F.lower(F.trim(F.coalesce(F.nullif(F.get(said, (F.col("o_orderkey") % 6).cast("int")), F.lit("")), F.lit("original"))))
    counts = table(spark, d, "orders").groupBy(standard.alias("standard")).agg(F.count("*").alias("n"))
    used = F.when(F.col("standard").isin("original", "rival"), F.col("standard")).otherwise("excluded")
    names = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "standard"))), 1, 4)
    told = F.array_join(F.transform(names, lambda s: F.concat(s["standard"], F.lit(" x"), (-s["k"]).cast("string"))), ", ")
    return counts.withColumn("used", used).groupBy("used").agg(F.sum("n").alias("n"), told.alias("note")).withColumn("note", F.when(F.col("used") == "excluded", F.col("note")))


_KEYS = ("temperature", "max_tokens", "top_p", "seed", "system_prompt")
_SETTINGS_SQL = """a AS (SELECT event_type AS arm, min(event_id) AS first, 0.7 AS temperature, 1000 + (min(event_id) % 2) * 24 AS max_tokens, 0.95 AS top_p, CASE WHEN min(event_id) % 3 > 0 THEN 13 END AS seed, CASE WHEN min(event_id) % 4 = 0 THEN 'be brief' END AS system_prompt FROM events GROUP BY 1),
f AS (SELECT * FROM a ORDER BY first LIMIT 1)"""


@query(f"WITH {_SETTINGS_SQL} " + " UNION ALL ".join(f"SELECT a.arm, '{k}' AS setting, a.{k}::VARCHAR AS value, f.{k}::VARCHAR AS first_value FROM a, f WHERE a.{k} IS DISTINCT FROM f.{k}" for k in _KEYS))
def settings_differences(spark: SparkSession, d: str) -> DataFrame:
    """Settings in which an arm differs from the first, of the five that comparisons rest on; there are as many rows as arms."""
    least = F.min("event_id")
    arms = table(spark, d, "events").groupBy(F.col("event_type").alias("arm")).agg(least.alias("first"))
    i = F.col("first")
    values = {"temperature": F.lit("0.7"), "max_tokens": (1000 + (i % 2) * 24).cast("string"), "top_p": F.lit("0.95"), "seed": F.when(i % 3 > 0, "13"), "system_prompt": F.when(i % 4 == 0, "be brief")}
    w = Window.orderBy("first")
    rows = arms.select("arm", "first", *(v.alias(k) for k, v in values.items()))
    told = F.array(*(F.struct(F.lit(k).alias("setting"), F.col(k).alias("value"), F.first(k).over(w).alias("first_value")) for k in _KEYS))
    return rows.select("arm", told.alias("t")).select("arm", F.inline("t")).where(~F.col("value").eqNullSafe(F.col("first_value")))


@query("""WITH s AS (SELECT event_type AS arm, event_id % 4 AS repeat_index, substr(sha256('{"temperature":' || CASE WHEN event_id % 4 = 0 THEN user_id % 2 ELSE 9 END || '}'), 1, 12) AS h FROM events)
SELECT arm, count(DISTINCT h) AS settings, count(*) AS answers, count(DISTINCT h) > 1 AS disagree FROM s WHERE repeat_index = 0 GROUP BY arm""")
def settings_disagreement(spark: SparkSession, d: str) -> DataFrame:
    """Distinct settings within each arm; repeats that probe for consistency, which run with others, don't count."""
    from assayframe.functions.hashing import record_hash

    probe = F.col("event_id") % 4
    h = record_hash(temperature=F.when(probe == 0, F.col("user_id") % 2).otherwise(9))
    rows = table(spark, d, "events").select(F.col("event_type").alias("arm"), probe.alias("repeat_index"), h.alias("h"))
    return rows.where("repeat_index = 0").groupBy("arm").agg(F.countDistinct("h").alias("settings"), F.count("*").alias("answers"), (F.countDistinct("h") > 1).alias("disagree"))


@query("""WITH l AS (SELECT p_partkey AS case_id, 'v' || p_size % 5 AS original_version, 'v' || (p_size * 7) % 6 AS rival_version FROM part),
k AS (SELECT case_id, original_version AS version, 'original' AS label FROM l UNION ALL SELECT case_id, rival_version, 'rival' FROM l WHERE rival_version <> original_version)
SELECT l_orderkey, l_linenumber, min(coalesce(k.label, 'unknown')) AS label, count(*) AS n FROM lineitem LEFT JOIN k ON k.case_id = l_partkey AND k.version = 'v' || l_suppkey % 6 GROUP BY ALL""")
def standard_labels(spark: SparkSession, d: str) -> DataFrame:
    """The standard that a rubric's version tells, never guessed: a version that both standards share is the original's, one that neither has is unknown."""
    part = table(spark, d, "part")
    original, rival = F.concat(F.lit("v"), (F.col("p_size") % 5).cast("string")), F.concat(F.lit("v"), (F.col("p_size") * 7 % 6).cast("string"))
    # 'original' < 'rival': the least of a version's labels is the original's.
    labels = part.select(F.col("p_partkey").alias("case_id"), F.inline(F.array(F.struct(original.alias("version"), F.lit("original").alias("label")), F.struct(rival.alias("version"), F.lit("rival").alias("label")))))
    labels = labels.groupBy("case_id", "version").agg(F.min("label").alias("label"))
    graded = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("case_id"), F.concat(F.lit("v"), (F.col("l_suppkey") % 6).cast("string")).alias("version"))
    return graded.join(labels, ["case_id", "version"], "left").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.coalesce("label", F.lit("unknown"))).alias("label"), F.count("*").alias("n"))


@query(
    with_views(
        f""", b AS (SELECT case_id, dimension, grp, score FROM primary_scores WHERE arm = 'N'), r AS (SELECT case_id, dimension, grp, score, CASE WHEN (case_id + dimension) % 3 = 0 THEN (case_id % 3)::INT END AS own FROM primary_scores WHERE arm = 'R'),
j AS (SELECT r.dimension, r.score AS after, coalesce(r.own, b.score) AS before, CASE WHEN r.own IS NOT NULL THEN 'in the row' ELSE 'source' END AS baseline FROM r LEFT JOIN b USING (case_id, dimension))
SELECT dimension, baseline, count(*) AS n, round({mean_sql("after - before")}, 6) AS premium FROM j WHERE before IS NOT NULL GROUP BY ALL""",
        "primary_scores",
    )
)
def recast_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Recasts against the score recorded in the row where there is one, else against the source's, with where it came from."""
    p = V.primary_scores(spark, d)
    own = F.when((F.col("case_id") + F.col("dimension")) % 3 == 0, (F.col("case_id") % 3).cast("int"))
    source = p.where("arm = 'N'").select("case_id", "dimension", F.col("score").alias("source"))
    rows = p.where("arm = 'R'").withColumn("own", own).join(source, ["case_id", "dimension"], "left").withColumn("before", F.coalesce("own", "source")).where("before is not null")
    where = F.when(F.col("own").isNotNull(), "in the row").otherwise("source")
    return rows.groupBy("dimension", where.alias("baseline")).agg(F.count("*").alias("n"), F.round(stats.exact_mean(F.col("score") - F.col("before")), 6).alias("premium"))

