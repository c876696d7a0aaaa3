"""Queries of controls and reviews: form premium, near-duplicate screens, reviews, disagreements and grading failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayframe.functions import text as X
from assayframe.operators import arms as M
from assayframe.operators import similarity as S
from assayframe.plans.registry import query
from assayframe.plans.texts import TOKENS
from assayframe.sources import adapters as V
from assayframe.sources.adapters import table, with_views

# A recast of an answer is its rival grading here; it is usable if it keeps half to twice the length, and moved if a score's side changes.
RECAST_SQL = """, p AS (SELECT case_id, dimension, grp, family_id, score, answer_length AS len FROM primary_scores WHERE arm = 'N'),
r AS (SELECT case_id, dimension, score, answer_length AS len FROM graded WHERE arm = 'N' AND standard = 'rival' AND score IS NOT NULL),
j AS (SELECT p.case_id, p.dimension, p.grp, p.family_id, p.score AS before, r.score AS after, r.len / p.len BETWEEN 0.5 AND 2 AS usable FROM p JOIN r USING (case_id, dimension))
"""


def recasts(spark: SparkSession, d: str) -> DataFrame:
    g = V.graded(spark, d).where("arm = 'N' and score is not null")
    p = g.where("standard = 'original'").select("case_id", "dimension", "grp", "family_id", F.col("score").alias("before"), F.col("answer_length").alias("l0"))
    r = g.where("standard = 'rival'").select("case_id", "dimension", F.col("score").alias("after"), F.col("answer_length").alias("l1"))
    return p.join(r, ["case_id", "dimension"]).withColumn("usable", (F.col("l1") / F.col("l0")).between(0.5, 2))


@query(
    with_views(
        RECAST_SQL
        + """SELECT grp, count(*) AS attempted, count(*) FILTER (usable) AS usable_n, count(DISTINCT case_id) FILTER (usable) AS cases, round(avg((after - before)::DOUBLE) FILTER (usable), 6) AS premium,
count(*) FILTER (usable AND (before > 0) <> (after > 0)) AS moved, count(DISTINCT case_id) FILTER (usable) >= 8 AND count(*) FILTER (usable) * 2 >= count(*) AS trustworthy FROM j GROUP BY grp""",
        "primary_scores",
    )
)
def form_premium(spark: SparkSession, d: str) -> DataFrame:
    """What a change of form alone does to scores; trusted from eight cases on if half of the recasts survive."""
    ok, gap = F.col("usable"), (F.col("after") - F.col("before")).cast("double")
    cases = F.countDistinct(F.when(ok, F.col("case_id")))
    return recasts(spark, d).groupBy("grp").agg(
        F.count("*").alias("attempted"), F.count_if(ok).alias("usable_n"), cases.alias("cases"), F.round(F.avg(F.when(ok, gap)), 6).alias("premium"),
        F.count_if(ok & ((F.col("before") > 0) != (F.col("after") > 0))).alias("moved"), ((cases >= 8) & (F.count_if(ok) * 2 >= F.count("*"))).alias("trustworthy"),
    )


@query(with_views(RECAST_SQL + "SELECT dimension, count(*) FILTER (usable) AS n, round(avg((after - before)::DOUBLE) FILTER (usable), 6) AS premium, count(*) FILTER (NOT usable) AS rejected FROM j GROUP BY dimension", "primary_scores"))
def form_premium_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    gap = F.when(F.col("usable"), (F.col("after") - F.col("before")).cast("double"))
    return recasts(spark, d).groupBy("dimension").agg(F.count_if("usable").alias("n"), F.round(F.avg(gap), 6).alias("premium"), F.count_if(~F.col("usable")).alias("rejected"))


@query(
    with_views(
        """, j AS (SELECT p.arm, p.case_id, p.dimension, p.standard, abs(p.score - r.score) AS gap FROM (SELECT * FROM scores_all WHERE judge_pass = 0) p JOIN (SELECT * FROM scores_all WHERE judge_pass = 1) r
   ON p.arm = r.arm AND p.case_id = r.case_id AND p.dimension = r.dimension AND p.standard = r.standard WHERE p.score <> r.score)
SELECT arm, case_id, dimension, standard, gap FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY gap DESC, case_id, dimension, standard) AS rn FROM j) WHERE rn <= 8""",
        "scores_all",
    )
)
def top_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """The eight widest of each arm; the ranking is cut to eight before the shuffle."""
    rows = V.scores_all(spark, d).where("judge_pass <= 1")
    both = rows.groupBy("arm", "case_id", "dimension", "standard").agg(*(F.max(F.when(F.col("judge_pass") == k, F.col("score"))).alias(f"s{k}") for k in (0, 1)))
    apart = both.where("s0 <> s1").withColumn("gap", F.abs(F.col("s0") - F.col("s1")))
    w = Window.partitionBy("arm").orderBy(F.desc("gap"), "case_id", "dimension", "standard")
    return apart.withColumn("rn", F.row_number().over(w)).where("rn <= 8").select("arm", "case_id", "dimension", "standard", "gap")


@query(
    with_views(
        """SELECT arm, CASE WHEN technical THEN 'technical' WHEN unscorable THEN 'unscorable' WHEN score IS NULL AND flagged THEN 'judging_failure' WHEN score IS NULL THEN 'inapplicable' ELSE 'scored' END AS reason, count(*) AS n, count(DISTINCT case_id) AS cases
FROM scores_all WHERE judge_pass = 0 GROUP BY ALL""",
        "scores_all",
    )
)
def grading_failures(spark: SparkSession, d: str) -> DataFrame:
    null = F.col("score").isNull()
    reason = F.when(F.col("technical"), "technical").when(F.col("unscorable"), "unscorable").when(null & F.col("flagged"), "judging_failure").when(null, "inapplicable").otherwise("scored")
    return V.scores_all(spark, d).where("judge_pass = 0").groupBy("arm", reason.alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))


@query("SELECT right(p_brand, 1) AS kind, count(DISTINCT p_brand) AS families, count(DISTINCT p_brand) FILTER (l_partkey IS NOT NULL) AS families_with_cases, count(DISTINCT l_partkey) AS cases FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1")
def kind_rollup(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).distinct()
    rows = table(spark, d, "part").join(used, F.col("p_partkey") == F.col("k"), "left")
    return rows.groupBy(F.substring("p_brand", -1, 1).alias("kind")).agg(
        F.countDistinct("p_brand").alias("families"), F.countDistinct(F.when(F.col("k").isNotNull(), F.col("p_brand"))).alias("families_with_cases"), F.countDistinct("k").alias("cases")
    )


@query("""WITH r AS (SELECT doc_id, unnest(CASE WHEN toxic = 1 AND quality = 0 THEN ['toxic', 'poor'] WHEN toxic = 1 THEN ['toxic'] WHEN quality = 0 THEN ['poor'] ELSE []::VARCHAR[] END) AS defect, toxic FROM labels)
SELECT defect, count(*) AS n, count(*) FILTER (toxic = 0) AS kept_with_concerns FROM r GROUP BY defect""")
def review_report(spark: SparkSession, d: str) -> DataFrame:
    """Defects found by reviews, and how many of them a kept case has; toxic ones block."""
    defects = F.filter(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "poor")), lambda x: x.isNotNull())
    rows = table(spark, d, "labels").select("toxic", F.explode(defects).alias("defect"))
    return rows.groupBy("defect").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 0).alias("kept_with_concerns"))


@query(f"""WITH t AS (SELECT item_id, {TOKENS} AS t FROM benchmark), x AS (SELECT item_id, len(t) AS n, unnest(t) AS token FROM t),
s AS (SELECT a.item_id AS item_id, b.item_id AS earlier, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS s FROM x a JOIN x b ON a.token = b.token AND b.item_id < a.item_id GROUP BY ALL)
SELECT item_id, earlier, round(s, 6) AS similarity FROM s WHERE s > 0.4""")
def situation_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Situations too like an earlier one."""
    found = S.similar_pairs(table(spark, d, "benchmark"), "item_id", "text", 0.4)
    return found.select(F.col("later").alias("item_id"), "earlier", F.round("similarity", 6).alias("similarity"))


_NEAR = 0.2


@query(f"""WITH RECURSIVE t AS (SELECT item_id, {TOKENS} AS t FROM benchmark), x AS (SELECT item_id, len(t) AS n, unnest(t) AS token FROM t),
s AS (SELECT a.item_id AS item_id, b.item_id AS earlier, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS s FROM x a JOIN x b ON a.token = b.token AND b.item_id < a.item_id GROUP BY ALL),
p AS (SELECT item_id, list(earlier) AS near, row_number() OVER (ORDER BY item_id) AS rn FROM s WHERE s > {_NEAR} GROUP BY item_id),
g(rn, refused) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT p.rn, CASE WHEN len(list_filter(p.near, lambda e: NOT list_contains(g.refused, e))) > 0 THEN list_append(g.refused, p.item_id) ELSE g.refused END FROM g JOIN p ON p.rn = g.rn + 1)
SELECT unnest(refused) AS item_id FROM (SELECT refused FROM g ORDER BY rn DESC LIMIT 1)""")
def refused_situations(spark: SparkSession, d: str) -> DataFrame:
    """Situations refused in their order, each too like an earlier one that was accepted."""
    return S.refused(S.similar_pairs(table(spark, d, "benchmark"), "item_id", "text", _NEAR)).select(F.col("later").alias("item_id"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s FROM lineitem GROUP BY ALL), g AS (SELECT l_orderkey AS group_id, l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 'a' || l_linenumber ELSE 'b' || l_linenumber END AS label FROM w),
p AS (SELECT l_orderkey AS group_id, l_linenumber AS pos, 'a' || l_linenumber AS label, s AS payload FROM w),
m AS (SELECT g.*, p.payload FROM g JOIN p ON g.group_id = p.group_id AND g.label = p.label),
l AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY pos) AS k FROM g ANTI JOIN m USING (group_id, label)), q AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY pos) AS k FROM p ANTI JOIN m USING (group_id, label))
SELECT group_id, label, payload, 'label' AS matched_by FROM m UNION ALL SELECT l.group_id, l.label, q.payload, 'position' FROM l LEFT JOIN q ON l.group_id = q.group_id AND l.k = q.k""")
def aligned_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads matched to what was asked for by label, and those left over by position; groups are single orders."""
    w = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("pos")).agg(F.min("l_suppkey").alias("payload"))
    wanted = w.select("group_id", "pos", F.concat(F.when(F.col("pos") % 2 == 0, "a").otherwise("b"), F.col("pos").cast("string")).alias("label"))
    given = w.select("group_id", "pos", F.concat(F.lit("a"), F.col("pos").cast("string")).alias("label"), "payload")
    return M.aligned(wanted, given).select("group_id", "label", "payload", "matched_by")


@query(f"""WITH c AS (SELECT conv_id, turn, {TOKENS} AS t FROM conversations), o AS (SELECT conv_id, arg_min(t, turn) AS o FROM c GROUP BY conv_id)
SELECT conv_id, min(turn) FILTER (CASE WHEN len(t) + len(o) - len(list_intersect(t, o)) > 0 THEN len(list_intersect(t, o)) / (len(t) + len(o) - len(list_intersect(t, o)))::DOUBLE ELSE 0 END <= 0.5) AS first_fresh FROM c JOIN o USING (conv_id) GROUP BY conv_id""")
def restated_turns(spark: SparkSession, d: str) -> DataFrame:
    """The first turn of a conversation that doesn't restate its opening; leading turns before it are dropped."""
    c = table(spark, d, "conversations").select("conv_id", "turn", X.token_set(F.col("text")).alias("t"))
    opening = c.groupBy("conv_id").agg(F.min_by("t", "turn").alias("o"))
    return c.join(opening, "conv_id").groupBy("conv_id").agg(F.min(F.when(X.jaccard(F.col("t"), F.col("o")) <= 0.5, F.col("turn"))).alias("first_fresh"))


@query(f"WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents), b AS (SELECT min(item_id) AS i FROM benchmark), x AS (SELECT {TOKENS} AS o FROM benchmark, b WHERE item_id = i) SELECT doc_id, round(len(list_intersect(t, o)) / greatest(1, len(t) + len(o) - len(list_intersect(t, o)))::DOUBLE, 6) AS similarity FROM t, x ORDER BY similarity DESC, doc_id LIMIT 5")
def most_similar(spark: SparkSession, d: str) -> DataFrame:
    """The five documents nearest to the first item; the item's tokens are one value, fetched first."""
    item = table(spark, d, "benchmark").orderBy("item_id").select(X.token_set(F.col("text")).alias("o")).first()["o"]
    s = X.jaccard(X.token_set(F.col("text")), F.array(*map(F.lit, item)))
    return table(spark, d, "documents").select("doc_id", F.round(s, 6).alias("similarity")).orderBy(F.desc("similarity"), "doc_id").limit(5)


@query(with_views("SELECT arm, count(*) AS eligible, count(DISTINCT family_id) AS families FROM (SELECT arm, case_id, family_id FROM primary_scores GROUP BY ALL HAVING count(*) >= 2 AND avg(answer_length) > 1000) GROUP BY arm", "primary_scores"))
def eligible_results(spark: SparkSession, d: str) -> DataFrame:
    """Results that a change of form can be measured on: at least two scored dimensions and enough text."""
    cases = V.primary_scores(spark, d).groupBy("arm", "case_id", "family_id").agg(F.count("*").alias("n"), F.avg("answer_length").alias("l")).where("n >= 2 and l > 1000")
    return cases.groupBy("arm").agg(F.count("*").alias("eligible"), F.countDistinct("family_id").alias("families"))


