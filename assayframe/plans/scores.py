"""Queries over graded scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayframe.functions import stats
from assayframe.operators import aggregates as A
from assayframe.operators import comparison as C
from assayframe.plans.registry import query
from assayframe.sources import adapters as V
from assayframe.sources.adapters import BASELINE, with_views

STATS_SQL = """count(score) AS n, round(avg(score::DOUBLE), 6) AS mean, count(*) FILTER (score = 0) AS n0, count(*) FILTER (score = 1) AS n1,
       count(*) FILTER (score = 2) AS n2, count(*) FILTER (score IS NULL) AS unscorable_n, count(DISTINCT case_id) AS cases, count(DISTINCT family_id) AS families"""
#: The sign test in SQL: log factorials from a table of running sums.
LF_SQL = "lf AS (SELECT i, sum(CASE WHEN i > 1 THEN ln(i) ELSE 0 END) OVER (ORDER BY i) AS v FROM range(0, 200001) t(i))"


def mean_sql(x: str) -> str:
    """exact_mean in SQL."""
    return f"sum(({x})::DECIMAL(20, 9))::DOUBLE / count({x})"


CHANGE_SQL = """
SELECT arm, {by}n, families, mean_before, mean_after, round(ma - mb, 6) AS delta, better, worse, n - better - worse AS level,
       round(CASE WHEN better + worse > 0 THEN least(1, 2 * (SELECT sum(exp(a.v - b.v - c.v - (better + worse) * ln(2)))
             FROM range(0, 100000) r(i), lf a, lf b, lf c WHERE r.i <= least(better, worse) AND a.i = better + worse AND b.i = r.i AND c.i = better + worse - r.i)) END, 6) AS sign_p,
       n < 20 AS small
FROM (SELECT arm, {by}count(*) AS n, count(DISTINCT family_id) AS families, {mean_before} AS mb, {mean_after} AS ma, round({mean_before}, 6) AS mean_before, round({mean_after}, 6) AS mean_after,
             count(*) FILTER (after - before > 1e-9) AS better, count(*) FILTER (after - before < -1e-9) AS worse FROM pairs GROUP BY arm{group})
"""


def _change_sql(pairs: str, by: str = "") -> str:
    body = CHANGE_SQL.format(by=f"{by}, " if by else "", group=f", {by}" if by else "", mean_before=mean_sql("before"), mean_after=mean_sql("after"))
    return f", {LF_SQL}, pairs AS ({pairs}) {body}".strip()


def _with(pairs: str, by: str, *views: str) -> str:
    head = with_views("", *views).rstrip()
    return head + _change_sql(pairs, by)


@query(with_views(f"SELECT arm, dimension, {STATS_SQL} FROM graded WHERE standard = 'original' GROUP BY arm, dimension", "graded"))
def dimension_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.score_stats(V.graded(spark, d).where("standard = 'original'"), ["arm", "dimension"])


@query(with_views(f"SELECT arm, grp, {STATS_SQL}, array_to_string(list_sort(list(DISTINCT dimension)), ',') AS dimensions FROM graded WHERE standard = 'original' GROUP BY arm, grp", "graded"))
def group_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = V.graded(spark, d).where("standard = 'original'")
    used = rows.groupBy("arm", "grp").agg(F.array_join(F.sort_array(F.collect_set("dimension")), ",").alias("dimensions"))
    return A.score_stats(rows, ["arm", "grp"]).join(F.broadcast(used), ["arm", "grp"])


@query(
    with_views(
        """SELECT a.arm, b.dimension, c.kind, count(score) AS n, round(avg(score::DOUBLE), 6) AS mean, count(DISTINCT family_id) AS families,
       count(score) >= 5 AS interpretable, count(DISTINCT family_id) = 1 AS single_family
FROM (SELECT DISTINCT arm FROM o) a CROSS JOIN (SELECT DISTINCT dimension FROM o) b CROSS JOIN (SELECT DISTINCT kind FROM o) c
LEFT JOIN o ON o.arm = a.arm AND o.dimension = b.dimension AND o.kind = c.kind GROUP BY ALL""",
        "graded",
    ).replace("\nSELECT a.arm", ", o AS (SELECT * FROM graded WHERE standard = 'original')\nSELECT a.arm")
)
def dimension_kind_grid(spark: SparkSession, d: str) -> DataFrame:
    return A.kind_grid(V.graded(spark, d).where("standard = 'original'"))


FLAG_SQL = """count(DISTINCT case_id) AS cases, count(DISTINCT family_id) AS families, count(*) FILTER (flagged) AS flags,
       round(count(*) FILTER (flagged) / count(*)::DOUBLE, 6) AS rate FROM graded WHERE standard = 'original'"""


@query(with_views(f"SELECT arm, 'all' AS scope, {FLAG_SQL} GROUP BY arm UNION ALL SELECT arm, kind, {FLAG_SQL} GROUP BY arm, kind", "graded"))
def flag_scopes(spark: SparkSession, d: str) -> DataFrame:
    return A.flag_scopes(V.graded(spark, d).where("standard = 'original'"))


@query(
    with_views(
        """SELECT arm, dimension, count(*) FILTER (score = 0) AS zeros, count(*) AS scored, round(count(*) FILTER (score = 0) / count(*)::DOUBLE, 6) AS rate,
       count(DISTINCT family_id) FILTER (score = 0) AS families FROM primary_scores GROUP BY arm, dimension""",
        "primary_scores",
    )
)
def zero_patterns(spark: SparkSession, d: str) -> DataFrame:
    zero = F.col("score") == 0
    return (
        V.primary_scores(spark, d)
        .groupBy("arm", "dimension")
        .agg(F.count_if(zero).alias("zeros"), F.count("*").alias("scored"), A.rate(F.count_if(zero), F.count("*")).alias("rate"), F.countDistinct(F.when(zero, F.col("family_id"))).alias("families"))
    )


PAIRS_SQL = """SELECT o.arm, b.dimension, b.kind, b.family_id, b.score AS before, o.score AS after
FROM (SELECT * FROM primary_scores WHERE arm = 'N') b JOIN primary_scores o ON o.case_id = b.case_id AND o.dimension = b.dimension AND o.arm <> 'N'"""
MEANS_SQL = """SELECT o.arm, b.grp, b.kind, b.family_id, b.score AS before, o.score AS after
FROM (SELECT arm, case_id, family_id, kind, grp, avg(score::DOUBLE) AS score FROM primary_scores WHERE arm = 'N' GROUP BY ALL) b
JOIN (SELECT arm, case_id, grp, avg(score::DOUBLE) AS score FROM primary_scores WHERE arm <> 'N' GROUP BY ALL) o ON o.case_id = b.case_id AND o.grp = b.grp"""


def _dimension_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.pairs(V.primary_scores(spark, d), BASELINE, ["case_id", "dimension"], keep=["kind"])


def _group_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.pairs(C.case_means(V.primary_scores(spark, d), ["grp", "kind"]), BASELINE, ["case_id", "grp"], keep=["kind"])


@query(_with(PAIRS_SQL, "dimension", "primary_scores"))
def change_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    return C.change(_dimension_pairs(spark, d), ["dimension"])


@query(_with(MEANS_SQL, "grp", "primary_scores"))
def change_by_group(spark: SparkSession, d: str) -> DataFrame:
    return C.change(_group_pairs(spark, d), ["grp"])


@query(_with(MEANS_SQL, "grp, kind", "primary_scores"))
def change_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return C.change(_group_pairs(spark, d), ["grp", "kind"])


@query(_with(PAIRS_SQL, "dimension, kind", "primary_scores"))
def change_dimension_kind(spark: SparkSession, d: str) -> DataFrame:
    return C.change(_dimension_pairs(spark, d), ["dimension", "kind"])


GAPS_SQL = {"gap_first": mean_sql("c01 - c00"), "gap_second": mean_sql("c11 - c10"), "gaps": mean_sql("(c11 - c10) - (c01 - c00)")}
DOD_SQL = """
SELECT arm, grp, count(*) AS n, round({gap_first}, 6) AS gap_first, round({gap_second}, 6) AS gap_second, round({gaps}, 6) AS difference,
       count(*) FILTER ((c11 - c10) - (c01 - c00) > 1e-9) AS wider, count(*) FILTER ((c11 - c10) - (c01 - c00) < -1e-9) AS narrower
FROM (SELECT t.arm, s.case_id, s.grp, avg(s.score::DOUBLE) FILTER ({row} = 0 AND s.arm = 'N') AS c00, avg(s.score::DOUBLE) FILTER ({row} = 0 AND s.arm = t.arm) AS c01,
             avg(s.score::DOUBLE) FILTER ({row} = 1 AND s.arm = 'N') AS c10, avg(s.score::DOUBLE) FILTER ({row} = 1 AND s.arm = t.arm) AS c11
      FROM {source} s JOIN (SELECT 'A' AS arm UNION ALL SELECT 'R') t ON s.arm IN ('N', t.arm) GROUP BY ALL)
WHERE c00 IS NOT NULL AND c01 IS NOT NULL AND c10 IS NOT NULL AND c11 IS NOT NULL GROUP BY arm, grp
"""


def _four_cells(values: DataFrame, row) -> DataFrame:
    # A baseline row stands in the comparison with either other arm.
    sides = F.when(F.col("arm") == BASELINE, F.array(F.lit("A"), F.lit("R"))).otherwise(F.array("arm"))
    spread = values.where("score is not null").withColumn("is_arm", F.col("arm") != BASELINE).withColumn("arm", F.explode(sides))
    return C.difference_of_differences(C.four_cells(spread, ["arm", "case_id", "grp"], row, F.col("is_arm")), ["arm", "grp"])


@query(with_views(DOD_SQL.format(**GAPS_SQL, row="s.judge", source="(SELECT * FROM scores_all WHERE NOT technical AND NOT unscorable AND standard = 'original' AND score IS NOT NULL)"), "scores_all"))
def judge_divergence(spark: SparkSession, d: str) -> DataFrame:
    rows = V.scores_all(spark, d).where("not technical and not unscorable and standard = 'original'")
    return _four_cells(rows, F.col("judge") == 1)


@query(with_views(DOD_SQL.format(**GAPS_SQL, row="(s.standard = 'rival')::INT", source="(SELECT * FROM graded WHERE score IS NOT NULL)"), "graded"))
def author_effect(spark: SparkSession, d: str) -> DataFrame:
    return _four_cells(V.graded(spark, d), F.col("standard") == "rival")


RELIABILITY_SQL = """
SELECT p.arm, p.dimension, count(*) FILTER (p.score IS NOT NULL AND r.score IS NOT NULL) AS pairs, count(*) FILTER (p.score = r.score) AS exact,
       count(*) FILTER (abs(p.score - r.score) <= 1) AS within_one, round(avg(abs(p.score - r.score)::DOUBLE), 6) AS mean_error,
       count(*) FILTER ((p.score IS NULL) <> (r.score IS NULL)) AS scorability_disagreements, count(*) FILTER (p.score IS NULL AND r.score IS NULL) AS both_unscorable
FROM (SELECT * FROM scores_all WHERE judge_pass = 0) p JOIN (SELECT * FROM scores_all WHERE judge_pass = 1) r
  ON p.arm = r.arm AND p.case_id = r.case_id AND p.dimension = r.dimension AND p.standard = r.standard
GROUP BY p.arm, p.dimension
"""


@query(with_views(RELIABILITY_SQL, "scores_all"))
def reliability(spark: SparkSession, d: str) -> DataFrame:
    """Primary gradings against their first repeats, by one conditional pass instead of a self-join."""
    rows = V.scores_all(spark, d).where("judge_pass <= 1")
    pair = rows.groupBy("arm", "case_id", "dimension", "standard").agg(
        F.max(F.when(F.col("judge_pass") == 0, F.col("score"))).alias("p"), F.max(F.when(F.col("judge_pass") == 1, F.col("score"))).alias("r"), F.max("judge_pass").alias("last")
    )
    p, r = F.col("p"), F.col("r")
    return (
        pair.where("last = 1")
        .groupBy("arm", "dimension")
        .agg(
            F.count_if(p.isNotNull() & r.isNotNull()).alias("pairs"), F.count_if(p == r).alias("exact"), F.count_if(F.abs(p - r) <= 1).alias("within_one"),
            F.round(F.avg(F.abs(p - r).cast("double")), 6).alias("mean_error"), F.count_if(p.isNull() != r.isNull()).alias("scorability_disagreements"),
            F.count_if(p.isNull() & r.isNull()).alias("both_unscorable"),
        )
    )


@query(
    with_views(
        """SELECT arm, count(*) AS rows, count(*) FILTER (technical) AS technical_n, count(*) FILTER (unscorable AND NOT technical) AS unscorable_n,
       count(*) FILTER (score IS NULL AND NOT technical AND NOT unscorable) AS null_scores, count(*) FILTER (judge_pass > 0) AS repeats,
       count(*) FILTER (standard = 'rival') AS rival_n, count(DISTINCT case_id) AS cases, count(DISTINCT case_id) FILTER (technical) AS technical_cases FROM scores_all GROUP BY arm""",
        "scores_all",
    )
)
def integrity(spark: SparkSession, d: str) -> DataFrame:
    t, u = F.col("technical"), F.col("unscorable")
    return (
        V.scores_all(spark, d)
        .groupBy("arm")
        .agg(
            F.count("*").alias("rows"), F.count_if(t).alias("technical_n"), F.count_if(u & ~t).alias("unscorable_n"), F.count_if(F.col("score").isNull() & ~t & ~u).alias("null_scores"),
            F.count_if(F.col("judge_pass") > 0).alias("repeats"), F.count_if(F.col("standard") == "rival").alias("rival_n"), F.countDistinct("case_id").alias("cases"),
            F.countDistinct(F.when(t, F.col("case_id"))).alias("technical_cases"),
        )
    )


@query(
    with_views(
        """, c AS (SELECT DISTINCT arm, case_id FROM primary_scores)
SELECT arm, count(*) FILTER (b.case_id IS NOT NULL) AS both, (SELECT count(*) FROM c WHERE arm = 'N') - count(*) FILTER (b.case_id IS NOT NULL) AS baseline_only,
       count(*) FILTER (b.case_id IS NULL) AS arm_only
FROM (SELECT * FROM c WHERE arm <> 'N') o LEFT JOIN (SELECT case_id FROM c WHERE arm = 'N') b ON o.case_id = b.case_id GROUP BY arm""",
        "primary_scores",
    )
)
def pairing_losses(spark: SparkSession, d: str) -> DataFrame:
    return C.losses(V.primary_scores(spark, d), BASELINE)


@query(
    with_views(
        """SELECT family_id, kind, count(DISTINCT case_id) AS cases, count(DISTINCT case_id) FILTER (arm = 'N') AS n_cases, count(DISTINCT case_id) FILTER (arm = 'A') AS a_cases,
       count(DISTINCT case_id) FILTER (arm = 'R') AS r_cases FROM primary_scores GROUP BY family_id, kind""",
        "primary_scores",
    )
)
def family_counts(spark: SparkSession, d: str) -> DataFrame:
    arms = [F.countDistinct(F.when(F.col("arm") == a, F.col("case_id"))).alias(f"{a.lower()}_cases") for a in ("N", "A", "R")]
    return V.primary_scores(spark, d).groupBy("family_id", "kind").agg(F.countDistinct("case_id").alias("cases"), *arms)


@query(
    with_views(
        """SELECT arm, kind, round(avg(score::DOUBLE) FILTER (grp = 'action'), 6) AS action_mean, count(*) FILTER (grp = 'action') AS action_n,
       round(avg(score::DOUBLE) FILTER (grp = 'reasoning'), 6) AS reasoning_mean, count(*) FILTER (grp = 'reasoning') AS reasoning_n, count(DISTINCT family_id) AS families
FROM primary_scores GROUP BY arm, kind""",
        "primary_scores",
    )
)
def family_kind_stats(spark: SparkSession, d: str) -> DataFrame:
    parts = [x for g in ("action", "reasoning") for x in (F.round(F.avg(F.when(F.col("grp") == g, F.col("score").cast("double"))), 6).alias(f"{g}_mean"), F.count_if(F.col("grp") == g).alias(f"{g}_n"))]
    return V.primary_scores(spark, d).groupBy("arm", "kind").agg(*parts, F.countDistinct("family_id").alias("families"))


LENGTH_SQL = ", l AS (SELECT arm, case_id, avg(answer_length) AS len, avg(score::DOUBLE) AS score FROM primary_scores GROUP BY arm, case_id)\n"


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return V.primary_scores(spark, d).groupBy("arm", "case_id").agg(F.avg("answer_length").alias("len"), F.avg(F.col("score").cast("double")).alias("score"))


@query(with_views(LENGTH_SQL + "SELECT arm, count(*) AS n, round(avg(len), 4) AS mean_length, round(median(len), 4) AS median_length, round(covar_pop(len, score) / sqrt(var_pop(len) * var_pop(score)), 6) AS pearson FROM l GROUP BY arm", "primary_scores"))
def verbosity_pearson(spark: SparkSession, d: str) -> DataFrame:
    rows = _lengths(spark, d)
    found = rows.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("len"), 4).alias("mean_length"), F.round(stats.pearson(F.col("len"), F.col("score")), 6).alias("pearson"))
    middle = stats.medians(rows, ["arm"], "len").select("arm", F.round("median", 4).alias("median_length"))
    return found.join(F.broadcast(middle), "arm")


@query(
    with_views(
        LENGTH_SQL
        + """, r AS (SELECT arm, rank() OVER (PARTITION BY arm ORDER BY len) + (count(*) OVER (PARTITION BY arm, len) - 1) / 2.0::DOUBLE AS x,
            rank() OVER (PARTITION BY arm ORDER BY score) + (count(*) OVER (PARTITION BY arm, score) - 1) / 2.0::DOUBLE AS y FROM l)
SELECT arm, round(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)), 6) AS spearman FROM r GROUP BY arm""",
        "primary_scores",
    )
)
def verbosity_spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(_lengths(spark, d), ["arm"], "len", "score").select("arm", F.round("spearman", 6).alias("spearman"))


@query(
    with_views(
        LENGTH_SQL
        + """, t AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY len, case_id) AS rn, count(*) OVER (PARTITION BY arm) AS n FROM l)
SELECT arm, tercile, count(*) AS n, round(avg(score), 6) AS mean FROM (SELECT *, CASE WHEN rn <= greatest(1, n // 3) THEN 'short' WHEN rn > n - greatest(1, n // 3) THEN 'long' ELSE 'middle' END AS tercile FROM t)
GROUP BY arm, tercile""",
        "primary_scores",
    )
)
def verbosity_terciles(spark: SparkSession, d: str) -> DataFrame:
    return stats.terciles(_lengths(spark, d), ["arm"], ["len", "case_id"]).groupBy("arm", "tercile").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(
    with_views(
        """, z AS (SELECT arm, case_id, count(*) FILTER (score = 0) AS zeros, avg(score::DOUBLE) AS mean, max(CASE WHEN score = 0 THEN dimension END) AS lead_dimension FROM primary_scores GROUP BY arm, case_id),
f AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY zeros DESC, mean, case_id) > 4 AS late FROM z WHERE zeros > 0),
k AS (SELECT * FROM f ORDER BY late, zeros DESC, mean, arm, case_id LIMIT 12)
SELECT arm, case_id, zeros, round(mean, 6) AS mean, lead_dimension, row_number() OVER (ORDER BY zeros DESC, mean, arm, case_id) AS rank FROM k""",
        "primary_scores",
    )
)
def worst_examples(spark: SparkSession, d: str) -> DataFrame:
    zero = F.col("score") == 0
    cases = V.primary_scores(spark, d).groupBy("arm", "case_id").agg(F.count_if(zero).alias("zeros"), F.avg(F.col("score").cast("double")).alias("mean"), F.max(F.when(zero, F.col("dimension"))).alias("lead_dimension"))
    best = A.quota_top_k(cases.where("zeros > 0"), "arm", [F.desc("zeros"), F.col("mean"), F.col("arm"), F.col("case_id")], 12)
    return best.select("arm", "case_id", "zeros", F.round("mean", 6).alias("mean"), "lead_dimension", "rank")


@query(with_views("SELECT standard, judge_pass = 0 AS is_primary, count(*) AS n FROM scores_all GROUP BY ALL", "scores_all"))
def standard_split(spark: SparkSession, d: str) -> DataFrame:
    return V.scores_all(spark, d).groupBy("standard", (F.col("judge_pass") == 0).alias("is_primary")).agg(F.count("*").alias("n"))


@query(
    """SELECT l_returnflag AS arm, l_partkey AS case_id, l_linenumber AS dimension, arg_min(l_orderkey, k) AS first_seq, count(*) - 1 AS repeats
FROM (SELECT *, struct_pack(a := l_orderkey, b := l_suppkey, c := l_quantity, d := l_extendedprice) AS k FROM lineitem) GROUP BY ALL"""
)
def dedup_primary(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_partkey").alias("case_id"), F.col("l_linenumber").alias("dimension"), "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice")
    keys = ["arm", "case_id", "dimension"]
    counts = rows.groupBy(*keys).agg(F.min(F.struct("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("r"), (F.count("*") - 1).alias("repeats"))
    return counts.select(*keys, F.col("r.l_orderkey").alias("first_seq"), "repeats")


@query(with_views("SELECT judge, count(DISTINCT (arm, case_id)) AS arm_cases, count(DISTINCT family_id) AS families, count(*) FILTER (judge_pass = 0) AS primary_n, count(*) FILTER (judge_pass > 0) AS repeat_n FROM scores_all GROUP BY judge", "scores_all"))
def judge_coverage(spark: SparkSession, d: str) -> DataFrame:
    first = F.col("judge_pass") == 0
    return V.scores_all(spark, d).groupBy("judge").agg(F.countDistinct("arm", "case_id").alias("arm_cases"), F.countDistinct("family_id").alias("families"), F.count_if(first).alias("primary_n"), F.count_if(~first).alias("repeat_n"))


@query(
    with_views(
        """, m AS (SELECT arm, grp, dimension, round(avg(score::DOUBLE), 6) AS mean FROM primary_scores GROUP BY ALL)
SELECT arm, grp, arg_min(dimension, (mean, dimension)) AS lowest, min(mean) AS lowest_mean, arg_max(dimension, (mean, dimension)) AS highest, max(mean) AS highest_mean FROM m GROUP BY arm, grp""",
        "primary_scores",
    )
)
def pooled_range(spark: SparkSession, d: str) -> DataFrame:
    means = V.primary_scores(spark, d).groupBy("arm", "grp", "dimension").agg(F.round(F.avg(F.col("score").cast("double")), 6).alias("mean"))
    s = F.struct("mean", "dimension")
    out = means.groupBy("arm", "grp").agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
    return out.select("arm", "grp", F.col("lo.dimension").alias("lowest"), F.col("lo.mean").alias("lowest_mean"), F.col("hi.dimension").alias("highest"), F.col("hi.mean").alias("highest_mean"))


@query(with_views(", c AS (SELECT arm, count(DISTINCT case_id) AS n FROM primary_scores GROUP BY arm) SELECT arg_min(arm, (n, arm)) AS fewest, arg_max(arm, (n, arm)) AS most, max(n) - min(n) AS gap FROM c", "primary_scores"))
def graded_imbalance(spark: SparkSession, d: str) -> DataFrame:
    s = F.struct("n", "arm")
    counts = V.primary_scores(spark, d).groupBy("arm").agg(F.countDistinct("case_id").alias("n")).agg(F.min(s).alias("a"), F.max(s).alias("b"))
    return counts.select(F.col("a.arm").alias("fewest"), F.col("b.arm").alias("most"), (F.col("b.n") - F.col("a.n")).alias("gap"))


@query(
    _with(PAIRS_SQL, "dimension, kind", "primary_scores").replace("\nSELECT arm, dimension, kind, n,", "\n, ch AS (SELECT arm, dimension, kind, n,")
    + ") SELECT arm, count(*) AS slices, count(*) FILTER (delta < -0.001) AS regressed, min(delta) FILTER (n >= 5) AS worst_delta FROM ch GROUP BY arm"
)
def regression_headline(spark: SparkSession, d: str) -> DataFrame:
    slices = C.change(_dimension_pairs(spark, d), ["dimension", "kind"])
    return slices.groupBy("arm").agg(F.count("*").alias("slices"), F.count_if(F.col("delta") < -0.001).alias("regressed"), F.min(F.when(F.col("n") >= 5, F.col("delta"))).alias("worst_delta"))


@query(
    with_views(
        """, k AS (SELECT kind, count(*) AS n FROM (SELECT arm, case_id, kind FROM primary_scores WHERE score = 0) GROUP BY kind)
SELECT kind, n, row_number() OVER (ORDER BY n DESC, kind) AS rank FROM k ORDER BY n DESC, kind LIMIT 5""",
        "primary_scores",
    )
)
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    counts = V.primary_scores(spark, d).where("score = 0").groupBy("kind").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "kind").limit(5).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "kind")))


@query(
    with_views(
        """, f AS (SELECT DISTINCT arm, case_id FROM primary_scores WHERE score = 0)
SELECT case_id, array_to_string(list_sort(list(arm)), ',') AS failed_arms, count(*) AS n FROM f GROUP BY case_id""",
        "primary_scores",
    )
)
def failed_together(spark: SparkSession, d: str) -> DataFrame:
    return V.primary_scores(spark, d).where("score = 0").groupBy("case_id").agg(F.sort_array(F.collect_set("arm")).alias("a")).select("case_id", F.array_join("a", ",").alias("failed_arms"), F.size("a").cast("long").alias("n"))
