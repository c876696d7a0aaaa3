"""Queries over change verdicts, capability checks, and records before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions import stats
from assayframe.operators import aggregates as A
from assayframe.operators import comparison as C
from assayframe.plans.registry import query
from assayframe.plans.scores import _with
from assayframe.sources import adapters as V
from assayframe.sources.adapters import with_views

RATES_SQL = """SELECT arm, measure, count(correct) AS n, count(*) FILTER (correct) AS correct_n, count(*) FILTER (correct IS NULL) AS undecided,
       round(count(*) FILTER (correct) / nullif(count(correct), 0)::DOUBLE, 6) AS rate, count(DISTINCT family_id) FILTER (correct IS NOT NULL) AS families FROM verdicts GROUP BY arm, measure"""


def rates(verdicts: DataFrame, by: tuple[str, ...] = ("arm", "measure")) -> DataFrame:
    ok = F.col("correct")
    return verdicts.groupBy(*by).agg(
        F.count(ok).alias("n"), F.count_if(ok).alias("correct_n"), F.count_if(ok.isNull()).alias("undecided"), A.rate(F.count_if(ok), F.count(ok)).alias("rate"),
        F.countDistinct(F.when(ok.isNotNull(), F.col("family_id"))).alias("families"),
    )


@query(with_views(RATES_SQL, "verdicts"))
def behaviour_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(V.verdicts(spark, d))


@query(
    with_views(
        f""", r AS ({RATES_SQL}), c AS (SELECT arm, rate AS consistency FROM r WHERE measure = 'self_consistency')
SELECT r.arm, measure, n, rate, round(CASE WHEN measure IN ('invariance', 'resistance') THEN consistency WHEN measure IN ('sensitivity', 'legitimate_update') THEN 1 - consistency END, 6) AS floor,
       rate > CASE WHEN measure IN ('invariance', 'resistance') THEN consistency WHEN measure IN ('sensitivity', 'legitimate_update') THEN 1 - consistency END + 1e-9 AS above_floor
FROM r LEFT JOIN c ON r.arm = c.arm""",
        "verdicts",
    )
)
def behaviour_floor(spark: SparkSession, d: str) -> DataFrame:
    """Rates against the noise floor: what should hold against the consistency of the same prompt, what should move against its complement."""
    r = rates(V.verdicts(spark, d))
    c = r.where("measure = 'self_consistency'").select("arm", F.col("rate").alias("consistency"))
    floor = F.when(F.col("measure").isin("invariance", "resistance"), F.col("consistency")).when(F.col("measure").isin("sensitivity", "legitimate_update"), 1 - F.col("consistency"))
    return r.join(F.broadcast(c), "arm", "left").select("arm", "measure", "n", "rate", F.round(floor, 6).alias("floor"), (F.col("rate") > floor + 1e-9).alias("above_floor"))


VERDICT_PAIRS_SQL = """SELECT o.arm, b.measure, b.family_id, b.correct::INT::DOUBLE AS before, o.correct::INT::DOUBLE AS after
FROM (SELECT * FROM verdicts WHERE arm = 'base' AND correct IS NOT NULL) b JOIN verdicts o ON o.family_id = b.family_id AND o.measure = b.measure AND o.arm <> 'base' AND o.correct IS NOT NULL"""


@query(_with(VERDICT_PAIRS_SQL, "measure", "verdicts"))
def change_by_measure(spark: SparkSession, d: str) -> DataFrame:
    rows = V.verdicts(spark, d).where("correct is not null").withColumn("score", F.col("correct").cast("int"))
    return C.change(C.pairs(rows, "base", ["measure"]), ["measure"])


@query(
    with_views(
        """SELECT p.arm, count(*) AS pairs, count(*) FILTER (p.did_change = r.did_change) AS agree, round(count(*) FILTER (p.did_change = r.did_change) / count(*)::DOUBLE, 6) AS rate
FROM (SELECT * FROM verdicts_all WHERE judge_pass = 0 AND did_change IS NOT NULL) p JOIN (SELECT * FROM verdicts_all WHERE judge_pass = 1 AND did_change IS NOT NULL) r
  ON p.arm = r.arm AND p.family_id = r.family_id AND p.measure = r.measure GROUP BY p.arm""",
        "verdicts_all",
    )
)
def verdict_stability(spark: SparkSession, d: str) -> DataFrame:
    rows = V.verdicts_all(spark, d).where("judge_pass <= 1 and did_change is not null")
    by_pass = [F.max(F.when(F.col("judge_pass") == k, F.col("did_change"))).alias(f"p{k}") for k in (0, 1)]
    both = rows.groupBy("arm", "family_id", "measure").agg(*by_pass).where("p0 is not null and p1 is not null")
    return both.groupBy("arm").agg(F.count("*").alias("pairs"), F.count_if(F.col("p0") == F.col("p1")).alias("agree"), A.rate(F.count_if(F.col("p0") == F.col("p1")), F.count("*")).alias("rate"))


@query(
    with_views(
        """SELECT coalesce(arm, 'all') AS arm, count(correct) FILTER (order_presented = 'original_first') AS decided_o, count(*) FILTER (correct AND order_presented = 'original_first') AS correct_o,
       count(correct) FILTER (order_presented = 'variant_first') AS decided_v, count(*) FILTER (correct AND order_presented = 'variant_first') AS correct_v,
       count(*) FILTER (did_change AND order_presented = 'original_first') AS moved_o, count(*) FILTER (did_change AND order_presented = 'variant_first') AS moved_v
FROM verdicts GROUP BY GROUPING SETS ((arm), ())""",
        "verdicts",
    )
)
def position_audit(spark: SparkSession, d: str) -> DataFrame:
    return _position(spark, d)


def _position(spark: SparkSession, d: str) -> DataFrame:
    def cells(side: str, order: str):
        here = F.col("order_presented") == order
        return [F.count(F.when(here, F.col("correct"))).alias(f"decided_{side}"), F.count_if(here & F.col("correct")).alias(f"correct_{side}"), F.count_if(here & F.col("did_change")).alias(f"moved_{side}")]

    out = V.verdicts(spark, d).groupingSets([["arm"], []], "arm").agg(*cells("o", "original_first"), *cells("v", "variant_first"))
    return out.withColumn("arm", F.coalesce("arm", F.lit("all")))


_FISHER_TERM = "(la1.v + lb1.v + lc1.v + ln1.v - lt.v - x1.v - x2.v - x3.v - x4.v)"


@query(
    with_views(
        """, lf AS (SELECT i, sum(CASE WHEN i > 1 THEN ln(i) ELSE 0 END) OVER (ORDER BY i) AS v FROM range(0, 400001) t(i)),
t AS (SELECT arm, count(*) FILTER (correct AND order_presented = 'original_first') AS a, count(*) FILTER (NOT correct AND order_presented = 'original_first') AS b,
             count(*) FILTER (correct AND order_presented = 'variant_first') AS c, count(*) FILTER (NOT correct AND order_presented = 'variant_first') AS d FROM verdicts GROUP BY arm),
x AS (SELECT arm, a, b, c, d, unnest(range(greatest(0, a + c - c - d), least(a + b, a + c) + 1)) AS k FROM t),
p AS (SELECT x.arm, x.a, x.k, r1.v + r2.v + c1.v + c2.v - n.v - k1.v - k2.v - k3.v - k4.v AS lp FROM x JOIN lf r1 ON r1.i = a + b JOIN lf r2 ON r2.i = c + d JOIN lf c1 ON c1.i = a + c JOIN lf c2 ON c2.i = b + d
      JOIN lf n ON n.i = a + b + c + d JOIN lf k1 ON k1.i = k JOIN lf k2 ON k2.i = a + b - k JOIN lf k3 ON k3.i = a + c - k JOIN lf k4 ON k4.i = d - a + k)
SELECT arm, round(least(1, sum(exp(lp)) FILTER (lp <= seen + 1e-9)), 6) AS p FROM (SELECT *, max(lp) FILTER (k = a) OVER (PARTITION BY arm) AS seen FROM p) GROUP BY arm""",
        "verdicts",
    )
)
def fisher_position(spark: SparkSession, d: str) -> DataFrame:
    rows = _position(spark, d).where("arm <> 'all'")
    table = [F.col(c) for c in ("correct_o", "decided_o", "correct_v", "decided_v")]
    p = stats.fisher_exact_p(table[0], table[1] - table[0], table[2], table[3] - table[2])
    return rows.select("arm", F.round(p, 6).alias("p"))


# --- capability: labels as passes, by language and source -----------------------------

CAPABILITY_SQL = "SELECT d.lang AS arm, d.source AS family, l.quality = 1 AS passed, l.toxic = 1 AS technical, CASE WHEN d.n_chars > 1000 THEN ['long', d.lang] ELSE ['short', d.lang] END AS tags, d.doc_id AS check_id FROM documents d JOIN labels l USING (doc_id)"


def capability(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = V.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), V.table(spark, d, "labels")
    size = F.when(F.col("n_chars") > 1000, "long").otherwise("short")
    return docs.join(labels, "doc_id").select(
        F.col("lang").alias("arm"), F.col("source").alias("family"), (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 1).alias("technical"), F.array(size, "lang").alias("tags"), F.col("doc_id").alias("check_id")
    )


@query(f"WITH c AS ({CAPABILITY_SQL}) SELECT arm, family, count(*) FILTER (NOT technical) AS n, count(*) FILTER (passed AND NOT technical) AS passed_n, count(*) FILTER (technical) AS technical_n, round(count(*) FILTER (passed AND NOT technical) / nullif(count(*) FILTER (NOT technical), 0)::DOUBLE, 6) AS rate FROM c GROUP BY arm, family")
def capability_rates(spark: SparkSession, d: str) -> DataFrame:
    fair, t = ~F.col("technical"), F.col("technical")
    return capability(spark, d).groupBy("arm", "family").agg(
        F.count_if(fair).alias("n"), F.count_if(fair & F.col("passed")).alias("passed_n"), F.count_if(t).alias("technical_n"), A.rate(F.count_if(fair & F.col("passed")), F.nullif(F.count_if(fair), F.lit(0))).alias("rate")
    )


@query(f"WITH c AS ({CAPABILITY_SQL}) SELECT arm, tag, count(*) AS n, count(*) FILTER (passed) AS passed_n, round(count(*) FILTER (passed) / count(*)::DOUBLE, 6) AS rate FROM (SELECT arm, passed, unnest(tags) AS tag FROM c WHERE NOT technical) GROUP BY arm, tag")
def capability_by_tag(spark: SparkSession, d: str) -> DataFrame:
    rows = capability(spark, d).where("not technical").select("arm", "passed", F.explode("tags").alias("tag"))
    return rows.groupBy("arm", "tag").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed_n"), A.rate(F.count_if("passed"), F.count("*")).alias("rate"))


@query("SELECT CASE WHEN grouping(lang) = 1 THEN 'source' ELSE 'lang' END AS axis, coalesce(lang, source, 'unknown') AS value, count(*) AS n, count(*) FILTER (quality = 1) AS passed_n, round(count(*) FILTER (quality = 1) / count(*)::DOUBLE, 3) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source))")
def legacy_tally(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "documents").select("doc_id", "lang", "source").join(V.table(spark, d, "labels"), "doc_id")
    ok = F.count_if(F.col("quality") == 1)
    out = rows.groupingSets([["lang"], ["source"]], "lang", "source").agg(F.count("*").alias("n"), ok.alias("passed_n"), F.round(ok / F.count("*"), 3).alias("rate"), F.grouping("lang").alias("g"))
    return out.select(F.when(F.col("g") == 1, "source").otherwise("lang").alias("axis"), F.coalesce("lang", "source", F.lit("unknown")).alias("value"), "n", "passed_n", "rate")


@query("SELECT coalesce(lang, 'total') AS grp, count(*) FILTER (quality = 1) AS before_n, count(*) FILTER (toxic = 0) AS after_n, count(*) FILTER (toxic = 0) - count(*) FILTER (quality = 1) AS change, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), ())")
def before_after(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "documents").select("doc_id", "lang").join(V.table(spark, d, "labels"), "doc_id")
    b, a = F.count_if(F.col("quality") == 1), F.count_if(F.col("toxic") == 0)
    return rows.groupingSets([["lang"], []], "lang").agg(b.alias("before_n"), a.alias("after_n"), (a - b).alias("change"), F.count("*").alias("n")).withColumnRenamed("lang", "grp").fillna("total", ["grp"])


@query("SELECT doc_id, CASE WHEN toxic = 0 THEN 'newly passing' ELSE 'newly failing' END AS flip FROM labels WHERE (quality = 1) <> (toxic = 0)")
def flips(spark: SparkSession, d: str) -> DataFrame:
    before, after = F.col("quality") == 1, F.col("toxic") == 0
    return V.table(spark, d, "labels").where(before != after).select("doc_id", F.when(after, "newly passing").otherwise("newly failing").alias("flip"))


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """What a resumed stage has yet to do."""
    return V.table(spark, d, "documents").select("doc_id").join(V.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT 'family' AS what, count(*) AS n FROM (SELECT DISTINCT p_brand FROM part ANTI JOIN lineitem ON p_partkey = l_partkey) UNION ALL SELECT 'case', count(*) FROM (SELECT p_partkey FROM part ANTI JOIN lineitem ON p_partkey = l_partkey)")
def orphan_families(spark: SparkSession, d: str) -> DataFrame:
    lost = V.table(spark, d, "part").join(V.table(spark, d, "lineitem").select("l_partkey"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")
    return lost.agg(F.countDistinct("p_brand").alias("family"), F.count("*").alias("case")).select(F.inline(F.array(F.struct(F.lit("family").alias("what"), F.col("family").alias("n")), F.struct(F.lit("case").alias("what"), F.col("case").alias("n")))))


@query(with_views("SELECT arm, min(seq) AS first_seen, row_number() OVER (ORDER BY arm <> 'base', min(seq)) AS position FROM verdicts_all GROUP BY arm", "verdicts_all"))
def arm_order(spark: SparkSession, d: str) -> DataFrame:
    """The baseline first, then the arms as they first appear; there are as many rows as arms."""
    from pyspark.sql import Window

    arms = V.verdicts_all(spark, d).groupBy("arm").agg(F.min("seq").alias("first_seen"))
    return arms.withColumn("position", F.row_number().over(Window.orderBy(F.col("arm") != "base", "first_seen")))


@query("""WITH a AS (SELECT DISTINCT event_type AS arm FROM events UNION SELECT DISTINCT 'rival_' || event_type FROM events WHERE event_type < 'e') SELECT a.arm AS phantom, b.arm AS of_arm FROM a JOIN a b ON lower(a.arm) IN ('rival_' || lower(b.arm), 'recast_' || lower(b.arm), lower(b.arm) || '_recast', lower(b.arm) || '_rival')""")
def phantom_arms(spark: SparkSession, d: str) -> DataFrame:
    """Arms that are named after another, found by equi-joins on the four forms of each name."""
    names = V.table(spark, d, "events").select(F.col("event_type").alias("arm")).distinct()
    arms = names.union(names.where("arm < 'e'").select(F.concat(F.lit("rival_"), F.col("arm")))).distinct()
    low = F.lower("arm")
    forms = arms.select(F.col("arm").alias("of_arm"), F.explode(F.array(F.concat(F.lit("rival_"), low), F.concat(F.lit("recast_"), low), F.concat(low, F.lit("_recast")), F.concat(low, F.lit("_rival")))).alias("form"))
    return arms.join(forms, F.lower("arm") == F.col("form")).select(F.col("arm").alias("phantom"), "of_arm")
