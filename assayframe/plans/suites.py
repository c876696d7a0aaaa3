"""Queries over suites: validation, coverage and summaries, with conversations as suites (a conversation a family, its turns the cases)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.operators import graph as G
from assayframe.operators import validate as R
from assayframe.plans.registry import query
from assayframe.sources import suites as U
from assayframe.sources.adapters import table

CASES_SQL = """SELECT conv_id * 1000 + turn AS case_id, conv_id AS group_id, CASE WHEN turn = 0 AND conv_id % 7 <> 0 THEN 'original' WHEN turn % 3 = 0 THEN 'paraphrase' WHEN turn % 3 = 1 THEN 'pressure' ELSE 'correction' END AS variant,
CASE WHEN turn > 0 AND turn % 3 <> 0 THEN conv_id * 1000 + turn - CASE WHEN conv_id % 11 = 0 THEN 400 ELSE 1 END END AS parent_id, role, text FROM conversations"""


def cases(spark: SparkSession, d: str) -> DataFrame:
    t, c = F.col("turn"), F.col("conv_id")
    back = F.when(c % 11 == 0, 400).otherwise(1)
    return table(spark, d, "conversations").select(
        (c * 1000 + t).alias("case_id"), c.alias("group_id"),
        F.when((t == 0) & (c % 7 != 0), "original").when(t % 3 == 0, "paraphrase").when(t % 3 == 1, "pressure").otherwise("correction").alias("variant"),
        F.when((t > 0) & (t % 3 != 0), c * 1000 + t - back).alias("parent_id"), "role", "text",
    )


@query(f"""WITH c AS ({CASES_SQL})
SELECT case_id::VARCHAR AS entity_id, 'has_text' AS rule, '' AS detail FROM c WHERE text IS NULL OR trim(text) = ''
UNION ALL SELECT case_id::VARCHAR, 'known_role', '' FROM c WHERE role IS NULL OR role NOT IN ('user', 'assistant')
UNION ALL SELECT case_id::VARCHAR, 'unique_id', count(*)::VARCHAR FROM c GROUP BY case_id HAVING count(*) > 1
UNION ALL SELECT case_id::VARCHAR, 'parent_exists', parent_id::VARCHAR FROM c WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT case_id FROM c)
UNION ALL SELECT case_id::VARCHAR, 'has_original', variant FROM c WHERE variant <> 'original' AND group_id NOT IN (SELECT group_id FROM c WHERE variant = 'original')""")
def suite_validation(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return R.union(
        R.violations(c, "case_id", {"has_text": F.trim("text") != "", "known_role": F.col("role").isin("user", "assistant")}),
        R.duplicates(c, "case_id"),
        R.missing_keys(c, "case_id", "parent_id", c, "case_id", "parent_exists"),
        R.without_original(c, ["group_id"]),
    )


_RULES = {
    "three_to_five_dimensions": "len(w) BETWEEN 3 AND 5", "dimensions_allowed": "true", "no_dimension_twice": "len(list_distinct(w)) = len(w)", "all_anchored": "len(list_filter(w, lambda x: NOT list_contains(w[:4], x))) = 0",
    "must_notice_given": "len(w) > 0", "acceptable_given": "len(list_filter(w, lambda x: length(x) > 3)) > 0",
}


@query("WITH p AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part) " + " UNION ALL ".join(f"SELECT p_partkey::VARCHAR AS entity_id, '{r}' AS rule, p_name AS detail FROM p WHERE NOT ({c})" for r, c in _RULES.items()))
def rubric_validation(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    words = F.split("p_name", " ")
    rules = R.rubric_rules(words, F.array_append(words, "x"), F.slice(words, 1, 4), words, F.filter(words, lambda w: F.length(w) > 3))
    return R.violations(p, "p_partkey", rules, F.col("p_name"))


@query(f"WITH RECURSIVE c AS ({CASES_SQL}), k AS (SELECT DISTINCT case_id, parent_id FROM c), l AS (SELECT case_id, 0 AS level FROM k WHERE parent_id IS NULL OR parent_id NOT IN (SELECT case_id FROM k) UNION ALL SELECT k.case_id, l.level + 1 FROM k JOIN l ON k.parent_id = l.case_id) SELECT case_id, level FROM l")
def dependency_levels(spark: SparkSession, d: str) -> DataFrame:
    return G.levels(cases(spark, d).select("case_id", "parent_id").distinct())


def _prune_sql(rounds: int = 10) -> str:
    steps = [f"c AS ({CASES_SQL})", "p0 AS (SELECT * FROM c)"]
    for i in range(rounds):
        steps.append(f"p{i + 1} AS (SELECT * FROM p{i} WHERE group_id IN (SELECT group_id FROM p{i} WHERE variant = 'original') AND (parent_id IS NULL OR parent_id IN (SELECT case_id FROM p{i} WHERE group_id IN (SELECT group_id FROM p{i} WHERE variant = 'original'))))")
    return f"WITH {', '.join(steps)} SELECT case_id, variant FROM p{rounds}"


@query(_prune_sql())
def prune_unsupported(spark: SparkSession, d: str) -> DataFrame:
    return G.prune(cases(spark, d).select("case_id", "group_id", "variant", "parent_id")).select("case_id", "variant")


@query(f"WITH RECURSIVE c AS ({CASES_SQL}), w AS (SELECT case_id FROM c WHERE case_id % 1000 >= 5 UNION SELECT c.parent_id FROM c JOIN w ON c.case_id = w.case_id WHERE c.parent_id IS NOT NULL) SELECT case_id FROM w")
def dependency_closure(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return G.closure(c.where("case_id % 1000 >= 5"), c)


@query(f"WITH c AS ({CASES_SQL}) SELECT variant, count(*) AS cases, count(DISTINCT group_id) AS families, count(parent_id) AS continuations, count(*) FILTER (role = 'user') AS user_turns FROM c GROUP BY variant")
def suite_summary(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).groupBy("variant").agg(F.count("*").alias("cases"), F.countDistinct("group_id").alias("families"), F.count("parent_id").alias("continuations"), F.count_if(F.col("role") == "user").alias("user_turns"))


@query(f"WITH c AS ({CASES_SQL}) SELECT v.case_id AS variant_case, o.case_id AS original_case, v.variant FROM c v JOIN c o ON o.group_id = v.group_id AND o.variant = 'original' WHERE v.variant <> 'original'")
def variant_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    originals = c.where("variant = 'original'").select("group_id", F.col("case_id").alias("original_case"))
    return c.where("variant <> 'original'").join(originals, "group_id").select(F.col("case_id").alias("variant_case"), "original_case", "variant")


@query(f"WITH c AS ({CASES_SQL}) SELECT a.case_id, CASE WHEN a.parent_id IS NULL THEN 'fresh' WHEN b.case_id IS NULL THEN 'unexpected' ELSE 'continuation' END AS isolation FROM c a LEFT JOIN (SELECT DISTINCT case_id FROM c) b ON b.case_id = a.parent_id")
def isolation_classes(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    known = c.select(F.col("case_id").alias("p")).distinct()
    return c.join(known, F.col("parent_id") == F.col("p"), "left").select("case_id", F.when(F.col("parent_id").isNull(), "fresh").when(F.col("p").isNull(), "unexpected").otherwise("continuation").alias("isolation"))


@query(f"WITH c AS ({CASES_SQL}) SELECT a.case_id, coalesce(b.text || chr(10), '') || a.text AS text FROM c a LEFT JOIN c b ON b.case_id = a.parent_id")
def comparable_texts(spark: SparkSession, d: str) -> DataFrame:
    """A continuation's text behind its parent's."""
    c = cases(spark, d)
    parents = c.select(F.col("case_id").alias("p"), F.col("text").alias("before"))
    return c.join(parents, F.col("parent_id") == F.col("p"), "left").select("case_id", F.concat(F.coalesce(F.concat("before", F.lit("\n")), F.lit("")), "text").alias("text"))


@query(f"""WITH RECURSIVE c AS ({CASES_SQL}), r(case_id, up, texts) AS (SELECT case_id, parent_id, [text] FROM c UNION ALL SELECT r.case_id, c.parent_id, list_prepend(c.text, r.texts) FROM r JOIN c ON c.case_id = r.up)
SELECT case_id, arg_max(array_to_string(texts, chr(10)), len(texts)) AS messages, max(len(texts)) AS n FROM r GROUP BY case_id""")
def replayed_turns(spark: SparkSession, d: str) -> DataFrame:
    """What is sent for a continuation: all that it continues, then its own text."""
    found = G.replayed(cases(spark, d))
    return found.select("case_id", F.array_join("texts", "\n").alias("messages"), F.size("texts").cast("long").alias("n"))


@query("""SELECT dimension, reachable, CASE WHEN NOT reachable THEN 'unreachable' WHEN selected = 0 THEN 'not selected' WHEN scored = 0 THEN 'never scored' WHEN scored < selected THEN 'partly scored' ELSE 'scored' END AS status, selected, scored
FROM (SELECT d.dimension, d.dimension <= 9 AS reachable, count(l_linenumber) AS selected, count(*) FILTER (l_linenumber IS NOT NULL AND round(l_tax * 100) <> 8) AS scored
      FROM range(1, 11) d(dimension) LEFT JOIN lineitem ON l_linenumber = d.dimension GROUP BY d.dimension)""")
def dimension_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The ten dimensions, those without rows too."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("dimension")).agg(F.count("*").alias("selected"), F.count_if(F.round(F.col("l_tax") * 100) != 8).alias("scored"))
    full = spark.range(1, 11).withColumnRenamed("id", "dimension").join(F.broadcast(rows), "dimension", "left").fillna(0, ["selected", "scored"])
    reach = F.col("dimension") <= 9
    status = F.when(~reach, "unreachable").when(F.col("selected") == 0, "not selected").when(F.col("scored") == 0, "never scored").when(F.col("scored") < F.col("selected"), "partly scored").otherwise("scored")
    return full.select("dimension", reach.alias("reachable"), status.alias("status"), "selected", "scored")


_GIVEN = ("title", "situation", "domain", "provenance", "held_out_rationale")
_FAMILIES_SQL = """SELECT 'f' || (s_suppkey - s_suppkey % 40 // 39) AS family_id, CASE s_suppkey % 6 WHEN 0 THEN 'standard' WHEN 1 THEN 'negative_control' WHEN 2 THEN 'far_transfer' WHEN 3 THEN 'odd' WHEN 4 THEN 'multi_episode' END AS kind, s_name AS title,
  CASE WHEN s_suppkey % 9 > 0 THEN 'scene' ELSE ' ' END AS situation, CASE WHEN s_suppkey % 8 > 0 THEN 'home' END AS domain, 'authored' AS provenance, CASE WHEN s_suppkey % 10 > 0 THEN 'why' ELSE '' END AS held_out_rationale, CASE WHEN s_suppkey % 4 > 0 THEN ['p1'] ELSE []::VARCHAR[] END AS principles_in_play FROM supplier"""
_FAMILY_RULES = {
    "known_kind": "kind IN ('standard', 'principle_conflict', 'negative_control', 'far_transfer', 'multi_episode')", **{f"{c}_given": f"trim({c}) <> ''" for c in _GIVEN},
    "control_without_principles": "kind <> 'negative_control' OR len(principles_in_play) = 0",
}


def _broken_sql(source: str, key: str, rules: dict[str, str], detail: str = "''") -> str:
    return " UNION ALL ".join(f"SELECT {key} AS entity_id, '{r}' AS rule, {detail} AS detail FROM {source} WHERE NOT coalesce({c}, false)" for r, c in rules.items())


def _families(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("s_suppkey")
    kind = F.when(i % 6 == 0, "standard").when(i % 6 == 1, "negative_control").when(i % 6 == 2, "far_transfer").when(i % 6 == 3, "odd").when(i % 6 == 4, "multi_episode")
    return table(spark, d, "supplier").select(
        F.concat(F.lit("f"), (i - F.floor(i % 40 / 39)).cast("string")).alias("family_id"), kind.alias("kind"), F.col("s_name").alias("title"), F.when(i % 9 > 0, "scene").otherwise(" ").alias("situation"), F.when(i % 8 > 0, "home").alias("domain"),
        F.lit("authored").alias("provenance"), F.when(i % 10 > 0, "why").otherwise("").alias("held_out_rationale"), F.when(i % 4 > 0, F.array(F.lit("p1"))).otherwise(F.array().cast("array<string>")).alias("principles_in_play"),
    )


@query(f"WITH f AS ({_FAMILIES_SQL}) {_broken_sql('f', 'family_id', _FAMILY_RULES)} UNION ALL SELECT family_id, 'unique_id', count(*)::VARCHAR FROM f GROUP BY family_id HAVING count(*) > 1")
def family_validation(spark: SparkSession, d: str) -> DataFrame:
    """Families that a suite can't be saved with."""
    return U.family_violations(_families(spark, d))


_VARIED = ("original", "paraphrase", "pressure", "correction", "odd")
_SUITE_SQL = """SELECT 'c' || p_partkey AS case_id, 'f' || p_partkey % 37 AS family_id, CASE p_size % 5 WHEN 0 THEN 'notice' WHEN 1 THEN 'guess' ELSE 'decide' END AS task, ['original', 'paraphrase', 'pressure', 'correction', 'odd'][(p_partkey % 5) + 1] AS variant,
  CASE p_partkey % 7 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['a', ' '] WHEN 2 THEN NULL ELSE ['a turn'] END AS turns, CASE WHEN p_partkey % 5 > 0 OR p_partkey % 11 = 0 THEN CASE p_partkey % 4 WHEN 0 THEN 1 ELSE 0 END END AS expected, CASE WHEN p_partkey % 6 = 0 THEN 'c' || (p_partkey + 1) WHEN p_partkey % 6 = 1 THEN 'none' END AS context_answer_from,
  ['d1', 'd2', 'd3', 'd4', 'd5', 'd6'][:(p_size % 6) + 1] AS dims FROM part"""
_SUITE_RULES = {
    "known_task": "task IN ('notice', 'duties_conflicts', 'boundaries', 'information_seeking', 'critique', 'decide', 'predict', 'diagnose')", "known_variant": "variant IN ('original', 'paraphrase', 'irrelevant_change', 'relevant_change', 'pressure', 'correction')",
    "turns_filled": "turns IS NULL OR len(list_filter(turns, lambda t: trim(t) = '')) = 0", "expectation_if_variant": "(expected IS NOT NULL) = (variant <> 'original')", "expectation_fits": "expected IS NULL OR (expected = 1) = (variant IN ('relevant_change', 'correction'))",
    "continuation_supported": "variant NOT IN ('pressure', 'correction') OR coalesce(len(turns), 0) > 0 OR context_answer_from IS NOT NULL", "three_to_five_dimensions": "len(dims) BETWEEN 3 AND 5", "all_anchored": "len(list_filter(dims, lambda x: x = 'd4')) = 0",
}


@query(
    f"WITH c AS ({_SUITE_SQL}), f AS ({_FAMILIES_SQL}) {_broken_sql('c', 'case_id', _SUITE_RULES)} UNION ALL SELECT case_id, 'family_exists', family_id FROM c WHERE family_id NOT IN (SELECT family_id FROM f) "
    "UNION ALL SELECT case_id, 'context_exists', context_answer_from FROM c WHERE context_answer_from IS NOT NULL AND context_answer_from NOT IN (SELECT case_id FROM c) "
    "UNION ALL SELECT case_id, 'has_original', variant FROM c ANTI JOIN (SELECT DISTINCT family_id, task FROM c WHERE variant = 'original') o USING (family_id, task) WHERE variant <> 'original'"
)
def case_validation(spark: SparkSession, d: str) -> DataFrame:
    """Cases that a suite can't be saved with."""
    i, size, none = F.col("p_partkey"), F.col("p_size"), F.array().cast("array<string>")
    turns = F.when(i % 7 == 0, none).when(i % 7 == 1, F.array(F.lit("a"), F.lit(" "))).when(i % 7 != 2, F.array(F.lit("a turn")))
    expected = F.when((i % 5 > 0) | (i % 11 == 0), F.struct(F.lit("w").alias("what_changed"), (i % 4 == 0).alias("should_change"), F.lit("").alias("expected_direction"), F.lit("j").alias("justification")))
    dims = F.slice(F.array(*(F.lit(f"d{k}") for k in range(1, 7))), 1, (size % 6 + 1).cast("int"))
    anchors = F.transform(dims, lambda x: F.struct(x.alias("dimension"), F.lit("0").alias("score_0"), F.when(x == "d4", " ").otherwise("1").alias("score_1"), F.lit("2").alias("score_2")))
    some = F.array(F.lit("x"))
    cases = table(spark, d, "part").select(
        F.concat(F.lit("c"), i.cast("string")).alias("case_id"), F.concat(F.lit("f"), (i % 37).cast("string")).alias("family_id"), F.when(size % 5 == 0, "notice").when(size % 5 == 1, "guess").otherwise("decide").alias("task"),
        F.get(F.array(*map(F.lit, _VARIED)), (i % 5).cast("int")).alias("variant"), turns.alias("turns"),
        F.struct(dims.alias("dimensions"), some.alias("must_notice"), none.alias("must_not_infer"), some.alias("acceptable_outputs"), none.alias("unacceptable_reasoning"), anchors.alias("anchors"), none.alias("unscorable_if")).alias("rubric"),
        expected.alias("change_expectation"), F.when(i % 6 == 0, F.concat(F.lit("c"), (i + 1).cast("string"))).when(i % 6 == 1, "none").alias("context_answer_from"),
    )
    return U.case_violations(cases, _families(spark, d))
