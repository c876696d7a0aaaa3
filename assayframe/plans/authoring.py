"""Queries of the rules for authored suites: families, cases, capability items and situation keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.operators import authoring as W
from assayframe.operators import validate as R
from assayframe.plans.registry import query
from assayframe.plans.texts import LEXICAL, NORMAL, _term, sentences_sql
from assayframe.sources.adapters import table

CUES = ("than", "sch")
_KIND_SQL = "CASE WHEN doc_id % 3 = 0 THEN 'negative_control' ELSE 'standard' END"
_UNCUED = "NOT (" + " OR ".join(_term(t, True) for t in CUES) + ")"
OVERLAP = 0.5


def _violations_sql(source: str, key: str, rules: dict[str, str], more: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {key}::VARCHAR AS entity_id, '{r}' AS rule, '' AS detail{more} FROM {source} WHERE NOT coalesce({c}, false)" for r, c in rules.items())


_FAMILY_RULES = {
    "uncued": _UNCUED, "three_to_eight_sentences": f"provenance <> 'authored' OR sentences BETWEEN 3 AND 8", "says_why_it_is_hard": "provenance <> 'authored' OR trim(coalesce(notes, '')) <> ''",
    "principles_in_play": "kind = 'negative_control' OR doc_id % 5 <> 0",
}


@query(
    f"WITH f AS (SELECT doc_id, text, {NORMAL} AS s, {_KIND_SQL} AS kind, CASE WHEN doc_id % 2 = 0 THEN 'authored' ELSE 'external' END AS provenance, CASE doc_id % 7 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE 'hard' END AS notes, sentences FROM documents JOIN ({sentences_sql('documents', 'doc_id')}) USING (doc_id)), {LEXICAL} "
    + _violations_sql("f", "doc_id", _FAMILY_RULES)
    + f" UNION ALL SELECT case_id::VARCHAR, 'apart_from_training', best_id::VARCHAR FROM r WHERE similarity >= {OVERLAP}"
)
def authored_families(spark: SparkSession, d: str) -> DataFrame:
    """Families that break a plan's rules: cues, length, reasons, principles, and nearness to training prompts."""
    i = F.col("doc_id")
    families = table(spark, d, "documents").select(
        i.alias("family_id"), F.col("text").alias("situation"), F.when(i % 3 == 0, W.CONTROL).otherwise("standard").alias("kind"), F.when(i % 2 == 0, "authored").otherwise("external").alias("provenance"),
        F.when(i % 7 == 0, "  ").when(i % 7 != 1, "hard").alias("notes"), F.when(i % 5 != 0, F.array(F.lit("p1"))).otherwise(F.array().cast("array<string>")).alias("principles_in_play"),
    )
    return R.union(W.family_rules(families, CUES), W.training_overlaps(families, table(spark, d, "benchmark").select("item_id", "text"), "item_id", OVERLAP))


_GENERIC = ", ".join("'" + w.replace("'", "''") + "'" for w in R.GENERIC_WORDS)
_TOKENS_OF = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'))"
_SCENE = "concat_ws(chr(10), situation, text)"
_CASE_RULES = {
    "must_not_infer_given": "len(mni) > 0", "unacceptable_reasoning_given": "true", "unscorable_if_given": "turn % 4 <> 1", "two_acceptable_outputs": "turn % 3 <> 0", "controls_limit_twice": "kind <> 'negative_control' OR len(mni) >= 2",
    "cites_a_principle": "kind = 'negative_control' OR regexp_matches(concat_ws(chr(10), note, array_to_string(mni, chr(10)), CASE WHEN turn % 2 = 0 THEN 'accept (P-1)' ELSE 'accept P-12' END), '\\b(?:P-1|P-2)\\b')",
    "turns_uncued": _UNCUED, "fresh_turn_carries_the_situation": "turn > 0 OR text = '' OR length(text) >= 80",
    "must_notice_grounded": f"len(list_intersect(list_filter({_TOKENS_OF.format('note')}, lambda t: length(t) >= 4 AND NOT list_contains([{_GENERIC}], t)), {_TOKENS_OF.format(_SCENE)})) >= 2",
}


@query(
    f"""WITH b AS (SELECT conv_id * 1000 + turn AS case_id, turn, coalesce(text, '') AS text, 'a scene with people' AS situation, CASE WHEN conv_id % 4 = 0 THEN 'negative_control' ELSE 'standard' END AS kind,
  CASE turn % 3 WHEN 0 THEN ['one limit'] WHEN 1 THEN ['one limit', 'another'] ELSE []::VARCHAR[] END AS mni, 'roles and duties of ' || substr(coalesce(text, ''), 1, 60) AS note FROM conversations), c AS (SELECT *, {NORMAL} AS s FROM b) """
    + _violations_sql("c", "case_id", _CASE_RULES)
)
def authored_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases that break a plan's rules: lists too short, no principle cited, cues, a first turn without its situation, entries that fit any situation."""
    t, text = F.col("turn"), F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    cases = table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + t).alias("case_id"), F.when(F.col("conv_id") % 4 == 0, W.CONTROL).otherwise("standard").alias("kind"), (t > 0).alias("continuation"), F.array(text).alias("turns"), F.lit("a scene with people").alias("situation"),
        F.array(F.concat(F.lit("roles and duties of "), F.substring(text, 1, 60))).alias("must_notice"),
        F.when(t % 3 == 0, F.array(F.lit("one limit"))).when(t % 3 == 1, F.array(F.lit("one limit"), F.lit("another"))).otherwise(none).alias("must_not_infer"),
        F.when(t % 3 == 0, F.array(F.when(t % 2 == 0, "accept (P-1)").otherwise("accept P-12"))).otherwise(F.array(F.when(t % 2 == 0, "accept (P-1)").otherwise("accept P-12"), F.lit("or this"))).alias("acceptable_outputs"),
        F.array(F.lit("a route")).alias("unacceptable_reasoning"), F.when(t % 4 != 1, F.array(F.lit("if empty"))).alias("unscorable_if"),
    )
    return W.case_rules(cases, CUES, ("P-1", "P-2"))


_ITEM_SQL = """SELECT CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE 'c' || p_partkey // 2 * (p_partkey % 9) END AS check_id, ['instruction_following', 'math', 'coding', 'poetry'][(p_partkey % 4) + 1] AS family, p_name AS prompt, CASE WHEN p_size % 10 > 0 THEN 'max_words' END AS verifier,
  CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type END AS description, CASE p_partkey % 3 WHEN 0 THEN ['format', 'length'] WHEN 1 THEN ['function'] ELSE ['length', 'odd'] END AS tags FROM part"""
_ITEM_RULES = {
    "check_id_given": "trim(check_id) <> ''", "prompt_given": "trim(coalesce(prompt, '')) <> ''", "verifier_given": "trim(coalesce(verifier, '')) <> ''", "description_given": "trim(coalesce(description, '')) <> ''",
    "known_family": "family IN ('instruction_following', 'math', 'coding')", "known_tags": f"len(list_filter(tags, lambda t: NOT list_contains([{', '.join(map(repr, W.ITEM_TAGS))}], t))) = 0",
}


def _items(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    families = F.array(*map(F.lit, (*W.ITEM_FAMILIES, "poetry")))
    tags = F.when(k % 3 == 0, F.array(F.lit("format"), F.lit("length"))).when(k % 3 == 1, F.array(F.lit("function"))).otherwise(F.array(F.lit("length"), F.lit("odd")))
    return table(spark, d, "part").select(
        F.when(k % 50 == 0, " ").otherwise(F.concat(F.lit("c"), (F.floor(k / 2) * (k % 9)).cast("string"))).alias("check_id"), F.get(families, (k % 4).cast("int")).alias("family"), F.col("p_name").alias("prompt"),
        F.when(size % 10 > 0, "max_words").alias("verifier"), F.when(size % 7 == 0, "").otherwise(F.col("p_type")).alias("description"), tags.alias("tags"),
    )


@query(f"WITH i AS ({_ITEM_SQL}) " + _violations_sql("i", "check_id", _ITEM_RULES) + " UNION ALL SELECT check_id, 'unique_id', count(*)::VARCHAR FROM i GROUP BY check_id HAVING count(*) > 1")
def capability_items(spark: SparkSession, d: str) -> DataFrame:
    """Capability items that aren't well formed."""
    return W.item_rules(_items(spark, d))


@query(f"WITH i AS ({_ITEM_SQL}) SELECT check_id, family, array_to_string(tags, ',') AS tags FROM i WHERE family IN ('math', 'coding') AND len(list_intersect(tags, ['length', 'literal'])) > 0")
def selected_items(spark: SparkSession, d: str) -> DataFrame:
    """The items of two families with one of two tags."""
    return W.items_for(_items(spark, d), ("math", "coding"), ("length", "literal")).select("check_id", "family", F.array_join("tags", ",").alias("tags"))


_SETTINGS = ("The Office", "a housing co-op board", "", "Ward", "the big room behind the old town hall", "hospital", "!!", "a long way off in the north of town")
_KEY_SQL = "regexp_replace(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), '^(?:the|a|an) ', '')"
_GENERIC_SETTINGS = ", ".join(map(repr, W.GENERIC_SETTINGS))


@query(
    f"WITH k AS (SELECT s_suppkey AS family_id, [{', '.join(map(repr, _SETTINGS))}][(s_suppkey % {len(_SETTINGS)}) + 1] AS setting, CASE WHEN s_suppkey % 6 = 0 THEN ' ' ELSE 'cousins' END AS relationship, 't' || s_suppkey % 4 AS tradeoff FROM supplier) "
    + _violations_sql("k", "family_id", {"setting_given": _KEY_SQL.format("setting") + " <> ''", "relationship_given": "trim(relationship) <> ''"}, ", 'load_bearing' AS severity")
    + " UNION ALL "
    + _violations_sql(
        "k", "family_id",
        {"setting_particular": f"{_KEY_SQL.format('setting')} NOT IN ({_GENERIC_SETTINGS})", "setting_short": f"{_KEY_SQL.format('setting')} IN ({_GENERIC_SETTINGS}) OR len(list_filter(string_split(setting, ' '), lambda w: w <> '')) <= 6", "known_tradeoff": "tradeoff IN ('t0', 't1', 't2')"},
        ", 'quality' AS severity",
    )
)
def key_problems(spark: SparkSession, d: str) -> DataFrame:
    """Situation keys that can't tell families apart, and those that could be better."""
    i = F.col("s_suppkey")
    setting = F.get(F.array(*map(F.lit, _SETTINGS)), (i % len(_SETTINGS)).cast("int"))
    keys = table(spark, d, "supplier").select(i.alias("family_id"), setting.alias("setting"), F.when(i % 6 == 0, " ").otherwise("cousins").alias("relationship"), F.concat(F.lit("t"), (i % 4).cast("string")).alias("tradeoff"))
    return W.key_rules(keys, ("t0", "t1", "t2"))
