"""Suites as files: a JSON document of families and cases, saved only if valid, and loaded with the same checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions.hashing import canonical_json, content_hash
from assayframe.operators import validate as R

FAMILIES = "family_id string, kind string, title string, situation string, domain string, provenance string, held_out_rationale string, principles_in_play array<string>, notes string"
CASES = (
    "case_id string, family_id string, task string, variant string, turns array<string>, rubric struct<dimensions:array<string>,must_notice:array<string>,must_not_infer:array<string>,"
    "acceptable_outputs:array<string>,unacceptable_reasoning:array<string>,anchors:array<struct<dimension:string,score_0:string,score_1:string,score_2:string>>,unscorable_if:array<string>>,"
    "change_expectation struct<what_changed:string,should_change:boolean,expected_direction:string,justification:string>, context_answer_from string"
)
# The vocabularies of suites.
TASKS = ("notice", "duties_conflicts", "boundaries", "information_seeking", "critique", "decide", "predict", "diagnose")
VARIANTS = ("original", "paraphrase", "irrelevant_change", "relevant_change", "pressure", "correction")
KINDS = ("standard", "principle_conflict", "negative_control", "far_transfer", "multi_episode")
MOVING = ("relevant_change", "correction")
CONTINUING = ("pressure", "correction")


class InvalidSuite(ValueError):
    """A suite with violations; the message names the first of them."""


def family_violations(families: DataFrame) -> DataFrame:
    given = {f"{c}_given": F.trim(c) != "" for c in ("title", "situation", "domain", "provenance", "held_out_rationale")}
    control = (F.col("kind") != "negative_control") | (F.coalesce(F.size("principles_in_play"), F.lit(0)) <= 0)
    return R.union(R.violations(families, "family_id", {"known_kind": F.col("kind").isin(*KINDS), **given, "control_without_principles": control}), R.duplicates(families, "family_id"))


def case_violations(cases: DataFrame, families: DataFrame) -> DataFrame:
    variant, expected = F.col("variant"), F.col("change_expectation")
    filled = lambda a: F.coalesce(F.forall(a, lambda t: F.trim(t) != ""), F.lit(True))
    r = F.col("rubric")
    anchored = F.transform(F.filter(r["anchors"], lambda a: (F.trim(a["score_0"]) != "") & (F.trim(a["score_1"]) != "") & (F.trim(a["score_2"]) != "")), lambda a: a["dimension"])
    rules = {
        "known_task": F.col("task").isin(*TASKS),
        "known_variant": variant.isin(*VARIANTS),
        "turns_filled": filled(F.col("turns")),
        "expectation_if_variant": expected.isNotNull() == (variant != "original"),
        "expectation_fits": expected.isNull() | (expected["should_change"] == variant.isin(*MOVING)),
        "continuation_supported": ~variant.isin(*CONTINUING) | (F.coalesce(F.size("turns"), F.lit(0)) > 0) | F.col("context_answer_from").isNotNull(),
        **R.rubric_rules(r["dimensions"], r["dimensions"], anchored, r["must_notice"], r["acceptable_outputs"]),
    }
    return R.union(
        R.violations(cases, "case_id", rules), R.duplicates(cases, "case_id"), R.missing_keys(cases, "case_id", "family_id", families, "family_id", "family_exists"),
        R.missing_keys(cases, "case_id", "context_answer_from", cases, "case_id", "context_exists"), R.without_original(cases, ["family_id", "task"]),
    )


def version(cases: DataFrame) -> DataFrame:
    """One row: a hash over the cases' own hashes, combined by exclusive-or in four parts, so that cases of any number are never together in one task."""
    # The order in which fields come, at any depth, doesn't count.
    own = cases.select(F.sha2(canonical_json(F.struct(*cases.columns), cases.schema), 256).alias("h"))
    parts = [F.bit_xor(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("long")).cast("string") for k in range(4)]
    return own.agg(content_hash(F.concat_ws(",", F.count("*").cast("string"), *parts)).alias("version"))


def _gate(families: DataFrame, cases: DataFrame) -> None:
    first = R.union(family_violations(families), case_violations(cases, families)).orderBy("entity_id", "rule").first()
    if first:
        raise InvalidSuite(f"{first['entity_id']}: {first['rule']} {first['detail']}".strip())


def save_suite(families: DataFrame, cases: DataFrame, path: str) -> None:
    """Writes both tables as JSON lines below path, or nothing if there is a violation."""
    _gate(families, cases)
    families.write.json(f"{path}/families")
    cases.write.json(f"{path}/cases")
    version(cases).write.json(f"{path}/version")


def load_suite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, bool]:
    """(families, cases, stale): stale if the stored version isn't that of the cases."""
    families, cases = spark.read.schema(FAMILIES).json(f"{path}/families"), spark.read.schema(CASES).json(f"{path}/cases")
    _gate(families, cases)
    return families, cases, spark.read.schema("version string").json(f"{path}/version").first() != version(cases).first()
