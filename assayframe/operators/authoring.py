"""Rules that a plan adds for authored families, cases, capability items and situation keys. Each gives its violations, as in validate."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions import text as X
from assayframe.operators import validate as R
from assayframe.operators.similarity import best_jaccard

MIN_SENTENCES, MAX_SENTENCES = 3, 8
MIN_ACCEPTABLE, MIN_CONTROL_LIMITS, MIN_FRESH_CHARS = 2, 2, 80
MAX_SETTING_WORDS = 6
CONTROL = "negative_control"
# The families and tags of capability items.
ITEM_FAMILIES = ("instruction_following", "math", "coding")
ITEM_TAGS = ("format", "length", "forbidden", "literal", "moral_pull", "arithmetic", "word_problem", "function")
# Settings that name no particular place.
GENERIC_SETTINGS = (
    "workplace", "work", "office", "home", "family", "family home", "school", "hospital", "company", "business", "organisation", "organization", "team", "community", "house",
    "workplace setting", "professional setting", "family setting", "online",
)


def filled(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) != ""


def uncued(text: Column, terms: Sequence[str]) -> Column:
    """Whether text names none of the terms."""

    def none_in(normal: Column) -> Column:
        out = F.lit(True)
        for t in terms:
            out = out & ~X.contains_term(normal, t, stemmed=True)
        return out

    return X.bound(X.normalise(text), none_in)


def cites(text: Column, ids: Sequence[str]) -> Column:
    """Whether text holds one of the ids as a word of its own."""
    return text.rlike(rf"\b(?:{'|'.join(map(re.escape, ids))})\b") if ids else F.lit(False)


def family_rules(families: DataFrame, cue_terms: Sequence[str]) -> DataFrame:
    """Violations of uncued, sentences (authored ones have 3 to 8), hardness (authored ones say why they are hard) and principles (all but controls have some).

    families: family_id, kind, provenance, situation, notes, principles_in_play.
    """
    authored, control = F.col("provenance") == "authored", F.col("kind") == CONTROL
    sentences = X.bound(X.count_sentences(F.col("situation")), lambda n: n.between(MIN_SENTENCES, MAX_SENTENCES))
    rules = {
        "uncued": uncued(F.col("situation"), cue_terms),
        "three_to_eight_sentences": ~authored | sentences,
        "says_why_it_is_hard": ~authored | filled(F.col("notes")),
        "principles_in_play": control | (F.coalesce(F.size("principles_in_play"), F.lit(0)) > 0),
    }
    return R.violations(families, "family_id", rules)


def training_overlaps(families: DataFrame, training: DataFrame, training_id: str, limit: float, text: str = "situation") -> DataFrame:
    """Violations of families whose situation is as like a training prompt as the limit or more; detail names the prompt."""
    near = best_jaccard(families, training.withColumnRenamed(training.columns[1], text), "family_id", training_id, text).where(F.col("similarity") >= limit)
    return near.select(F.col("case_id").cast("string").alias("entity_id"), F.lit("apart_from_training").alias("rule"), F.col("best_id").cast("string").alias("detail"))


def case_rules(cases: DataFrame, cue_terms: Sequence[str], principle_ids: Sequence[str]) -> DataFrame:
    """Violations of what a plan asks of cases beyond their schema.

    cases: case_id, kind, continuation, turns, situation and the rubric's lists must_notice, must_not_infer, acceptable_outputs,
    unacceptable_reasoning and unscorable_if.
    """
    lists = ("must_notice", "must_not_infer", "acceptable_outputs", "unacceptable_reasoning", "unscorable_if")
    size = {c: F.coalesce(F.size(c), F.lit(0)) for c in lists}
    control = F.col("kind") == CONTROL
    rubric = F.concat_ws("\n", *lists)
    first = F.coalesce(F.get("turns", F.lit(0)), F.lit(""))
    scene = F.concat_ws("\n", F.col("situation"), F.col("turns"))
    rules = {
        "must_not_infer_given": size["must_not_infer"] > 0,
        "unacceptable_reasoning_given": size["unacceptable_reasoning"] > 0,
        "unscorable_if_given": size["unscorable_if"] > 0,
        "two_acceptable_outputs": size["acceptable_outputs"] >= MIN_ACCEPTABLE,
        "controls_limit_twice": ~control | (size["must_not_infer"] >= MIN_CONTROL_LIMITS),
        "cites_a_principle": control | cites(rubric, principle_ids),
        "turns_uncued": uncued(F.concat_ws("\n", "turns"), cue_terms),
        "fresh_turn_carries_the_situation": F.col("continuation") | (first == "") | (F.length(first) >= MIN_FRESH_CHARS),
        "must_notice_grounded": F.forall(F.coalesce("must_notice", F.array().cast("array<string>")), lambda e: R.grounded(e, scene)),
    }
    return R.violations(cases, "case_id", rules)


def item_rules(items: DataFrame) -> DataFrame:
    """Violations of a set of capability items: check_id, family, prompt, verifier, description, tags."""
    rules = {f"{c}_given": filled(F.col(c)) for c in ("check_id", "prompt", "verifier", "description")}
    rules |= {"known_family": F.col("family").isin(*ITEM_FAMILIES), "known_tags": F.size(F.array_except(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, ITEM_TAGS)))) == 0}
    return R.union(R.violations(items, "check_id", rules), R.duplicates(items, "check_id"))


def items_for(items: DataFrame, families: Sequence[str] | None = None, tags: Sequence[str] | None = None) -> DataFrame:
    """The items of some families that carry one of some tags; None asks for any."""
    out = items if families is None else items.where(F.col("family").isin(*families))
    return out if tags is None else out.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)).cast("array<string>")))


def key_rules(keys: DataFrame, tradeoffs: Sequence[str], strict: bool = True) -> DataFrame:
    """Violations of situation keys (family_id, setting, relationship, tradeoff), with severity: without a setting or relationship families can't be told apart.

    strict: the others, which are of quality, too.
    """
    setting = X.key_part(F.col("setting"))
    bearing = {"setting_given": setting != "", "relationship_given": X.key_part(F.col("relationship")) != ""}
    words = F.size(F.filter(F.split(F.coalesce("setting", F.lit("")), r"\s+"), lambda w: w != ""))
    generic = setting.isin(*GENERIC_SETTINGS)
    quality = {"setting_particular": ~generic, "setting_short": generic | (words <= MAX_SETTING_WORDS)}
    if tradeoffs:
        quality["known_tradeoff"] = F.col("tradeoff").isin(*tradeoffs)
    found = R.violations(keys, "family_id", bearing).withColumn("severity", F.lit("load_bearing"))
    return found.unionByName(R.violations(keys, "family_id", quality).withColumn("severity", F.lit("quality"))) if strict else found
