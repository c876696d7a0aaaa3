"""Integrity rules. Each is a query for its violations: entity_id, rule, detail; a suite is valid if all are empty."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.text import overlap_coefficient, token_set

ANCHOR_OVERLAP, MIN_ANCHOR_TOKENS, MIN_SHARED_TOKENS = 0.85, 3, 2


def violations(df: DataFrame, entity: str, rules: Mapping[str, Column], detail: Column | None = None) -> DataFrame:
    """A row for each entity and rule that doesn't hold. rules: name -> whether it holds; null counts as no."""
    cells = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    told = (detail if detail is not None else F.lit("")).cast("string")
    return df.select(F.col(entity).cast("string").alias("entity_id"), F.explode(F.filter(cells, lambda r: r.isNotNull())).alias("rule"), told.alias("detail"))


def duplicates(df: DataFrame, key: str, rule: str = "unique_id") -> DataFrame:
    many = df.groupBy(F.col(key).cast("string").alias("entity_id")).agg(F.count("*").alias("n")).where("n > 1")
    return many.select("entity_id", F.lit(rule).alias("rule"), F.col("n").cast("string").alias("detail"))


def missing_keys(df: DataFrame, entity: str, key: str, others: DataFrame, other_key: str, rule: str) -> DataFrame:
    """Entities whose key isn't null and isn't among the others'."""
    known = others.select(F.col(other_key).alias("_k"))
    lost = df.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("_k"), "left_anti")
    return lost.select(F.col(entity).cast("string").alias("entity_id"), F.lit(rule).alias("rule"), F.col(key).cast("string").alias("detail"))


def without_original(cases: DataFrame, groups: Sequence[str], variant: str = "variant", original: str = "original") -> DataFrame:
    lost = cases.where(F.col(variant) != original).join(cases.where(F.col(variant) == original).select(*groups), list(groups), "left_anti")
    return lost.select(F.col("case_id").cast("string").alias("entity_id"), F.lit("has_original").alias("rule"), F.col(variant).alias("detail"))


def rubric_rules(dimensions: Column, allowed: Column, anchored: Column, must_notice: Column, acceptable: Column) -> dict[str, Column]:
    """Rules of a rubric: three to five dimensions, allowed for the task, none twice, all anchored, lists not empty."""
    return {
        "three_to_five_dimensions": F.size(dimensions).between(3, 5),
        "dimensions_allowed": F.size(F.array_except(dimensions, allowed)) == 0,
        "no_dimension_twice": F.size(F.array_distinct(dimensions)) == F.size(dimensions),
        "all_anchored": F.size(F.array_except(dimensions, anchored)) == 0,
        "must_notice_given": F.size(must_notice) > 0,
        "acceptable_given": F.size(acceptable) > 0,
    }


# Words that tell nothing of a particular situation.
GENERIC_WORDS = tuple(
    """
    that this with from have been they them their there then than what when where which while
    would could should must will been being does doing into onto only also just like about
    over under after before between during because since such each both same other others
    more most many much some any all not but and the for its it's who whom whose
    role roles relationship relationships obligation obligations duty duties responsibility
    responsibilities harm harms severity urgency urgent serious stake stakes stakeholder
    stakeholders consideration considerations party parties person people situation situations
    context factor factors circumstance circumstances involved present important matter matters
    notice notices noticing recognise recognises recognize recognizes identify identifies
    acknowledge acknowledges concern concerns interest interests value values principle
    principles moral morally ethical ethically answer answers reply response model
    needs need take takes make makes give gives states state name names naming mention mentions
    """.split()
)
MIN_DISTINCTIVE_CHARS = 4


def distinctive(text: Column) -> Column:
    """The tokens of text that can only come from its own situation."""
    long = F.filter(token_set(text), lambda t: F.length(t) >= MIN_DISTINCTIVE_CHARS)
    return F.array_except(long, F.array(*map(F.lit, GENERIC_WORDS)))


def grounded(entry: Column, situation: Column) -> Column:
    """Whether an entry shares at least two distinctive tokens with the situation."""
    return F.size(F.array_intersect(distinctive(entry), token_set(situation))) >= MIN_SHARED_TOKENS


def discriminating(low: Column, high: Column, overlap: float = ANCHOR_OVERLAP) -> Column:
    """Whether two anchors differ enough to tell answers apart."""
    a, b = token_set(low), token_set(high)
    return (F.least(F.size(a), F.size(b)) < MIN_ANCHOR_TOKENS) | (F.coalesce(overlap_coefficient(a, b), F.lit(0.0)) <= overlap)


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
