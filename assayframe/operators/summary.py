"""Summaries of suites and of changes: many counters in one pass, and the slices that lost most."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = "negative_control"
#: A change of a mean by less is none.
MOVED = 0.001
#: Units from which a slice may be named as the worst.
SOLID = 5


def _cell(counter: str, key: Column | str, n: Column | int = 1) -> Column:
    return F.struct(F.lit(counter).alias("counter"), (F.lit(key) if isinstance(key, str) else key.cast("string")).alias("key"), (F.lit(n) if isinstance(n, int) else n).cast("long").alias("n"))


def suite_counters(families: DataFrame, cases: DataFrame, vocabularies: Mapping[str, Sequence[str]]) -> DataFrame:
    """counter, key, n: how many families and cases there are, by kind, task, variant, domain, measure, dimension and provenance.

    families: family_id, kind, domain, provenance; cases: case_id, family_id, task, variant, measure, is_continuation, dimensions (array), checks (a number).
    Every key of a vocabulary (counter -> keys) is there, with 0 if nothing counts for it. Each table is read once: rows
    are spread into the cells that they count for, and added up before the shuffle.
    """
    known = families.select("family_id", F.col("kind").alias("_kind"), F.col("domain").alias("_domain"))
    per_family = cases.groupBy("family_id").agg(F.count("*").alias("_cases"))
    of_families = families.join(per_family, "family_id", "left").select(
        F.inline(
            F.array(
                _cell("families", ""), _cell("families_by_kind", F.col("kind")), _cell("provenance", F.coalesce(F.nullif(F.split_part("provenance", F.lit(":"), F.lit(1)), F.lit("")), F.lit("authored"))),
                _cell("families_without_cases", "", F.col("_cases").isNull().cast("int")),
            )
        )
    )
    unknown = F.lit("?")
    rows = cases.join(known, "family_id", "left")
    single = F.array(
        _cell("cases", ""), _cell("cases_by_family_kind", F.coalesce("_kind", unknown)), _cell("cases_by_task", F.col("task")), _cell("cases_by_variant", F.col("variant")), _cell("cases_by_domain", F.coalesce("_domain", unknown)),
        _cell("negative_control_cases", "", F.coalesce(F.col("_kind") == CONTROL, F.lit(False)).cast("int")), _cell("continuation_cases", "", F.coalesce("is_continuation", F.lit(False)).cast("int")),
        _cell("deterministic_checks", "", F.coalesce("checks", F.lit(0))),
    )
    measured = F.when(F.coalesce("measure", F.lit("")) != "", F.array(_cell("cases_by_measure", F.col("measure")))).otherwise(F.slice(single, 1, 0))
    covered = F.coalesce(F.transform("dimensions", lambda x: _cell("dimension_coverage", x)), F.slice(single, 1, 0))
    empty = families.sparkSession.createDataFrame([(c, k, 0) for c, keys in vocabularies.items() for k in keys], "counter string, key string, n long")
    counted = of_families.union(rows.select(F.inline(F.concat(single, measured, covered)))).union(empty).groupBy("counter", "key").agg(F.sum("n").alias("n"))
    uncovered = counted.where("counter = 'dimension_coverage'").select(F.inline(F.array(_cell("dimensions_uncovered", "", (F.col("n") == 0).cast("int"))))).groupBy("counter", "key").agg(F.sum("n").alias("n"))
    return counted.union(uncovered)


def cases_per_family(families: DataFrame, cases: DataFrame) -> DataFrame:
    """least, most, mean (two digits) of the cases that a family has, families without any among them; zeros without families."""
    n = F.coalesce("n", F.lit(0))
    per = families.select("family_id").join(cases.groupBy("family_id").agg(F.count("*").alias("n")), "family_id", "left")
    return per.agg(F.coalesce(F.min(n), F.lit(0)).alias("least"), F.coalesce(F.max(n), F.lit(0)).alias("most"), F.coalesce(F.round(F.sum(n) / F.count("*"), 2), F.lit(0.0)).alias("mean"))


def headline(slices: DataFrame) -> DataFrame:
    """A row an arm: slices, regressed and improved ones, and the regressed one that lost most, of those with SOLID units if there are such.

    slices: arm, slice_kind, slice_name, n, families, delta, better, worse.
    """
    lost = F.col("delta") < -MOVED
    entry = F.struct("delta", "slice_kind", "slice_name", "n", "families", "better", "worse")
    told = slices.groupBy("arm").agg(
        F.count("*").alias("slices"), F.count_if(lost).alias("regressed"), F.count_if(F.col("delta") > MOVED).alias("improved"),
        F.min(F.when(lost & (F.col("n") >= SOLID), entry)).alias("solid"), F.min(F.when(lost, entry)).alias("any"),
    )
    worst = F.coalesce("solid", "any")
    return told.select("arm", "slices", "regressed", "improved", *(worst[c].alias(f"worst_{c}") for c in ("slice_kind", "slice_name", "delta", "n", "families", "better", "worse")), F.col("solid").isNotNull().alias("solid"))
