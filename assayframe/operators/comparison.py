"""Paired comparisons of arms with a baseline, and the four-cell comparisons of two graders or two standards.

Both pair by one grouped pass with conditional aggregates: a shuffle with partial sums
instead of self-joins, whatever the number of arms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.stats import exact_mean, sign_test_p

SMALL_N = 20
DEAD_BAND = 1e-9


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by an explicit order: a minimum with partial aggregation, not a sorted window."""
    rest = [c for c in df.columns if c not in keys]
    head = F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_r")
    return df.groupBy(*keys).agg(head).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def case_means(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean score of each case of each arm, by further columns such as the dimension group."""
    return scores.where("score is not null").groupBy("arm", "case_id", "family_id", *by).agg(F.avg(F.col("score").cast("double")).alias("score"))


def pairs(values: DataFrame, baseline: str, unit: Sequence[str], value: str = "score", keep: Sequence[str] = ()) -> DataFrame:
    """arm, unit, family_id, keep..., before and after for every unit that both the baseline and the arm have."""
    spread = values.groupBy(*unit, "family_id", *keep).agg(
        F.avg(F.when(F.col("arm") == baseline, F.col(value).cast("double"))).alias("before"),
        F.collect_list(F.when(F.col("arm") != baseline, F.struct("arm", F.col(value).cast("double").alias("after")))).alias("others"),
    )
    return spread.where("before is not null").select(*unit, "family_id", *keep, "before", F.inline("others"))


def change(paired: DataFrame, by: Sequence[str]) -> DataFrame:
    """Change statistics of paired rows by arm and further columns: n, families, means, delta, better, worse, level, sign_p, small."""
    gap = F.col("after") - F.col("before")
    out = paired.groupBy("arm", *by).agg(
        F.count("*").alias("n"),
        F.countDistinct("family_id").alias("families"),
        exact_mean(F.col("before")).alias("mean_before"),
        exact_mean(F.col("after")).alias("mean_after"),
        F.count_if(gap > DEAD_BAND).alias("better"),
        F.count_if(gap < -DEAD_BAND).alias("worse"),
    )
    return out.select(
        "arm", *by, "n", "families",
        F.round("mean_before", 6).alias("mean_before"), F.round("mean_after", 6).alias("mean_after"), F.round(F.col("mean_after") - F.col("mean_before"), 6).alias("delta"),
        "better", "worse", (F.col("n") - F.col("better") - F.col("worse")).alias("level"),
        F.round(sign_test_p(F.col("better"), F.col("worse")), 6).alias("sign_p"), (F.col("n") < SMALL_N).alias("small"),
    )


def four_cells(values: DataFrame, unit: Sequence[str], row: Column, column: Column, value: str = "score", keep: Sequence[str] = ()) -> DataFrame:
    """unit, keep... and c00, c01, c10, c11: the mean value where row and column (booleans) hold; only units with all four."""
    v = F.col(value).cast("double")
    cells = {f"c{int(r)}{int(c)}": F.avg(F.when((row == F.lit(r)) & (column == F.lit(c)), v)) for r in (False, True) for c in (False, True)}
    out = values.groupBy(*unit, *keep).agg(*(x.alias(k) for k, x in cells.items()))
    return out.where(" and ".join(f"{k} is not null" for k in cells))


def difference_of_differences(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """By columns: n, both gaps (column 1 minus 0 in rows 0 and 1), their difference, and how many units go either way."""
    first, second = F.col("c01") - F.col("c00"), F.col("c11") - F.col("c10")
    return cells.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(exact_mean(first), 6).alias("gap_first"),
        F.round(exact_mean(second), 6).alias("gap_second"),
        F.round(exact_mean(second - first), 6).alias("difference"),
        F.count_if(second - first > DEAD_BAND).alias("wider"),
        F.count_if(second - first < -DEAD_BAND).alias("narrower"),
    )


def losses(scores: DataFrame, baseline: str) -> DataFrame:
    """arm, both, baseline_only, arm_only: which cases pairing keeps and loses."""
    cases = scores.groupBy("case_id").agg(F.max(F.col("arm") == baseline).alias("has_base"), F.collect_set("arm").alias("arms"))
    per_arm = cases.select("has_base", F.explode("arms").alias("arm")).where(F.col("arm") != baseline)
    held = per_arm.groupBy("arm").agg(F.count_if("has_base").alias("both"), F.count_if(~F.col("has_base")).alias("arm_only"))
    base = cases.where("has_base").count()
    return held.withColumn("baseline_only", F.lit(base) - F.col("both")).select("arm", "both", "baseline_only", "arm_only")
