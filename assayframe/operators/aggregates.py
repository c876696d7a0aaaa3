"""Grouped summaries of scores. Every rate has its count of cases and families beside it; null is never zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_CELL_N = 5


def rate(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6)


def score_stats(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, mean, the histogram of 0, 1 and 2, unscorable entries, and distinct cases and families."""
    s = F.col("score")
    return scores.groupBy(*by).agg(
        F.count(s).alias("n"), F.round(F.avg(s.cast("double")), 6).alias("mean"),
        F.count_if(s == 0).alias("n0"), F.count_if(s == 1).alias("n1"), F.count_if(s == 2).alias("n2"), F.count_if(s.isNull()).alias("unscorable_n"),
        F.countDistinct("case_id").alias("cases"), F.countDistinct("family_id").alias("families"),
    )


def dense(df: DataFrame, axes: Sequence[DataFrame], counts: Sequence[str]) -> DataFrame:
    """df on a full grid of its axes (small vocabularies), with zero in counts where a cell has no rows.

    The grid is the product of vocabularies, which don't grow with the data.
    """
    grid = axes[0]
    for a in axes[1:]:
        names = [*grid.columns]
        packed = a.agg(F.collect_set(F.struct(*a.columns)).alias("_x"))
        grid = grid.withColumn("_one", F.lit(1)).join(F.broadcast(packed.withColumn("_one", F.lit(1))), "_one").select(*names, F.inline("_x"))
    keys = grid.columns
    return grid.join(df, keys, "left").fillna(0, list(counts))


def kind_grid(scores: DataFrame) -> DataFrame:
    """Dimension by kind for every arm, empty cells too; interpretable from MIN_CELL_N on."""
    cells = scores.groupBy("arm", "dimension", "kind").agg(F.count("score").alias("n"), F.round(F.avg(F.col("score").cast("double")), 6).alias("mean"), F.countDistinct("family_id").alias("families"))
    full = dense(cells, [scores.select(c).distinct() for c in ("arm", "dimension", "kind")], ["n", "families"])
    return full.withColumns({"interpretable": F.col("n") >= MIN_CELL_N, "single_family": F.col("families") == 1})


def flag_scopes(cases: DataFrame, flag: str = "flagged", kinds: Sequence[str] = ()) -> DataFrame:
    """Flag rates of cases by arm over all and by kind, in one pass; kinds asked for are there even without cases."""
    sets = cases.groupingSets([["arm"], ["arm", "kind"]], "arm", "kind").agg(
        F.countDistinct("case_id").alias("cases"), F.countDistinct("family_id").alias("families"), F.count_if(F.col(flag)).alias("flags"), F.count("*").alias("rows"), F.grouping("kind").alias("_all")
    )
    out = sets.withColumn("scope", F.when(F.col("_all") == 1, "all").otherwise(F.col("kind"))).drop("_all", "kind")
    if kinds:
        wanted = cases.select("arm").distinct().withColumn("scope", F.explode(F.array(*map(F.lit, kinds))))
        out = wanted.join(out, ["arm", "scope"], "full").fillna(0, ["cases", "families", "flags", "rows"])
    return out.select("arm", "scope", "cases", "families", "flags", rate(F.col("flags"), F.col("rows")).alias("rate"))


def quota_top_k(df: DataFrame, arm: str, order: Sequence[Column], limit: int) -> DataFrame:
    """The best `limit` rows, but first each arm's share of limit // arms; ranked again at the end.

    Both rankings are cut to the limit, so that no partition of a window grows with the data.
    """
    share = max(1, limit // max(1, df.select(arm).distinct().count()))
    per_arm = df.withColumn("_ra", F.row_number().over(Window.partitionBy(arm).orderBy(*order))).where(F.col("_ra") <= limit)
    filled = per_arm.withColumn("_late", (F.col("_ra") > share).cast("int"))
    picked = filled.orderBy("_late", *order).limit(limit)
    return picked.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("_ra", "_late")


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], limit: int, out: str, value: Column) -> DataFrame:
    """by and out: the values of the first rows of each group, as an array in order. The ranking is cut to the limit before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = df.select(*by, *order, value.alias("_v"), F.row_number().over(w).alias("_at")).where(F.col("_at") <= limit)
    return first.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_v"))), lambda s: s["_v"]).alias(out))


def top_by_count(df: DataFrame, by: Sequence[str], term: str, seen: str, limit: int) -> DataFrame:
    """by, term, n, rank: the commonest terms of each group, of equally common ones the first seen."""
    counts = df.groupBy(*by, term).agg(F.count("*").alias("n"), F.min(seen).alias("_seen"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "_seen"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= limit).drop("_seen")


def ordinal(column: str, vocabulary: Sequence[str]) -> list[Column]:
    """Order by a vocabulary's order, names that it doesn't have last, by name."""
    at = F.array_position(F.array(*map(F.lit, vocabulary)), F.col(column))
    return [F.when(at > 0, at).otherwise(len(vocabulary) + 1), F.col(column)]


CHECK_ENTRY = "struct<kind:string,check:string,passed:boolean,error:string>"


def check_rows(df: DataFrame, payload: str, keys: Sequence[str]) -> DataFrame:
    """keys, check, passed, error: a row for each check of a JSON payload of any of three shapes, a value a check, an object a check, or a list.

    What is none of these is left out. error: whether the check could not run.
    """
    raw = F.from_json(F.col(payload), "map<string,string>")
    listed = F.from_json(F.get_json_object(payload, "$.checks"), f"array<{CHECK_ENTRY}>")
    in_list = F.transform(listed, lambda e: F.struct(F.coalesce(e["kind"], e["check"], F.lit("check")).alias("check"), e["passed"].alias("passed"), (F.coalesce(e["error"], F.lit("false")) != "false").alias("error")))

    def one(e: Column) -> Column:
        inner = F.from_json(e["value"], CHECK_ENTRY)
        whole = F.when(e["value"].isin("true", "false"), e["value"] == "true")
        return F.struct(e["key"].alias("check"), F.coalesce(whole, inner["passed"]).alias("passed"), (F.coalesce(inner["error"], F.lit("false")) != "false").alias("error"))

    every = F.coalesce(in_list, F.transform(F.map_entries(raw), one))
    return df.select(*keys, F.inline(every)).where("error or passed is not null")


def check_stats(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    ran = ~F.col("error")
    n, ok = F.count_if(ran), F.count_if(ran & F.col("passed"))
    return rows.groupBy(*by, "check").agg(n.alias("n"), ok.alias("passed_n"), rate(ok, F.nullif(n, F.lit(0))).alias("rate"), F.count_if("error").alias("errors"), F.countDistinct("family_id").alias("families"))
