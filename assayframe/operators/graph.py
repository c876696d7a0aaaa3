"""Forests of continuations: levels, closures and pruning, as loops of joins until nothing changes, with checkpoints in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.session import cut


def levels(cases: DataFrame, case: str = "case_id", parent: str = "parent_id") -> DataFrame:
    """case, level: 0 without a parent among the cases, else one more than the parent's; -1 on or behind a cycle.

    Pointer doubling: each round joins every case with the ancestor it has reached, so a chain of n takes log2(n) rounds.
    A chain is no longer than there are cases; what hasn't come to an end then is on or behind a cycle.
    """
    known = cases.select(F.col(case).alias("case_id"), F.col(parent).alias("parent_id"))
    ids = known.select(F.col("case_id").alias("p"))
    linked = known.join(ids, F.col("parent_id") == F.col("p"), "left").select("case_id", F.col("p").alias("up"), F.when(F.col("p").isNull(), 0).otherwise(1).alias("steps"))
    state, reach = cut(linked), 1
    longest = state.count()
    while reach <= longest and not state.where("up is not null").isEmpty():
        above = state.select(F.col("case_id").alias("c"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        joined = state.join(above, F.col("up") == F.col("c"), "left")
        state = cut(joined.select("case_id", F.col("up2").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps")))
        reach *= 2
    return state.select("case_id", F.when(F.col("up").isNull(), F.col("steps")).otherwise(-1).alias("level"))


def prune(cases: DataFrame, original: str = "original") -> DataFrame:
    """cases without those that lack support: variants whose original is gone and continuations whose parent is gone, until nothing changes.

    cases: case_id, group_id, variant, parent_id (null for none). Each round can only remove, so the count tells when it ends.
    """
    current, n = cut(cases), None
    while True:
        before, n = n, current.count()
        if n == before:
            return current
        originals = current.where(F.col("variant") == original).select("group_id").distinct()
        kept = current.join(originals, "group_id", "left_semi")
        parents = kept.select(F.col("case_id").alias("p")).distinct()
        whole = kept.where("parent_id is null").unionByName(kept.where("parent_id is not null").join(parents, F.col("parent_id") == F.col("p"), "left_semi"))
        current = cut(whole)


def closure(wanted: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id of the wanted cases and of all they depend on, through parent_id."""
    found, new = cut(wanted.select("case_id").distinct()), None
    new = found
    while True:
        up = new.join(cases.select("case_id", "parent_id"), "case_id").where("parent_id is not null").select(F.col("parent_id").alias("case_id")).distinct()
        new = cut(up.join(found, "case_id", "left_anti"))
        if new.isEmpty():
            return found
        found = cut(found.union(new))


def replayed(cases: DataFrame, text: str = "text") -> DataFrame:
    """case_id and texts: the texts of all that a case continues, the first first, and then its own. Cases on or behind a cycle have their own alone.

    Pointer doubling with arrays: each round puts what the ancestor reached has gathered before what a case has, so a chain of n takes log2(n) rounds.
    """
    known = cut(cases.select("case_id", "parent_id", F.array(text).alias("texts")))
    sure = levels(known).where("level > 0").select("case_id")
    sound = levels(known).where("level >= 0").select("case_id")
    roots = known.join(sure, "case_id", "left_anti").select("case_id", "texts", F.lit(None).cast(known.schema["parent_id"].dataType).alias("up"))
    state = cut(known.join(sure, "case_id").select("case_id", "texts", F.col("parent_id").alias("up")).union(roots))
    while not state.where("up is not null").isEmpty():
        above = state.join(sound, "case_id").select(F.col("case_id").alias("c"), F.col("up").alias("up2"), F.col("texts").alias("before"))
        joined = state.join(above, F.col("up") == F.col("c"), "left")
        state = cut(joined.select("case_id", F.concat(F.coalesce("before", F.array().cast("array<string>")), "texts").alias("texts"), F.col("up2").alias("up")))
    return state.select("case_id", "texts")


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: every node of the pairs with the least node that it is joined to, itself included.

    Each node holds a parent. In a round a node and its parent take the least grandparent among the node's neighbours, so trees hook onto
    lower ones, and every node moves up to its grandparent: trees halve in depth while they merge, so rounds grow as the logarithm of the nodes.
    Minima are combined before each shuffle.
    """
    ends = pairs.select(F.col(a).alias("node"), F.col(b).alias("other"))
    edges = cut(ends.union(ends.select("other", "node")).where("node is not null and other is not null").distinct())
    state = cut(edges.select("node").distinct().withColumn("up", F.col("node")))
    while True:
        parents = state.select(F.col("node").alias("up"), F.col("up").alias("top"))
        raised = cut(state.join(parents, "up").select("node", "up", "top"))
        seen = edges.join(raised.select(F.col("node").alias("other"), F.col("top").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        offers = raised.join(seen, "node").select(F.inline(F.array(*(F.struct(F.col(n).alias("node"), F.col(v).alias("up")) for n, v in (("node", "near"), ("up", "near"), ("node", "top"))))))
        moved = cut(offers.groupBy("node").agg(F.min("up").alias("up")))
        if moved.exceptAll(state.select("node", "up")).isEmpty():
            return moved.select("node", F.col("up").alias("root"))
        state = moved
