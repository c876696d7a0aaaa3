"""Decisions over the few names of a run: arms, graders, settings and plans. They work on vocabularies, not on rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names that mean the baseline.
BASELINE_NAMES = ("base", "baseline", "before")


def parse_arms(text: str) -> dict[str, str]:
    """`a=x,b=y` as a mapping; names are needed and can't repeat."""
    out: dict[str, str] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, eq, value = (x.strip() for x in part.partition("="))
        if not name or not eq or not value or name in out:
            raise ValueError(f"not an arm: {part!r}")
        out[name] = value
    return out


def pick_baseline(arms: Sequence[str], requested: str | None = None) -> str | None:
    """The arm asked for if it is there, else one that is named like a baseline, else the first."""
    if requested in arms:
        return requested
    return next((a for b in BASELINE_NAMES for a in arms if a.lower() == b), arms[0] if arms else None)


def resolve(wanted: str, known: Sequence[str]) -> tuple[str | None, str]:
    """(name, note): the known name that is meant, equal or the only one that holds it in any case."""
    if wanted in known:
        return wanted, ""
    held = [k for k in known if wanted.lower() in k.lower()]
    return (held[0], f"{wanted!r} read as {held[0]!r}") if len(held) == 1 else (None, f"{wanted!r} fits {len(held)} of {len(known)}")


def judge_pairs(primary: Sequence[str], later: Sequence[str], curator: str | None = None) -> list[tuple[str, str]]:
    """Graders to compare: the curator, or else each primary one, with every later grader that isn't primary."""
    firsts = [curator] if curator else list(dict.fromkeys(primary))
    return [(a, b) for a in firsts for b in dict.fromkeys(later) if b != a and (b not in primary or curator)]


def plan_problems(
    coverage: Mapping[str, Mapping[str, int]], reachable: Mapping[str, Sequence[str]], required: Sequence[str], kinds: Sequence[str], follows: Mapping[tuple[str, str], str] | None = None, domains: Sequence[str] | None = None
) -> list[str]:
    """What is wrong with a plan of kind -> task -> count.

    Unknown kinds, counts below 0, no families at all, no control, dimensions that no planned task reaches, tasks that follow
    one that their kind doesn't cover (follows: (kind, task) -> task), and no domains, if domains are given.
    """
    out = [f"unknown kind {k}" for k in coverage if k not in kinds]
    out += [f"negative count for {k}/{t}" for k, tasks in coverage.items() for t, n in tasks.items() if n < 0]
    if domains is not None and not domains:
        out.append("no domains")
    if not any(n > 0 for tasks in coverage.values() for n in tasks.values()):
        out.append("no families")
    if not sum(coverage.get("negative_control", {}).values()):
        out.append("no negative control")
    out += [f"{k}/{t} follows {other}, which isn't covered" for (k, t), other in (follows or {}).items() if other not in coverage.get(k, {})]
    planned = {t for tasks in coverage.values() for t, n in tasks.items() if n > 0}
    reached = {d for t in planned for d in reachable.get(t, ())}
    return out + [f"dimension {d} is out of reach" for d in required if d not in reached]


def planned_cases(coverage: Mapping[str, Mapping[str, int]], reachable: Mapping[str, Sequence[str]], dimensions: Sequence[str]) -> dict[str, object]:
    """How many cases a plan asks for, and the dimensions that its tasks can and can't score, in the vocabulary's order."""
    planned = [t for tasks in coverage.values() for t, n in tasks.items() if n > 0]
    reached = {d for t in planned for d in reachable.get(t, ())}
    return {"cases": sum(max(0, n) for tasks in coverage.values() for n in tasks.values()), "reachable": [d for d in dimensions if d in reached], "unreachable": [d for d in dimensions if d not in reached]}


def not_self_grading(rewriter: str, grader: str) -> None:
    if rewriter == grader:
        raise ValueError("the grader has written what it would grade")


def aligned(wanted: DataFrame, payloads: DataFrame, group: str = "group_id", label: str = "label", order: str = "pos") -> DataFrame:
    """wanted with the payload of the same label, those left over being matched by their order within the group."""
    keys = [group, label]
    first = Window.partitionBy(group, label).orderBy(order)
    one = payloads.withColumn("_n", F.row_number().over(first))
    by_label = wanted.join(one.where("_n = 1").select(*keys, F.col("payload"), F.col(order).alias("_used")), keys, "left")
    nth = Window.partitionBy(group).orderBy(order)
    left_over = by_label.where("payload is null").withColumn("_k", F.row_number().over(nth))
    used = by_label.where("payload is not null").select(group, F.col("_used").alias(order))
    spare = payloads.join(used, [group, order], "left_anti").withColumn("_k", F.row_number().over(nth)).select(group, "_k", F.col("payload").alias("_spare"))
    zipped = left_over.join(spare, [group, "_k"], "left").select(*keys, order, F.col("_spare").alias("payload"), F.lit("position").alias("matched_by"))
    return by_label.where("payload is not null").select(*keys, order, "payload", F.lit("label").alias("matched_by")).unionByName(zipped)


def parsed_arms(text: Column) -> Column:
    """parse_arms over a column: a map, or null where a part isn't `name=value` or a name repeats. Blank parts are left out."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    entries = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.substr(p, F.instr(p, "=") + 1, F.length(p))).alias("value"), (F.instr(p, "=") > 0).alias("named")))
    names = F.transform(entries, lambda e: e["key"])
    good = F.forall(entries, lambda e: e["named"] & (e["key"] != "") & (e["value"] != "")) & (F.size(F.array_distinct(names)) == F.size(names))
    return F.when(good, F.map_from_arrays(names, F.transform(entries, lambda e: e["value"])))


def judge_pair_rows(gradings: DataFrame, by: Sequence[str], judge: str = "judge", later: Column | None = None) -> DataFrame:
    """judge_pairs over a table: by, first, second: each grader of record with every later one that isn't of record there. later: which gradings are repeats."""
    seen = gradings.groupBy(*by, judge).agg(F.bool_or(~later).alias("of_record"), F.bool_or(later).alias("repeats"))
    first = seen.where("of_record").select(*by, F.col(judge).alias("first"))
    second = seen.where("repeats and not of_record").select(*by, F.col(judge).alias("second"))
    return first.join(second, list(by))


def plan_violations(plan: DataFrame, reach: DataFrame, kinds: Sequence[str], dimensions: Sequence[str], control: str = "negative_control") -> DataFrame:
    """rule, detail: what is wrong with a planned table (kind, task, n): unknown kinds, counts below 0, no control, dimensions out of reach. reach: task, dimension."""
    unknown = plan.where(~F.col("kind").isin(*kinds)).select(F.lit("known_kind").alias("rule"), F.col("kind").alias("detail")).distinct()
    negative = plan.where("n < 0").select(F.lit("count_not_negative").alias("rule"), F.concat_ws("/", "kind", "task").alias("detail"))
    controls = plan.agg(F.coalesce(F.sum(F.when(F.col("kind") == control, F.col("n"))), F.lit(0)).alias("n")).where("n = 0").select(F.lit("has_control").alias("rule"), F.lit("").alias("detail"))
    lost = planned_dimensions(plan, reach, dimensions).where("not reachable").select(F.lit("dimension_in_reach").alias("rule"), F.col("dimension").alias("detail"))
    return unknown.union(negative).union(controls).union(lost)


def planned_dimensions(plan: DataFrame, reach: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """dimension, reachable, cases: for every dimension of the vocabulary, whether a planned task scores it, and how many planned cases do."""
    known = plan.sparkSession.createDataFrame([(d,) for d in dimensions], "dimension string")
    cases = plan.where("n > 0").groupBy("task").agg(F.sum("n").alias("n")).join(reach.distinct(), "task").groupBy("dimension").agg(F.sum("n").alias("cases"))
    return known.join(cases, "dimension", "left").select("dimension", F.col("cases").isNotNull().alias("reachable"), F.coalesce("cases", F.lit(0)).alias("cases"))
