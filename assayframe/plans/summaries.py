"""Queries of suite counters, the headline of all slices, resumed stages, and hashes of nested settings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions import hashing as H
from assayframe.functions import labels as L
from assayframe.operators import comparison as C
from assayframe.operators import summary as S
from assayframe.plans.registry import query
from assayframe.plans.scores import MEANS_SQL, PAIRS_SQL, _change_sql, _dimension_pairs, _group_pairs, _with
from assayframe.plans.suites import CASES_SQL, cases
from assayframe.plans.verdicts import VERDICT_PAIRS_SQL
from assayframe.session import scratch
from assayframe.sources import adapters as V
from assayframe.sources import records as I
from assayframe.sources import suites as U
from assayframe.sources.adapters import table, with_views

KINDS = ("standard", "negative_control", "far_transfer", "multi_episode")
VOCABULARIES = {
    "families_by_kind": KINDS, "cases_by_family_kind": KINDS, "cases_by_task": ("advise", "explain", "decide"), "cases_by_variant": ("original", "paraphrase", "pressure", "correction", "reversal"),
    "dimension_coverage": tuple(f"d{k}" for k in range(1, 11)),
}
_FAMILIES_SQL = """SELECT DISTINCT conv_id + x AS family_id, ['standard', 'negative_control', 'far_transfer'][(conv_id % 3) + 1] AS kind, CASE WHEN conv_id % 4 > 0 THEN 'home' ELSE 'work' END AS domain,
  CASE conv_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'public: set ' || conv_id ELSE 'authored' END AS provenance FROM conversations, (SELECT unnest([0, 1000000]) AS x) WHERE x = 0 AND conv_id % 13 <> 0 OR x > 0 AND conv_id % 9 = 0"""
_MORE_SQL = """SELECT *, CASE WHEN case_id % 2 = 0 THEN 'advise' ELSE 'decide' END AS task, CASE WHEN variant = 'paraphrase' THEN 'invariance' WHEN variant = 'pressure' THEN 'resistance' WHEN variant = 'original' THEN '' END AS measure,
  list_filter(['d1', 'd2', 'd3', 'd4', 'd5'], lambda x, i: (case_id + i) % 3 > 0) AS dims, case_id % 4 AS checks FROM c"""


def _suite(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as families, some of them without cases, and their turns as cases, some of them without a family."""
    i = F.col("conv_id")
    ids = table(spark, d, "conversations").select(i, F.explode(F.array(F.lit(0), F.lit(1_000_000))).alias("x")).where((F.col("x") == 0) & (i % 13 != 0) | (F.col("x") > 0) & (i % 9 == 0)).distinct()
    kind = F.get(F.array(*map(F.lit, KINDS[:3])), (i % 3).cast("int"))
    provenance = F.when(i % 5 == 1, F.concat(F.lit("public: set "), i.cast("string"))).when(i % 5 > 1, "authored")
    families = ids.select((i + F.col("x")).alias("family_id"), kind.alias("kind"), F.when(i % 4 > 0, "home").otherwise("work").alias("domain"), provenance.alias("provenance"))
    c = F.col("case_id")
    rows = cases(spark, d).select(
        c, F.col("group_id").alias("family_id"), "variant", F.when(c % 2 == 0, "advise").otherwise("decide").alias("task"),
        F.when(F.col("variant") == "paraphrase", "invariance").when(F.col("variant") == "pressure", "resistance").when(F.col("variant") == "original", "").alias("measure"), F.col("parent_id").isNotNull().alias("is_continuation"),
        F.filter(F.array(*(F.lit(f"d{k}") for k in range(1, 6))), lambda _, k: (c + k + 1) % 3 > 0).alias("dimensions"), (c % 4).alias("checks"),
    )
    return families, rows


_EMPTY_SQL = " UNION ALL ".join(f"SELECT '{c}' AS counter, unnest([{', '.join(repr(k) for k in keys)}]) AS key, 0::BIGINT AS n" for c, keys in VOCABULARIES.items())


@query(
    f"""WITH c AS ({CASES_SQL}), f AS ({_FAMILIES_SQL}), m AS ({_MORE_SQL}), k AS (SELECT m.*, f.kind, f.domain FROM m LEFT JOIN f ON f.family_id = m.group_id),
x AS (SELECT 'families' AS counter, '' AS key, count(*) AS n FROM f UNION ALL SELECT 'families_by_kind', kind, count(*) FROM f GROUP BY kind
  UNION ALL SELECT 'provenance', coalesce(nullif(split_part(provenance, ':', 1), ''), 'authored'), count(*) FROM f GROUP BY ALL
  UNION ALL SELECT 'families_without_cases', '', count(*) FROM f WHERE family_id NOT IN (SELECT group_id FROM c)
  UNION ALL SELECT 'cases', '', count(*) FROM k UNION ALL SELECT 'cases_by_family_kind', coalesce(kind, '?'), count(*) FROM k GROUP BY ALL UNION ALL SELECT 'cases_by_task', task, count(*) FROM k GROUP BY ALL
  UNION ALL SELECT 'cases_by_variant', variant, count(*) FROM k GROUP BY ALL UNION ALL SELECT 'cases_by_domain', coalesce(domain, '?'), count(*) FROM k GROUP BY ALL
  UNION ALL SELECT 'cases_by_measure', measure, count(*) FROM k WHERE measure <> '' GROUP BY ALL UNION ALL SELECT 'negative_control_cases', '', count(*) FROM k WHERE kind = 'negative_control'
  UNION ALL SELECT 'continuation_cases', '', count(*) FROM k WHERE parent_id IS NOT NULL UNION ALL SELECT 'deterministic_checks', '', sum(checks) FROM k
  UNION ALL SELECT 'dimension_coverage', dim, count(*) FROM (SELECT unnest(dims) AS dim FROM k) GROUP BY ALL UNION ALL {_EMPTY_SQL}),
t AS (SELECT counter, key, sum(n)::BIGINT AS n FROM x GROUP BY ALL)
SELECT * FROM t UNION ALL SELECT 'dimensions_uncovered', '', count(*) FILTER (n = 0) FROM t WHERE counter = 'dimension_coverage'"""
)
def suite_counters(spark: SparkSession, d: str) -> DataFrame:
    return S.suite_counters(*_suite(spark, d), VOCABULARIES)


@query(f"WITH c AS ({CASES_SQL}), f AS ({_FAMILIES_SQL}), n AS (SELECT family_id, count(c.case_id) AS n FROM f LEFT JOIN c ON c.group_id = f.family_id GROUP BY family_id) SELECT coalesce(min(n), 0) AS least, coalesce(max(n), 0) AS most, coalesce(round(sum(n) / count(*)::DOUBLE, 2), 0) AS mean FROM n")
def cases_per_family(spark: SparkSession, d: str) -> DataFrame:
    return S.cases_per_family(*_suite(spark, d))


#: Slices of the four kinds: where they come from and what names them.
_SLICES = (("group", MEANS_SQL, "grp", "grp"), ("dimension", PAIRS_SQL, "dimension", "dimension::VARCHAR"), ("family_kind", MEANS_SQL, "grp, kind", "grp || '/' || kind"), ("measures", VERDICT_PAIRS_SQL, "measure", "measure"))


def _slice_sql(kind: str, pairs: str, by: str, name: str) -> str:
    """The change statistics' SQL as one select."""
    return f"(WITH q AS (SELECT 1 AS one) {_change_sql(pairs, by)})".replace("(WITH q AS (SELECT 1 AS one) ", f"(SELECT arm, '{kind}' AS slice_kind, {name} AS slice_name, n, families, delta, better, worse FROM (WITH q AS (SELECT 1 AS one) ", 1) + ")"


@query(
    with_views("", "primary_scores", "verdicts").rstrip()
    + ", z AS ("
    + " UNION ALL ".join(_slice_sql(*s) for s in _SLICES)
    + """), w AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY n < 5, delta, slice_kind, slice_name) AS r FROM z WHERE delta < -0.001),
a AS (SELECT arm, count(*) AS slices, count(*) FILTER (delta < -0.001) AS regressed, count(*) FILTER (delta > 0.001) AS improved FROM z GROUP BY arm)
SELECT a.*, w.slice_kind AS worst_slice_kind, w.slice_name AS worst_slice_name, w.delta AS worst_delta, w.n AS worst_n, w.families AS worst_families, w.better AS worst_better, w.worse AS worst_worse, coalesce(w.n >= 5, false) AS solid
FROM a LEFT JOIN w ON w.arm = a.arm AND w.r = 1"""
)
def change_headline(spark: SparkSession, d: str) -> DataFrame:
    """What an arm lost against the baseline, over groups, dimensions, family kinds and measures alike."""
    scored = V.verdicts(spark, d).where("correct is not null").withColumn("score", F.col("correct").cast("int"))
    found = None
    for kind, paired, by in (
        ("group", _group_pairs(spark, d), ["grp"]), ("dimension", _dimension_pairs(spark, d), ["dimension"]), ("family_kind", _group_pairs(spark, d), ["grp", "kind"]), ("measures", C.pairs(scored, "base", ["measure"]), ["measure"]),
    ):
        part = C.change(paired, by).select("arm", F.lit(kind).alias("slice_kind"), F.concat_ws("/", *(F.col(c).cast("string") for c in by)).alias("slice_name"), "n", "families", "delta", "better", "worse")
        found = part if found is None else found.union(part)
    return S.headline(found)


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'kept' END AS state, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id UNION ALL SELECT doc_id, 'kept', quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def resumed_rows(spark: SparkSession, d: str) -> DataFrame:
    """A stage that is run again: rows that are done are kept as they are, and only what is pending is worked out."""
    name, buckets = f"done_{uuid.uuid4().hex}", 8
    I.save_done(table(spark, d, "labels").select("doc_id", "quality"), name, "doc_id", buckets, scratch(spark, "done"))
    todo = I.pending(table(spark, d, "documents").select("doc_id"), name, "doc_id", buckets)
    done = spark.table(name).select("doc_id", F.lit("kept").alias("state"), "quality")
    return I.resumed(done, todo.withColumn("state", F.lit("new")))


@query("""WITH s AS (SELECT o_orderkey, '{"a": [' || o_custkey || ', ' || (o_orderkey % 7) || '], "m": {"k' || (o_orderkey % 3) || '": {"p": ' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || ', "q": true}}, "z": "' || o_orderpriority || '"}' AS t FROM orders)
SELECT o_orderkey, substr(sha256(t), 1, 12) AS version FROM s""")
def nested_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of nested records, whose fields come in another order than the canonical one."""
    i = F.col("o_orderkey")
    inner = F.struct(F.lit(True).alias("q"), F.when(i % 2 != 0, F.col("o_orderstatus")).alias("p"))
    value = F.struct(F.col("o_orderpriority").alias("z"), F.create_map(F.concat(F.lit("k"), (i % 3).cast("string")), inner).alias("m"), F.array(F.col("o_custkey"), i % 7).alias("a"))
    rows = table(spark, d, "orders").select("o_orderkey", value.alias("v"))
    return rows.select("o_orderkey", H.nested_hash(F.col("v"), rows.schema["v"].dataType).alias("version"))


@query(
    _with(PAIRS_SQL, "dimension, kind", "primary_scores").replace("\nSELECT arm, dimension, kind, n,", "\n, ch AS (SELECT arm, dimension, kind, n,")
    + """) SELECT arm, dimension, kind, printf('%+.2f', round(delta, 2)) AS change, CASE WHEN abs(delta) <= 0.001 THEN 'level' WHEN delta > 0 THEN 'better' ELSE 'worse' END AS direction,
printf('%.0f %%', round(100 * (better / n::DOUBLE), 0)) || ' (' || better || '/' || n || ')' || CASE WHEN n < 5 THEN '†' ELSE '' END AS won, CASE WHEN sign_p IS NULL THEN 'n/a' WHEN sign_p < 0.001 THEN '<0.001' ELSE printf('%.3f', round(sign_p, 3)) END AS p,
CASE WHEN abs(delta) <= 0.001 THEN 'none' WHEN (mean_after - 1) / delta < 0 THEN 'reversed' WHEN (mean_after - 1) / delta >= 1 THEN 'all' WHEN (mean_after - 1) / delta >= 0.5 THEN 'most' WHEN (mean_after - 1) / delta >= 0.2 THEN 'some' ELSE 'little' END AS share FROM ch"""
)
def labelled_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes as a report words them."""
    c = C.change(_dimension_pairs(spark, d), ["dimension", "kind"])
    return c.select(
        "arm", "dimension", "kind", L.signed(F.col("delta")).alias("change"), L.direction(F.col("delta")).alias("direction"), L.rate(F.col("better"), F.col("n")).alias("won"), L.p_value(F.col("sign_p")).alias("p"),
        L.share_of(F.col("mean_after") - 1, F.col("delta")).alias("share"),
    )


@query("WITH t AS (SELECT item_id, replace(trim(regexp_replace(text || ' | ' || item_id, '\\s+', ' ', 'g')), '|', '\\|') AS t FROM benchmark) SELECT item_id, CASE WHEN length(t) <= 80 THEN t ELSE left(t, 79) || '…' END AS cell FROM t")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", L.cell(F.concat_ws(" | ", "text", F.col("item_id").cast("string"))).alias("cell"))


@query("""SELECT 's' || s_suppkey || '.' || x AS case_id, 's' || s_suppkey AS family_id, ['original', 'pressure'][x + 1] AS variant, 3 AS dimensions, false AS stale FROM supplier, (SELECT unnest([0, 1]) AS x)""")
def suite_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A suite that is valid, saved and loaded again with its version."""
    s = table(spark, d, "supplier")
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    texts = lambda *x: F.array(*map(F.lit, x))
    families = s.select(
        name.alias("family_id"), F.lit("standard").alias("kind"), F.col("s_name").alias("title"), F.lit("scene").alias("situation"), F.lit("home").alias("domain"), F.lit("authored").alias("provenance"), F.lit("why").alias("held_out_rationale"),
        texts("p").alias("principles_in_play"), F.lit(None).cast("string").alias("notes"),
    )
    anchors = F.array(*(F.struct(F.lit(k).alias("dimension"), F.lit("0").alias("score_0"), F.lit("1").alias("score_1"), F.lit("2").alias("score_2")) for k in "abc"))
    none = F.array().cast("array<string>")
    rubric = F.struct(
        texts(*"abc").alias("dimensions"), texts("x").alias("must_notice"), none.alias("must_not_infer"), texts("y").alias("acceptable_outputs"), none.alias("unacceptable_reasoning"), none.alias("unscorable_if"), anchors.alias("anchors"),
    )
    first = F.col("x") == 0
    expected = F.struct(F.lit("w").alias("what_changed"), F.lit(False).alias("should_change"), F.lit("").alias("expected_direction"), F.lit("j").alias("justification"))
    rows = s.withColumn("x", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.concat(name, F.lit("."), F.col("x").cast("string")).alias("case_id"), name.alias("family_id"), F.lit("decide").alias("task"), F.when(first, "original").otherwise("pressure").alias("variant"), texts("t").alias("turns"), rubric.alias("rubric"),
        F.when(~first, expected).alias("change_expectation"), F.when(~first, F.concat(name, F.lit(".0"))).alias("context_answer_from"),
    )
    path = scratch(spark, "suite")
    U.save_suite(families, rows, path)
    _, again, stale = U.load_suite(spark, path)
    return again.select("case_id", "family_id", "variant", F.size("rubric.dimensions").alias("dimensions"), F.lit(stale).alias("stale"))
