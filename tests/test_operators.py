"""Operators on fixtures made by hand."""

from pyspark.sql import functions as F

from assayframe.operators import comparison as C
from assayframe.operators import graph as G
from assayframe.operators import sampling as P
from assayframe.operators import similarity as S
from assayframe.operators import validate as V
from assayframe.sources import records as I


def test_pairs_keep_only_what_both_have(spark):
    rows = spark.createDataFrame([("N", 1, "f", 1), ("A", 1, "f", 2), ("N", 2, "f", 0), ("A", 3, "g", 2)], "arm string, case_id int, family_id string, score int")
    got = C.change(C.pairs(rows, "N", ["case_id"]), []).collect()
    assert len(got) == 1 and (got[0]["n"], got[0]["delta"], got[0]["better"], got[0]["small"]) == (1, 1.0, 1, True)


def test_four_cells_need_all_four(spark):
    rows = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 0, 0), (1, 1, 1, 2), (2, 0, 0, 1)], "case_id int, judge int, arm int, score int")
    cells = C.four_cells(rows, ["case_id"], F.col("judge") == 1, F.col("arm") == 1)
    got = C.difference_of_differences(cells, []).collect()[0]
    assert (got["n"], got["gap_first"], got["gap_second"], got["difference"]) == (1, 1.0, 2.0, 1.0)


def test_first_per_key(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 1, None)], "k string, seq int, v string")
    assert {r["k"]: r["v"] for r in C.first_per_key(rows, ["k"], ["seq"]).collect()} == {"a": "early", "b": None}


def test_levels_and_cycles(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, 6)], "case_id int, parent_id int")
    assert {r["case_id"]: r["level"] for r in G.levels(rows).collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: -1, 6: -1, 7: -1}


def test_long_chain(spark):
    rows = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "case_id int, parent_id int")
    assert {r["case_id"]: r["level"] for r in G.levels(rows).collect()} == {i: i for i in range(40)}


def test_prune_to_fixpoint(spark):
    rows = spark.createDataFrame(
        [(1, 1, "original", None), (2, 1, "pressure", 1), (3, 1, "pressure", 9), (4, 1, "correction", 3), (5, 2, "paraphrase", None)], "case_id int, group_id int, variant string, parent_id int"
    )
    assert sorted(r["case_id"] for r in G.prune(rows).collect()) == [1, 2]


def test_sample_does_not_depend_on_order(spark):
    a = spark.range(100).withColumnRenamed("id", "k")
    assert {r["k"] for r in P.hash_sample(a, "k", 5, count=10).collect()} == {r["k"] for r in P.hash_sample(a.orderBy(F.desc("k")), "k", 5, count=10).collect()}


def test_similarity_of_disjoint_and_equal_texts(spark):
    cases = spark.createDataFrame([(1, "red fox"), (2, "zzz"), (3, "")], "id int, text string")
    corpus = spark.createDataFrame([(7, "Red fox"), (5, "red FOX")], "cid int, text string")
    assert {r["case_id"]: (r["best_id"], r["similarity"]) for r in S.best_jaccard(cases, corpus, "id", "cid").collect()} == {1: (5, 1.0), 2: (-1, 0.0), 3: (-1, 0.0)}
    assert S.best_jaccard(cases, corpus.limit(0), "id", "cid").where("best_id = -1").count() == 3


def test_rules_report_violations_and_nulls(spark):
    rows = spark.createDataFrame([(1, "x", 5), (2, None, 6), (2, "y", 5)], "id int, v string, fk int")
    got = V.union(V.violations(rows, "id", {"v_given": F.col("v") != ""}), V.duplicates(rows, "id"), V.missing_keys(rows, "id", "fk", spark.createDataFrame([(5,)], "k int"), "k", "fk_known"))
    assert sorted((r["entity_id"], r["rule"]) for r in got.collect()) == [("2", "fk_known"), ("2", "unique_id"), ("2", "v_given")]


def test_anchor_and_grounding_rules(spark):
    one = spark.range(1)
    assert one.select(V.discriminating(F.lit("names the risk clearly"), F.lit("names the risk clearly"))).first()[0] is False
    assert one.select(V.discriminating(F.lit("names the risk clearly"), F.lit("ignores every danger here"))).first()[0] is True
    assert one.select(V.grounded(F.lit("the landlord kept the deposit"), F.lit("A landlord will not return a deposit"))).first()[0] is True


def test_records(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"case_id":"c","arm":"base","odd":1,"scores":[{"dimension":"a","score":"2"},{"dimension":"a","score":"x"},{"dimension":" "}],"unscorable":"","answer_text":"a b","answer_meta":"{\\"usage\\":{\\"tokens\\":7}}"}\n\n')
    rows = I.read_records(spark, str(path), I.RESULTS)
    assert rows.count() == 1 and "odd" not in rows.columns
    assert I.read_records(spark, str(tmp_path / "none"), I.RESULTS).count() == 0
    assert [(r["dimension"], r["score"]) for r in I.dimension_scores(rows).collect()] == [("a", None)]
    r = rows.select(I.is_graded().alias("g"), I.standard_of().alias("s"), I.answer_length().alias("l"), I.truncated().alias("t")).first()
    assert (r["g"], r["s"], r["l"]["length"], r["l"]["source"], r["t"]) == (True, "original", 7.0, "tokens", False)


def test_run_record_keeps_other_stages():
    assert I.merge_record({"run": 1, "stages": {"a": {"n": 1}}}, "b", {"n": 2}) == {"run": 1, "stages": {"a": {"n": 1}, "b": {"n": 2}}}


def test_headline_prefers_solid_slices(spark):
    from assayframe.operators import summary as Y

    rows = [("a", "group", "x", 9, 3, -0.2, 1, 5), ("a", "dimension", "7", 2, 1, -0.9, 0, 2), ("a", "measures", "m", 8, 2, 0.3, 4, 0), ("b", "group", "x", 1, 1, -0.5, 0, 1), ("c", "group", "x", 9, 3, 0.0005, 1, 1)]
    slices = spark.createDataFrame(rows, "arm string, slice_kind string, slice_name string, n long, families long, delta double, better long, worse long")
    got = {r["arm"]: (r["slices"], r["regressed"], r["improved"], r["worst_slice_name"], r["worst_delta"], r["solid"]) for r in Y.headline(slices).collect()}
    assert got == {"a": (3, 2, 1, "x", -0.2, True), "b": (1, 1, 0, "x", -0.5, False), "c": (1, 0, 0, None, None, False)}


def test_counters_hold_every_key_of_a_vocabulary(spark):
    from assayframe.operators import summary as Y

    families = spark.createDataFrame([(1, "standard", "home", "public: x"), (2, "odd", None, None)], "family_id long, kind string, domain string, provenance string")
    cases = spark.createDataFrame([(10, 1, "advise", "original", "", False, ["d1"], 2), (11, 9, "advise", "original", "m", True, None, None)], "case_id long, family_id long, task string, variant string, measure string, is_continuation boolean, dimensions array<string>, checks int")
    vocabulary = {"families_by_kind": ("standard", "negative_control"), "dimension_coverage": ("d1", "d2")}
    got = {(r["counter"], r["key"]): r["n"] for r in Y.suite_counters(families, cases, vocabulary).collect()}
    assert got["families_by_kind", "negative_control"] == 0 and got["families_by_kind", "odd"] == 1 and got["dimensions_uncovered", ""] == 1
    assert got["cases_by_family_kind", "?"] == 1 and got["families_without_cases", ""] == 1 and got["deterministic_checks", ""] == 2 and got["continuation_cases", ""] == 1
    assert got["provenance", "public"] == got["provenance", "authored"] == 1 and got["cases_by_measure", "m"] == 1 and got["cases_by_domain", "?"] == 1
    empty = {r["counter"]: r["n"] for r in Y.suite_counters(families.limit(0), cases.limit(0), vocabulary).where("key = '' or counter = 'dimension_coverage'").collect()}
    assert empty["dimensions_uncovered"] == 2
    assert tuple(Y.cases_per_family(families, cases).first()) == (0, 1, 0.5) and tuple(Y.cases_per_family(families.limit(0), cases).first()) == (0, 0, 0.0)
