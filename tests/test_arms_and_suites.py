import pytest

from assayframe.operators import arms as A
from assayframe.sources import suites as S


def test_arm_names():
    assert A.parse_arms("a=x, b=y,") == {"a": "x", "b": "y"}
    for bad in ("a", "a=", "=x", "a=x,a=y"):
        with pytest.raises(ValueError):
            A.parse_arms(bad)
    assert (A.pick_baseline(["t", "Before"]), A.pick_baseline(["t", "base"], "t"), A.pick_baseline(["x", "y"]), A.pick_baseline([])) == ("Before", "t", "x", None)
    assert A.resolve("Alpha", ["model-alpha-1", "beta"])[0] == "model-alpha-1"
    assert A.resolve("a", ["alpha", "beta"])[0] is None
    assert A.judge_pairs(["p"], ["p", "q", "q"]) == [("p", "q")]
    with pytest.raises(ValueError):
        A.not_self_grading("m", "m")


def test_plan_problems():
    good = {"standard": {"decide": 2}, "negative_control": {"notice": 1}}
    assert A.plan_problems(good, {"decide": ["d1"], "notice": ["d2"]}, ["d1", "d2"], S.KINDS) == []
    assert len(A.plan_problems({"odd": {"decide": -1}}, {}, ["d1"], S.KINDS)) == 5


def test_alignment_by_label_then_position(spark):
    wanted = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "group_id int, pos int, label string")
    given = spark.createDataFrame([(1, 0, "x", "P"), (1, 1, "a", "Q"), (1, 2, "a", "R")], "group_id int, pos int, label string, payload string")
    assert {r["label"]: (r["payload"], r["matched_by"]) for r in A.aligned(wanted, given).collect()} == {"a": ("Q", "label"), "b": ("P", "position"), "c": ("R", "position")}


def rubric():
    return {"dimensions": ["a", "b", "c"], "must_notice": ["x"], "must_not_infer": [], "acceptable_outputs": ["y"], "unacceptable_reasoning": [], "unscorable_if": [], "anchors": [{"dimension": k, "score_0": "0", "score_1": "1", "score_2": "2"} for k in "abc"]}


def suite(spark, **change):
    family = {"family_id": "f", "kind": "standard", "title": "t", "situation": "s", "domain": "d", "provenance": "p", "held_out_rationale": "h", "principles_in_play": ["p"], "notes": None}
    original = {"case_id": "c", "family_id": "f", "task": "decide", "variant": "original", "turns": ["t"], "rubric": rubric(), "change_expectation": None, "context_answer_from": None}
    pressed = {**original, "case_id": "v", "variant": "pressure", "context_answer_from": "c", "change_expectation": {"what_changed": "w", "should_change": False, "expected_direction": "", "justification": "j"}, **change}
    return spark.createDataFrame([family], S.FAMILIES), spark.createDataFrame([original, pressed], S.CASES)


def test_valid_suite_comes_back(spark, tmp_path):
    families, cases = suite(spark)
    S.save_suite(families, cases, str(tmp_path / "s"))
    _, again, stale = S.load_suite(spark, str(tmp_path / "s"))
    assert not stale and again.count() == 2


@pytest.mark.parametrize(
    "change",
    [{"family_id": "g"}, {"context_answer_from": "none"}, {"task": "odd"}, {"task": "notice"}, {"variant": "correction"}, {"change_expectation": None}, {"turns": [" "]}, {"case_id": "c"}, {"rubric": {**rubric(), "dimensions": ["a", "a", "b"]}}],
)
def test_each_violation_stops_the_save(spark, tmp_path, change):
    families, cases = suite(spark, **change)
    with pytest.raises(S.InvalidSuite):
        S.save_suite(families, cases, str(tmp_path / "s"))
    assert not (tmp_path / "s").exists()


def test_arms_of_a_column_as_of_text(spark):
    from pyspark.sql import functions as F

    specs = ["a=x, b=y,", "a", "a=", "=x", "a=x,a=y", "", "k=v=w", " n = 100 "]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(specs)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(A.parsed_arms(F.col("s"))).collect()]

    def by_hand(text):
        try:
            return A.parse_arms(text)
        except ValueError:
            return None

    assert got == [by_hand(s) for s in specs]


def test_pages_that_are_broken_give_no_rows(spark, tmp_path):
    import json

    from assayframe.sources import records as I

    whole = {"rows": [{"row_idx": 1, "row": {"id": "a", "text": "x"}}, {"row_idx": 2, "row": {"id": "b", "text": None}}]}
    for name, text in (("1", json.dumps(whole)), ("2", json.dumps(whole)[:-5]), ("3", ""), ("4", "[1]"), ("5", json.dumps({"rows": None})), ("6", json.dumps(whole, indent=1).replace('"a"', '"c"'))):
        (tmp_path / name).write_text(text)
    assert sorted(map(tuple, I.read_pages(spark, str(tmp_path)).collect())) == [(1, "a", "x"), (1, "c", "x")]
