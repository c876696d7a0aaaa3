"""Answer files, run records and reports."""

import hashlib
import json
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from assayframe.functions import hashing as H
from assayframe.plans import report as R
from assayframe.sources import records as I
from assayframe.sources import run_records as RR


def test_answers_need_their_keys(spark, tmp_path):
    def written(name, *rows):
        (tmp_path / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
        return str(tmp_path / name)

    good = written("good.jsonl", {"prompt_id": "a", "text": "x", "more": 1}, "", {"prompt_id": "b", "text": "y", "model": "m"})
    assert sorted(map(tuple, I.read_answers(spark, good, "good").collect())) == [("a", "good", "x"), ("b", "m", "y")]
    with pytest.raises(ValueError, match="a line has: model, prompt_id"):
        I.read_answers(spark, written("bad.jsonl", {"prompt_id": "a", "text": "x"}, {"prompt_id": "b", "model": "m"}), "bad")
    with pytest.raises(ValueError, match="a line has: none"):
        I.read_answers(spark, written("odd.jsonl", "no json"), "odd")
    with pytest.raises(ValueError, match="no answers"):
        I.read_answers(spark, written("empty.jsonl", " "), "empty")


def test_rows_as_json_keep_nulls(spark):
    df = spark.createDataFrame([(1, None, [Row(a=1, b=None)])], "x int, y string, z array<struct<a:int,b:string>>")
    assert json.loads(I.as_json(df).first()["record"]) == {"x": 1, "y": None, "z": [{"a": 1, "b": None}]}


def test_run_record_keeps_the_latest_of_each_stage(spark, tmp_path):
    path = str(tmp_path / "record")
    assert RR.run_record(spark, path).count() == 0
    for at, stage, n in (("2024-01-01", "answer", 1), ("2024-01-02", "judge", 2), ("2024-01-03", "answer", 3)):
        RR.record_stage(spark, path, "r", stage, {"n": n}, at)
    assert {r["stage"]: json.loads(r["payload"])["n"] for r in RR.run_record(spark, path).collect()} == {"answer": 3, "judge": 2}


@pytest.mark.parametrize("local", [True, False])
def test_writers_at_once_lose_nothing_and_the_later_write_wins(spark, tmp_path, monkeypatch, local):
    path, begin = str(tmp_path / "record"), RR.Store.__init__

    def opened(self, *args):
        begin(self, *args)
        self.local = local

    monkeypatch.setattr(RR.Store, "__init__", opened)
    if local:
        with ThreadPoolExecutor(6) as pool:
            list(pool.map(lambda k: RR.record_stage(spark, path, "r", f"s{k % 8}", {"n": k}, "same"), range(24)))
    else:
        for k in range(24):
            RR.record_stage(spark, path, "r", f"s{k % 8}", {"n": k}, "same")
    store = RR.Store(spark, path, "r")
    number, record = store.latest()
    assert number == 24 and len(record["stages"]) == 8 and len(store.numbers()) <= RR.KEEP + 6
    assert not store.claim(24, {"lost": True}) and store.latest()[1] == record
    RR.record_stage(spark, path, "r", "s0", {"n": "A"}, "earlier by its clock")
    RR.record_stage(spark, path, "q", "s0", {"n": 1}, "x")
    rows = {(r["run_id"], r["stage"]): (r["at"], r["payload"]) for r in RR.run_record(spark, path).collect()}
    assert rows["r", "s0"] == ("earlier by its clock", '{"n": "A"}') and len(rows) == 9


def test_resuming_moves_nothing_that_is_done(spark, tmp_path):
    done = spark.range(0, 500, 2).select(F.col("id").alias("key"), F.lit("old").alias("note"))
    I.save_done(done, "resumed_stage", "key", 4, str(tmp_path / "done"))
    items = spark.range(300).withColumnRenamed("id", "key")
    with_plans = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    open_items = I.pending(items, "resumed_stage", "key", 4)
    plan = open_items._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in scan.split("\n", 1)[0]
    assert plan.index("Exchange hashpartitioning") < plan.index("FileScan")  # on the items' side alone
    rows = I.resumed(spark.table("resumed_stage"), open_items.withColumn("note", F.lit("new"))).collect()
    assert sorted((r["key"], r["note"]) for r in rows) == sorted([(k, "old") for k in range(0, 500, 2)] + [(k, "new") for k in range(1, 300, 2)])
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == with_plans
    spark.sql("DROP TABLE resumed_stage")


def test_canonical_json_as_by_sorted_keys(spark):
    rows = [
        {"z": 'q"\\\n\x1fü\u2028\\u001f', "a": {"y": [{"q": 1, "b": 1.5}, {"q": None, "b": 1e7}, None], "c": True, "B": {"z": ["x"], "A": None, "é": []}}, "m": {"k2": {"k": 5, "a": None}, "k1": None}, "e": []},
        {"z": None, "a": None, "m": {}, "e": [3, None, 1]},
        {"z": "", "a": {"y": [{"q": -7, "b": b} for b in (1e16, 12345678.25, 1.25e-5, 0.00012, -3e21, 0.0, 1e-10, 123456789012.0)], "c": False, "B": {}}, "m": None, "e": None},
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r struct<z:string,a:struct<y:array<struct<q:int,b:double>>,c:boolean,B:map<string,array<string>>>,m:map<string,struct<k:bigint,a:string>>,e:array<int>>")
    got = [r[0] for r in df.orderBy("i").select(H.canonical_json(F.col("r"), df.schema["r"].dataType)).collect()]
    assert got == [json.dumps(r, sort_keys=True, ensure_ascii=False) for r in rows]
    hashes = [r[0] for r in df.orderBy("i").select(H.nested_hash(F.col("r"), df.schema["r"].dataType)).collect()]
    assert hashes == [hashlib.sha256(g.encode()).hexdigest()[:12] for g in got]
    moved = df.select("i", F.struct("r.m", "r.e", "r.a", "r.z").alias("r"))
    assert [r[0] for r in moved.orderBy("i").select(H.nested_hash(F.col("r"), moved.schema["r"].dataType)).collect()] == hashes


def test_sections_are_all_there_in_order():
    text = R.full_report("Run", {"dimension_stats": [Row(arm=f"a{i}", n=i) for i in range(5)]}, limit=3)
    at = [text.index(f"## {heading}\n") for heading, _, _ in R.SECTIONS]
    assert at == sorted(at) and len(at) == 14
    assert "| a2 | 2 |" in text and "| a3 |" not in text and "2 more rows." in text and "No rows." in text


def test_report_over_tables(spark, small, tmp_path):
    text = R.run_report(spark, small, limit=5)
    assert text.count("\n## ") == 14 and "| arm | dimension |" in text
    assert re.search(r"\n[1-9][0-9]* more rows\.\n", text)  # tables beyond the limit say so
    R.save_report(spark, text, str(tmp_path / "report"))
    assert "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()).startswith("# Run")


def test_wording():
    assert R.judge_verdict({"action": 0.2, "reasoning": 0.1}) == "flattering on action by +0.20"
    assert R.judge_verdict({"action": 0.0, "reasoning": -0.3}) == "harder on reasoning by -0.30"
    assert R.judge_verdict({"action": 0.1, "reasoning": None}) == "no material flattery" and R.judge_verdict({"action": None}) == "not measured"
    far = {"upper_median": 0.7, "min": 0.6, "max": 0.8, "low": 0, "identical": 0}
    assert R.divergence_note(far, 3) == "median 0.70, 0.60 to 0.80"
    assert "failed measurement" in R.divergence_note({**far, "upper_median": 0.1}, 3) and "2 near, 1 identical" in R.divergence_note({**far, "low": 2, "identical": 1}, 3)
    assert R.divergence_note(None, 3) == "no divergence was measured" and R.divergence_note(None, 0) == ""


def test_writing_counts_the_rows(spark, tmp_path):
    assert I.write_records(spark.range(17), str(tmp_path / "a")) == 17
    assert I.write_records(spark.range(0), str(tmp_path / "b")) == 0


def test_checks_fold_compatibility_forms(spark):
    from pyspark.sql import functions as F

    from assayframe.functions import checks as K
    from assayframe.functions import judging as J
    from assayframe.functions import text as X

    df = spark.createDataFrame([(1, "Ｓｔｏｉｃｉｓｍ"), (2, "die Straße"), (3, "ﬁne “words”"), (4, "naïve ÀÉ"), (5, None)], "doc_id int, text string")
    assert [r["n"] for r in df.orderBy("doc_id").select(X.normalise_unicode(F.col("text")).alias("n")).collect()] == ["stoicism", "die strasse", 'fine "words"', "naïve àé", ""]
    found = K.run_checks(df, [("must_mention_all", {"terms": ["strasse"]}), ("forbidden_terms", {"terms": ["stoic"]})]).collect()
    assert {(r["doc_id"], r["check"]) for r in found if r["passed"]} == {(2, "must_mention_all"), *((i, "forbidden_terms") for i in (2, 3, 4, 5))}
    said = spark.createDataFrame([(["2", "tell  the Truth", "odd", "", "1"],)], "r array<string>").select(J.rubric_flags(F.col("r"), F.array(F.lit("keep faith"), F.lit("tell the truth"))).alias("f")).first()["f"]
    assert list(said["items"]) == ["tell the truth", "keep faith"] and list(said["dropped"]) == ["odd"]
