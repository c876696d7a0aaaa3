import datetime
import json
import uuid

from pyspark.sql import Row

from assayframe.plans import report as R
from assayframe.streaming import ingest as S


def test_stream_drops_repeats_and_goes_on(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    at = datetime.datetime(2024, 1, 1).isoformat()
    row = {"arm": "a", "case_id": 1, "family_id": "f", "dimension": "d", "score": 1, "judge_pass": 0, "graded_at": at}
    (source / "1.json").write_text("\n".join(json.dumps(r) for r in (row, {**row, "score": 2}, {**row, "case_id": 2}, {**row, "judge_pass": 1})))
    name = uuid.uuid4().hex
    run = lambda: S.append_parquet(S.first_gradings(S.score_stream(spark, str(source))), out, name).awaitTermination(60)
    run()
    assert spark.read.parquet(out).count() == 2
    (source / "2.json").write_text("\n".join(json.dumps(r) for r in (row, {**row, "case_id": 3})))
    run()
    assert sorted(r["case_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_windowed_stats(spark):
    t = datetime.datetime(2024, 1, 1, 0, 10)
    rows = spark.createDataFrame([("a", 1, "f", "d", 2, 0, t), ("a", 2, "f", "d", None, 0, t)], S.SCORES)
    got = S.windowed_stats(rows).first()
    assert (got["n"], got["total"], got["unscorable_n"]) == (1, 2, 1)


def test_formats():
    assert (R.rate(1, 3), R.rate(3, 10), R.rate(0, 0)) == ("33 % (1/3)†", "30 % (3/10)", "n/a (0)")
    assert (R.signed(0.5), R.p_value(0.0004), R.p_value(None), R.direction(-0.01), R.direction(0.0005)) == ("+0.50", "<0.001", "n/a", "worse", "level")
    assert R.cell("a|b\n" + "x" * 100).startswith("a\\|b x") and len(R.cell("x" * 100)) == 80
    assert [R.share_of(a, 1.0) for a in (1.2, 0.6, 0.3, 0.1, -0.1)] == ["all", "most", "some", "little", "reversed"] and R.share_of(1.0, 0.0) == "none"


def test_render():
    rows = [Row(arm="a", mean_before=1.0, mean_after=0.5, delta=-0.5, n=3, better=0, worse=2, sign_p=0.5, small=True), Row(arm="b", mean_before=1.0, mean_after=1.5, delta=0.5, n=30, better=20, worse=2, sign_p=0.0001, small=False)]
    text = "\n".join(R.changes_section(rows[::-1]))
    assert text.index("- a:") < text.index("- b:") and "3 pairs†" in text and "p = <0.001" in text
    assert "No rows." in R.render("Run", [("Empty", [])]) and "| arm |" in R.render("Run", [("Changes", [Row(arm="a")])])
