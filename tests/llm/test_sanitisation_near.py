"""The words near an entity, from the whole text and not from between the matches of its kind."""

import re

from compare import difference, duck
from pyspark.sql import functions as F

from assayframe.llm import queries as Q
from assayframe.llm import sanitisation as P
from test_sanitisation import PLAIN, base

CARD = "4111 1111 1111 1111"
TEXTS = [
    f"Jane Doe 1985, {CARD}", "Jane Doe a@x.org, b@x.org", f"{'far ' * 30}near 12 34 {CARD} 56 after 78 {'off ' * 30}", f"jim.smith@home.org {CARD} 10.0.0.1 host",
    "w" * 3 + " " * 77 + "a@b.co" + " " * 77 + "yyy", "w" * 4 + " " * 77 + "a@b.co" + " " * 77 + "yyyy", "é😀 " * 2100 + "zwölf 77 a@b.co ñandú 😀 c@d.co " + "ende " * 2000,
]


def words_near(text, start, end):
    """By the definition: words wholly within NEAR_CHARS on either side, emails and the entity itself having none."""
    blank = re.sub(PLAIN["email"], lambda m: "." * len(m.group()), text, flags=re.ASCII)
    found = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", blank)]
    return sorted(w for w, a, b in found if (a >= start - P.NEAR_CHARS and b <= start) or (a >= end and b <= end + P.NEAR_CHARS))


def test_words_near_as_by_definition(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").select("doc_id", P.findings(F.col("text")).alias("f")).collect()
    for r in rows:
        text = TEXTS[r["doc_id"]]
        assert [(m["kind"], m["start"], m["end"]) for m in r["f"]] == base(text)
        for m in r["f"]:
            assert sorted(re.findall(r"[^\W\d_]{3,}", m["near"].lower())) == words_near(text, m["start"], m["end"]), (r["doc_id"], m)


def test_names_before_numbers_and_lists_count(spark):
    near = P.contexts(spark.createDataFrame([(t,) for t in TEXTS[:2]], "text string")).collect()
    assert {("card:" + CARD, "jane"), ("card:" + CARD, "doe"), ("email:b@x.org", "jane"), ("email:a@x.org", "doe")} <= {(r["entity"], r["term"]) for r in near}


def test_query_as_its_sql(spark, small, tmp_path):
    assert difference(Q.op3_pii(spark, small), duck(small), Q.oracle_sql()["op3_pii"]) == ""
    texts = TEXTS + ["filler text without anything"] * 20 + [None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duck(small)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(Q.op3_pii(spark, str(tmp_path)), con, Q.oracle_sql()["op3_pii"]) == ""
