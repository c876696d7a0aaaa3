import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from assayframe.llm import sanitisation as P
from assayframe.llm.expressions import running_total

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k in P.KINDS for m in re.finditer(PLAIN[k], text or "", re.ASCII) if holds(k, m.group())]


TEXTS = [
    None, "", "a@b.c@d.e x_y%z@h-1.co.uk. q@nodot @x.y é😀 m@n.o_p@q.r",
    "1.2.3.4.5 999.1.1.1 0001.002.3.255 1.2.3 1.2.3.256 ip10.0.0.1x", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 4041894974608795 12",
    "+1 (724) 555-7058. +123 +1234567890123456 ++44 20 7946 0958) +1-", "call +1 (724) 555-7058 or a@b.co from 10.0.0.1 é 4111111111111111 end",
    "x" * 5000 + "@" + "y" * 50 + ".z", "1" * 6000, "a@" + "b." * 3000 + "c", "9 " * 3000, "+" + "1(" * 2000, "." * 4000 + "@a.b", "0" * 3000 + ".1.1.1",
]


def test_base_findings_as_by_plain_patterns(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    for r in P.inspect(rows).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == base(TEXTS[r["doc_id"]]), r["doc_id"]


def test_digest(spark):
    text = TEXTS[6]
    row = P.inspect(spark.createDataFrame([(text,)], "text string")).select(F.sha2(P.joined(F.col("base")), 256)).first()
    assert row[0] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(text)).encode()).hexdigest()


def test_running_total(spark):
    for n in (0, 1, 2, 3, 10, 101):
        got = spark.range(1).select(running_total(F.array(*(F.lit(i * i).cast("long") for i in range(n))) if n else F.array().cast("array<long>"))).first()[0]
        assert got == [sum(i * i for i in range(k + 1)) for k in range(n)]


def corpus():
    docs = [(i, f"Meeting notes number {i} with agenda about gardens", None) for i in range(40)]
    docs += [(100 + i, f"Report {w}: the surgeon zebrafish wrote from a.b@c.org about gardens and {w}", "x") for i, w in enumerate(("alpha", "beta", "gamma"))]
    docs += [(200, "Only once: unicornword mailto u@v.org end", None), (201, "Only once: unicornword mailto u@v.org end", None), (300, None, None), (301, "zebrafish alone", None)]
    return docs


def disclosure(docs, entity, term):
    near = [t for _, t, _ in docs if t and entity in t and term in t.lower()]
    n, ne, nt, joint = len(docs), sum(entity in (t or "") for _, t, _ in docs), sum(term in re.findall(r"[^\W\d_]{3,}", (t or "").lower()) for _, t, _ in docs), len(near)
    return math.log(joint * n / (ne * nt)) / math.log(n / ne), len(set(near))


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_disclosures_as_by_hand(spark, monkeypatch, few):
    monkeypatch.setattr(P, "BROADCAST_BYTES", few)
    docs = corpus()
    rows = spark.createDataFrame(docs, "doc_id int, text string, kind string")
    single = {(r["entity"], r["term"]): r["disclosure"] for r in P.disclosures(rows, P.contexts(rows)).collect()}
    assert single["email:a.b@c.org", "alpha"] == pytest.approx(disclosure(docs, "a.b@c.org", "alpha")[0]) and ("email:u@v.org", "unicornword") in single
    got = {(r["entity"], r["term"]): r["disclosure"] for r in P.disclosures(rows, P.contexts(rows), min_texts=2).collect()}
    for term in ("zebrafish", "surgeon", "gardens", "about", "wrote", "from", "report", "the"):
        want, texts = disclosure(docs, "a.b@c.org", term)
        assert ((("email:a.b@c.org", term) in got) and got["email:a.b@c.org", term] == pytest.approx(want)) if want >= P.GENERALISE and texts >= 2 else ("email:a.b@c.org", term) not in got
    assert ("email:a.b@c.org", "surgeon") in got and ("email:a.b@c.org", "gardens") not in got
    assert not any(t == "unicornword" for _, t in got)  # two copies are one text
    assert set(got) <= set(single)


def test_sanitised_text(spark, monkeypatch):
    rows = spark.createDataFrame(corpus() + [(9, "plain é text", "k")] * 2, "doc_id int, text string, kind string")
    for limit in (1_000_000, 0):
        monkeypatch.setattr(P, "BROADCAST_BYTES", limit)
        out = P.sanitise(rows, min_texts=2)
        assert out.columns == rows.columns and out.count() == rows.count()
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert got[300] is None and got[9] == "plain é text" and got[301] == "zebrafish alone" and got[5] == "Meeting notes number 5 with agenda about gardens"
        assert "surgeon" not in got[100] and "[EMAIL]" in got[100] and "gardens" in got[100] and "alpha" in got[100]
        assert "unicornword" in got[200] and "u@v.org" not in got[200]


def test_single_sightings_count_by_default(spark):
    rows = spark.createDataFrame(corpus(), "doc_id int, text string, kind string")
    got = {r["doc_id"]: r["text"] for r in P.sanitise(rows).collect()}
    assert "unicornword" not in got[200] and "gardens" in got[100] and got[5] == "Meeting notes number 5 with agenda about gardens"
    spans = {r["doc_id"]: r["all_spans"] for r in P.inspect(rows).collect()}
    text = dict((i, t) for i, t, _ in corpus())[200]
    assert ("unicornword", True) in {(text[s["start"] : s["end"]], s["kind"].startswith("term_")) for s in spans[200]}


def test_masks_every_kind_and_only_valid_ones(spark):
    text = "a@b.co 10.0.0.1 999.1.1.1, 4111 1111 1111 1111, 4111111111111112, +1 (724) 555-7058 +12"
    got = spark.createDataFrame([(text,)], "text string").select(P.masked(F.col("text"))).first()[0]
    assert got == "[EMAIL] [IP] 999.1.1.1, [CARD], 4111111111111112, [PHONE] +12"


def test_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id int, text string, base string")
    assert P.sanitise(rows).count() == 0 and P.inspect(rows).count() == 0
