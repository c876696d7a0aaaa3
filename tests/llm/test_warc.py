import gzip
import hashlib
from pathlib import Path

from assayframe.llm import warc as W


def round_trip(spark, rows, path, columns="page_id long, url string, html string"):
    df = spark.createDataFrame(rows, columns)
    W.write_archives(df, str(path))
    return W.captures_of(W.assemble(W.read_records(spark, str(path)))).collect()


def expected(rows):
    payloads = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    out = []
    for i, b in payloads:
        same = [j for j, c in payloads if c == b and j is not None]
        first = max(same, default=None) if len(b) >= W.MIN_REVISIT else None
        revisit = first is not None and (i is None or i < first)
        out.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", str(first if revisit else None)))
    return sorted(out)


BIG = "é<p>\r\n\r\nWARC/1.1\r\n\r\n" * 100
ROWS = [
    (1, "http://a.org/", "short"), (2, "http://a.org/", "short"), (3, "http://b.org/", BIG), (4, "http://b.org/", BIG), (5, "http://c.org/", BIG), (6, "http://d.org/", "x" * 999),
    (7, "http://d.org/", "x" * 999), (8, "http://e.org/", "x" * 1000), (9, "http://e.org/", "x" * 1000), (10, None, None), (11, "http://f.org/\r\nEvil: 1", ""), (12, "http://g.org/", "y" * 300_000),
    (None, "http://h.org/", BIG), (13, "http://a.org/", "\r\n\r\n" * 5), (14, "http://i.org/", "twice"), (14, "http://i.org/", "twice"), (15, "http://j.org/", "Z" * 1500), (15, "http://j.org/", "Z" * 1500),
    (None, "http://k.org/", "alone" * 300),
]


def test_captures_come_back_as_written(spark, tmp_path):
    got = round_trip(spark, ROWS, tmp_path / "w")
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == expected(ROWS)
    assert all(r["intact"] for r in got if r["record_type"] == "response")


def test_archives_are_well_formed(spark, tmp_path):
    round_trip(spark, ROWS, tmp_path / "w")
    kinds = []
    for p in Path(tmp_path / "w").glob("*.txt.gz"):
        data = gzip.decompress(p.read_bytes())
        end = 0
        for fields, start, stop in W.split_records(data):
            assert data[end:].startswith(b"WARC/1.1\r\n") and data[stop : stop + 4] == b"\r\n\r\n"
            assert fields[b"warc-record-id"].startswith(b"<urn:uuid:") and b"warc-date" in fields
            kinds.append(fields[b"warc-type"].decode())
            assert (b"warc-concurrent-to" in fields) == (kinds[-1] in ("request", "metadata"))
            end = stop + 4
        assert end == len(data)
    assert sorted(set(kinds)) == ["metadata", "request", "response", "revisit"] and len(kinds) == 3 * len(ROWS)


def test_transactions_are_nested(spark, tmp_path):
    W.write_archives(spark.createDataFrame(ROWS[:5], "page_id long, url string, html string"), str(tmp_path / "w"))
    rows = W.assemble(W.read_records(spark, str(tmp_path / "w"))).collect()
    assert len(rows) == 5
    for r in rows:
        assert r["request"]["concurrent_to"] == r["record_id"] == r["metadata"]["concurrent_to"] and r["request"]["fields"].startswith("GET http://")


def test_lost_requests_leave_the_capture(spark, tmp_path):
    W.write_archives(spark.createDataFrame(ROWS[:1], "page_id long, url string, html string"), str(tmp_path / "w"))
    found = W.read_records(spark, str(tmp_path / "w"))
    r = W.assemble(found.where("record_type <> 'request'")).first()
    assert r["request"] is None and r["metadata"] is not None


def test_many_files_empty_tables_and_extra_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FILE_BYTES", 2_000)
    rows = [(i, f"http://a.org/{i}", f"{i % 5}" * 1200, "mine") for i in range(60)]
    got = round_trip(spark, rows, tmp_path / "w", "page_id long, url string, html string, digest string")
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == expected(rows)
    W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert W.captures_of(W.assemble(W.read_records(spark, str(tmp_path / "e")))).count() == 0


def test_ids_below_zero(spark, tmp_path):
    body = "x" * 1200
    rows = [(-5, "http://a.org/", body), (-3, "http://b.org/", body), (-1, "http://c.org/", "short")]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in round_trip(spark, rows, tmp_path / "w")}
    assert got == {-5: ("revisit", -3), -3: ("response", None), -1: ("response", None)}
