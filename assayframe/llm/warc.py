"""WARC archives: writing captures and assembling transactions.

Writing: each page becomes a request, a response (or a revisit of an equal payload)
and a metadata record. Records are rows of one string, written by Spark's text sink
with the separator that ends WARC records (two CRLF) and gzip, so archives land in
any file system that Spark writes to.

Reading: archive files are read whole as binary rows, files being kept to a bounded
size at writing, and cut into records by Content-Length, once: the records' fields,
without payloads, are kept by a checkpoint. They are then joined through
WARC-Concurrent-To into one nested row a capture, and revisits are joined to the
response they refer to. Only revisits take part in that join, and those of one response
are spread over SALTS keys, since one response may have a third of all revisits.
Payloads are never shuffled where the repeated ones are few (REPEATED): only their
digests are.

Defined results: null html is an empty payload; a null url or id is an empty field and
a null id comes back as null; equal rows write equal records, which come back as
often as they were written; of equal payloads of at least MIN_REVISIT bytes, the rows
with the largest id are responses, all others revisits. Extra columns are not archived.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.session import cut

MIN_REVISIT = 1_000
#: Up to so many repeated payloads their digests, of about 150 bytes, are broadcast to the pages, else joined by a shuffle.
REPEATED = 200_000
#: Keys over which the revisits of a response are spread.
SALTS = 32
#: Bytes of payload that go to an archive file, about.
FILE_BYTES = 24_000_000
CRLF = "\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, warc_date string, "
    "payload_bytes long, payload_digest string, fields string, intact boolean"
)


def _urn(capture: Column, kind: str) -> Column:
    h = F.md5(F.concat(capture, F.lit("/" + kind)))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] * bool(i) + [F.substring(h, a, n)])), F.lit(">"))


def _lines(*lines: Column | str) -> Column:
    return F.concat(*(x for line in lines for x in (F.lit(line) if isinstance(line, str) else line, F.lit(CRLF))))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value)


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, body, digest, bytes, capture and refers (the capture that a revisit repeats, else null)."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", "%20").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("body"))
    rows = rows.withColumns({"digest": F.sha1(F.col("body").cast("binary")), "bytes": F.octet_length("body").cast("long")})
    rows = rows.withColumn("capture", F.sha1(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "url", "digest").cast("binary")))
    first = cut(
        rows.where((F.col("bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.max(F.struct("page_id", "capture")).alias("first"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "first")
    )
    older = (F.col("page_id") < F.col("first.page_id")) | (F.col("page_id").isNull() & F.col("first").isNotNull())
    return rows.join(F.broadcast(first) if first.count() <= REPEATED else first, "digest", "left").withColumn("refers", F.when(older, F.col("first.capture"))).drop("first")


def records(found: DataFrame) -> DataFrame:
    """record: the text of every record, without the end mark."""
    revisit = F.col("refers").isNotNull()
    response_id = _urn(F.col("capture"), "response")
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", _field("Content-Length", F.col("bytes").cast("string")), "")
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    answer = F.concat(
        _lines("WARC/1.1", _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _field("WARC-Record-ID", response_id), f"WARC-Date: {DATE}", _field("WARC-Target-URI", F.col("url"))),
        F.when(revisit, _lines(_field("WARC-Refers-To", _urn(F.col("refers"), "response")), "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")).otherwise(""),
        _lines(_field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), "Content-Type: application/http;msgtype=response", _field("Content-Length", F.octet_length(block).cast("string")), ""),
        block,
    )

    def other(kind: str, content_type: str, content: Column) -> Column:
        return F.concat(
            _lines("WARC/1.1", f"WARC-Type: {kind}", _field("WARC-Record-ID", _urn(F.col("capture"), kind)), _field("WARC-Concurrent-To", response_id), f"WARC-Date: {DATE}", _field("WARC-Target-URI", F.col("url"))),
            _lines(f"Content-Type: {content_type}", _field("Content-Length", F.octet_length(content).cast("string")), ""),
            content,
        )

    request = other("request", "application/http;msgtype=request", _lines(F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1")), ""))
    metadata = other("metadata", "application/warc-fields", _lines(_field("page-id", F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    return found.select(F.explode(F.array(request, answer, metadata)).alias("record"))


def write_archives(pages: DataFrame, path: str, **columns: str) -> None:
    """Writes the archives of pages below path, which must be shared by all executors."""
    size = pages.agg(F.avg(F.octet_length(columns.get("html", "html")))).first()[0] or 1
    rows = 3 * max(1, int(FILE_BYTES / size))
    records(captures(pages, **columns)).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", rows).text(path)


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def split_records(data: bytes) -> Iterator[tuple[dict[bytes, bytes], int, int]]:
    """(header fields, start, end) of each record's block in an archive."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        start = data.index(b"\r\n\r\n", at) + 4
        fields = {k.lower(): v for k, v in _HEADER.findall(data, at, start)}
        end = start + int(fields[b"content-length"])
        yield fields, start, end
        at = end + 4


def _row(data: bytes, fields: dict[bytes, bytes], start: int, end: int) -> tuple:
    text = lambda k: fields[k].decode() if k in fields else None
    kind, size, digest, intact, rest = text(b"warc-type"), None, None, None, None
    if kind in ("response", "revisit"):
        body = data.index(b"\r\n\r\n", start) + 4
        digest = text(b"warc-payload-digest").removeprefix("sha1:")
        size = int(dict(_HEADER.findall(data, start, body))[b"Content-Length"])
        if kind == "response":
            intact = size == end - body and digest == hashlib.sha1(memoryview(data)[body:end]).hexdigest()
    else:
        rest = data[start:end].decode()
    return text(b"warc-record-id"), kind, text(b"warc-concurrent-to"), text(b"warc-refers-to"), text(b"warc-target-uri"), text(b"warc-date"), size, digest, rest, intact


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    for pdf in batches:
        for content in pdf["content"]:
            if content[:2] == b"\x1f\x8b":
                content = zlib.decompress(content, wbits=31)
            rows = pd.DataFrame([_row(content, *r) for r in split_records(content)], columns=names)
            yield rows.astype({"payload_bytes": "Int64"})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records' fields, without payloads; intact says whether a response's payload has the recorded digest and length. Kept by a checkpoint."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    return cut(files.mapInPandas(_parse, RECORD))


def assemble(found: DataFrame) -> DataFrame:
    """One nested row a capture: record_id, answer, request and metadata (structs), copies.

    Equal records count once in the joins; `copies` says how often they came.
    """
    fields = [x.split()[0] for x in RECORD.split(", ") if not x.startswith("record_id")]
    once = found.groupBy("record_id").agg(F.first(F.struct(*fields)).alias("r"), F.count("*").alias("copies"))
    answers = once.where("r.record_type in ('response', 'revisit')").select("record_id", F.col("r").alias("answer"), "copies")
    others = once.where("r.record_type not in ('response', 'revisit')").select(F.col("r.concurrent_to").alias("record_id"), "r")
    by_answer = others.groupBy("record_id").agg(
        F.max(F.when(F.col("r.record_type") == "request", F.col("r"))).alias("request"), F.max(F.when(F.col("r.record_type") == "metadata", F.col("r"))).alias("metadata")
    )
    return answers.join(by_answer, "record_id", "left")


def page_id_of(metadata: Column) -> Column:
    return F.nullif(F.regexp_extract(metadata["fields"], r"(?m)^page-id: (-?\d+)", 1), F.lit("")).try_cast("long")


def captures_of(assembled: DataFrame, salts: int = SALTS) -> DataFrame:
    """One flat row a capture: page_id, payload_bytes, payload_digest, record_type, refers_to (page id), url, request (its first line), intact."""
    rows = cut(assembled.withColumn("page_id", page_id_of(F.col("metadata"))))
    revisit = F.coalesce(F.col("answer.record_type") == "revisit", F.lit(False))
    targets = rows.where(revisit).select(F.col("answer.refers_to").alias("record_id")).distinct()
    named = rows.where(~revisit).select("record_id", F.col("page_id").alias("refers_to")).join(targets, "record_id")
    spread = named.select(F.col("record_id").alias("_to"), "refers_to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = rows.where(revisit).withColumns({"_to": F.col("answer.refers_to"), "_salt": F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int")})
    revisits = salted.join(spread, ["_to", "_salt"], "left").select(*rows.columns, "refers_to")
    linked = rows.where(~revisit).withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)
    return linked.select(
        "page_id",
        "answer.payload_bytes",
        "answer.payload_digest",
        "answer.record_type",
        "refers_to",
        F.col("answer.target_uri").alias("url"),
        F.regexp_extract(F.col("request.fields"), "^[^\r\n]*", 0).alias("request"),
        "answer.intact",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
