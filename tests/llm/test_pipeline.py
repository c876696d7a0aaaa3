"""The pipeline over the small tables, every stage against brute force on that stage's own input."""

import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from test_decontamination import brute
from test_sanitisation import base
from test_simhash import plain_groups

import corpus_pipeline as P
from assayframe.llm import byte_bpe
from assayframe.llm.queries import RANKS


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """The rows before the first stage and after each."""
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs.collect()]
    for name, stage in P.STAGES:
        stage(spark, docs, small).write.parquet(str(top / name))
        docs = spark.read.parquet(str(top / name))
        out.append(docs.collect())
    return out


def test_stages_keep_the_columns_of_documents(spark, small, stages):
    names = spark.read.parquet(f"{small}/documents.parquet").columns
    assert all(list(rows[0].__fields__) == names for rows in stages[:-1])


def test_language_keeps_clean_documents(stages):
    before, after = ({r["doc_id"]: r["text"] for r in rows} for rows in stages[:2])
    assert all(after[i] == before[i] for i in after)
    # What goes says too little to tell: some words, or one word over and over.
    assert all(len(set(before[i].split())) < 20 for i in before.keys() - after.keys())
    assert len(after) >= 0.97 * len(before)


def test_near_duplicates(stages):
    assert sorted(str(r["doc_id"]) for r in stages[2]) == plain_groups([(r["doc_id"], r["text"]) for r in stages[1]])


def test_decontamination(spark, small, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in stages[2]} - {r["doc_id"] for r in stages[3]}
    suspects = [(r["doc_id"], r["text"]) for r in stages[2] if r["doc_id"] in gone or any(" ".join(t.split()[3:9]) in r["text"] for _, t in items)]
    assert gone == {d for d, _ in brute(suspects, items)}


def test_sanitisation(stages):
    before, after = ({r["doc_id"]: r for r in rows} for rows in stages[3:5])
    assert before.keys() == after.keys()
    for i, r in before.items():
        if not base(r["text"]):
            assert after[i] == r
        else:
            assert after[i]["text"] != r["text"] and not base(after[i]["text"]) and re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", after[i]["text"])
        assert after[i]["n_chars"] == len(after[i]["text"])


def test_encoding_and_run(spark, small, stages):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path(RANKS)), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    rows = {r["doc_id"]: r for r in stages[5]}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert rows[i]["ids"] == ids and library.decode_bytes(rows[i]["ids"]) == t.encode()
    assert sorted(map(tuple, P.run(spark, small).collect())) == sorted(map(tuple, stages[5]))


def test_empty_documents(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
