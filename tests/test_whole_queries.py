"""Queries against brute force over whole tables, apart from their SQL."""

import math

import pyarrow.parquet as pq

from assayframe.operators import similarity as S
from assayframe.plans import catalogue


def read(small, name, *columns):
    return list(zip(*pq.read_table(f"{small}/{name}.parquet", columns=list(columns)).to_pydict().values()))


def test_every_order_is_aligned(spark, small):
    given = {}
    for order, line, supplier in read(small, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey"):
        lines = given.setdefault(order, {})
        lines[line] = min(supplier, lines.get(line, supplier))
    want = set()
    for order, lines in given.items():
        want |= {(order, f"a{i}", lines[i], "label") for i in lines if i % 2 == 0}
        want |= {(order, f"b{i}", lines[i], "position") for i in lines if i % 2}  # those left over are the odd lines on both sides
    got = catalogue.queries()["aligned_payloads"](spark, small).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_queries_have_all_other_vectors_as_candidates(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (50, [1.0, 0.1]), (100, [0.1, 1.0]), (7, [-1.0, -1.0])], "vec_id long, embedding array<float>")
    got = {r["case_id"]: r["best_id"] for r in S.best_cosine(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding").collect()}
    assert got == {0: 50, 20: 100, 100: 20}


def test_every_twentieth_vector_against_all_others(spark, small):
    vectors = {i: [x / math.hypot(*v) for x in v] for i, v in read(small, "embeddings", "vec_id", "embedding")}
    want = {}
    for i in (i for i in vectors if i % 20 == 0):
        s, order = max((max(0.0, round(math.sumprod(vectors[i], w), 9)), -j) for j, w in vectors.items() if j != i)
        want[i] = (-order, round(s, 5))
    got = catalogue.queries()["cosine_best"](spark, small).collect()
    assert len(got) == len(want) == 25 and {r["case_id"]: (r["best_id"], r["similarity"]) for r in got} == want
