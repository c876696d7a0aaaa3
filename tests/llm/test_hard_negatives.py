import numpy as np
import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from assayframe.llm import hard_negatives as H
from assayframe.llm import queries

SCHEMA = "vec_id long, label int, embedding array<float>, score string, width int"


def brute(rows, every, positives=5, negatives=3):
    usable = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            r = (label, [int(np.floor(256 * float(x))) for x in v])
            usable[i] = min(usable.get(i, r), r)
    out = []
    for a, (label, v) in usable.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for i, (other, w) in usable.items() if i != a and len(v) == len(w)]
        for s, p, _ in sorted(x for x in scored if x[2])[:positives]:
            fit = sorted(x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every=50, **kw):
    df = spark.createDataFrame([(i, label, v, "x", 1) for i, label, v in rows], SCHEMA)
    return sorted(map(tuple, H.mine(H.prepared(df, F.col("label")), F.col("vec_id") % every == 0, **kw).collect()))


def vectors(n=600, d=8, ties=0):
    m = np.random.default_rng(7).normal(size=(n, d)).astype(np.float32)
    m[n - ties :] = m[1]
    return [(i, i % 3, [float(x) for x in m[i]]) for i in range(n)]


def test_as_by_brute_force_over_several_blocks(spark):
    rows, told = vectors(), []
    assert mined(spark, rows, 20, block=100, told=told) == brute(rows, 20)
    assert told  # counted by digits


def test_large_groups_of_equal_vectors_go_on_to_digits_of_the_ids(spark):
    rows, told = vectors(700, 4, 400), []
    assert mined(spark, rows, 100, block=150, told=told) == brute(rows, 100)
    assert len(told) > 4  # more passes than the score has digits


def test_nulls_widths_repeats_and_single_labels(spark):
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 2, [0.5, 0.5]), (1, 1, None), (2, 1, []), (3, 1, [1.0, None]), (4, 2, [float("nan"), 1.0]), (5, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]),
            (6, 1, [2.0, 0.5]), (7, 2, [1.0, 1.0]), (8, 2, [1.0, 1.0]), (9, 2, [1.0]), (50, 3, [1.0, 2.0]), (100, 1, [0.0, 0.0]), (150, 1, [-1.0, -1.0])]
    got = mined(spark, rows)
    assert got == brute(rows, 50)
    assert not [r for r in got if r[0] == 50]  # no other row of its label
    assert [r for r in got if r[0] == 0]


def test_empty_table_and_no_anchor(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []


def test_large_components_stay_exact():
    a, b = np.array([[1 << 27, -3]]), np.array([[(1 << 27) + 1, 5], [7, 9]])
    assert H.scores_of(a, b).tolist() == [[(1 << 27) * ((1 << 27) + 1) - 15, 7 * (1 << 27) - 27]]


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_conversation_repair"])
def test_query_as_its_sql(spark, small, name):
    assert difference(queries.queries()[name](spark, small), duck(small), queries.oracle_sql()[name]) == ""
