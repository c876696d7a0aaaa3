import numpy as np
from pyspark.sql import functions as F

from assayframe.llm import impact_search as I


def brute(rows, k, every=100):
    out = []
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in usable:
        if q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(a) == len(b))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def search(spark, rows, **kw):
    v = I.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"))
    return sorted(map(tuple, I.top_k(v, v.where(I.is_query(F.col("vec_id"))), **kw).collect()))


def vectors(n=700, d=16):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(n, d)).astype(np.float32)
    m[100:160] = m[3]  # ties
    return [(i, [float(x) for x in m[i]], "x") for i in range(n)]


def test_as_by_brute_force_over_several_blocks(spark):
    rows = vectors()
    assert search(spark, rows, block=150, query_block=2) == brute([r[:2] for r in rows], 10)


def test_nulls_widths_repeats_zeros_and_few_candidates(spark):
    rows = [(0, [1.0, 0.5], "a"), (0, [1.0, 0.5], "a"), (1, None, "a"), (2, [], "a"), (3, [1.0, None], "a"), (4, [float("nan"), 1.0], "a"), (5, [float("inf"), 1.0], "a"), (None, [1.0, 1.0], "a"), (6, [0.0, 0.0], "a"),
            (7, [-1.0, 2.0], "a"), (8, [1.0], "a"), (100, [0.0, 0.0], "a"), (200, [3.0], "a"), (300, [1.0, 2.0, 3.0], "a")]
    got = search(spark, rows)
    assert [r for r in got if r[0] == 200] == [(200, 1, 8, 3072 * 1024)]
    assert not [r for r in got if r[0] == 300]
    assert [r[2] for r in got if r[0] == 100] == [0, 0, 6, 7]
    assert [(r[2], r[3]) for r in got if r[0] == 0 and r[1] <= 3] == [(6, 0), (7, 0), (100, 0)]


def test_empty_table(spark):
    assert search(spark, []) == []


def test_bounds_are_proofs():
    rng = np.random.default_rng(7)
    for n, d, spread in ((50, 4, 3), (400, 8, 50), (600, 32, 2000), (30, 3, 2**40)):
        m = rng.integers(-spread, spread + 1, size=(n, d))
        ids = np.sort(rng.choice(5 * n, n, replace=False))
        places = np.argsort(m, axis=0, kind="stable").T.copy()
        values = np.take_along_axis(m.T, places, axis=1).astype(float)
        for q in (m[0], m[1] * 0, -m[2], m[3] * (rng.random(d) < 0.3)):
            for levels in (2, 8, 32):
                got, scores = I.search(q, ids, m, places, values, 10, int(ids[0]), levels)
                s = m @ q
                order = [i for i in np.lexsort((ids, -s)) if i != 0][:10]
                assert np.array_equal(got, ids[order]) and np.array_equal(scores, s[order])


def test_stops_before_the_last_level_and_rescores_few():
    rng = np.random.default_rng(9)
    for n in (2_000, 20_000):
        m = rng.normal(size=(n, 64))
        m = np.floor(1024 * m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.int64)
        places = np.argsort(m, axis=0, kind="stable").T.copy()
        values = np.take_along_axis(m.T, places, axis=1).astype(float)
        for q in range(0, n, n // 4):
            told = {}
            got, scores = I.search(m[q], np.arange(n), m, places, values, 10, q, told=told)
            s = m @ m[q]
            order = [i for i in np.lexsort((np.arange(n), -s)) if i != q][:10]
            assert np.array_equal(got, order) and np.array_equal(scores, s[order])
            assert told["done"] < told["levels"] and told["rescored"] < n // 3


def test_blocks_are_skipped_by_their_bounds(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] * 4 + 0.2 * rng.normal(size=16)], "x") for i in range(1200)]
    v = I.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"))
    told: dict = {}
    got = sorted(map(tuple, I.top_k(v, v.where(I.is_query(F.col("vec_id"), 50)), block=60, told=told).collect()))
    assert got == brute([r[:2] for r in rows], 10, 50)
    assert told["visited"] < told["pairs"] / 2
