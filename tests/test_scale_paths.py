"""The ways that operators take with large inputs, against those with small ones or brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from assayframe.functions import stats
from assayframe.functions.text import count_sentences, sentences
from assayframe.operators import aggregates as A
from assayframe.operators import authoring as W
from assayframe.operators import graph as G
from assayframe.operators import sampling as P
from assayframe.operators import similarity as S


def texts(n=120, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return [(i, " ".join(rng.choices(words, weights=range(40, 0, -1), k=rng.randint(0, 14)))) for i in range(n)]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("tokens", [400_000, 25])
def test_best_jaccard_in_one_block_and_many(spark, tokens):
    cases, corpus = texts(80, 1) + [(900, None), (901, "É ??"), ((1 << 60) + 1, "w1 w2")], texts(30, 2) + [(500, None)]
    got = {r["case_id"]: (r["best_id"], r["similarity"]) for r in S.best_jaccard(*(spark.createDataFrame(x, "id long, text string") for x in (cases, corpus)), "id", "id", block_tokens=tokens).collect()}
    assert len(got) == len(cases)
    for i, t in cases:
        s, order = max(((jaccard(set((t or "").split()) - {"É", "??"}, set((u or "").split())), -j) for j, u in corpus))
        assert got[i] == ((-order, pytest.approx(s)) if s > 0 else (-1, 0.0))


def test_a_common_word_pairs_few_texts(spark):
    """Rows as by brute force with a word that all texts hold, of whose postings few are read."""
    rng = random.Random(5)
    rows = [(i, " ".join(["common", *(f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(3, 9)))])) for i in range(3000)]
    cases, corpus = rows[:400], [(i, t) for i, t in rows[200:]]
    sets = {i: frozenset(t.split()) for i, t in corpus}
    got = {r["case_id"]: (r["best_id"], r["similarity"]) for r in S.best_jaccard(*(spark.createDataFrame(x, "id long, text string") for x in (cases, corpus)), "id", "id", block_tokens=3000).collect()}
    for i, t in cases:
        own = frozenset(t.split())
        s, order = max((jaccard(own, u), -j) for j, u in sets.items())
        assert got[i] == (-order, pytest.approx(s))
    held = [(i, list(u)) for i, u in sets.items()]
    codes, words = S.pd.factorize(S.np.concatenate([u for _, u in held]))
    rank = S.np.argsort(S.np.argsort(S.np.bincount(codes), kind="stable"))
    block = S.Block([i for i, _ in held], list(S.pd.Series(words)[S.np.argsort(S.np.bincount(codes), kind="stable")]), S.np.cumsum([len(u) for _, u in held]), rank[codes])
    i, t = corpus[-1]
    best, s, read = block.best(t.split(), 0.0)
    assert (best, s) == (i, 1.0) and read < len(corpus) / 4


def test_greedy_passes_over_a_long_chain_and_over_rounds(spark):
    chain = spark.range(1, 10_001).select(F.col("id").alias("later"), (F.col("id") - 1).alias("earlier"))
    assert sorted(r["later"] for r in S.refused(chain).collect()) == list(range(1, 10_001, 2))
    rng = random.Random(2)
    pairs = {(max(p), min(p)) for p in (rng.sample(range(60), 2) for _ in range(90))}
    gone: set = set()
    for i in range(60):
        if any((i, j) in pairs and j not in gone for j in range(i)):
            gone.add(i)
    df = spark.createDataFrame(sorted(pairs), "later long, earlier long")
    for most in (1_000_000, 5):
        assert {r["later"] for r in S.refused(df, pass_pairs=most).collect()} == gone


def test_components_of_a_long_path_and_of_stars(spark):
    path = spark.range(1, 3000).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    star = spark.range(1, 500).select((F.col("id") + 5000).alias("a"), F.lit(5000).cast("long").alias("b"))
    got = G.components(path.union(star), "a", "b").groupBy("root").count().collect()
    assert {r["root"]: r["count"] for r in got} == {0: 3000, 5000: 500}


def test_replay_of_a_thousand_levels(spark):
    cases = spark.range(1, 1001).select(F.col("id").alias("case_id"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"), F.col("id").cast("string").alias("text"))
    got = {r["case_id"]: list(r["texts"]) for r in G.replayed(cases).collect()}
    assert got[1000] == [str(k) for k in range(1, 1001)] and got[1] == ["1"] and len(got[37]) == 37


def test_cosines_by_pivots_skip_most_blocks(spark):
    rng = S.np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    m = centres[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 16))
    m[5] = m[6]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")
    told: dict = {}
    got = {r["case_id"]: (r["best_id"], r["similarity"]) for r in S.best_cosine(rows.where("id < 200"), rows, "id", "v", pivots=64, block_rows=64, told=told).collect()}
    u = m / S.np.linalg.norm(m, axis=1, keepdims=True)
    s = S.np.maximum(S.np.round(u[:200] @ u.T, 9), 0)
    s[S.np.arange(200), S.np.arange(200)] = -1
    assert {i: b for i, (b, _) in got.items()} == dict(enumerate(s.argmax(axis=1)))
    assert told["visited"] < told["pairs"] / 4


@pytest.mark.parametrize("above", [0.2, 0.4, 0.75])
def test_similar_pairs_as_by_all_pairs(spark, above):
    rows = texts()
    sets = {i: set(t.split()) for i, t in rows}
    want = {(i, j) for i in sets for j in sets if j < i and jaccard(sets[i], sets[j]) > above}
    pairs = S.similar_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text", above)
    assert {(r["later"], r["earlier"]) for r in pairs.collect()} == want
    taken, refused = [], set()
    for i in sorted(sets):
        if any((i, j) in want for j in taken):
            refused.add(i)
        else:
            taken.append(i)
    assert {r["later"] for r in S.refused(pairs).collect()} == refused


def test_large_samples_as_by_the_hash(spark, monkeypatch):
    want = sorted(range(3000), key=lambda i: (hashlib.sha256(f"5:{i}".encode()).hexdigest(), i))
    df = spark.range(3000).withColumn("_note", F.lit("x"))
    for top in (10_000, 10):
        monkeypatch.setattr(P, "TOP", top)
        for how in ({"count": 700}, {"fraction": 0.25}, {"count": 5000}, {"count": 0}):
            n = how.get("count", 750)
            got = P.hash_sample(df, "id", 5, **how)
            assert got.columns == df.columns and {r["id"] for r in got.collect()} == set(want[:n])


def test_rotation_of_a_hot_stratum(spark):
    rows = [("a", i) for i in range(500)] + [("b", i) for i in range(3)]
    got = P.rotated(spark.createDataFrame(rows, "s string, k long"), "s", "k", 7, 0.1, 2).collect()
    assert {r["k"] for r in got if r["s"] == "a"} == set(range(7, 57)) and {r["k"] for r in got if r["s"] == "b"} == {1, 2}


def test_deep_chains_and_cycles(spark):
    edges = [(i, i - 1 if i else None) for i in range(150)] + [(1000, 1001), (1001, 1000), (1002, 1001)]
    df = spark.createDataFrame(edges, "case_id long, parent_id long")
    got = {r["case_id"]: r["level"] for r in G.levels(df).collect()}
    assert got == {**{i: i for i in range(150)}, 1000: -1, 1001: -1, 1002: -1}
    assert {r["case_id"] for r in G.closure(spark.createDataFrame([(1002,), (30,)], "case_id long"), df.where("case_id < 40 or case_id >= 1000")).collect()} == {*range(31), 1000, 1001, 1002}


def test_pruning_goes_on_to_the_end(spark):
    rows = [(i, i, "original", i - 1 if i else 99) for i in range(12)] + [(50, 50, "original", None), (51, 50, "pressure", 50), (52, 77, "pressure", None)]
    assert {r["case_id"] for r in G.prune(spark.createDataFrame(rows, "case_id long, group_id long, variant string, parent_id long")).collect()} == {50, 51}


def test_replay_of_chains(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 9, "d"), (5, 6, "e"), (6, 5, "f")], "case_id long, parent_id long, text string")
    assert {r["case_id"]: list(r["texts"]) for r in G.replayed(df).collect()} == {1: ["a"], 2: ["a", "b"], 3: ["a", "b", "c"], 4: ["d"], 5: ["e"], 6: ["f"]}


def test_means_do_not_depend_on_the_order(spark):
    rows = [(k / 3,) for k in range(1, 200)]
    means = {spark.createDataFrame(rows, "x double").repartition(n).agg(stats.exact_mean(F.col("x"))).first()[0] for n in (1, 3, 7)}
    assert len(means) == 1 and means.pop() == pytest.approx(100 / 3, abs=1e-9)


def test_sentences_around_decimals_and_abbreviations(spark):
    said = {"It is 1.5. Or 227.5.221.1 of them.": 3, "See e.g. this... and i.e. that!": 1, 'He said "No." Then left': 2, "Mr. A. met Dr. B": 2, "?!": 0, "One\ntwo": 1, "": 0, None: 0}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", F.size(sentences(F.col("t"))).alias("n")).collect()}
    assert [got[i] for i in range(len(said))] == list(said.values())
    counted = {r["i"]: r["n"] for r in df.select("i", count_sentences(F.col("t")).alias("n")).collect()}
    assert counted == got
    more = {"a.... b": 2, "Wow!... so": 2, "(etc.) and etc.! x": 2, "1.2.3 and 10.20.30": 2, "x etc... y": 2, 'so..." he': 1, "ETC. Dr. Who?": 1, "i.e. E.G. x. y": 2}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(more)], "i int, t string")
    assert {r["t"]: r["n"] for r in df.select("t", count_sentences(F.col("t")).alias("n")).collect()} == more


def test_items_by_family_and_tag(spark):
    items = spark.createDataFrame([("a", "math", ["arithmetic"]), ("b", "coding", ["function", "length"]), ("c", "math", None)], "check_id string, family string, tags array<string>")
    picked = lambda **how: {r["check_id"] for r in W.items_for(items, **how).collect()}
    assert picked() == {"a", "b", "c"} and picked(families=["math"]) == {"a", "c"} and picked(tags=["length", "arithmetic"]) == {"a", "b"} and picked(families=["math"], tags=["length"]) == set()


def test_lists_are_cut_and_ordered(spark):
    rows = spark.createDataFrame([("a", i) for i in range(20, 0, -1)] + [("b", 5)], "arm string, k int")
    assert {r["arm"]: list(r["ids"]) for r in A.first_rows(rows, ["arm"], ["k"], 3, "ids", F.col("k")).collect()} == {"a": [1, 2, 3], "b": [5]}
    terms = spark.createDataFrame([("a", t, i) for i, t in enumerate("zzyyxw")], "arm string, term string, seen int")
    assert [(r["term"], r["n"], r["rank"]) for r in A.top_by_count(terms, ["arm"], "term", "seen", 3).orderBy("rank").collect()] == [("z", 2, 1), ("y", 2, 2), ("x", 1, 3)]


def test_tasks_of_a_block_grow_with_its_cases(spark, monkeypatch):
    """A block's cases are dealt among more tasks the more tokens they have, so that none reads more than the bound asks for."""
    from assayframe.operators import similarity as S

    cases = spark.createDataFrame([(k, f"w{k % 50} w{k % 7} x{k} y{k}") for k in range(600)], "id long, text string")
    corpus = spark.createDataFrame([(k, f"w{k} z{k}") for k in range(50)], "cid long, text string")
    read = spark.sparkContext.accumulator(0)
    visited = S._visited

    def counted(batches):
        seen = 0

        def through():
            nonlocal seen
            for pdf in batches:
                seen += int((pdf["kind"] == 1).sum())
                yield pdf

        yield from visited(through())
        read.add(seen > 150)

    want = {tuple(r) for r in S.best_jaccard(cases, corpus, "id", "cid").collect()}
    monkeypatch.setattr(S, "_visited", counted)
    got = {tuple(r) for r in S.best_jaccard(cases, corpus, "id", "cid", case_tokens=100).collect()}
    assert got == want and len(got) == 600 and read.value == 0


def test_a_rule_works_its_value_out_once(spark):
    """What several comparisons of a rule need is in the plan once."""
    from assayframe.operators import authoring as W

    rows = spark.createDataFrame([(1, "authored", "standard", "One than. Two. Three.", "hard", ["p"]), (2, "authored", "standard", "One. Two. Three.", "hard", ["p"])], "family_id long, provenance string, kind string, situation string, notes string, principles_in_play array<string>")
    found = W.family_rules(rows, ("than", "sch"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("[.!?]+") <= 2 and {(r["entity_id"], r["rule"]) for r in found.collect()} == {("1", "uncued")}


def test_a_batch_of_cases_is_compared_a_bounded_part_at_a_time():
    """However many cases a batch holds, their cosines with a whole block are never held together."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from assayframe.operators import similarity as S

    rng, n, rows = np.random.default_rng(3), 4000, 3000
    m, v = rng.normal(size=(rows, 4)), rng.normal(size=(n, 4))
    batch = pd.DataFrame({"block": 1, "kind": [0] + [1] * n, "ids": [np.arange(rows)] + [None] * n, "m": [m.tobytes()] + [None] * n, "case_id": [0, *range(n)], "v": [None, *v], "best_id": -1, "s": -1.0})
    tracemalloc.start()
    found = pd.concat(S._compared(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000
    for k in range(0, n, 397):
        s = np.maximum(np.round(v[k] @ m.T, 9), 0)
        if k < rows:
            s[k] = -1
        assert found["best_id"].iloc[k] == s.argmax() and abs(found["s"].iloc[k] - s.max()) < 1e-8
