import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.llm import maxent as M
from assayframe.llm import queries

SCHEMA = "doc_id long, text string, score double, row long, word string"


def words(text):
    return (text or "").encode().lower().split() + [M.END]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1.0, 1, "x") for i, t in rows], SCHEMA)


def corpus(n=120):
    rng = np.random.default_rng(3)
    kinds = [["der", "die", "und", "das"], ["the", "and", "of", "to"]]
    return [(k, " ".join(rng.choice(kinds[k % 2] + [f"{'ung' if k % 2 else 'ing'}{j}{'keit' if k % 2 else 'tion'}" for j in range(9)], size=int(rng.integers(1, 40))))) for k in range(n)]


def base_of(rows, train):
    counts = Counter(w for i, t in rows if i in train for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, len(words(t)), sum(counts[w] > 0 for w in words(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows]


def scored(spark, rows, train, **kw):
    df = frame(spark, rows)
    model = M.learn(df.where(F.col("doc_id").isin(*train)), **kw)
    return model, M.score(df, model).collect()


def test_counts_and_base_score_as_by_brute_force(spark):
    rows = corpus() + [(500, None), (501, ""), (502, "İ ẞ x THE"), (502, "İ ẞ x THE"), (None, "a\x0bb\x1cc")]
    train = [i for i, _ in rows if i is not None and i % 3]
    _, got = scored(spark, rows, train, updates=1)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9)) for r in got) == sorted(
        (i is None, i or 0, n, k, t, round(b, 9)) for i, n, k, t, b in base_of(rows, train)
    )


def test_words_that_tasks_do_not_hold_meet_their_counts_in_the_join(spark):
    rows = [(k, " ".join([f"w{(k * 50 + j) % 600}" for j in range(50)] + [f"r{(k * 8 + j) % 900}" for j in range(8)])) for k in range(120)]
    few, many = (scored(spark, rows, range(100), held=held, updates=2)[1] for held in (700, 4000))
    results = [sorted((r["doc_id"], r["n_known"], round(r["base_score"], 8), round(r["score"], 5)) for r in got) for got in (few, many)]
    assert results[0] == results[1]


def test_probabilities_sum_to_one(spark):
    rows = corpus()
    model, _ = scored(spark, rows, range(120), updates=4)
    v = model.vocabulary
    members = M._member_table(model.weights[1])
    for one, two in ((v.start, v.start), (0, 3), (M.CONTEXTS + 5, 1)):
        known = [(np.array([k]), np.array([v.label[k]])) for k in range(len(v.words))]
        unknown = [(np.array([-1]), np.array([M.HOT // M.MEMBERS + t])) for t in range(M.TAILS)]
        total = sum(math.exp(M.token_scores(v, model.weights, model.tails, members, at, label, np.array([one]), np.array([two]))[0]) for at, label in known + unknown)
        assert 0.999 < total <= 1 + 1e-9


def test_held_out_texts_are_likelier_than_by_unigrams(spark, small):
    rows = queries.op11_lm_scoring(spark, small).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 200 and held
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in rows)


def test_order_of_words_matters(spark):
    rows = [(k, "the cat sat on the mat " * 5) for k in range(40)] + [(100, "the cat sat on the mat"), (101, "mat the on sat cat the")]
    _, got = scored(spark, rows, range(40))
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[100] > score[101] + 1


@pytest.mark.parametrize("train", [[], [7]])
def test_no_training_documents_and_one(spark, train):
    rows = [(7, "a b"), (8, "a c"), (9, None)]
    _, got = scored(spark, rows, train or [-1])
    assert len(got) == 3 and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert {r["train_tokens"] for r in got} == {3 if train else 0}


def test_empty_table(spark):
    assert scored(spark, [], [1])[1] == []


def test_long_texts_are_read_in_pieces_with_the_same_result(spark, monkeypatch):
    text = " ".join(f"w{k % 50}" for k in range(4000)).encode()
    whole = list(M.token_groups(iter([b"x", text, None])))
    assert len(whole) == 1 and whole[0][1] == [0, 2, 4003]
    v = M.Vocabulary([M.END, *(f"w{k}".encode() for k in range(300))], [1] * 301)
    monkeypatch.setattr(M, "GROUP_BYTES", 100)
    pieces = list(M.token_groups(iter([b"x", text, None])))
    assert len(pieces) > 10 and [w for p in pieces for w in p[0]] == whole[0][0]
    cut = [np.concatenate(x) for x in zip(*((one, two) for *_, one, two in M._contexts(v, [b"x", text, None])))]
    monkeypatch.setattr(M, "GROUP_BYTES", 1 << 20)
    uncut = [np.concatenate(x) for x in zip(*((one, two) for *_, one, two in M._contexts(v, [b"x", text, None])))]
    assert all((a == b).all() for a, b in zip(cut, uncut))


def test_updates_follow_the_gradient(spark):
    left: list = []
    rows = corpus()
    df = frame(spark, rows).where("doc_id < 100")
    fit = M.fit
    M.fit = lambda events, updates, words: fit(events, updates, words, left)
    try:
        M.learn(df, updates=8)
    finally:
        M.fit = fit
    assert left[-1] < left[0] / 3
