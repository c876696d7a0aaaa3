import random
import re
from itertools import combinations

from assayframe.llm import decontamination as D


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    out = set()
    for d, text in docs:
        a = words(text)
        for i, item in items:
            b = words(item)
            if len(b) < 5:
                continue
            n, share = min(D.VERIFY_WORDS, len(b)), 1 if len(b) < 9 else D.SIMILARITY
            for x in range(len(a) - n + 1):
                for y in range(len(b) - n + 1):
                    if sum(p == q for p, q in zip(a[x : x + n], b[y : y + n], strict=True)) >= share * n:
                        out.add((d, i))
    return out


def test_masks_miss_no_two_substitutions():
    for bad in combinations(range(D.VERIFY_WORDS), 2):
        assert any(all(m[b - o] == "0" for b in bad if 0 <= b - o < len(m)) for m in D.MASKS for o in range(D.VERIFY_WORDS - len(m) + 1))


def test_short_masks_miss_nothing_within_the_similarity():
    for n in range(9, D.VERIFY_WORDS):
        for bad in combinations(range(n), next(k for k in range(n) if n - k - 1 < D.SIMILARITY * n)):
            assert any(all(m[b - o] == "0" for b in bad if 0 <= b - o < len(m)) for m in D.CLASSES[1].masks for o in range(n - len(m) + 1))


def test_short_items_as_by_brute_force(spark):
    rng = random.Random(8)
    make = lambda n: [f"w{rng.randint(0, 40)}" for _ in range(n)]
    items = [(i, " ".join(make(3 + i % 12))) for i in range(60)]
    docs = []
    for k in range(150):
        body, part = make(rng.randint(0, 30)), items[k % 60][1].split()
        for j in rng.sample(range(len(part)), min(len(part), k % 4)):
            part[j] = "zz"
        at = rng.randint(0, len(body))
        docs.append((k, " ".join(body[:at] + part + body[at:])))
    found = D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {r["doc_id"]: r["n_items"] for r in found} == {d: sum(x == d for x, _ in want) for d in {d for d, _ in want}} and len(found) > 40


def test_every_place_of_a_repeated_window_counts(spark):
    seed = [f"s{i}" for i in range(9)]
    item = seed + [f"a{i}" for i in range(20)] + seed + [f"b{i}" for i in range(4)]
    doc = [f"x{i}" for i in range(9)] + seed + [f"b{i}" for i in range(4)]
    found = D.overlaps(spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["matched"], r["start"]) for r in found] == [(1, 7, 13, 9)]


def fixture():
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(60)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(n))) for i, n in enumerate((14, 20, 40, 13, 30, 8, 25))] + [(50, None), (51, "")]
    docs = []
    for k in range(40):
        body = make(rng.randint(0, 60))
        if k % 2:
            i, t = items[rng.randint(0, 6)]
            part = t.split()
            for j in rng.sample(range(len(part)), min(len(part), k % 6)):
                part[j] = "zz"
            if k % 3 == 0:
                part = part[: rng.randint(5, len(part))]
            body[len(body) // 2 : len(body) // 2] = part
        docs.append((k, ", ".join(body).title()))
    return docs + [(90, None), (91, ""), (92, items[2][1] * 3 + " tail"), (93, "the " * 3000)], items


def test_as_by_brute_force(spark):
    docs, items = fixture()
    found = D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {r["doc_id"] for r in found} == {d for d, _ in want}
    assert {r["doc_id"]: r["n_items"] for r in found} == {d: sum(x == d for x, _ in want) for d, _ in want}
    for r in found:
        assert (r["doc_id"], r["item_id"]) in want and r["matched"] >= D.SIMILARITY * r["words"]


def test_blocks_of_seeds_give_the_same(spark, monkeypatch):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, D.overlaps(d, b).collect()))
    monkeypatch.setattr(D, "SEED_ROWS", 60)
    assert sorted(map(tuple, D.overlaps(d, b).collect())) == whole


def test_filter_keeps_clean_rows_repeats_nulls_and_columns(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x " + passage, "a"), (1, "x " + passage, "a"), (2, "clean", "b"), (2, "clean", "b"), (None, passage, "c"), (3, None, None)], "doc_id long, text string, key string")
    bench = spark.createDataFrame([(1, passage), (2, passage), (2, passage)], "item_id long, text string")
    for limit in (10, 0):
        monkeypatch.setattr(D, "BROADCAST_KEYS", limit)
        out = D.decontaminate(docs, bench)
        assert out.columns == docs.columns
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(2, "clean", "b"), (2, "clean", "b"), (3, None, None)]))
    assert D.decontaminate(docs, bench.limit(0)).count() == 6
    assert D.decontaminate(docs.limit(0), bench).count() == 0


def test_ids_of_items_may_be_text(spark):
    item = " ".join(f"w{k}" for k in range(20))
    items = spark.createDataFrame([("it-2", item), ("it-1", item + " x"), ("it-3", "a b c d e f g")], "item_id string, text string")
    found = D.overlaps(spark.createDataFrame([(1, f"so {item} x"), (2, "none of it")], "doc_id long, text string"), items).collect()
    assert [(r["doc_id"], r["item_id"], r["n_items"]) for r in found] == [(1, "it-1", 2)]
