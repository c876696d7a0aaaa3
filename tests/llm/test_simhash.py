import random

import numpy as np
import xxhash

from assayframe.llm import simhash as S
from assayframe.llm.components import components


def plain_fingerprint(text):
    import re

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=2):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((str(i), f"{prints[k][1]:016x}", str(least.get(root(k)))) for k, (i, _) in enumerate(rows))


def texts():
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(100, 400))] for _ in range(12)]
    rows = []
    for k in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"X{rng.randint(0, 9)}"
        rows.append((k, " ".join(w)))
    odd = [None, "", " \t\n", "one", "One", "one two", "a b c", "é x y", "A\x0bB\x0cC", "the " * 30_000]
    return rows + [(500 + i, t) for i, t in enumerate(odd)] + [(3, rows[3][1]), (None, rows[5][1]), (None, "only null here at all")]


def test_as_by_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    for tile in (2048, 4):
        assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in S.near_duplicates(df, tile=tile).collect()) == want


def test_links_connect_all_pairs_within_the_radius(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(-(2**63), 2**63 - 1, size=30, dtype=np.int64)
    prints = {int(s) for s in seeds}
    for s in seeds:
        x = int(s)
        for _ in range(20):
            x ^= 1 << int(rng.integers(0, 63))
            prints.add(x)
    prints |= {0, 1, -1, -2, 1 << 62}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for radius, tile in ((2, 2048), (2, 8), (1, 16), (3, 64)):
        got = {r["node"]: r["root"] for r in components(S.links(df, radius, tile)).collect()}
        names = {p: got.get(p, p) for p in prints}
        us = sorted(prints)
        parent = {p: p for p in us}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(us):
            for b in us[:i]:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                    parent[root(a)] = root(b)
        groups, found = {}, {}
        for p in us:
            groups.setdefault(root(p), set()).add(p)
            found.setdefault(names[p], set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_forest_is_small_even_where_all_pairs_link():
    a = np.array([(1 << i) | 1 for i in range(1, 60)], dtype=np.uint64)
    left, right = S.forest(a, a, 2, True)
    assert len(left) == len(a) - 1 == len(right)


def test_components_of_a_chain_a_star_loops_and_nulls(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, k) for k in range(1001, 1300)] + [(7, 7), (None, 3), (3, None), (1, 0)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{k: 1000 for k in range(1001, 1300)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)}


def plain_groups(rows, similarity=0.8):
    """The rows that stay, by brute force over all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root(k), []).append((i is None, i or 0))
    return sorted(str(None if last else i) for last, i in map(min, groups.values()))


def copies():
    """Texts with copies edited to similarities on either side of the threshold."""
    rng = random.Random(11)
    rows = []
    for g in range(25):
        base = [f"t{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 500))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 8)):
            w = list(base)
            for _ in range(int(len(w) * rng.choice((0.004, 0.01, 0.015, 0.05, 0.1)))):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_one_of_each_group_stays(spark, monkeypatch):
    rows = copies() + [(900 + i, t) for i, t in enumerate([None, "", " \t", "one", "One", "one two three four five", "ONE two  three four five"])] + [(None, "null id only here"), (3, copies()[3][1])]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, fp string")
    for tile, shingle_tile in ((2048, 150_000), (10, 900)):
        monkeypatch.setattr(S, "TILE_SHINGLES", shingle_tile)
        monkeypatch.setattr(S, "BROADCAST_MEMBERS", tile - 10)
        out = S.keep_one(df, tile=tile)
        assert out.columns == df.columns
        assert sorted(str(r["doc_id"]) for r in out.collect()) == plain_groups(rows)
    assert S.keep_one(df.limit(0)).count() == 0


def test_shared_counts(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 300, size=rng.integers(0, 80))) for _ in range(n)] for n in (7, 5))
    monkeypatch.setattr(S, "CELLS", 100)
    assert np.array_equal(S.shared_counts(a, b), [[len(np.intersect1d(x, y)) for y in b] for x in a])
    monkeypatch.setattr(S, "STRIP", 3)
    for similarity in (0.05, 0.2):
        assert np.array_equal(S.alike(a, b, similarity), [[len(np.intersect1d(x, y)) >= similarity * len(np.union1d(x, y)) - 1e-4 for y in b] for x in a])


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"t{i}" for i in range(300)]
    rows = []
    for k in range(600):
        w = list(base)
        w[rng.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(w)))
    assert [r["doc_id"] for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), tile=128).collect()] == [0]


def test_repeated_ids_with_other_texts_stay(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "something else entirely here"), (2, "alpha beta gamma delta")], "doc_id long, text string")
    assert sorted(r["text"] for r in S.keep_one(df).collect()) == ["alpha beta gamma delta", "something else entirely here"]


def test_layout_covers_neighbours():
    assert len(S._near_cells(2)) == 21 and (0, 0, 0, 0) in S._near_cells(2)
    assert S._near_cells(0) == [(0, 0, 0, 0)]
