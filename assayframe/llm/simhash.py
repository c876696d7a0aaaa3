"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared in tiles with numpy's exclusive-or and bit counts. Two
fingerprints within a radius also have population counts within it, in the whole and
in sum over any parts, so the distinct fingerprints are laid out by the counts of
their four quarters, and only pairs of tiles whose counts differ by no more than the
radius are compared; all other pairs are skipped with proof. A layout cell with many
fingerprints is cut into tiles of a fixed size, so no task holds more than two tiles.
A tile pair gives the links of a spanning forest, not all pairs, which keeps every
connection and bounds the rows by the fingerprints read; components are then joined
over all tiles.

near_copies is the form for corpora, by similarity instead of bits: texts whose sets of
five-word shingles have a Jaccard similarity of 0.8 or more. Two such sets share one of
their LEAST smallest shingle hashes: always if both have fewer than 40 shingles, as the
sets would otherwise differ in too many, and else but for a chance of 0.2 to the power
LEAST (three pairs in a million at the very threshold, fewer above). So the tiles are
laid out by these hashes: fingerprints of 128 bits are compared within a cell of texts
that have such a hash in common, cells with the same texts only once, and a cell with
more texts than a tile also by the number of shingles, since sets whose sizes differ by
more than the similarity allows can't reach it. Work and shuffle therefore grow with the
texts and with the cells' own copies, not with the square of the corpus. Fingerprints
within the radius (radius_of: none is asked of short texts, whose bits say little; 44 or
40 bits beyond, five standard deviations above what a pair at the threshold has) are
candidates, which are then told apart exactly, by tiles of shingle hashes within each
group of candidates.

Defined results: null, empty and wordless texts have fingerprint zero and are linked
like any other; a text of fewer words than a shingle has one shingle, its whole word
sequence; repeated rows share a component; a component's id is the least non-null id
in it (null if all are null). As near copies, null, empty and wordless texts are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.llm.components import components
from assayframe.llm.expressions import give_back, small_batches
from assayframe.session import cut

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
TILE = 2_048
QUARTERS = 4
#: Shingles that are hashed and counted at once.
BLOCK = 16_384
COPY_WORDS = 5
SIMILARITY = 0.8
#: Least hashes of a text by which its cells are named.
LEAST = 8
#: Cells of so few texts are compared many at once, all their links being kept.
FEW = 4
#: Shingle hashes of a tile in the exact comparison, and cells of its incidence matrices at once (4 bytes each).
TILE_SHINGLES = 100_000
CELLS = 2_000_000
#: Rows of a tile that are compared with the other tile at once.
STRIP = 256
#: Up to so many texts in groups of candidates their keys are broadcast, else joined by a shuffle.
BROADCAST_MEMBERS = 300_000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash over word shingles, repeats included."""
    import xxhash

    w = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = w[at : min(at + BLOCK, n) + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
        h = np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64))


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """df with fp, the fingerprint as a signed long."""
    return small_batches(df).withColumn("fp", _fingerprints(F.col(text)))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _counts(fp: Column) -> Column:
    """Population counts of the quarters as one number in base 17."""
    out = F.lit(0)
    for i in range(QUARTERS):
        out = out * 17 + F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")))
    return out.cast("int")


def _near_cells(radius: int) -> list[tuple[int, ...]]:
    """Offsets of quarter counts of a size up to the radius in sum, one of each opposite pair."""
    found = [()]
    for _ in range(QUARTERS):
        found = [(*x, d) for x in found for d in range(-radius, radius + 1) if sum(map(abs, x)) + abs(d) <= radius]
    return [x for x in found if x >= (0,) * QUARTERS]


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over the pairs of a and b within the radius."""
    left, right = spanning(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius, same)
    return a[left], b[right]


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, y, same in zip(pdf["l_key"], pdf["r_key"], pdf["same"], strict=True):
                a, b = forest(np.asarray(x, dtype=np.int64).view(np.uint64), np.asarray(y, dtype=np.int64).view(np.uint64), radius, bool(same))
                if len(a):
                    yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def _tiles(rows: DataFrame, cell: Sequence[str], parts: Column, payload: Sequence[str]) -> DataFrame:
    """rows (with key) of each cell dealt by the key into so many tiles, which come out near equal: the cell's columns, part, parts and the payload's as arrays."""
    dealt = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    tiles = dealt.groupBy(*cell, "part").agg(F.collect_list(F.struct(*payload)).alias("r"), F.max("parts").alias("parts"))
    return cut(tiles.select(*cell, "part", "parts", *(F.col(f"r.{c}").alias(c) for c in payload)))


def _tile_pairs(tiles: DataFrame, cell: Sequence[str], steps: tuple[int, ...]) -> DataFrame:
    """same, and l_ and r_ with the payload's names: each pair of tiles of one cell (step 0) and of cells whose last column is apart by the other steps, once.

    A tile is sent to its partners by cell and part, so the pairs of a cell with many tiles spread over many tasks.
    A tile alone in its cell, and without another step, meets itself where it is.
    """
    *within, last = cell
    payload = [c for c in tiles.columns if c not in (*cell, "part", "parts")]
    pair = lambda left, right: (*(F.col(c).alias(f"l_{c}") for c in left), *(F.col(c).alias(f"r_{c}") for c in right))
    alone = None
    if len(steps) == 1:
        alone = tiles.where("parts = 1").select(F.lit(True).alias("same"), *pair(payload, payload))
        tiles = tiles.where("parts > 1")
    sizes = tiles.groupBy(*cell).agg(F.max("parts").alias("other_parts")).withColumnRenamed(last, "other")
    start = tiles.withColumn("step", F.explode(F.array(*map(F.lit, steps))))
    start = start.withColumn("other", F.col(last) + F.col("step") if len(steps) > 1 else F.col(last))
    first = F.when(F.col("step") == 0, F.col("part")).otherwise(0)
    sent = start.join(sizes, [*within, "other"]).where(first < F.col("other_parts")).withColumn("other_part", F.explode(F.sequence(first, F.col("other_parts") - 1)))
    left = sent.select(*within, "other", "other_part", "step", "part", *pair(payload, ()))
    right = tiles.select(*within, F.col(last).alias("other"), F.col("part").alias("other_part"), *pair((), payload))
    same = (F.col("step") == 0) & (F.col("part") == F.col("other_part"))
    met = left.join(right, [*within, "other", "other_part"]).select(same.alias("same"), *(f"{side}_{c}" for side in "lr" for c in payload))
    return met if alone is None else alone.union(met)


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all that lie within the radius."""
    cells = distinct.select(F.col("fp").alias("key"), _counts(F.col("fp")).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size"))
    tiles = _tiles(cells.join(sizes, "cell"), ["cell"], F.ceil(F.col("size") / (tile * 3 // 4)).cast("int"), ["key"])
    steps = tuple(sum(d * 17 ** (QUARTERS - 1 - i) for i, d in enumerate(x)) for x in _near_cells(radius))
    return _tile_pairs(tiles, ["cell"], steps).mapInPandas(_compare(radius), "a long, b long")


def _members(df: DataFrame, doc_id: str, text: str, radius: int, tile: int) -> DataFrame:
    """doc_id, key (MD5 of the text), fp, root (a fingerprint that names the component), component_id for each row of df."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = cut(fingerprints(rows).select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"), "fp"))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, radius, tile))
    linked = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(linked.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row a row of df: doc_id, fingerprint (hex), component_id."""
    return _members(df, doc_id, text, radius, tile).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int) -> set[bytes]:
    """The distinct shingles of a text; that of too few words is its whole word sequence, and without words it is empty."""
    w = (text or "").encode().lower().split()
    if len(w) < words:
        return {b" ".join(w)} if w else {b""}
    return set(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))


def wide_fingerprint(text: str | None, words: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of distinct shingles, SimHash of 128 bits as two words, the LEAST smallest hashes) of a text's shingle set."""
    import xxhash

    shingles = shingle_set(text, words)
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, shingles)), dtype=np.uint8).reshape(-1, 16)
    ones = sum(np.unpackbits(digests[i : i + BLOCK], axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(digests), BLOCK))
    low = digests.view(np.int64)[:, 0]
    low = np.partition(low, LEAST)[:LEAST] if len(low) > LEAST else low
    return len(shingles), np.packbits(ones * 2 > len(digests), bitorder="little").view(np.int64), low


def _wide(words: int):
    @F.pandas_udf("n int, f1 long, f2 long, low array<long>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = [wide_fingerprint(t, words) for t in batch]
            yield pd.DataFrame({
                "n": np.array([n for n, _, _ in rows], dtype=np.int32), "f1": np.array([f[0] for _, f, _ in rows], dtype=np.int64),
                "f2": np.array([f[1] for _, f, _ in rows], dtype=np.int64), "low": [low for _, _, low in rows],
            })
        give_back()

    return run


def _hashes(words: int):
    """key, cell and h, the sorted hashes of the text's shingle set; in small batches, since hashes are larger than the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                h = [np.sort(np.fromiter((xxhash.xxh64_intdigest(s) for s in shingle_set(t, words)), dtype=np.uint64)).view(np.int64) for t in part["text"]]
                yield pd.DataFrame({"key": part["key"], "cell": part["cell"], "h": h})
        give_back()

    return run


def spanning(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the links of a spanning forest over the pairs marked in near. same: rows and columns are the same nodes."""
    rows_left, columns_left = near.any(axis=1), near.any(axis=0)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for start in np.flatnonzero(rows_left):
        if not rows_left[start]:
            continue
        rows_left[start] = False
        if same:
            columns_left[start] = False
        queue = [(True, start)]
        while queue:
            by_row, at = queue.pop()
            reached = np.flatnonzero(near[at] & columns_left if by_row else near[:, at] & rows_left)
            if not len(reached):
                continue
            (columns_left if by_row else rows_left)[reached] = False
            if same:
                rows_left[reached] = columns_left[reached] = False
            here = np.full(len(reached), at)
            found.append((here, reached) if by_row else (reached, here))
            queue += [(same or not by_row, k) for k in reached.tolist()]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _linked(left: np.ndarray, right: np.ndarray, near: np.ndarray, same: bool) -> pd.DataFrame:
    """The names of a spanning forest's links over the pairs marked in near."""
    x, y = spanning(near, same)
    return pd.DataFrame({"a": left[x], "b": right[y]})


def radius_of(n: np.ndarray) -> np.ndarray:
    """Bits in which the fingerprint of a set of n shingles may differ from a candidate's."""
    return np.where(n < 16, 128, np.where(n < 64, 44, 40)).astype(np.int16)


def _apart(left: Sequence[np.ndarray], right: Sequence[np.ndarray], similarity: float) -> np.ndarray:
    """Which of left and right, both (f1, f2, n) along the last axis, are candidates."""
    bits = sum(np.bitwise_count(a[..., :, None] ^ b[..., None, :]).astype(np.int16) for a, b in zip(left[:2], right[:2], strict=True))
    n, m = left[2][..., :, None], right[2][..., None, :]
    return (bits <= np.maximum(radius_of(left[2])[..., :, None], radius_of(right[2])[..., None, :])) & (n >= similarity * m - 1e-6) & (m >= similarity * n - 1e-6)


def _apart_in_strips(left: Sequence[np.ndarray], right: Sequence[np.ndarray], similarity: float) -> np.ndarray:
    return np.concatenate([_apart([x[i : i + STRIP] for x in left], right, similarity) for i in range(0, len(left[0]), STRIP)])


def _compare_wide(similarity: float):
    """Candidates among the texts of two tiles, as the links of a forest over their first 64 bits."""

    def of(keys, f2, n) -> list[np.ndarray]:
        return [np.asarray(keys, dtype=np.int64).view(np.uint64), np.asarray(f2, dtype=np.int64).view(np.uint64), np.asarray(n, dtype=np.int32)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = np.where(pdf["same"].to_numpy(bool), pdf["l_key"].map(len), 0)
            for few in range(2, FEW + 1):
                if (here := pdf[size == few]).empty:
                    continue
                side = [x.reshape(-1, few) for x in of(*(np.concatenate(list(here[c])) for c in ("l_key", "l_f2", "l_n")))]
                near = np.triu(_apart(side, side, similarity), 1)
                at, x, y = np.nonzero(near)
                if len(at):
                    yield pd.DataFrame({"a": side[0][at, x].view(np.int64), "b": side[0][at, y].view(np.int64)})
            for r in pdf[(size == 0) | (size > FEW)].itertuples(index=False):
                left, right = of(r.l_key, r.l_f2, r.l_n), of(r.r_key, r.r_f2, r.r_n)
                if left[2].max() < similarity * right[2].min() or right[2].max() < similarity * left[2].min():
                    continue
                ones = [np.bitwise_count(x[0]).astype(np.int16) + np.bitwise_count(x[1]) for x in (left, right)]
                radius = max(radius_of(left[2]).max(), radius_of(right[2]).max())
                if ones[0].min() - ones[1].max() > radius or ones[1].min() - ones[0].max() > radius:
                    continue
                found = _linked(left[0].view(np.int64), right[0].view(np.int64), _apart_in_strips(left, right, similarity), bool(r.same))
                if len(found):
                    yield found
        give_back()

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of left shares with each of right, by incidence matrices of the hashes that both sides have."""
    sides = [np.concatenate(t) for t in (left, right)]
    rows = [np.repeat(np.arange(len(t)), [len(h) for h in t]) for t in (left, right)]
    both = np.intersect1d(*sides)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    at = [np.searchsorted(both, s) for s in sides]
    kept = [(k < len(both)) & (both[np.minimum(k, max(0, len(both) - 1))] == s) if len(both) else np.zeros(len(s), bool) for k, s in zip(at, sides, strict=True)]
    at, rows = [k[m] for k, m in zip(at, kept, strict=True)], [r[m] for r, m in zip(rows, kept, strict=True)]
    columns = max(1, CELLS // max(1, len(left), len(right)))
    for c in range(0, len(both), columns):
        parts = []
        for k, r, t in zip(at, rows, (left, right), strict=True):
            here = (k >= c) & (k < c + columns)
            m = np.zeros((len(t), min(columns, len(both) - c)), dtype=np.float32)
            m[r[here], k[here] - c] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def alike(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of left and right, sets of hashes, are as similar as asked for."""
    sizes = [np.array([len(h) for h in t], dtype=np.float64) for t in (left, right)]
    out = []
    for i in range(0, len(left), STRIP):
        shared = shared_counts(left[i : i + STRIP], right)
        out.append(shared >= similarity * (sizes[0][i : i + STRIP, None] + sizes[1][None, :] - shared) - 1e-4)
    return np.concatenate(out)


def _verify(similarity: float):
    """Links between texts of two tiles that are as similar as asked for, as those of a forest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                left, right = ([np.asarray(h, dtype=np.int64) for h in t] for t in (r.l_h, r.r_h))
                found = _linked(np.asarray(r.l_key, dtype=object), np.asarray(r.r_key, dtype=object), alike(left, right, similarity), bool(r.same))
                if len(found):
                    yield found
        give_back()

    return run


def candidates(prints: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """a, b: links between the first 64 bits of texts that may be as similar as asked for. prints: text_key, n, f1, f2 and low, one row a text."""
    named = prints.select("text_key", "n", F.col("f1").alias("key"), "f2", F.explode("low").alias("hash"))
    # Cells that hold the same texts, as those of copies do, are compared once: equal in number and in the exclusive-or of the texts' hashes.
    shared = named.groupBy("hash").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("text_key")).alias("members")).where("size > 1")
    cells = shared.groupBy("size", "members").agg(F.min("hash").alias("hash")).select("hash", "size")
    log = F.floor(F.ln(F.col("n").cast("double")) / F.lit(float(-np.log(similarity))) + 1e-9).cast("int")
    rows = cut(named.join(cells, "hash").select("hash", F.when(F.col("size") > tile, log).otherwise(0).alias("cell"), "size", "key", "f2", "n").distinct())
    large = F.col("size") > tile
    small = _tiles(rows.where(~large), ["hash"], F.lit(1), ["key", "f2", "n"]).where(F.size("key") > 1)
    classes = rows.where(large)
    counts = classes.groupBy("hash", "cell").agg(F.count("*").alias("rows"))
    hot = _tiles(classes.join(counts, ["hash", "cell"]), ["hash", "cell"], F.ceil(F.col("rows") / (tile * 3 // 4)).cast("int"), ["key", "f2", "n"])
    return _tile_pairs(small, ["hash"], (0,)).union(_tile_pairs(hot, ["hash", "cell"], (0, 1))).mapInPandas(_compare_wide(similarity), "a long, b long")


def near_copies(df: DataFrame, text: str = "text", words: int = COPY_WORDS, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """key, root: for the MD5 of each text that isn't the first of its group, and that of the first, the group's name."""
    keyed = small_batches(df).select(F.col(text).alias("text")).withColumn("key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    prints = keyed.select(F.col("key").alias("text_key"), _wide(words)(F.col("text")).alias("p")).select("text_key", "p.*")
    prints = cut(prints.groupBy("text_key").agg(*(F.first(c).alias(c) for c in ("n", "f1", "f2", "low"))))
    # Candidates are named by their first 64 bits; texts that share these belong together as candidates, whatever else.
    roots = components(candidates(prints, similarity, tile))
    grouped = prints.join(roots, prints["f1"] == roots["node"], "left").select(F.col("text_key").alias("key"), F.coalesce("root", "f1").alias("cell"))
    several = cut(grouped.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"))
    members = cut(grouped.join(F.broadcast(several) if several.count() <= BROADCAST_MEMBERS else several, "cell"))
    texts = keyed.join(F.broadcast(members) if members.count() <= BROADCAST_MEMBERS else members, "key").groupBy("key", "cell").agg(F.first("text").alias("text"))
    hashed = cut(texts.mapInPandas(_hashes(words), "key string, cell long, h array<long>"))
    totals = cut(hashed.groupBy("cell").agg(F.sum(F.size("h")).alias("total"), F.count("*").alias("texts")))
    # Joined without a shuffle where groups are few, the texts of a large group are dealt into tiles from where they are.
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_MEMBERS else totals
    parts = F.ceil(F.greatest(F.col("total") / TILE_SHINGLES, F.col("texts") / TILE)).cast("int")
    exact = _tiles(hashed.join(totals, "cell"), ["cell"], parts, ["key", "h"])
    found = components(_tile_pairs(exact, ["cell"], (0,)).mapInPandas(_verify(similarity), "a string, b string"))
    return found.select(F.col("node").alias("key"), "root")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """df with one row of each group of near copies: that of the least id (nulls last), of equal ids that of the least MD5 of the text.

    how: words, similarity and the rest as for near_copies.
    """
    roots = near_copies(df, text, **how)
    keyed = df.withColumn("_md5", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    pairs = keyed.groupBy(F.col(doc_id).alias("doc_id"), F.col("_md5").alias("key")).agg(F.count("*").alias("n"))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    # The first row of each text, then that of each group.
    by_text = pairs.groupBy("key").agg(F.min(row).alias("r")).join(roots, "key", "left")
    firsts = by_text.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("r").alias("r")).select(F.col("r.doc_id").alias("_id"), F.col("r.key").alias("_key"))
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    odd = cut(pairs.join(firsts, same, "left").where("_key is null or n > 1").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("_key").isNotNull().alias("kept")))
    here = (F.col("_md5") == F.col("_key")) & F.col(doc_id).eqNullSafe(F.col("_id"))
    count = odd.agg(F.count("*").alias("all"), F.count_if("kept").alias("kept")).first()
    if count["all"] > BROADCAST_MEMBERS:
        return keyed.join(firsts, here, "left_semi").dropDuplicates([doc_id, "_md5"]).drop("_md5")
    # What goes, and what is repeated, is little: the other texts stay where they are.
    out = keyed.join(F.broadcast(odd), here, "left_anti")
    if count["kept"]:
        out = out.unionByName(keyed.join(F.broadcast(odd.where("kept")), here, "left_semi").dropDuplicates([doc_id, "_md5"]))
    return out.drop("_md5")
