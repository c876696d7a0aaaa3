"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are turned into integers and dealt evenly into blocks. A block's index keeps,
for every component, its postings in the order of their values, so that for a query's
component of either sign the postings come in order of impact from one end. Impacts,
counted from the least possible in the block, are quantised into levels, and the
segments of all components are processed level by level from the highest. After a
level, a vector's score is at least what it has gathered and at most that plus the
level's bound for each component not met yet. The search stops when these bounds prove
that so few vectors can still be among the k best that rescoring them exactly reads
fewer components than the postings left, which is never so while all are possible;
where the bounds never part them, all segments are processed and the sums are the scores.
Blocks hold vectors near the same pivot, of a bounded sample. The least and the greatest value of
each component in a block bound every score in it. A query goes first to the block of the greatest
bound, and then only to blocks whose bound reaches the k-th score found there. A block is sent
once for each of the two, and its queries stream past it; a ranking cut to k a query joins what they give.

Defined results: vectors null, empty, or holding null or non-finite components take no
part, neither as queries nor as candidates; vectors are compared with those of equal
length; ties go to the smaller id; rows that share the query's id are not its
candidates, and the least of their vectors is the query; other rows of one id are
ranked each; a query without candidates has no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.session import cut

SCALE = 1024
#: Components of a block's vectors together: 4 MB in each of the index's three arrays.
BLOCK_VALUES = 524_288
QUERY_BLOCK = 256
#: Vectors sampled as pivots at most, and blocks whose ranges are kept in one row.
PIVOTS = 64
RANGE_BLOCKS = 512
LEVELS = 32

INDEX = "block int, width int, ids binary, matrix binary, places binary, sorted binary"
FOUND = "query_id long, vec_id long, score long"


def quantised(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as floor(scale * x), of the rows that take part."""
    x = F.col(embedding).cast("array<double>")
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    return df.where(usable & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda y: F.floor(y * scale)).alias("v"))


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A block's index for each width of vectors in it. A partition is a block."""
    rows = [pdf for pdf in batches if len(pdf)]
    if not rows:
        return
    pdf = pd.concat(rows)
    for width, part in pdf.groupby(pdf["v"].map(len)):
        part = part.sort_values("vec_id", kind="stable")
        m = np.stack(part["v"].to_numpy()).astype(np.int64)
        places = np.argsort(m, axis=0, kind="stable").T.astype(np.int64)
        values = np.take_along_axis(m.T, places, axis=1)
        yield pd.DataFrame(
            [(int(part["block"].iloc[0]), int(width), part["vec_id"].to_numpy(np.int64).tobytes(), m.tobytes(), np.ascontiguousarray(places).tobytes(), np.ascontiguousarray(values, dtype=np.float64).tobytes())],
            columns=[c.split()[0] for c in INDEX.split(", ")],
        )


def _near(pivots: np.ndarray):
    """The pivot nearest to each vector by direction; vectors of another width have none."""

    @F.pandas_udf("int")
    def run(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), -1, dtype=np.int32)
        fit = np.flatnonzero(vectors.map(len).to_numpy() == pivots.shape[1])
        if len(fit):
            out[fit] = (np.stack(vectors.iloc[fit].to_numpy()).astype(np.float64) @ pivots.T).argmax(axis=1)
        return pd.Series(out)

    return run


def _tour(points: np.ndarray) -> np.ndarray:
    """Pivots in such an order that each is followed by the nearest of those left, so that neighbours come into one block."""
    order, left = [0], set(range(1, len(points)))
    while left:
        order.append(max(left, key=lambda j: (float(points[order[-1]] @ points[j]), -j)))
        left.remove(order[-1])
    return points[order]


def build_index(vectors: DataFrame, block: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """The index of vectors (as of quantised), stored by a checkpoint; blocks count from 0. block: vectors of a block, by default as BLOCK_VALUES allows."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n = max(1, math.ceil(size["n"] / (block or max(1, BLOCK_VALUES // (size["width"] or 1)))))
    sample = vectors.where(F.size("v") == (size["width"] or 0)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect() if n > 1 else []
    dealt = vectors.repartition(n)
    if sample:
        points = np.array([r["v"] for r in sample], dtype=np.float64)
        points = _tour(points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300))
        # Ranges of (pivot, place by hash): about as many vectors in each.
        dealt = vectors.withColumn("pivot", _near(points)("v")).repartitionByRange(n, "pivot", F.xxhash64("vec_id", "v")).drop("pivot")
    return cut(dealt.withColumn("block", F.spark_partition_id()).mapInPandas(_index, INDEX))


def search(q: np.ndarray, ids: np.ndarray, matrix: np.ndarray, places: np.ndarray, values: np.ndarray, k: int, own: int, levels: int = LEVELS, room: tuple[np.ndarray, np.ndarray] | None = None, told: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best of a block for a query; ids are sorted, so positions break ties. room: arrays to work in. told: gets levels, done and rescored."""
    n = len(ids)
    used = np.flatnonzero(q)
    exact, q = q, q.astype(np.float64)  # exact, as long as the sums below are
    low = np.minimum(q * values[:, 0], q * values[:, -1])[used]
    high = np.maximum(q * values[:, 0], q * values[:, -1])[used]
    # k best are sought among others: rows of the query's own id may be in the way, so the bound asks for that many more
    lo, hi = np.searchsorted(ids, [own, own + 1])
    want = k + int(hi - lo)
    first = levels // 2
    top = int((high - low).max(initial=0))
    step = max(1, -(-(top + 1) // levels))
    edges = step * np.arange(-(-(top + 1) // step) - 1, -1, -1, dtype=np.float64)  # the lower edge of each level, falling
    cuts = []
    for d, least in zip(used, low, strict=True):
        if q[d] > 0:
            at = np.searchsorted(values[d], np.ceil((edges + least) / q[d]), "left")
            cuts.append(np.concatenate(([n], at)))
        else:
            at = np.searchsorted(values[d], np.floor((edges + least) / q[d]), "right")
            cuts.append(np.concatenate(([0], at)))
    spans = high - low
    # One sum holds both what a vector has gathered and how many components it has met.
    unit = float(1 << int(spans.sum()).bit_length())
    if unit * (len(used) + 1) > 2.0**53:
        return _plain(exact, ids, matrix, k, lo, hi)
    where, impact = room or (np.empty(places.size, np.int64), np.empty(places.size))
    total, may, left = np.zeros(n), np.arange(n), n * len(used)
    for i, edge in enumerate(edges):
        size = 0
        for d, least, at in zip(used, low, cuts, strict=True):
            a, b = (at[i + 1], at[i]) if q[d] > 0 else (at[i], at[i + 1])
            if a < b:
                here, size = slice(size, size + b - a), size + b - a
                where[here] = places[d, a:b]
                part = np.multiply(values[d, a:b], q[d], out=impact[here])
                part += unit - least
        if size:
            total += np.bincount(where[:size], impact[:size], n)
            left -= size
        if n <= want:
            break
        # Components whose whole span lies below the edge are unmet by all, and add their spans to the bound.
        below = spans < edge
        if i < first and not below.any():
            continue
        met = np.floor(total / unit)
        gathered = total - met * unit
        rest = spans[below].sum() + (len(used) - below.sum() - met) * (edge - 1)
        kth = np.partition(gathered, n - want)[n - want]
        may = np.flatnonzero(gathered + rest >= kth)
        # Proven, and cheaper than the rest: rescoring a vector reads all its components.
        if len(may) * len(q) < left:
            break
    if told is not None:
        told |= {"levels": len(edges), "done": i + 1, "rescored": len(may)}
    may = may[(may < lo) | (may >= hi)]
    scores = matrix[may] @ exact
    best = np.lexsort((may, -scores))[:k]
    return ids[may[best]], scores[best]


def _plain(q: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by all scores, for components too large for the sums above to be exact."""
    may = np.delete(np.arange(len(ids)), slice(lo, hi))
    scores = matrix[may] @ q
    best = np.lexsort((may, -scores))[:k]
    return ids[may[best]], scores[best]


def _visited(k: int):
    """The k best of a block for each query that comes behind it in a sorted partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = None
        for pdf in batches:
            found = []
            for r in pdf.itertuples(index=False):
                if r.kind == 0:
                    ids = np.frombuffer(r.ids, np.int64)
                    shape = (r.width, len(ids))
                    places = np.frombuffer(r.places, np.int64).reshape(shape)
                    here = (r.block, r.width, ids, np.frombuffer(r.matrix, np.int64).reshape(len(ids), r.width), places, np.frombuffer(r.sorted, np.float64).reshape(shape), (np.empty(places.size, np.int64), np.empty(places.size)))
                elif here is not None and here[:2] == (r.block, r.width):
                    got, scores = search(np.asarray(r.v, dtype=np.int64), *here[2:6], k, int(r.query_id), room=here[6])
                    found.append(pd.DataFrame({"query_id": int(r.query_id), "vec_id": got, "score": scores}))
            yield pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """group, block, width, low, high: the ends of each component's values in a block."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            values = np.frombuffer(r.sorted, np.float64).reshape(r.width, -1)
            yield pd.DataFrame([(r.block // RANGE_BLOCKS, r.block, r.width, values[:, 0], values[:, -1])], columns=["group", "block", "width", "low", "high"])


def _bounds(first: bool):
    """Of each group of blocks, the block of the greatest bound for a query, or all other blocks whose bound reaches its line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                low, high = np.stack(r.low), np.stack(r.high)
                for q in r.queries:
                    v = np.asarray(q["v"], dtype=np.float64)
                    bound = high @ np.maximum(v, 0) + low @ np.minimum(v, 0)
                    if first:
                        at = int(bound.argmax())
                        out.append((q["vec_id"], q["v"], r.blocks[at], r.width, bound[at]))
                    else:
                        # Bounds are sums of doubles: a hair more than they come out.
                        reach = bound + np.abs(bound) * 1e-12 >= q["line"]
                        out += [(q["vec_id"], q["v"], b, r.width, 0.0) for b, ok in zip(r.blocks, reach, strict=True) if ok and b != q["home"]]
            yield pd.DataFrame(out, columns=["query_id", "v", "block", "width", "bound"])

    return run


_SENT = "query_id long, v array<long>, block int, width int, bound double"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int | None = None, query_block: int = QUERY_BLOCK, told: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of vectors for each row of queries (both as of quantised). told: gets how many (query, block) there are, and how many are visited."""
    index = build_index(vectors, block)
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumns({"home": F.lit(-1), "line": F.lit(0.0)})

    def visit(rows: DataFrame) -> DataFrame:
        both = index.withColumn("kind", F.lit(0)).unionByName(rows.select("block", "width", "query_id", "v").withColumn("kind", F.lit(1)), allowMissingColumns=True)
        n = max(1, index.rdd.getNumPartitions())
        filled = both.withColumn("query_id", F.coalesce("query_id", F.lit(0)))
        return filled.repartition(n, "block").sortWithinPartitions("block", "width", "kind").mapInPandas(_visited(k), FOUND)

    def ranked_best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    blocks = index.agg(F.max("block")).first()[0] or 0
    if not blocks:  # one block, which all queries visit
        return ranked_best(visit(queries.select(F.col("vec_id").alias("query_id"), "v", F.lit(0).alias("block"), F.size("v").alias("width"))))
    last = blocks // RANGE_BLOCKS
    ranges = index.select("block", "width", "sorted").mapInPandas(_ranges, "group int, block int, width int, low array<double>, high array<double>")
    ranges = cut(ranges.groupBy("group", "width").agg(*(F.collect_list(c).alias(c + "s" * (c == "block")) for c in ("block", "low", "high"))))
    parts = max(1, math.ceil(queries.count() / query_block))

    def sent(rows: DataFrame, first: bool) -> DataFrame:
        """Rows of queries for blocks: chunks of queries meet groups of ranges, a few numbers for each block."""
        dealt = rows.repartition(parts).groupBy(F.spark_partition_id().alias("part"), F.size("v").alias("width")).agg(F.collect_list(F.struct("vec_id", "v", "home", "line")).alias("queries"))
        pairs = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(last)))).join(ranges, ["group", "width"])
        return pairs.mapInPandas(_bounds(first), _SENT)

    best = F.max(F.struct("bound", (-F.col("block")).alias("order"))).alias("b")
    nearest = sent(queries, True)
    home = cut(nearest.groupBy("query_id").agg(best, F.first("v").alias("v")).select("query_id", "v", (-F.col("b.order")).alias("block"), F.size("v").alias("width")))
    first = cut(visit(home))
    # The k-th score found at home; without so many, any score may matter.
    ranked = first.groupBy("query_id").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n"))
    lines = home.join(ranked, "query_id", "left").select(F.col("query_id").alias("vec_id"), "v", F.col("block").alias("home"), F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf")).alias("line"))
    others = cut(sent(lines, False))
    if told is not None:
        told |= {"pairs": home.count() * index.count(), "visited": home.count() + others.count()}
    return ranked_best(first.union(visit(others)))


def is_query(vec_id: Column, every: int = 100) -> Column:
    return vec_id % every == 0
