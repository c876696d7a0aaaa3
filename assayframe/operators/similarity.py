"""Similarity of texts and vectors to a corpus, and similar pairs within one, without a product of all with all."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.text import jaccard, token_set
from assayframe.operators.graph import components
from assayframe.session import cut

#: Tokens of the texts of a block, and blocks at least.
BLOCK_TOKENS = 400_000
#: Tokens of the cases that a task reads for a block, about.
CASE_TOKENS = 2_000_000
#: Postings a token, on average, up to which a case's are counted at once.
SHORT_LISTS = 64

LEXICAL_THRESHOLD, LEXICAL_FLOOR = 0.45, 0.35
EMBEDDING_THRESHOLD, EMBEDDING_FLOOR = 0.85, 0.55


_BLOCK = "block int, kind int, ids array<long>, words array<string>, ends array<int>, codes array<int>, case_id string, t array<string>, best_id long, similarity double"
_FOUND = "case_id string, t array<string>, best_id long, similarity double"


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's texts as one block: their ids in order, the distinct tokens with the rarest first, and each text's tokens as numbers."""
    rows = [pdf for pdf in batches if len(pdf)]
    if not rows:
        return
    pdf = pd.concat(rows).sort_values("best_id")
    sizes = pdf["t"].map(len).to_numpy()
    codes, words = pd.factorize(np.concatenate(pdf["t"].to_list()))
    order = np.argsort(np.bincount(codes), kind="stable")
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order))
    yield pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "least": [int(sizes.min())], "most": [int(sizes.max())], "ids": [pdf["best_id"].to_numpy(np.int64)], "words": [list(words[order])], "ends": [np.cumsum(sizes).astype(np.int32)], "codes": [place[codes]]})


class Block:
    """Texts of similar size, and the postings of their tokens."""

    def __init__(self, ids, words, ends, codes) -> None:
        self.ids, self.ends, codes = (np.asarray(x) for x in (ids, ends, codes))
        self.places = {w: k for k, w in enumerate(words)}
        self.sizes = np.diff(self.ends, prepend=0)
        text = np.repeat(np.arange(len(self.ids)), self.sizes)
        order = np.argsort(codes, kind="stable")
        self.postings, self.starts = text[order], np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(self.places)))))

    def best(self, tokens: list[str], so_far: float) -> tuple[int, float, int]:
        """(id, similarity, postings read) of the text most like a case, if it may be as like as `so_far`; -1 if none shares a token or can be.

        Postings are read from the rarest token on. Texts not met yet share at most the tokens left, which bounds their similarity;
        once that is below the best of those met, only they are counted on.
        """
        own = sorted(self.places[t] for t in tokens if t in self.places)
        n, least = len(tokens), int(self.sizes.min())
        lists = [self.postings[self.starts[c] : self.starts[c + 1]] for c in own]
        if (total := sum(map(len, lists))) <= SHORT_LISTS * len(own):  # counted at once, sooner than their bounds are looked at
            both = np.bincount(np.concatenate(lists), minlength=len(self.ids)) if own else np.zeros(len(self.ids), dtype=np.int64)
            s = both / (n + self.sizes - both)
            at = int(np.argmax(s))
            return (int(self.ids[at]), float(s[at]), total) if both[at] else (-1, 0.0, total)
        both, read, met = np.zeros(len(self.ids), dtype=np.int64), 0, None
        found = so_far
        for k in range(len(own)):
            left = len(own) - k
            if left / (n + max(least, left) - left) < found:
                met = np.flatnonzero(both) if met is None else met
                # What those met share at most: what they have, and all tokens left.
                met = met[(both[met] + left) / np.maximum(n + self.sizes[met] - both[met] - left, 1) >= found]
                if not len(met):
                    break
            here = lists[k]
            if met is not None:
                here = here[np.isin(here, met)] if len(here) < 16 * len(met) else met[np.isin(met, here)]
            both[here] += 1
            read += len(here)
            if len(here):
                found = max(found, float((both[here] / (n + self.sizes[here] - both[here])).max()))
        s = both / (n + self.sizes - both)
        at = int(np.argmax(s)) if len(s) else -1
        return (int(self.ids[at]), float(s[at]), read) if at >= 0 and both[at] else (-1, 0.0, read)


def _visited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each case's best in the block that comes before it in a sorted partition."""
    number, block = None, None
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.kind == 0:
                number, block = r.block, Block(r.ids, r.words, r.ends, r.codes)
            elif number == r.block:
                best, s, _ = block.best(list(r.t), r.similarity)
                out.append((r.case_id, r.t, best, s) if best >= 0 and (s > r.similarity or s == r.similarity and (r.best_id < 0 or best < r.best_id)) else (r.case_id, r.t, r.best_id, r.similarity))
        yield pd.DataFrame(out, columns=["case_id", "t", "best_id", "similarity"])


def best_jaccard(cases: DataFrame, corpus: DataFrame, case_id: str, corpus_id: str, text: str = "text", block_tokens: int = BLOCK_TOKENS, case_tokens: int = CASE_TOKENS) -> DataFrame:
    """case_id, best_id, similarity: the corpus text most like each case, the first of equals; -1 and 0 without a shared token.

    The corpus lies in blocks of texts of similar size. A case goes first to the block of its own size, and then to those whose
    sizes allow a text as like as the best found there. A block is sent once for each CASE_TOKENS of its cases, which stream past it, so that a
    task holds one block and reads no more, however many cases there are.
    """
    kind = cases.schema[case_id].dataType.simpleString()
    right = cut(corpus.select(F.col(corpus_id).cast("long").alias("best_id"), token_set(F.col(text)).alias("t")).where(F.size("t") > 0).groupBy("best_id").agg(F.max("t").alias("t")))
    n = max(1, math.ceil((right.agg(F.sum(F.size("t"))).first()[0] or 0) / block_tokens))
    dealt = right.withColumn("n", F.size("t")).repartitionByRange(n, "n", "best_id").drop("n").withColumn("block", F.spark_partition_id())
    blocks = cut(dealt.mapInPandas(_packed, "block int, least int, most int, ids array<long>, words array<string>, ends array<int>, codes array<int>"))
    # A few numbers of each block go to the cases.
    spans = blocks.select("block", "least", "most").orderBy("least", "block").toPandas()
    numbers, low, high = (spans[c].to_numpy() for c in ("block", "least", "most"))

    def bounds(sizes: pd.Series) -> dict[int, np.ndarray]:
        """For each size of a case what a text of each block may be like it at most."""
        return {n: np.minimum(n, high) / np.maximum(n, low) for n in set(sizes)}

    @F.pandas_udf("int")
    def nearest(sizes: pd.Series) -> pd.Series:
        home = {n: int(numbers[x.argmax()]) for n, x in bounds(sizes).items()}
        return sizes.map(home).astype("int32")

    @F.pandas_udf("array<int>")
    def within(sizes: pd.Series, least: pd.Series, home: pd.Series) -> pd.Series:
        """The other blocks whose sizes allow a text as like."""
        known = bounds(sizes)
        return pd.Series([numbers[(known[n] >= s) & (numbers != h)] for n, s, h in zip(sizes, least, home, strict=True)])

    left = cases.select(F.col(case_id).cast("string").alias("case_id"), token_set(F.col(text)).alias("t"))
    if not len(spans):
        return left.select(F.col("case_id").cast(kind).alias("case_id"), F.lit(-1).cast("long").alias("best_id"), F.lit(0.0).alias("similarity"))
    start = cut(left.where(F.size("t") > 0).withColumns({"block": nearest(F.size("t")), "best_id": F.lit(-1).cast("long"), "similarity": F.lit(0.0)}))
    names = [c.split()[0] for c in _BLOCK.split(", ")]

    def visit(rows: DataFrame) -> DataFrame:
        # A block's cases are dealt among as many tasks as their tokens ask for, a few blocks' among all tasks. A number of each block is fetched.
        least = max(1, blocks.sparkSession.sparkContext.defaultParallelism // n)
        tasks = {r["block"]: max(least, math.ceil(r["tokens"] / case_tokens)) for r in rows.groupBy("block").agg(F.sum(F.size("t")).alias("tokens")).collect()}
        dealt_to = F.broadcast(blocks.sparkSession.createDataFrame(list(tasks.items()), "block int, salts int"))
        sent = blocks.drop("least", "most").join(dealt_to, "block").withColumns({"kind": F.lit(0), "best_id": F.lit(-1).cast("long"), "similarity": F.lit(0.0), "salt": F.explode(F.sequence(F.lit(0), F.col("salts") - 1))})
        dealt = rows.join(dealt_to, "block").withColumns({"kind": F.lit(1), "salt": F.pmod(F.xxhash64("case_id"), F.col("salts")).cast("int")})
        both = sent.unionByName(dealt, allowMissingColumns=True).repartitionByRange(max(1, sum(tasks.values())), "block", "salt").sortWithinPartitions("block", "salt", "kind")
        return both.select(*names).mapInPandas(_visited, _FOUND)

    first = cut(visit(start))
    others = first.withColumn("block", F.explode(within(F.size("t"), "similarity", nearest(F.size("t")))))
    found = first.select("case_id", "best_id", "similarity").union(visit(others).select("case_id", "best_id", "similarity")) if n > 1 else first.select("case_id", "best_id", "similarity")
    best = found.groupBy("case_id").agg(F.max(F.struct(F.col("similarity").alias("s"), (-F.col("best_id")).alias("order"))).alias("b"))
    return left.select("case_id").join(best, "case_id", "left").select(
        F.col("case_id").cast(kind).alias("case_id"), F.coalesce(F.when(F.col("b.s") > 0, -F.col("b.order")), F.lit(-1)).cast("long").alias("best_id"), F.coalesce("b.s", F.lit(0.0)).alias("similarity")
    )


def similar_pairs(df: DataFrame, key: str, text: str, above: float) -> DataFrame:
    """later, earlier, similarity: pairs of texts whose token sets' Jaccard similarity is over a threshold above 0, by key.

    By prefixes: tokens are ordered by the number of texts that hold them, rarest first, and two sets as similar
    as asked for share one of their first n - ceil(above n) + 1 tokens, so the commonest tokens of a text pair none.
    """
    rows = cut(df.select(F.col(key).alias("k"), token_set(F.col(text)).alias("t")).where(F.size("t") > 0))
    words = rows.select("k", F.size("t").alias("n"), F.explode("t").alias("token"))
    spread = words.groupBy("token").agg(F.count("*").alias("df"))
    ordered = words.join(spread, "token").groupBy("k", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("w"))
    # A hair below the threshold, since a product of floats may come out above.
    prefix = F.slice("w", 1, (F.col("n") - F.ceil(F.col("n") * F.lit(above) - 1e-9) + 1).cast("int"))
    heads = ordered.select("k", "n", F.explode(prefix).alias("w")).select("k", "n", F.col("w.token").alias("token"))
    other = heads.select(F.col("k").alias("earlier"), F.col("n").alias("m"), "token")
    fits = (F.col("earlier") < F.col("k")) & (F.least("n", "m") >= F.greatest("n", "m") * above - 1e-9)
    pairs = heads.join(other, "token").where(fits).select("k", "earlier").distinct()
    sets = rows.select(F.col("k").alias("earlier"), F.col("t").alias("u"))
    scored = pairs.join(rows, "k").join(sets, "earlier").select(F.col("k").alias("later"), "earlier", jaccard(F.col("t"), F.col("u")).alias("similarity"))
    return scored.where(F.col("similarity") > above)


#: Pairs of a component up to which one task settles it in a single pass.
PASS_PAIRS = 1_000_000


def _passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The refused of whole components, in a partition sorted by component, later and earlier; the refused of one component are held."""
    root, key, gone, out = None, None, set(), []
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            if r.root != root:
                root, gone, key = r.root, set(), None
            if r.later != key and r.earlier not in gone:
                key = r.later
                gone.add(key)
                out.append(key)
        yield pd.DataFrame({"later": pd.Series(out, dtype=pdf["later"].dtype)})
        out = []


def refused(pairs: DataFrame, later: str = "later", earlier: str = "earlier", pass_pairs: int = PASS_PAIRS) -> DataFrame:
    """later: the texts that a greedy pass in the order of keys refuses, each being too like an earlier one that it has accepted.

    Components of the pairs don't bear on each other. Those of up to `pass_pairs` pairs are settled in one ordered pass, spread over tasks by component.
    Larger ones take a round in which texts whose earlier neighbours are all accepted are so too, and all like them refused; what is left of
    them falls into smaller components.
    """
    open_pairs = cut(pairs.select(F.col(later).alias("later"), F.col(earlier).alias("earlier")).where("later is not null and earlier is not null").distinct())
    out = open_pairs.select("later").limit(0)
    while not open_pairs.isEmpty():
        rooted = cut(open_pairs.join(components(open_pairs, "later", "earlier").select(F.col("node").alias("later"), "root"), "later"))
        large = rooted.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > pass_pairs).select("root")
        small = rooted.join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root", "later", "earlier")
        out = out.union(cut(small.select("root", "later", "earlier").mapInPandas(_passed, f"later {open_pairs.schema['later'].dataType.simpleString()}")))
        rest = cut(rooted.join(large, "root").select("later", "earlier"))
        # Earlier texts that wait for none are accepted, and all that are like them refused.
        sure = rest.join(rest.select(F.col("later").alias("earlier")).distinct(), "earlier", "left_anti")
        gone = cut(sure.select("later").distinct())
        out = out.union(gone)
        # Pairs of refused texts, on either side, bind no one any more.
        left = rest.join(gone, "later", "left_anti")
        open_pairs = cut(left.join(gone.select(F.col("later").alias("earlier")), "earlier", "left_anti"))
    return out


def calibrated(similarity: str, floor: float = LEXICAL_FLOOR, sigmas: float = 3.0) -> Column:
    """An aggregate: the threshold from the scores themselves, their mean and three population deviations, at least the floor."""
    return F.greatest(F.lit(floor), F.avg(similarity) + sigmas * F.stddev_pop(similarity))


def annotated(report: DataFrame, threshold: float = LEXICAL_THRESHOLD, floor: float = LEXICAL_FLOOR) -> DataFrame:
    """A report with over_threshold, the calibrated cut and over_calibrated; the cut is one number, fetched first."""
    line = report.agg(calibrated("similarity", floor).alias("c")).first()["c"]
    return report.withColumns({"over_threshold": F.col("similarity") >= threshold, "calibrated_threshold": F.lit(line), "over_calibrated": F.col("similarity") >= F.lit(line)})


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return F.transform(vector, lambda x: F.try_divide(x.cast("double"), norm))


#: Numbers in a block of vectors that a task compares at once, cosines that it works out at once, pivots at most, and what rounding may add to an angle.
BLOCK_VALUES = 262_144
COSINES = 1_048_576
PIVOTS = 128
SLACK = 1e-6

_VECTORS = "kind int, pivot int, least double, most double, ids array<long>, m binary"
_BEST = "case_id long, v array<double>, best_id long, s double"


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))


def _nearest(pivots: np.ndarray):
    """id, v, pivot, angle: each vector with the pivot nearest to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                angles = _angles(np.stack(pdf["v"].to_numpy()), pivots)
                at = angles.argmin(axis=1)
                yield pdf.assign(pivot=at.astype(np.int32), angle=angles[np.arange(len(at)), at])

    return run


def _ringed(rows: int):
    """A sorted partition's vectors cut into blocks of one pivot, each within a ring of angles around it."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        m = np.stack(pdf["v"].to_numpy())
        return pd.DataFrame({"kind": [0], "pivot": [int(pdf["pivot"].iloc[0])], "least": [pdf["angle"].min()], "most": [pdf["angle"].max()], "ids": [pdf["id"].to_numpy(np.int64)], "m": [m.tobytes()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            for _, part in pdf.groupby("pivot", sort=False):
                if held and held[0]["pivot"].iloc[0] != part["pivot"].iloc[0]:
                    yield block(pd.concat(held))
                    held = []
                held.append(part)
                while sum(map(len, held)) >= rows:
                    whole = pd.concat(held)
                    yield block(whole[:rows])
                    held = [whole[rows:]] if len(whole) > rows else []
        if held:
            yield block(pd.concat(held))

    return run


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each case's best in the block that comes before it in a sorted partition, if it is better than what is known."""
    number = None
    for pdf in batches:
        cases = pdf[pdf["kind"] == 1]
        found = []
        for r in pdf[pdf["kind"] == 0].itertuples(index=False):
            found.append((r.block, np.asarray(r.ids, dtype=np.int64), np.frombuffer(r.m, np.float64).reshape(len(r.ids), -1)))
        blocks = {b: (ids, m) for b, ids, m in ([number] if number else []) + found}
        number = found[-1] if found else number
        for b, part in cases.groupby("block"):
            ids, m = blocks[b]
            own = part["case_id"].to_numpy(np.int64)
            k, top = np.empty(len(own), dtype=np.int64), np.empty(len(own))
            step = max(1, COSINES // len(ids))  # some cases at once: a batch's against a whole block would be large
            for at in (slice(i, i + step) for i in range(0, len(own), step)):
                s = np.stack(part["v"].iloc[at].to_numpy()) @ m.T
                np.maximum(np.round(s, 9, out=s), 0.0, out=s)
                s[own[at, None] == ids[None, :]] = -1.0
                k[at] = s.argmax(axis=1)
                top[at] = s.max(axis=1)
            best, known = part["best_id"].to_numpy(np.int64), part["s"].to_numpy()
            better = (top > known) | (top == known) & (top >= 0) & ((best < 0) | (ids[k] < best))
            yield pd.DataFrame({"case_id": own, "v": part["v"].to_numpy(), "best_id": np.where(better, ids[k], best), "s": np.where(better, top, known)})


def best_cosine(cases: DataFrame, corpus: DataFrame, key: str, vector: str, pivots: int = PIVOTS, block_rows: int | None = None, told: dict | None = None) -> DataFrame:
    """key, best_id, similarity: the corpus vector of the largest cosine, at least 0, the first of equals; never that of the case's own key.

    A pivot index, exact by proof: the corpus is grouped round pivots (a sample of at most `pivots` of its vectors), and each group cut into
    blocks by the angle to the pivot. By the triangle inequality no vector of a block is nearer to a case than the case's angle to the
    pivot lies outside the block's ring. A case goes first to the block that may be nearest, and then to those that may still hold one as near
    as the best found there. A block is sent once, and cases stream past it. Vectors are of one width, none null or zero; keys are distinct.
    told: gets how many (case, block) there are, and how many are visited.
    """
    rows = cut(corpus.select(F.col(key).cast("long").alias("id"), unit(F.col(vector)).alias("v")))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
    left = cases.select(F.col(key).cast("long").alias("case_id"), unit(F.col(vector)).alias("v"))
    if not sample:
        return left.where("false").select("case_id", F.lit(0).cast("long").alias("best_id"), F.lit(0.0).alias("similarity"))
    points = np.unique(np.array([r["v"] for r in sample]), axis=0)
    size = block_rows or max(1, BLOCK_VALUES // points.shape[1])
    near = rows.mapInPandas(_nearest(points), "id long, v array<double>, pivot int, angle double")
    ringed = near.repartitionByRange("pivot", "angle", "id").sortWithinPartitions("pivot", "angle", "id").mapInPandas(_ringed(size), _VECTORS)
    # Blocks are named by their place, which the checkpoint fixes. A few numbers of each go to the cases.
    blocks = cut(ringed.withColumn("block", F.monotonically_increasing_id()))
    spans = blocks.select("block", "pivot", "least", "most").toPandas()
    names, at, low, high = (spans[c].to_numpy() for c in ("block", "pivot", "least", "most"))

    def bounds(vectors: pd.Series) -> Iterator[np.ndarray]:
        """For each case the least angle to anything in each block, so many cases at once as make a matrix of BLOCK_VALUES."""
        step = max(1, BLOCK_VALUES // len(names))
        for k in range(0, len(vectors), step):
            angles = _angles(np.stack(vectors.iloc[k : k + step].to_numpy()), points)[:, at]
            yield from np.maximum(np.maximum(low - angles, angles - high), 0.0)

    @F.pandas_udf("long")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series([names[x.argmin()] for x in bounds(vectors)], dtype="int64")

    @F.pandas_udf("array<long>")
    def within(vectors: pd.Series, reach: pd.Series, home: pd.Series) -> pd.Series:
        """The other blocks that may hold something as near."""
        return pd.Series([names[(x <= r) & (names != h)] for x, r, h in zip(bounds(vectors), reach, home, strict=True)])

    def visit(sent: DataFrame) -> DataFrame:
        both = blocks.withColumns({"case_id": F.lit(0).cast("long"), "v": F.lit(None).cast("array<double>"), "best_id": F.lit(-1).cast("long"), "s": F.lit(-1.0)}).unionByName(sent.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        # A partition for every block, or as many as the session deals out.
        n = min(len(names), 4 * blocks.sparkSession.sparkContext.defaultParallelism)
        return both.repartition(n, "block").sortWithinPartitions("block", "kind").select("block", "kind", "ids", "m", "case_id", "v", "best_id", "s").mapInPandas(_compared, _BEST)

    fresh = left.withColumns({"best_id": F.lit(-1).cast("long"), "s": F.lit(-1.0), "block": nearest("v")})
    first = cut(visit(fresh))
    reach = F.acos(F.greatest(F.least("s", F.lit(1.0)), F.lit(0.0))) + SLACK
    others = cut(first.withColumn("block", F.explode(within("v", reach, nearest("v")))))
    if told is not None:
        told |= {"pairs": left.count() * len(names), "visited": left.count() + others.count()}
    found = first.union(visit(others)) if len(names) > 1 else first
    best = found.groupBy("case_id").agg(F.max(F.struct("s", (-F.col("best_id")).alias("order"))).alias("b")).where("b.s >= 0")
    return best.select("case_id", (-F.col("b.order")).alias("best_id"), F.col("b.s").alias("similarity"))
