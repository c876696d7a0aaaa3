"""Hard negatives by distributed radix selection.

An anchor's positives are its best rows of the same label, and for each of them the best
rows of other labels within a window of scores are its hard negatives. Both are found by
one selection over windows: the first `need` rows of a window in the order of falling
score, then rising id.

Selection works on digits. In a pass every task counts, for each window, how many rows
have each value of the next digit of the distance from the window's upper end; the sums
over tasks locate the digit that holds the row wanted last, the window shrinks to it, and
the next pass counts the next digit. When all digits of the score are spent and rows still
tie, the ids are refined in the same way. A window is settled once its last bucket holds no
more rows than wanted, or at most GATHER; a last pass then gathers the rows down to the
bucket's end, and only they are ranked. A task's counts beyond its own last wanted row can't
matter, so it sends at most `need` counts a window and block.

Rows lie in blocks of BLOCK_VALUES numbers. In each pass a block is sent once, and the
anchors follow it in chunks through a sorted partition, so that a task holds one block and
one chunk, whatever the table's size. Scores are worked out by matrix products.

Defined results: rows with a null id or label, a null or empty vector, or null or non-finite
components take no part; of rows of one id the one of the least label and vector counts,
once; only vectors of equal length are compared; an anchor without rows of its label, and a
positive without rows in its window, have no row; scores must fit a long; an empty table
gives no row; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.session import cut

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95
BLOCK_VALUES = 524_288
#: Least rows of a block, where the table is dealt out to more tasks.
BLOCK_ROWS = 1_024
CHUNK = 128
DIGIT = 8
GATHER = 64

_BLOCK = "block int, width int, kind int, ids array<long>, labels binary, matrix binary"
_COUNTS = "anchor_id long, slot int, digit int, n long"
_GATHERED = "anchor_id long, slot int, vec_id long, score long"
_WINDOW = ("slot", "same", "high", "low", "need", "start", "shift", "by_id", "id_start", "id_shift")


def prepared(df: DataFrame, label: Column, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (components as floor(scale * x)) of the rows that take part, one an id."""
    x = F.col(embedding).cast("array<double>")
    usable = F.col(vec_id).isNotNull() & label.isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    rows = df.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), F.struct(label.cast("long").alias("label"), F.transform(x, lambda y: F.floor(y * scale)).alias("v")).alias("r"))
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")


def _pack(kind: int):
    """A partition's rows as one row for each width: a block (kind 0) or a chunk of anchors (kind 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [pdf for pdf in batches if len(pdf)]
        if not rows:
            return
        pdf = pd.concat(rows)
        for (block, width), part in pdf.groupby([pdf["block"], pdf["v"].map(len)]):
            part = part.sort_values("vec_id")
            m = np.stack(part["v"].to_numpy()).astype(np.int64)
            yield pd.DataFrame(
                [(int(block), int(width), kind, part["vec_id"].to_numpy(np.int64), part["label"].to_numpy(np.int64).tobytes(), m.tobytes())], columns=[c.split()[0] for c in _BLOCK.split(", ")]
            )

    return run


def _dealt(rows: DataFrame, parts: int, kind: int) -> DataFrame:
    return cut(rows.repartition(parts).withColumn("block", F.spark_partition_id()).mapInPandas(_pack(kind), _BLOCK))


class Tables:
    """Blocks of all rows, chunks of the anchors, and the bounds that windows start from."""

    def __init__(self, rows: DataFrame, anchors: Column, block: int | None = None, chunk: int = CHUNK) -> None:
        rows = cut(rows)
        own = rows.where(anchors)
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.min("vec_id").alias("least"), F.max("vec_id").alias("most"), F.count_if(anchors).alias("anchors")).first()
        self.rows, self.least, self.most = rows, size["least"] or 0, size["most"] or 0
        wide = rows.sparkSession.sparkContext.defaultParallelism
        most = block or max(1, BLOCK_VALUES // (size["width"] or 1))
        n = max(1, math.ceil(size["n"] / most), 0 if block else min(wide, size["n"] // BLOCK_ROWS))
        self.blocks = _dealt(rows, n, 0)
        self.n_blocks = n
        self.chunks = _dealt(own, max(1, math.ceil(size["anchors"] / chunk)), 1).withColumnRenamed("block", "chunk")
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, y: acc + y.cast("double") * y))
        longest = rows.agg(F.max(norm)).first()[0] or 0.0
        # No score is further from 0 than the product of the lengths.
        reach = (F.ceil(norm * F.lit(longest * (1 + 1e-9))) + 1).cast("long")
        self.anchors = own.select(F.col("vec_id").alias("anchor_id"), reach.alias("reach"))


def _streamed(tables: Tables, windows: DataFrame) -> DataFrame:
    """Each block followed by the chunks of anchors with their windows, in sorted partitions."""
    ids = tables.chunks.select("chunk", F.explode("ids").alias("anchor_id"))
    per_chunk = windows.join(ids, "anchor_id").groupBy("chunk").agg(F.collect_list(F.struct("anchor_id", *_WINDOW)).alias("windows"))
    sent = tables.chunks.join(per_chunk, "chunk").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(tables.n_blocks - 1)))).drop("chunk")
    own = tables.blocks.withColumn("windows", F.lit(None).cast(per_chunk.schema["windows"].dataType))
    return own.unionByName(sent).repartition(tables.n_blocks, "block").sortWithinPartitions("block", "width", "kind")


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: in floating point only where every partial sum is below 2^53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if top < 2.0**53 else a @ b.T


def _stream(batches: Iterator[pd.DataFrame], handle) -> Iterator[pd.DataFrame]:
    here = None
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            ids, labels = np.asarray(r.ids, dtype=np.int64), np.frombuffer(r.labels, np.int64)
            m = np.frombuffer(r.matrix, np.int64).reshape(len(ids), r.width)
            if r.kind == 0:
                here = (r.block, r.width, ids, labels, m)
            elif here is not None and here[:2] == (r.block, r.width):
                found = pd.DataFrame.from_records(list(r.windows))
                found = found.astype({"same": bool, "by_id": bool})
                at = np.searchsorted(ids, found["anchor_id"].to_numpy(np.int64))
                yield from handle(here, found, at, labels[at], scores_of(m, here[4]))


def _matches(here: tuple, part: pd.DataFrame, at: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance from the upper end, whether the row is a candidate), windows x rows."""
    distance = part["high"].to_numpy(np.int64)[:, None] - scores[at]
    fits = (here[3][None, :] == labels[:, None]) == part["same"].to_numpy()[:, None]
    fits &= here[2][None, :] != part["anchor_id"].to_numpy(np.int64)[:, None]
    fits &= (distance >= 0) & (distance <= (part["high"] - part["low"]).to_numpy(np.int64)[:, None])
    return distance, fits


def _each_slot(found: pd.DataFrame, at: np.ndarray, labels: np.ndarray):
    for slot in np.unique(found["slot"]):
        own = np.flatnonzero((found["slot"] == slot).to_numpy())
        yield found.iloc[own], at[own], labels[own]


def _column(part: pd.DataFrame, name: str) -> np.ndarray:
    return part[name].to_numpy(np.int64)[:, None]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts by the next digit of each window, as far as the block's own last wanted row."""
    buckets = 1 << DIGIT

    def handle(here, found, at, labels, scores):
        for part, own, label in _each_slot(found, at, labels):
            distance, fits = _matches(here, part, own, label, scores)
            by_id = part["by_id"].to_numpy()[:, None]
            offset = np.where(by_id, here[2][None, :] - _column(part, "id_start"), distance - _column(part, "start"))
            shift = np.where(by_id, _column(part, "id_shift"), _column(part, "shift"))
            fits &= ~by_id | (distance == _column(part, "start"))
            fits &= (offset >= 0) & (offset >> shift == 0)
            row, col = np.nonzero(fits)
            digit = offset[row, col] >> np.maximum(shift[row, 0] - DIGIT, 0)
            counts = np.bincount(row * buckets + digit, minlength=len(part) * buckets).reshape(len(part), buckets)
            before = counts.cumsum(axis=1) - counts
            w, d = np.nonzero((counts > 0) & (before < _column(part, "need")))
            yield pd.DataFrame({"anchor_id": part["anchor_id"].to_numpy(np.int64)[w], "slot": part["slot"].to_numpy()[w], "digit": d, "n": counts[w, d]})

    yield from _stream(batches, handle)


def _gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def handle(here, found, at, labels, scores):
        for part, own, label in _each_slot(found, at, labels):
            distance, fits = _matches(here, part, own, label, scores)
            over = distance - _column(part, "start")
            ids = here[2][None, :] - _column(part, "id_start")
            # Either before the bucket, or in it: of the score's digits alone, or of the ids' digits too.
            fits &= (over < 0) | np.where(part["by_id"].to_numpy()[:, None], (over == 0) & ((ids < 0) | (ids >> _column(part, "id_shift") == 0)), over >> _column(part, "shift") == 0)
            row, col = np.nonzero(fits)
            yield pd.DataFrame({"anchor_id": part["anchor_id"].to_numpy(np.int64)[row], "slot": part["slot"].to_numpy()[row], "vec_id": here[2][col], "score": scores[own[row], col]})

    yield from _stream(batches, handle)


def _bits(n: Column) -> Column:
    """The least number of bits, DIGIT at least, that hold a whole number."""
    return F.greatest(F.lit(DIGIT), F.length(F.bin(n))).cast("long")


def select(tables: Tables, windows: DataFrame, told: list | None = None, gather: int = GATHER) -> DataFrame:
    """anchor_id, slot, rank (from 1), vec_id, score: the first `need` rows of each window.

    windows: anchor_id, slot, same (whether rows of the anchor's label are sought, or of others), high, low (ends of the scores), need.
    told: gets the number of windows counted in each pass.
    """
    zero = F.lit(0).cast("long")
    wanted = windows.select("anchor_id", "slot", F.col("need").alias("wanted"))
    fresh = windows.where("low <= high").select("anchor_id", *_WINDOW[:5], zero.alias("start"), _bits(F.col("high") - F.col("low")).alias("shift"), F.lit(False).alias("by_id"), zero.alias("id_start"), zero.alias("id_shift"))
    active, settled = cut(fresh), None
    while n := active.count():
        if told is not None:
            told.append(n)
        counts = _streamed(tables, active).mapInPandas(_count, _COUNTS).groupBy("anchor_id", "slot", "digit").agg(F.sum("n").alias("n"))
        # At most 1 << DIGIT of them a window.
        digits = counts.groupBy("anchor_id", "slot").agg(F.sort_array(F.collect_list(F.struct("digit", "n"))).alias("d"))
        start = F.struct(F.lit(None).cast("int").alias("digit"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("n"))

        def further(acc: Column, x: Column) -> Column:
            """The digit with which the rows wanted are reached, and the counts before it and in it."""
            return F.when(acc["before"] + acc["n"] >= F.col("need"), acc).otherwise(F.struct(x["digit"].alias("digit"), (acc["before"] + acc["n"]).alias("before"), x["n"].alias("n")))

        by_id = F.col("by_id")
        found = active.join(digits, ["anchor_id", "slot"]).withColumn("f", F.aggregate("d", start, further))
        enough = F.col("f.before") + F.col("f.n") >= F.col("need")
        left = F.when(by_id, F.col("id_shift")).otherwise(F.col("shift"))
        step = F.greatest(left - DIGIT, F.lit(0))
        width = F.call_function("shiftleft", F.lit(1).cast("long"), step.cast("int"))
        moved = found.select(
            "anchor_id", *_WINDOW[:4], (F.col("need") - F.when(enough, F.col("f.before")).otherwise(0)).alias("need"),
            F.when(enough & ~by_id, F.col("start") + F.col("f.digit") * width).otherwise(F.col("start")).alias("start"),
            F.when(enough & ~by_id, step).otherwise(F.col("shift")).alias("shift"), "by_id",
            F.when(enough & by_id, F.col("id_start") + F.col("f.digit") * width).otherwise(F.col("id_start")).alias("id_start"),
            F.when(enough & by_id, step).otherwise(F.col("id_shift")).alias("id_shift"),
            (~enough | (F.col("f.n") <= F.greatest(F.lit(gather), F.col("need") - F.col("f.before")))).alias("done"),
        )
        moved = cut(moved)
        now = moved.where("done").drop("done")
        settled = now if settled is None else settled.unionByName(now)
        # Scores told apart to the last digit, and still too many: on to the ids.
        last = (F.col("shift") == 0) & ~by_id
        active = moved.where("not done").drop("done").withColumns({
            "id_start": F.when(last, F.lit(tables.least).cast("long")).otherwise(F.col("id_start")),
            "id_shift": F.when(last, F.lit(max(DIGIT, (tables.most - tables.least).bit_length())).cast("long")).otherwise(F.col("id_shift")),
            "by_id": by_id | last,
        })
    if settled is None:
        return active.select("anchor_id", "slot", F.lit(0).alias("rank"), zero.alias("vec_id"), zero.alias("score"))
    rows = _streamed(tables, settled).mapInPandas(_gather, _GATHERED)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")))
    return ranked.join(wanted, ["anchor_id", "slot"]).where("rank <= wanted").select("anchor_id", "slot", "rank", "vec_id", "score")


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int | None = None, told: list | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows as of prepared, anchors a condition on vec_id."""
    tables = Tables(rows, anchors, block)
    windows = tables.anchors.select("anchor_id", F.lit(0).alias("slot"), F.lit(True).alias("same"), F.col("reach").alias("high"), (-F.col("reach")).alias("low"), F.lit(positives).cast("long").alias("need"))
    best = cut(select(tables, windows, told).select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    s = F.col("positive_score")
    upper, lower = (s * high - F.pmod(s * high, F.lit(100))) / 100, -((-s * low - F.pmod(-s * low, F.lit(100))) / 100)
    windows = best.select("anchor_id", "slot", F.lit(False).alias("same"), upper.cast("long").alias("high"), lower.cast("long").alias("low"), F.lit(negatives).cast("long").alias("need"))
    found = select(tables, windows, told)
    return found.join(best, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
