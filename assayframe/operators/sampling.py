"""Deterministic samples: by hash, rotated within strata, and in rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.functions.hashing import case_seed
from assayframe.functions.stats import placed

#: Rows of a sample up to which it is the top of one ranking.
TOP = 10_000


def sample_key(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def hash_sample(df: DataFrame, key: str, seed: int, count: int | None = None, fraction: float | None = None) -> DataFrame:
    """count rows, or a fraction rounded half to even, of the smallest hashes of seed and key: the same on any engine and in any order.

    A sample of more than TOP rows is not ranked as a whole: a bound on the hash lets somewhat more rows pass than are
    wanted, and these are placed by ranges of the hash.
    """
    total = df.count() if count is None or count > TOP else None
    n = count if count is not None else int(round(total * (fraction or 0)))
    hashed = df.withColumn("_h", sample_key(F.col(key), seed))
    if n <= TOP:
        return hashed.orderBy("_h", key).limit(n).drop("_h")
    if n >= total:
        return df
    # The hash's first 52 bits are spread evenly; five deviations more than wanted pass, and all if that should not do.
    share = min(1.0, (n + 5 * n**0.5) / total)
    some = hashed.where(F.conv(F.substring("_h", 1, 13), 16, 10).cast("long") < int(share * (1 << 52)))
    rows = placed(some if some.count() >= n else hashed, [], ["_h", key])
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_h", key))
    return rows.withColumn("_at", at).where(F.col("_at") <= n).select(*(F.col(f"`{c}`") for c in df.columns))


def rotated(df: DataFrame, stratum: str, key: str, start: int, fraction: float, minimum: int) -> DataFrame:
    """Of each stratum a fraction of its rows (half to even), at least a minimum, taken from a rotated order of the keys.

    Strata are numbered by ranges of the keys, so no task holds a whole one.
    """
    rows = placed(df, [stratum], [key])
    n = F.col("_total")
    at = F.pmod(F.col("_before") + F.row_number().over(Window.partitionBy(stratum, "_part").orderBy(key)) - 1 - start, n)
    want = F.least(n, F.greatest(F.lit(minimum), F.rint(n * F.lit(fraction)).cast("long")))
    return rows.withColumn("_keep", at < want).where("_keep").select(*(F.col(f"`{c}`") for c in df.columns))


def round_robin(df: DataFrame, family: str, order: str, limit: int) -> DataFrame:
    """The first of every family, then the second of every family and so on, up to a limit; families by their first row; in the original order.

    No family can give more than limit rows, which bounds the ranking.
    """
    w = Window.partitionBy(family)
    ranked = df.withColumn("_round", F.row_number().over(w.orderBy(order))).where(F.col("_round") <= limit)
    first = df.groupBy(family).agg(F.min(order).alias("_first"))
    return ranked.join(first, family).orderBy("_round", "_first").limit(limit).orderBy(order).drop("_round", "_first")


def coin(key: Column, seed: int) -> Column:
    return case_seed(key, seed) % 2 == 0
