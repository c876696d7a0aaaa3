"""Exact small-sample tests and rank statistics as expressions and grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.session import cut


def exact_mean(x: Column) -> Column:
    """The mean as an aggregate that doesn't depend on the order of the rows: values are added as decimals of nine places. Null without values."""
    return F.try_divide(F.sum(x.cast("decimal(20,9)")).cast("double"), F.count(x).cast("double"))


def log_factorial(n: Column) -> Column:
    """By summing logarithms up to 256 and, beyond, by Stirling's series, which is exact to double precision there."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n.cast("int"), F.lit(1)), F.lit(256))), F.lit(0.0), lambda acc, k: acc + F.ln(k.cast("double")))
    big = x * F.ln(x) - x + 0.5 * F.ln(x * 2 * 3.141592653589793) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 1, F.lit(0.0)).when(n <= 256, small).otherwise(big)


def sign_test_p(better: Column, worse: Column) -> Column:
    """Two-sided exact sign test; null without trials. In log space, so any number of trials works."""
    n, k = better + worse, F.least(better, worse)
    # The terms choose(n, i) / 2^n from i = k down to 0, each from the one before; far terms are 0.
    head = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n.cast("double") * F.ln(F.lit(2.0))
    tail = F.aggregate(
        F.sequence(F.lit(0), k.cast("int")),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda acc, i: F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * (k - i) / (n - k + i + 1)).alias("term")),
    )["sum"]
    return F.when(n > 0, F.least(F.lit(1.0), 2 * F.exp(head) * tail))


def fisher_exact_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact test of the table ((a, b), (c, d)); null if a margin is empty. Tables as likely as the observed count, within 1e-9."""
    r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
    low, high = F.greatest(F.lit(0), c1 - r2).cast("int"), F.least(r1, c1).cast("int")
    fixed = log_factorial(r1) + log_factorial(r2) + log_factorial(c1) + log_factorial(n - c1) - log_factorial(n)

    def term(x: Column) -> Column:
        return fixed - log_factorial(x) - log_factorial(r1 - x) - log_factorial(c1 - x) - log_factorial(r2 - c1 + x)

    observed = term(a)
    total = F.aggregate(F.sequence(low, high), F.lit(0.0), lambda acc, x: acc + F.when(term(x) <= observed + 1e-9, F.exp(term(x))).otherwise(0.0))
    return F.when((r1 > 0) & (r2 > 0) & (c1 > 0) & (n - c1 > 0), F.least(F.lit(1.0), total))


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate over pairs; null below three pairs or if either side is constant."""
    x, y = (F.when(x.isNotNull() & y.isNotNull(), v.cast("double")) for v in (x, y))
    n = F.count(x)
    cov, vx, vy = F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)
    return F.when((n >= 3) & (vx > 1e-18) & (vy > 1e-18), F.try_divide(cov, F.sqrt(vx * vy)))


def placed(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with _part, _before and _total: dealt in ranges of the order within each group, with the rows before the range and in the group.

    Numbering rows within ranges takes no task over a whole group; equal keys share a range. The ranges are kept by a
    checkpoint, since another run could draw other bounds.
    """
    parts = cut(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    # A row a group and range: as many as partitions.
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*by, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("_total"))
    return parts.join(F.broadcast(before), [*by, "_part"])


def with_ranks(df: DataFrame, by: Sequence[str], **columns: str) -> DataFrame:
    """df with a rank from 1 for each named column, ties sharing the mean of their ranks; rank column = source column."""
    for out, source in columns.items():
        df = placed(df, by, [source])
        first = F.col("_before") + F.rank().over(Window.partitionBy(*by, "_part").orderBy(source))
        ties = F.count("*").over(Window.partitionBy(*by, "_part", source))
        df = df.withColumn(out, first + (ties - 1) / F.lit(2.0)).drop("_part", "_before", "_total")
    return df


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, out: str = "spearman") -> DataFrame:
    """by and the rank correlation of x and y over rows with both."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return with_ranks(rows, by, _rx=x, _ry=y).groupBy(*by).agg(pearson(F.col("_rx"), F.col("_ry")).alias(out))


def medians(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """by, median (interpolated) and upper_median (of an even number the higher middle value), over the values that aren't null."""
    rows = placed(df.where(F.col(column).isNotNull()).select(*by, column), by, [column])
    at = F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_part").orderBy(column))
    half = F.floor(F.col("_total") / 2)
    middle = rows.withColumns({"_low": at == F.floor((F.col("_total") + 1) / 2), "_high": at == half + 1}).where("_low or _high")
    low, high = (F.max(F.when(F.col(c), F.col(column))) for c in ("_low", "_high"))
    return middle.groupBy(*by).agg(((low + high) / 2).alias("median"), high.alias("upper_median"))


def terciles(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with tercile: short, middle or long; both ends hold a third of a group's rows, cut to a whole number, at least one; null below three rows."""
    rows = placed(df, by, order)
    at, n = F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)), F.col("_total")
    third = F.greatest(F.lit(1), F.floor(n / 3))
    return rows.withColumn("tercile", F.when(n < 3, F.lit(None)).when(at <= third, "short").when(at > n - third, "long").otherwise("middle")).drop("_part", "_before", "_total")
