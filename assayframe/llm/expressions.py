"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of whole texts that a Python worker is given at once, against Spark's default of 64 MB.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: a column named in a lambda would be worked out for every element."""
    return F.transform(F.array(value), body)[0]


def running_total(numbers: Column) -> Column:
    """The inclusive running sums of an array of longs, in blocks of its length's root, so that the work grows as n to 1.5."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def with_blocks(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s["a"]) - 1) / s["b"]).cast("int")), lambda i: total(F.slice(s["a"], i * s["b"] + 1, s["b"])))
        return let(blocks, lambda sums: let(F.transform(sums, lambda _, i: total(F.slice(sums, 1, i))), lambda before: each(s, before)))

    def each(s: Column, before: Column) -> Column:
        def upto(_: Column, i: Column) -> Column:
            block = F.floor(i / s["b"]).cast("int")
            return F.get(before, block) + total(F.slice(s["a"], block * s["b"] + 1, i - block * s["b"] + 1))

        return F.transform(s["a"], upto)

    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(numbers).cast("double"))).cast("int"))
    return F.when(F.size(numbers) == 0, F.array().cast("array<long>")).otherwise(let(F.struct(numbers.alias("a"), width.alias("b")), with_blocks))


def located(text: Column, pattern: str, build: Callable[[Column, Column, Column, Column, Column], Column]) -> Column:
    """build(match, start, end, gap before, gap after) for each match of a pattern that never matches nothing; in code points, from 0."""
    parts = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(p: Column) -> Column:
        sizes = F.transform(p["m"], lambda m, i: (F.length(m) + F.length(F.get(p["g"], i))).cast("long"))
        return let(running_total(sizes), lambda ends: F.transform(p["m"], lambda m, i: build(m, F.get(ends, i) - F.length(m), F.get(ends, i), F.get(p["g"], i), F.get(p["g"], i + 1))))

    return let(parts, placed)


def rewritten(text: Column, pattern: str, replace: Callable[[Column], Column]) -> Column:
    """text with each match of the pattern replaced."""
    parts = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return let(parts, lambda p: F.array_join(F.transform(p["g"], lambda g, i: F.concat(g, F.when(i < F.size(p["m"]), replace(F.get(p["m"], i))).otherwise(""))), ""))


def content_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on gives Python workers batches of BATCH_BYTES; a size that the session has set itself stays.

    A row larger than that is a batch of its own.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Returns a Python worker's free memory to the machine: workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
