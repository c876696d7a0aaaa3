"""How numbers read in a report, as expressions: signed, as a share, and the classes that sentences are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 0.001
SMALL_CELL = 5
NONE = "n/a"


def signed(value: Column, places: int = 2) -> Column:
    # The sign is the value's own, since rounding loses that of a small loss: -0.00, not +0.00.
    size = F.format_string(f"%.{places}f", F.round(F.abs(value.cast("double")), places))
    return F.when(value.isNull(), NONE).otherwise(F.concat(F.when(value < 0, "-").otherwise("+"), size))


def percent(value: Column) -> Column:
    return F.when(value.isNull(), NONE).otherwise(F.format_string("%.0f %%", F.round(100 * value.cast("double"), 0)))


def rate(part: Column, whole: Column) -> Column:
    """A rate with its count, marked where the count is small."""
    counts = F.concat(F.lit(" ("), part.cast("string"), F.lit("/"), whole.cast("string"), F.lit(")"), F.when(whole < SMALL_CELL, "†").otherwise(""))
    return F.when(F.coalesce(whole, F.lit(0)) == 0, f"{NONE} (0)").otherwise(F.concat(percent(F.try_divide(part.cast("double"), whole.cast("double"))), counts))


def p_value(value: Column) -> Column:
    return F.when(value.isNull(), NONE).when(value < 0.001, "<0.001").otherwise(F.format_string("%.3f", F.round(value.cast("double"), 3)))


def direction(delta: Column) -> Column:
    return F.when(delta.isNull(), "unknown").when(F.abs(delta) <= EPSILON, "level").when(delta > 0, "better").otherwise("worse")


def share_of(part: Column, whole: Column) -> Column:
    """Which part of a gap another explains: none, all, most, some, little or reversed."""
    s = F.try_divide(part, whole)
    told = F.when(s < 0, "reversed").when(s >= 1, "all").when(s >= 0.5, "most").when(s >= 0.2, "some").otherwise("little")
    return F.when(part.isNull() | whole.isNull() | (F.abs(whole) <= EPSILON), "none").otherwise(told)


def cell(value: Column, limit: int = 80) -> Column:
    """A value for a table: one line, bars escaped, cut with an ellipsis."""
    text = F.replace(F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))
