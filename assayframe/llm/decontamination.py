"""Benchmark decontamination by spaced seeds.

Texts become sequences of word hashes. A seed hashes the words of a window at the
positions of a fixed mask and ignores the others, so that a substituted word at an
ignored position leaves the seed whole; several masks cover the positions by turns.
Seeds of the benchmark items are joined with those of every window of every document,
and each hit is verified on its diagonal: some window of VERIFY_WORDS words (the item's
length, if shorter), inside both texts, must agree in at least SIMILARITY of its words.
Windows, join and the start of every run of hits on a diagonal come from one pass over
the documents; only these starts are shuffled, with the words on their diagonal.

Which masks an item has depends on its length (CLASSES). Items from VERIFY_WORDS words on
and those of 9 to 12 words have masks of which one fits whatever words are substituted
within SIMILARITY. Items of 5 to 8 words must be there word for word.

The benchmark's seeds are broadcast in blocks of at most about SEED_ROWS rows, one pass a
block, so a benchmark of any size is compared whole.

Defined results: null, empty and short texts overlap with nothing; items of fewer than
5 words, which clean texts hold too, are not looked for; equal items count as one, named
by the least id; repeated documents get the same decision. Extra columns stay with the rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.expressions import content_key, let
from assayframe.session import cut

VERIFY_WORDS = 13
SIMILARITY = 0.8


class Class(NamedTuple):
    """Items of `words` words and more (up to the class before): their masks, all of one span, and the share of words that must agree."""

    words: int
    masks: tuple[str, ...]
    share: float


#: Windows of nine words, of which six count: in 13 words of which any two are substituted, one of these masks fits somewhere
#: with all its counting positions on agreeing words. The same holds of the next two masks for any two substitutions in
#: 10 to 12 words and any one in 9. The last asks for no substitutions at all.
CLASSES = (Class(VERIFY_WORDS, ("100101111", "111011001"), SIMILARITY), Class(9, ("111001", "110101"), SIMILARITY), Class(5, ("11111",), 1.0))
MASKS = CLASSES[0].masks
SEED_ROWS = 1_000_000
#: Up to so many contaminated texts their keys are broadcast, else joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Up to so many words the items are broadcast to their diagonals, else joined by a shuffle.
BROADCAST_WORDS = 2_000_000
WORD = r"[\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _seed(hashes: Column, at: Column, mask: str) -> Column:
    """The mask's seed for the window that starts at `at`."""
    return F.xxhash64(F.lit(mask), *(F.get(hashes, at + i) for i, c in enumerate(mask) if c == "1"))


def _windows(rows: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """rows (with h) times windows and masks, with at, mask (its number) and seed."""
    span = len(masks[0])
    starts = rows.where(F.size("h") >= span).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("h") - span)))
    return starts.select("*", F.posexplode(F.array(*(_seed(F.col("h"), F.col("at"), m) for m in masks))).alias("mask", "seed"))


def _before(masks: tuple[str, ...]) -> Column:
    """The seed of the window before, null for the first."""
    at = F.col("at") - 1
    return F.when(F.col("at") > 0, F.coalesce(*(F.when(F.col("mask") == k, _seed(F.col("h"), at, m)) for k, m in enumerate(masks))))


def _diagonal(doc: Column, shift: Column, words: Column) -> Column:
    """The document's words that stand beside an item of so many words."""
    first = F.greatest(shift, F.lit(0))
    return F.slice(doc, first + 1, F.least(F.size(doc), shift + words) - first)


def _flags(part: Column, item: Column, shift: Column) -> Column:
    """For each word of the item 1 if the document has it there, 0 if another, x outside the document. part: as of _diagonal."""
    outside = F.greatest(-shift, F.lit(0))
    return F.array_join(F.transform(item, lambda w, i: F.when((i < outside) | (i - outside >= F.size(part)), "x").when(F.get(part, i - outside) == w, "1").otherwise("0")), "")


def _best_window(flags: Column) -> Column:
    """struct(matched, words, start): the window with most agreeing words; start counts the item's words."""

    def of(s: Column) -> Column:
        def window(at: Column) -> Column:
            part = F.substr(s["flags"], at + 1, s["words"])
            matched = F.when(F.instr(part, "x") > 0, 0).otherwise(F.length(F.replace(part, F.lit("0"), F.lit(""))))
            return F.struct(matched.alias("matched"), s["words"].alias("words"), at.alias("start"))

        return F.array_max(F.transform(F.sequence(F.lit(0), F.length(s["flags"]) - s["words"]), window))

    return let(F.struct(flags.alias("flags"), F.least(F.lit(VERIFY_WORDS), F.length(flags)).alias("words")), of)


def _class_of(words: Column) -> Column:
    """The number of the class of items of so many words, null if they are too short."""
    return F.coalesce(*(F.when(words >= c.words, k) for k, c in enumerate(CLASSES)))


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row a contaminated document: doc_id, key (MD5 of the text), item_id (best matching item), matched, words, start, n_items."""
    items = benchmark.select(F.col(item_id).alias("item_id"), word_hashes(F.col(item_text)).alias("h"))
    items = items.groupBy("h").agg(F.min("item_id").alias("item_id")).withColumn("item", F.xxhash64("h")).withColumn("class", _class_of(F.size("h")))
    items = cut(items.where("class is not null"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), word_hashes(F.col(text)).alias("h"))
    lines = None
    # A class without items costs nothing, but the first, which gives the result its columns.
    present = {0} | {r["class"] for r in items.select("class").distinct().collect()}
    for k in sorted(present):
        masks = CLASSES[k].masks
        seeds = _windows(items.where(F.col("class") == k), masks).select("seed", "mask", "item", F.col("at").alias("item_at"), F.size("h").alias("item_words"), _before(masks).alias("item_before"))
        seeds = cut(seeds)
        blocks = max(1, math.ceil(seeds.count() / SEED_ROWS))
        for b in range(blocks):
            mine = seeds if blocks == 1 else seeds.where(F.pmod(F.xxhash64("seed", "item", "item_at"), F.lit(blocks)) == b)
            hits = _windows(rows, masks).join(F.broadcast(mine), ["seed", "mask"])
            # Where the windows before agree too, the diagonal has a hit already.
            hits = hits.where(~F.coalesce(F.col("item_before") == _before(masks), F.lit(False)))
            shift = F.col("at") - F.col("item_at")
            part = hits.select("doc_id", content_key(F.col("_text")).alias("key"), "item", shift.alias("shift"), _diagonal(F.col("h"), shift, F.col("item_words")).alias("part"))
            lines = part if lines is None else lines.union(part)
    # One row a document, item and diagonal goes on.
    lines = lines.groupBy("doc_id", "key", "item", "shift").agg(F.first("part").alias("part"))
    whole = items.select("item", "item_id", "class", F.col("h").alias("item_h"))
    words = items.agg(F.sum(F.size("h"))).first()[0] or 0
    checked = lines.join(F.broadcast(whole) if words <= BROADCAST_WORDS else whole, "item")
    checked = checked.withColumn("r", _best_window(_flags(F.col("part"), F.col("item_h"), F.col("shift"))))
    share = F.coalesce(*(F.when(F.col("class") == k, F.lit(c.share)) for k, c in enumerate(CLASSES)))
    line = F.struct(F.col("r.matched").alias("matched"), F.col("r.words").alias("words"), (F.col("shift") + F.col("r.start")).alias("start"))
    found = checked.where(F.col("r.matched") >= share * F.col("r.words")).groupBy("doc_id", "key", "item").agg(F.min("item_id").alias("item_id"), F.max(line).alias("r"))
    # The largest share, of these the most words, of these the least id, whatever its type.
    best = F.min(F.struct((-F.col("r.matched") / F.col("r.words")).alias("share"), (-F.col("r.words")).alias("words"), "item_id", "r"))
    return found.groupBy("doc_id", "key").agg(best.alias("b"), F.count("*").alias("n_items")).select(
        "doc_id", "key", F.col("b.item_id").alias("item_id"), F.col("b.r.matched").alias("matched"), F.col("b.r.words").alias("words"), F.col("b.r.start").alias("start"), "n_items"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """docs without the contaminated ones; the decision goes by the text."""
    keys = cut(overlaps(docs, benchmark, doc_id, text, **names).select(F.col("key").alias("_bad")).distinct())
    right = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return docs.join(right, content_key(F.col(text)) == F.col("_bad"), "left_anti")
