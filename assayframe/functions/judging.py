"""Reading a grader's replies: quotations, unscorable fields, rubric items, scores and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayframe.functions.text import collapse_ends, normalise_all
from assayframe.functions.text import normalise_unicode as normalise

MIN_QUOTE_CHARS, MIN_QUOTE_WORDS = 12, 3
MIN_FRAGMENT_CHARS, MIN_FRAGMENT_WORDS = 8, 2
MAX_FRAGMENTS = 4
# What a field that should be empty says when it means empty, or yes.
NEGATIVES = (
    "", "false", "no", "none", "null", "nil", "n/a", "n a", "na", "0", "nope", "-", "not applicable", "scorable", "not unscorable",
    "no reason", "no issues", "no problem", "no problems", "empty", "n/a - scorable",
)
AFFIRMATIVES = ("true", "yes", "1", "unscorable", "y")
# The outcomes of reading a score.
OMITTED, INAPPLICABLE, BAD_SCORE, ABSENCE, NO_QUOTE, SHORT_QUOTE, NOT_FOUND, SCORED = (
    "omitted", "inapplicable", "bad_score", "absence", "quote_missing", "quote_too_short", "quote_not_found", "scored",
)


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " "), lambda w: w != ""))


def verify_quote(answer: Column, quote: Column) -> Column:
    """Whether a quotation, with at most four parts around ellipses, is in an answer: parts in order, without overlaps, none too short."""
    body, parts = normalise(answer), F.filter(F.transform(F.split(normalise(quote), r"\.\.\."), lambda s: F.trim(s)), lambda p: p != "")
    content = F.array_join(parts, " ")
    long_enough = (F.length(content) >= MIN_QUOTE_CHARS) & (_words(content) >= MIN_QUOTE_WORDS) & F.size(parts).between(1, MAX_FRAGMENTS)
    each = F.forall(parts, lambda p: (F.length(p) >= MIN_FRAGMENT_CHARS) & (_words(p) >= MIN_FRAGMENT_WORDS))

    def beyond(acc: Column, part: Column) -> Column:
        """What is left of the answer after the part, or null."""
        at = F.instr(acc, part)
        return F.when(at > 0, F.substr(acc, at + F.length(part)))

    return F.coalesce(long_enough & each & F.aggregate(parts, body, beyond).isNotNull(), F.lit(False))


def unscorable_verdict(raw: Column) -> Column:
    """scorable, unscorable or unrecognised: what the free text of an `unscorable` field means. Null means scorable."""
    key = F.regexp_replace(normalise(raw), r"^[ .!?;:,\-\"']+|[ .!?;:,\-\"']+$", "")
    return (
        F.when(raw.isNull() | key.isin(*NEGATIVES), "scorable")
        .when(key.isin(*AFFIRMATIVES), "unscorable")
        .when(key.rlike(r"^(?:no|none|not|never|nothing|n/?a)\b"), "scorable")
        .when(_words(key) >= 2, "unscorable")
        .otherwise("unrecognised")
    )


def _meant(key: Column, allowed: Column, normal: Column) -> Column:
    """The item that a normalised entry means; normal: the items' normal forms."""
    equal = F.try_element_at(F.filter(allowed, lambda _, i: F.get(normal, i) == key), F.lit(-1))
    by_number = F.get(allowed, key.try_cast("int") - 1)
    held = F.filter(allowed, lambda _, i: (F.get(normal, i) != "") & (F.contains(key, F.get(normal, i)) | F.contains(F.get(normal, i), key)))
    return F.when(key != "", F.coalesce(equal, F.when(key.rlike("^[0-9]+$"), by_number), F.when(F.size(held) == 1, held[0])))


def _over(body, **values: Column) -> Column:
    """body of named values, each worked out once and outside any lambda, where Python has no place."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body)[0]


def rubric_item(returned: Column, allowed: Column) -> Column:
    """The item of `allowed` (an array) that a returned entry means: equal, by its number from 1, or the only one that holds or is held; else null."""
    return _over(lambda s: _meant(s["key"], s["allowed"], s["normal"]), key=normalise(returned), allowed=allowed, normal=normalise_all(allowed))


def rubric_flags(returned: Column, allowed: Column) -> Column:
    """struct(items, dropped): the items that the entries of an array mean, in order and once each, and the entries that mean none."""

    def read(s: Column) -> Column:
        pairs = F.filter(F.arrays_zip(s["returned"].alias("entry"), s["keys"].alias("key")), lambda p: p["key"] != "")
        told = F.transform(pairs, lambda p: F.struct(_meant(p["key"], s["allowed"], s["normal"]).alias("item"), p["entry"].alias("entry")))
        items = F.array_distinct(F.transform(F.filter(told, lambda p: p["item"].isNotNull()), lambda p: p["item"]))
        return F.struct(items.alias("items"), F.transform(F.filter(told, lambda p: p["item"].isNull()), lambda p: p["entry"]).alias("dropped"))

    return _over(read, returned=returned, keys=normalise_all(returned), allowed=allowed, normal=normalise_all(allowed))


def score_of(raw: Column) -> Column:
    """0, 1 or 2 from a raw score as text, else null; fractions are cut. What is no number, or none that a score could be, is null."""
    text = F.trim(raw.cast("string"))
    # A suffix for the number's type is no part of a number.
    value = F.when(~text.rlike("[dDfF]$"), text).try_cast("double").try_cast("int")
    return F.when(value.isin(0, 1, 2), value)


def score_outcome(found: Column, applicable: Column, raw_score: Column, quote: Column, basis: Column, answer: Column) -> Column:
    """How a rubric dimension's entry reads, one of the outcomes above. found: whether the grader returned the dimension."""
    score, bare = score_of(raw_score), F.coalesce(collapse_ends(quote), F.lit(""))
    return (
        F.when(~F.coalesce(found, F.lit(False)), OMITTED)
        .when(applicable == F.lit(False), INAPPLICABLE)
        .when(score.isNull(), BAD_SCORE)
        .when((score == 0) & ((normalise(basis) == "absence") | (bare == "")), ABSENCE)
        .when(bare == "", NO_QUOTE)
        .when(verify_quote(answer, quote), SCORED)
        .when(F.length(normalise(quote)) < MIN_QUOTE_CHARS, SHORT_QUOTE)
        .otherwise(NOT_FOUND)
    )


def kept_score(outcome: Column, raw_score: Column) -> Column:
    return F.when(outcome.isin(SCORED, ABSENCE), score_of(raw_score))


def change_correct(should: Column, did: Column) -> Column:
    """Whether a change verdict is right; null if it is undecided."""
    return did == should


def change_evidence(first: Column, second: Column, original_first: Column, how: Column) -> Column:
    """What a change verdict rests on: both positions, the original's first whatever the order they were shown in, and how they differ."""
    a, b = (F.trim(F.coalesce(c, F.lit(""))) for c in (first, second))
    own, other = F.when(original_first, a).otherwise(b), F.when(original_first, b).otherwise(a)
    told = [F.when(own != "", F.concat(F.lit("original: "), own)), F.when(other != "", F.concat(F.lit("variant: "), other)), F.nullif(F.trim(F.coalesce(how, F.lit(""))), F.lit(""))]
    return F.concat_ws(" | ", *told)


def change_verdict(moved: Column, undecidable: Column, should: Column) -> tuple[Column, Column]:
    """(did, correct): both null if the grader could not decide or said nothing."""
    did = F.when(~F.coalesce(undecidable, F.lit(False)), moved)
    return did, change_correct(should, did)


def technical_failure(answer_error: Column, answer: Column, call_error: Column, kind: Column, unscorable: Column, truncated: Column, failures: Column, dimensions: Column) -> Column:
    """Why a case could not be graded, null if it could: the first that holds, from the answer to the grader's reply.

    kind: what the grader returned, `object` if as asked for; unscorable: the class that its field reads as; failures: how many of the
    case's dimensions it failed on. A case that it found unscorable is a technical failure only if the answer was cut off.
    """
    said = unscorable == "unscorable"
    # The wordings of failures.
    return (
        F.when(F.coalesce(answer_error, F.lit("")) != "", F.concat(F.lit("no answer was produced: "), answer_error))
        .when(F.trim(F.coalesce(answer, F.lit(""))) == "", "empty answer")
        .when(F.coalesce(call_error, F.lit("")) != "", F.concat(F.lit("judge call failed: "), call_error))
        .when(kind != "object", F.concat(F.lit("judge returned "), kind, F.lit(", not an object")))
        .when(said & truncated, "answer hit the token limit before reaching a position")
        .when(~said & (failures > 0) & (failures == dimensions), F.concat(F.lit("judging failed on all "), failures.cast("string"), F.lit(" dimensions")))
    )


def failure_note(note: Column) -> Column:
    """The reason that a null score's note gives: the grader failed, the dimension doesn't apply, or other."""
    return F.when(note.startswith("judging_failure:"), "judging_failure").when(note.startswith("inapplicable:"), "inapplicable").otherwise("other")
