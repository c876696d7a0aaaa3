"""Information-theoretic sanitisation of personal data.

Base findings are emails, IP addresses, card and phone numbers, each kind leftmost and
without overlaps. Every distinct finding is a protected entity. Terms (words of at least
three letters) that stand near an entity can reveal it even once it is masked: over the
whole corpus, with N documents, n(e) of them holding entity e, n(t) holding term t, and
n(e,t) holding t near e, the term discloses

    log(n(e,t) N / (n(e) n(t))) / log(N / n(e))

of the entity's information content: 1 where the term alone names the entity, 0 where
both are independent. From GENERALISE on a term is generalised and from REMOVE on it is
removed, in all texts where it stands near that entity, at all its places there. Where
single sightings are too weak an evidence, min_texts asks for a joint count from more
different texts, of which copies are one.

All counts cover all documents. Counts are combined before every shuffle; no group is
collected but the terms of one text.

Defined results: a null text counts as empty and stays null; with no entity, or with one
that all documents hold, nothing is disclosed; repeated documents count each and get
the same result; extra columns stay unless they bear the name of a result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.expressions import content_key, let, located, rewritten
from assayframe.session import cut

KINDS = ("email", "ip", "card", "phone")
#: The kinds' patterns. They match as the plain forms do, but possessively, and not from within a run that has failed
#: already, so that long runs neither exhaust the stack nor take quadratic time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a finding must have, cheaper to look for where the pattern itself finds much else.
HINTS = PATTERNS | {"card": r"[0-9](?:[\x20-]?[0-9]){15}"}
TERM = r"\p{L}{3,}"
#: Characters on either side of an entity whose words count as near.
NEAR_CHARS = 80
GENERALISE = 0.8
REMOVE = 0.95
MIN_TEXTS = 1
#: Up to so many bytes a table is broadcast, else joined by a shuffle; bytes that a row or a term takes beside its characters.
BROADCAST_BYTES = 32_000_000
ROW_BYTES = 100
TERM_BYTES = 24
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        x = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern holds."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda s: (F.length(s) <= 3) & (F.coalesce(s.try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def may_hold(text: Column) -> Column:
    """Whether text can hold a finding at all."""
    out = F.lit(False)
    for kind in KINDS:
        out = out | text.rlike(HINTS[kind])
    return F.coalesce(out, F.lit(False))


def _near(text: Column, found: Column) -> Column:
    """found, each with near: the whole words up to NEAR_CHARS characters before and after it in text, letters of emails left out.

    Only emails hold letters, so no word of any finding counts. The text is looked up in pieces, so that the work doesn't
    grow with its length times the findings.
    """
    width = max(4096, NEAR_CHARS + 1)
    without = F.when(text.rlike(HINTS["email"]), rewritten(text, PATTERNS["email"], lambda m: F.repeat(F.lit("."), F.length(m)))).otherwise(text)

    def cut_out(pieces: Column, start: Column, length: Column) -> Column:
        first = F.floor(start / width).cast("int")
        two = F.concat(F.coalesce(F.get(pieces, first), F.lit("")), F.coalesce(F.get(pieces, first + 1), F.lit("")))
        return F.substr(two, (start % width + 1).cast("int"), length.cast("int"))

    def add(pieces: Column, m: Column) -> Column:
        start = F.greatest(m["start"] - NEAR_CHARS - 1, F.lit(0).cast("long"))
        # One character more than counts shows whether a word goes on beyond.
        before = let(cut_out(pieces, start, m["start"] - start), lambda b: F.when(F.length(b) > NEAR_CHARS, F.regexp_replace(b, r"^\p{L}+", "")).otherwise(b))
        after = let(cut_out(pieces, m["end"], F.lit(NEAR_CHARS + 1)), lambda a: F.when(F.length(a) > NEAR_CHARS, F.regexp_replace(a, r"\p{L}+$", "")).otherwise(a))
        return F.struct(m["kind"].alias("kind"), m["value"].alias("value"), m["start"].alias("start"), m["end"].alias("end"), F.concat_ws(" | ", before, after).alias("near"))

    return let(F.regexp_extract_all(without, F.lit(f"(?s).{{1,{width}}}"), F.lit(0)), lambda pieces: F.transform(found, lambda m: add(pieces, m)))


def findings(text: Column) -> Column:
    """The valid base findings, by kind and start: array of struct(kind, value, start, end, near), near being the text around."""

    def of(kind: str) -> Column:
        def build(value: Column, start: Column, end: Column, *_: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), value.alias("value"), start.alias("start"), end.alias("end"))

        return F.when(text.rlike(HINTS[kind]), F.filter(located(text, PATTERNS[kind], build), lambda m: valid(kind, m["value"])))

    none = F.array().cast("array<struct<kind:string,value:string,start:bigint,end:bigint>>")
    empty = F.array().cast("array<struct<kind:string,value:string,start:bigint,end:bigint,near:string>>")
    every = F.concat(*(F.coalesce(of(kind), none) for kind in KINDS))
    return F.when(may_hold(text), let(every, lambda found: F.when(F.size(found) > 0, _near(text, found)).otherwise(empty))).otherwise(empty)


def _entity(found: Column) -> Column:
    return F.concat(found["kind"], F.lit(":"), F.lower(found["value"]))


def found_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """key (the text's MD5), found, n: the findings of the texts that have some, a row a text, and how many documents have it. Kept by a checkpoint."""
    rows = docs.where(may_hold(F.col(text))).select(content_key(F.col(text)).alias("key"), findings(F.col(text)).alias("found")).where(F.size("found") > 0)
    return cut(rows.groupBy("key").agg(F.first("found").alias("found"), F.count("*").alias("n")))


def _near_terms(found: Column) -> Column:
    """array of struct(entity, term): each entity with the terms near it, once each, and with null."""
    near = F.transform(
        found, lambda m: let(_entity(m), lambda e: F.concat(F.array(F.struct(e.alias("entity"), F.lit(None).cast("string").alias("term"))), F.transform(
            F.regexp_extract_all(F.lower(m["near"]), F.lit(TERM), F.lit(0)), lambda t: F.struct(e.alias("entity"), t.alias("term")))))
    )
    return F.array_distinct(F.flatten(near))


def contexts(docs: DataFrame, text: str = "text") -> DataFrame:
    """entity, term, key, n: how many documents of that text (by its MD5) have the term near the entity. term is null in one row an entity and text."""
    rows = docs.where(may_hold(F.col(text))).select(content_key(F.col(text)).alias("key"), findings(F.col(text)).alias("found"))
    return rows.select("key", F.inline(_near_terms(F.col("found")))).groupBy("entity", "term", "key").agg(F.count("*").alias("n"))


def disclosures(docs: DataFrame, near: DataFrame, text: str = "text", generalise: float = GENERALISE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """entity, term, disclosure for all pairs at or above the threshold. near: as of contexts."""
    total = docs.count()
    counted = near.groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    entities = counted.where("term is null").select("entity", F.col("n").alias("n_entity"))
    joint = counted.where((F.col("term").isNotNull()) & (F.col("texts") >= min_texts))
    terms = cut(joint.select("term").distinct())
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0)))).alias("term"))
    # Few terms are looked up before words are counted; beyond the bound all words are, each task's counts being summed first.
    size = terms.agg(F.sum(F.octet_length("term") + ROW_BYTES)).first()[0] or 0
    looked_up = words.join(F.broadcast(terms), "term", "left_semi") if size <= BROADCAST_BYTES else words
    spread = looked_up.groupBy("term").agg(F.count("*").alias("n_term"))
    content = F.ln(F.lit(float(max(total, 1))) / F.col("n_entity"))
    share = F.ln(F.col("n") * float(total) / (F.col("n_entity") * F.col("n_term"))) / content
    return (
        joint.join(entities, "entity").join(spread, "term").where(F.col("n_entity") < total).select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= generalise)
    )


def terms_by_text(docs: DataFrame, text: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, min_texts: int = MIN_TEXTS, found: DataFrame | None = None) -> DataFrame:
    """key, general, removed: the terms to generalise and to remove in each text that has some. found: as of found_texts, if there already."""
    near = contexts(docs, text) if found is None else found.select("key", "n", F.inline(_near_terms(F.col("found")))).select("entity", "term", "key", "n")
    near = cut(near)
    told = disclosures(docs, near, text, generalise, min_texts)
    worst = near.where("term is not null").join(told, ["entity", "term"]).groupBy("key", "term").agg(F.max("disclosure").alias("d"))
    return worst.groupBy("key").agg(F.collect_set(F.when(F.col("d") < remove, F.col("term"))).alias("general"), F.collect_set(F.when(F.col("d") >= remove, F.col("term"))).alias("removed"))


def _with_terms(docs: DataFrame, text: str, **thresholds: float) -> DataFrame:
    """docs with _general and _removed."""
    terms = cut(terms_by_text(docs, text, **thresholds))
    listed = F.aggregate(F.concat("general", "removed"), F.lit(ROW_BYTES).cast("long"), lambda n, t: n + F.octet_length(t) + TERM_BYTES)
    size = terms.agg(F.sum(listed)).first()[0] or 0
    right = terms.select(F.col("key").alias("_key"), F.col("general").alias("_general"), F.col("removed").alias("_removed"))
    may, same = may_hold(F.col(text)), content_key(F.col(text)) == F.col("_key")
    if size <= BROADCAST_BYTES:
        return docs.withColumn("_of", F.when(may, content_key(F.col(text)))).join(F.broadcast(right), F.col("_of") == F.col("_key"), "left").drop("_of", "_key")
    # Texts without a finding have no terms and stay where they are.
    none = F.lit(None).cast("array<string>")
    return docs.where(may).join(right, same, "left").drop("_key").unionByName(docs.where(~may).withColumns({"_general": none, "_removed": none}))


def _with_findings(docs: DataFrame, text: str, **thresholds: float) -> DataFrame:
    """docs with findings, _general and _removed. Texts are looked through for findings once; after that they meet theirs by their MD5."""
    found = found_texts(docs, text)
    known = cut(found.drop("n").join(terms_by_text(docs, text, found=found, **thresholds), "key", "left").select(F.col("key").alias("_key"), F.col("found").alias("findings"), F.col("general").alias("_general"), F.col("removed").alias("_removed")))
    of_findings = F.aggregate("findings", F.lit(ROW_BYTES).cast("long"), lambda n, m: n + F.octet_length(m["value"]) + F.octet_length(m["near"]) + ROW_BYTES)
    of_terms = F.aggregate(F.concat("_general", "_removed"), F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + TERM_BYTES)
    size = known.agg(F.sum(of_findings + F.coalesce(of_terms, F.lit(0)))).first()[0] or 0
    none = F.array().cast(known.schema["findings"].dataType)
    same = content_key(F.col(text)) == F.col("_key")
    if size <= BROADCAST_BYTES:
        joined = docs.join(F.broadcast(known), same, "left")
    else:
        # Only texts that may have findings are shuffled.
        may = may_hold(F.col(text))
        joined = docs.where(may).join(known, same, "left").unionByName(docs.where(~may), allowMissingColumns=True)
    return joined.drop("_key").withColumn("findings", F.coalesce("findings", none))


def term_spans(text: Column, general: Column, removed: Column, base: Column) -> Column:
    """array of struct(kind, start, end) of the terms, but where they touch a base finding."""

    def build(word: Column, start: Column, end: Column, *_: Column) -> Column:
        kind = let(F.lower(word), lambda w: F.when(F.array_contains(removed, w), "term_removed").when(F.array_contains(general, w), "term_generalised"))
        return F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"))

    kept = F.filter(located(text, TERM, build), lambda s: s["kind"].isNotNull() & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.array_sort(kept)


def inspect(docs: DataFrame, text: str = "text", **thresholds: float) -> DataFrame:
    """docs with findings, base (spans of the base findings) and all_spans, arrays of struct(kind, start, end)."""
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("findings", "base", "all_spans")))
    rows = _with_findings(kept, text, **thresholds)
    rows = rows.withColumn("base", F.transform("findings", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))))
    terms = F.when(F.col("_general").isNotNull(), term_spans(F.col(text), F.col("_general"), F.col("_removed"), F.col("base")))
    return rows.withColumn("all_spans", F.concat("base", F.coalesce(terms, F.array().cast(span)))).drop("_general", "_removed")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column) -> Column:
    """text with every base finding replaced by its kind."""
    def step(kind: str, before: Column) -> Column:
        def replace(match: Column) -> Column:
            return F.when(valid(kind, match), f"[{kind.upper()}]").otherwise(match)

        return let(before, lambda t: F.when(t.rlike(HINTS[kind]), rewritten(t, PATTERNS[kind], replace)).otherwise(t))

    out = text
    for kind in KINDS:
        out = step(kind, out)
    return out


def sanitise(docs: DataFrame, text: str = "text", **thresholds: float) -> DataFrame:
    """docs with base findings masked, and disclosing terms generalised to [TERM] or removed."""
    rows = _with_terms(docs, text, **thresholds)
    body = F.when(may_hold(F.col(text)), masked(F.col(text))).otherwise(F.col(text))

    def replace(word: Column) -> Column:
        return let(F.lower(word), lambda w: F.when(F.array_contains(F.col("_removed"), w), "").when(F.array_contains(F.col("_general"), w), "[TERM]").otherwise(word))

    clean = let(body, lambda t: F.when(F.col("_general").isNotNull(), rewritten(t, TERM, replace)).otherwise(t))
    return rows.withColumn(text, clean).select(*(F.col(f"`{c}`") for c in docs.columns))
