"""Queries over texts: checks, verifiers, quotations, similarities and contamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions import checks as K
from assayframe.functions import hashing as H
from assayframe.functions import judging as J
from assayframe.functions import stats
from assayframe.functions import text as X
from assayframe.operators import similarity as S
from assayframe.plans.registry import query
from assayframe.session import cut
from assayframe.sources.adapters import table

#: normalise in SQL.
NORMAL = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '’', ''''), '‘', ''''), '“', '\"'), '”', '\"'), '–', '-'), '—', '-'), '…', '...'), '\\s+', ' ', 'g'))"
ENDINGS = "|".join(sorted(X.STEM_ENDINGS, key=len, reverse=True)).replace("'", "''")
FORBIDDEN, MENTIONED, OPTIONS = ("than", "sch", "queaux"), ("the", "of"), ("that", "dass", "pour")


def _term(term: str, stemmed: bool = False) -> str:
    end = f"(?:{ENDINGS})?" if stemmed else ""
    return f"regexp_matches(s, '(^|[^\\p{{L}}\\p{{N}}_]){term}{end}([^\\p{{L}}\\p{{N}}_]|$)')"


_SHORT = "|".join(a for a in X.ABBREVIATIONS if "." not in a)
_RUN = "[.!?]+[\"'')\\]]*"


def sentences_sql(source: str, key: str) -> str:
    """A select of key and sentences: pieces between runs of end marks are counted that hold a letter or digit, pieces joined by a run that ends nothing counting once.

    A run ends nothing if it is the point of a decimal (of points that follow each other in a row of single digits every second is one), or is an ellipsis, or stands behind an abbreviation.
    """
    return f"""SELECT {key}, len(list_distinct(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN regexp_matches(g[i], '[\\p{{L}}\\p{{N}}]') THEN len(list_filter(ends[:i - 1], lambda e: e)) END))) AS sentences FROM (
    SELECT {key}, g, list_transform(range(1, len(r) + 1), lambda i: NOT (point[i] AND (i - list_max(list_filter(range(1, i + 1), lambda j: NOT (j > 1 AND length(g[j]) = 1 AND coalesce(point[j - 1], false))))) % 2 = 0)
        AND replace(CASE WHEN regexp_matches(g[i], '(?i)(^|[^a-z])({_SHORT})$') AND r[i][1] = '.' THEN substr(rtrim(r[i], '"'')]'), 2) ELSE rtrim(r[i], '"'')]') END, '...', '') <> '') AS ends FROM (
      SELECT {key}, g, r, list_transform(range(1, len(r) + 1), lambda i: r[i] = '.' AND regexp_matches(g[i], '[0-9]$') AND regexp_matches(g[i + 1], '^[0-9]')) AS point FROM (
        SELECT {key}, regexp_split_to_array(t, '{_RUN}') AS g, regexp_extract_all(t, '{_RUN}') AS r FROM (SELECT {key}, regexp_replace(regexp_replace(text, '(?i)(^|[^a-z])e\\.g\\.', '\\1eg ', 'g'), '(?i)(^|[^a-z])i\\.e\\.', '\\1ie ', 'g') AS t FROM {source}))))"""


_LISTED = lambda names: ", ".join("'" + n.replace("'", "''") + "'" for n in names)
CHECKS = (
    ("forbidden_terms", {"terms": FORBIDDEN}),
    ("must_mention_all", {"terms": MENTIONED}),
    ("must_choose_one_of", {"options": OPTIONS}),
    ("max_words", {"limit": 300}),
    ("min_words", {"limit": 50}),
    ("max_words", {"limit": 1000}),
)
_N = f"len(regexp_extract_all(coalesce(text, ''), '[㐀-䶿一-鿿豈-﫿]|\\p{{L}}+(?:[''’\\-]\\p{{L}}+)*|[0-9][0-9,.]*'))"


def _rows(cells: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{n}' AS \"check\", {c} AS passed, false AS error FROM n" for n, c in cells)


@query(
    f"WITH n AS (SELECT doc_id, {NORMAL} AS s, {_N} AS words FROM documents) "
    + _rows(
        [
            ("forbidden_terms", "NOT (" + " OR ".join(_term(t, True) for t in FORBIDDEN) + ")"),
            ("must_mention_all", " AND ".join(_term(t) for t in MENTIONED)),
            ("must_choose_one_of", " + ".join(f"({_term(t)})::INT" for t in OPTIONS) + " = 1"),
            ("max_words", "words <= 300"),
            ("min_words", "words >= 50"),
            ("max_words#2", "words <= 1000"),
        ]
    )
)
def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    return K.run_checks(table(spark, d, "documents"), CHECKS)


_REFUSED = "(?i)^" + X.REFUSAL_OPENERS + "(?:" + "|".join(X.REFUSALS) + ")"
#: refusal in SQL: DuckDB's patterns look at no places before them, so the breaks are marked first.
_PARTS = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?:;])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '' AND NOT regexp_matches(s, '^" + X.QUOTE_OPENERS.replace("'", "''") + "'))"


@query(
    f"""WITH r AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN text || ' I''m sorry, but I cannot help with that.' WHEN 2 THEN 'Unfortunately, i won''t be able to answer; ' || text WHEN 3 THEN '"I refuse to answer" he said. ' || text ELSE text || chr(10) || 'As an AI, I do not know.' END AS text FROM conversations)
SELECT conv_id, turn, coalesce(list_filter(list_transform({_PARTS}, lambda s: regexp_extract(s, '{_REFUSED.replace("'", "''")}')), lambda s: s <> '')[1], '') AS refusal FROM r"""
)
def refusal_checks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with refusals in some turns, of which quoted ones don't count."""
    i, t = F.col("turn") % 5, F.col("text")
    said = (
        F.when(i == 0, t).when(i == 1, F.concat(t, F.lit(" I'm sorry, but I cannot help with that."))).when(i == 2, F.concat(F.lit("Unfortunately, i won't be able to answer; "), t))
        .when(i == 3, F.concat(F.lit('"I refuse to answer" he said. '), t)).otherwise(F.concat(t, F.lit("\nAs an AI, I do not know.")))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", X.refusal(said).alias("refusal"))


@query(
    f"WITH n AS (SELECT lang, doc_id, {NORMAL} AS s, {_N} AS words FROM documents), c AS ("
    + " UNION ALL ".join(f"SELECT lang, '{n}' AS \"check\", {c} AS passed FROM n" for n, c in (("max_words", "words <= 300"), ("min_words", "words >= 50")))
    + ') SELECT lang, "check", count(*) AS n, count(*) FILTER (passed) AS passed_n, round(count(*) FILTER (passed) / count(*)::DOUBLE, 6) AS rate FROM c GROUP BY ALL'
)
def deterministic_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = K.run_checks(table(spark, d, "documents"), [CHECKS[3], CHECKS[4]], keys=["lang"])
    return rows.groupBy("lang", "check").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed_n"), F.round(F.count_if("passed") / F.count("*"), 6).alias("rate"))


VERIFIED = {
    "max_words": ("max_words", {"count": 200}, "w <= 200"),
    "min_words": ("min_words", {"count": 20}, "w >= 20"),
    "all_lowercase": ("all_lowercase", {}, "NOT regexp_matches(t, '\\p{Lu}')"),
    "no_punctuation": ("no_punctuation", {}, "NOT regexp_matches(t, '[!-/:-@\\[-`{-~—–‘’“”…]')"),
    "forbidden_letter": ("forbidden_letter", {"letter": "q"}, "NOT contains(lower(t), 'q')"),
    "forbidden_substrings": ("forbidden_substrings", {"substrings": ["License", "copyright"], "word_boundary": False}, "NOT regexp_matches(t, '(?i)license') AND NOT regexp_matches(t, '(?i)copyright')"),
    "contains_all": ("contains_all", {"substrings": ["the", "and"]}, "regexp_matches(t, '(?i)(^|[^\\p{L}\\p{N}_])the([^\\p{L}\\p{N}_]|$)') AND regexp_matches(t, '(?i)(^|[^\\p{L}\\p{N}_])and([^\\p{L}\\p{N}_]|$)')"),
    "starts_with": ("starts_with", {"text": "the", "case_sensitive": False}, "starts_with(lower(b), 'the')"),
    "ends_with": ("ends_with", {"text": "."}, "ends_with(b, '.')"),
    "regex_full_match": ("regex_full_match", {"pattern": "[A-Za-z .,\\n]+"}, "regexp_full_match(b, '[A-Za-z .,\\n]+')"),
    "line_count": ("line_count", {"count": 1}, "len(ls) = 1"),
    "line_ends_with": ("line_ends_with", {"text": "the"}, "coalesce(regexp_matches(regexp_replace(ls[1], '(?:[!-/:-@\\[-`{-~—–‘’“”…]|[ \\t])+$', ''), '(?i)(^|[^\\p{L}\\p{N}_])the$'), false)"),
    "no_list_markers": ("no_list_markers", {}, "NOT regexp_matches(t, '(?m)^\\s*(?:[-*•+–—]\\s+|[0-9]+[.)]\\s+)')"),
    "single_word": ("single_word", {}, "regexp_matches(tok, '^\\S+$')"),
    "code_fence_wrapped": ("code_fence_wrapped", {}, "starts_with(b, '```') AND ends_with(b, '```') AND length(b) >= 7"),
}
_VIEW = (
    "n AS (SELECT doc_id, text AS t, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS b, "
    "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]'))) AS w, "
    "list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls, "
    "regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '[.,!?;:]+$', '') AS tok FROM documents)"
)


@query(f"WITH {_VIEW} SELECT doc_id, {', '.join(f'{sql} AS {name}' for name, (_, _, sql) in VERIFIED.items())} FROM n")
def verifiers(spark: SparkSession, d: str) -> DataFrame:
    return K.verify_all(table(spark, d, "documents"), {name: (kind, p) for name, (kind, p, _) in VERIFIED.items()})


@query("WITH p AS (SELECT event_id, '1. ' || event_type || chr(10) || CASE WHEN event_id % 3 = 0 THEN '2) ' ELSE '3. ' END || 'x' AS t FROM events) SELECT event_id, event_id % 3 = 0 AS passed FROM p")
def numbered_list(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("1. "), F.col("event_type"), F.lit("\n"), F.when(F.col("event_id") % 3 == 0, "2) ").otherwise("3. "), F.lit("x"))
    return table(spark, d, "events").select("event_id", K.verify("numbered_list", answer, {"count": 2}).alias("passed"))


_JSON = {"required_keys": ["k", "note"], "types": {"k": "number", "note": "string"}, "enums": {"note": ["a", "b c d", "yes"]}, "max_words": {"note": 2}}


_ANSWERS = (
    '{"k": 1, "note": "a"}', '{"k": true, "note": "a"}', '{"k": 2.5, "note": "b c d"}', "no {json", '{"k": 1, "note": "a"} and more', '{"k": 1, "note": "a"}}', '{"k": 1, "note": "a"}{"b": 2}', 'So: {"k": 3, "note": "} b {"} it is',
    '[{"k": 1}]', '1, "w": {"k": 1}', '{"k": 1, "note": "yes \\" }"} end',
)


@query(
    f"""WITH j AS (SELECT event_id, CASE event_id % 13 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || '{{"k": ' || event_id || ', "note": "yes"}}' || chr(10) || '```' ELSE [{_LISTED(_ANSWERS)}][(event_id % 13) - 1] END AS t FROM events),
u AS (SELECT event_id, regexp_replace(regexp_replace(t, '^```json\\n', ''), '\\n```$', '') AS t FROM j),
p AS (SELECT *, list_filter(list_transform(range(instr(t, '{{'), length(t) + 1), lambda i: CASE WHEN i > 0 AND t[i] = '}}' THEN substr(t, instr(t, '{{'), i - instr(t, '{{') + 1) END), lambda x: x IS NOT NULL AND json_valid(x))[1] AS part FROM u),
v AS (SELECT event_id, CASE WHEN json_valid(t) THEN t::JSON END AS j, CASE WHEN json_valid(t) THEN t::JSON ELSE part::JSON END AS w FROM p)
SELECT event_id, coalesce(json_type(j) = 'OBJECT', false) AS is_object, coalesce(json_type(w) = 'OBJECT', false) AS within, coalesce(json_type(j) = 'OBJECT' AND list_contains(json_keys(j), 'k') AND list_contains(json_keys(j), 'note') AND json_type(j, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
   AND json_type(j, '$.note') = 'VARCHAR' AND j->>'$.note' IN ('a', 'b c d', 'yes') AND len(string_split(j->>'$.note', ' ')) <= 2, false) AS fits FROM v"""
)
def json_object_check(spark: SparkSession, d: str) -> DataFrame:
    """Answers that should be JSON objects: whether they are, hold one, and have the keys, types, values and lengths asked for."""
    i = F.col("event_id") % 13
    fenced = F.concat(F.lit('```json\n{"k": '), F.col("event_id").cast("string"), F.lit(', "note": "yes"}\n```'))
    said = F.when(i == 0, F.col("props")).when(i == 1, fenced).otherwise(F.get(F.array(*map(F.lit, _ANSWERS)), (i - 2).cast("int")))
    cells = {"is_object": {}, "within": {"allow_surrounding_text": True}, "fits": _JSON}
    return table(spark, d, "events").select("event_id", *(K.verify("json_object", said, p).alias(n) for n, p in cells.items()))


_NUM = "'-?[0-9][0-9,]*(?:\\.[0-9]+)?'"
_MARKED = "'(?is)^.*(?:final answer|the answer is|answer\\s*[:=]|answer is)'"


@query(
    f"""WITH a AS (SELECT event_id, printf('%,.2f', round(value, 2)) AS v, round(value, 2) AS want FROM events),
t AS (SELECT *, CASE event_id % 6 WHEN 0 THEN 'It is 1 or 2.' || chr(10) || 'The answer is **$' || v || '**' WHEN 1 THEN 'First 3, then 4.' || chr(10) || 'So \\boxed{{' || v || '}} fits.' || chr(10) || 'Done 7 and 8' WHEN 2 THEN 'Answer: ' || v || ' of 10 cases' || chr(10) || 'and 2 or 3 more'
   WHEN 3 THEN 'we have 5 and 6' || chr(10) || 'then 9 and ' || v WHEN 4 THEN 'only 12' || chr(10) || 'no numbers here' ELSE 'nothing' END AS said FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(said, '\\*\\*|__', '', 'g'), '[$£€¥]', '', 'g') AS c FROM t),
l AS (SELECT *, regexp_extract_all(string_split(c, chr(10))[-1], {_NUM}) AS last, list_filter(regexp_extract_all(c, '\\\\boxed\\s*\\{{([^}}]*)\\}}', 1), lambda b: regexp_matches(b, {_NUM})) AS boxes, regexp_extract_all(CASE WHEN regexp_matches(c, {_MARKED}) THEN regexp_replace(c, {_MARKED}, '') ELSE '' END, {_NUM}) AS after, regexp_extract_all(c, {_NUM}) AS every FROM c),
n AS (SELECT event_id, want, replace(coalesce(CASE WHEN len(last) = 1 THEN last[1] END, regexp_extract_all(boxes[-1], {_NUM})[1], after[1], last[-1], every[-1]), ',', '')::DOUBLE AS number FROM l)
SELECT event_id, coalesce(abs(number - want) < 1e-6, false) AS passed, round(number, 2) AS number FROM n"""
)
def numeric_answers(spark: SparkSession, d: str) -> DataFrame:
    """The number that an answer offers, in six ways of saying it."""
    i, v = F.col("event_id") % 6, F.format_number(F.round("value", 2), 2)
    said = (
        F.when(i == 0, F.concat(F.lit("It is 1 or 2.\nThe answer is **$"), v, F.lit("**")))
        .when(i == 1, F.concat(F.lit("First 3, then 4.\nSo \\boxed{"), v, F.lit("} fits.\nDone 7 and 8")))
        .when(i == 2, F.concat(F.lit("Answer: "), v, F.lit(" of 10 cases\nand 2 or 3 more")))
        .when(i == 3, F.concat(F.lit("we have 5 and 6\nthen 9 and "), v)).when(i == 4, "only 12\nno numbers here").otherwise("nothing")
    )
    number = K.final_number(said)
    return table(spark, d, "events").select("event_id", F.coalesce(F.abs(number - F.round("value", 2)) < 1e-6, F.lit(False)).alias("passed"), F.round(number, 2).alias("number"))


@query(f"SELECT doc_id, sentences::INT AS sentences FROM ({sentences_sql('documents', 'doc_id')})")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.count_sentences(F.col("text")).alias("sentences"))


_QUOTE = "substr(text, 11, 40) || ' ... ' || substr(text, CASE WHEN item_id % 3 = 0 THEN 1 ELSE 61 END, 30)"


@query(
    f"""WITH q AS (SELECT item_id, {NORMAL} AS h, {NORMAL.replace("coalesce(text, '')", f"({_QUOTE})")} AS q FROM benchmark),
p AS (SELECT item_id, h, list_filter(list_transform(string_split(q, '...'), lambda x: trim(x)), lambda x: x <> '') AS f FROM q),
l AS (SELECT *, len(f) BETWEEN 1 AND 4 AND length(array_to_string(f, ' ')) >= 12 AND len(list_filter(f, lambda x: length(x) < 8 OR len(string_split(x, ' ')) < 2)) = 0 AND len(string_split(array_to_string(f, ' '), ' ')) >= 3 AS long FROM p)
SELECT item_id, long AND instr(h, f[1]) > 0 AND (len(f) < 2 OR instr(substr(h, instr(h, f[1]) + length(f[1])), f[2]) > 0) AS verified FROM l"""
)
def quote_verify(spark: SparkSession, d: str) -> DataFrame:
    start = F.when(F.col("item_id") % 3 == 0, 1).otherwise(61)
    quote = F.concat(F.substring("text", 11, 40), F.lit(" ... "), F.substr("text", start, F.lit(30)))
    return table(spark, d, "benchmark").select("item_id", J.verify_quote(F.col("text"), quote).alias("verified"))


_WIDE = ("abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ")


@query(f"""WITH q AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'Die Straße im Süden ist heute gesperrt' WHEN 1 THEN 'the ﬁrst ofﬁce is closed today' ELSE substr(text, 1, 60) END AS a, item_id % 4 AS k, substr(text, 1, 60) AS text FROM benchmark),
n AS (SELECT item_id, k, {NORMAL} AS s FROM q)
SELECT item_id, CASE k WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN length(trim(substr(s, 1, 40))) >= 12 AND len(list_filter(string_split(trim(substr(s, 1, 40)), ' '), lambda w: w <> '')) >= 3 ELSE false END AS verified FROM n""")
def folded_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotations in other forms of the same letters: ss for ß, letters for ligatures, full-width ones; and some that aren't there."""
    k, text = F.col("item_id") % 4, F.substring("text", 1, 60)
    answer = F.when(k == 0, "Die Straße im Süden ist heute gesperrt").when(k == 1, "the ﬁrst ofﬁce is closed today").otherwise(text)
    quote = F.when(k == 0, "DIE STRASSE IM SÜDEN").when(k == 1, "the first office").when(k == 2, F.translate(F.lower(F.substring("text", 1, 40)), *_WIDE)).otherwise("words that no item ever says")
    return table(spark, d, "benchmark").select("item_id", J.verify_quote(answer, quote).alias("verified"))


_RAW = ("No.", "N/A.", "0", "cut off by the limit", "yes", "hm", "none of these apply", None, "  Unscorable! ", "-", "never", "the answer is empty", "'na'")
#: unscorable_verdict in SQL, of a column raw.
UNSCORABLE_SQL = f"""CASE WHEN raw IS NULL OR k IN ({_LISTED(J.NEGATIVES)}) THEN 'scorable' WHEN k IN ({_LISTED(J.AFFIRMATIVES)}) THEN 'unscorable' WHEN regexp_matches(k, '^(?:no|none|not|never|nothing|n/?a)\\b') THEN 'scorable'
 WHEN len(list_filter(string_split(k, ' '), lambda w: w <> '')) >= 2 THEN 'unscorable' ELSE 'unrecognised' END"""
_KEY_SQL = "regexp_replace(" + NORMAL.replace("coalesce(text, '')", "coalesce(raw, '')") + ", '^[ .!?;:,\\-\"'']+|[ .!?;:,\\-\"'']+$', '', 'g')"


@query(f"WITH r AS (SELECT o_orderkey, [{', '.join('NULL' if x is None else _LISTED([x]) for x in _RAW)}][(o_orderkey % {len(_RAW)}) + 1] AS raw FROM orders), n AS (SELECT *, {_KEY_SQL} AS k FROM r) SELECT o_orderkey, {UNSCORABLE_SQL} AS verdict FROM n")
def unscorable_classes(spark: SparkSession, d: str) -> DataFrame:
    raw = F.array(*(F.lit(x) for x in _RAW))
    return table(spark, d, "orders").select("o_orderkey", J.unscorable_verdict(F.get(raw, (F.col("o_orderkey") % len(_RAW)).cast("int"))).alias("verdict"))


_SAID = ("Keep the  promise", "2", "they should ask first, then act", "something else", "promise", "", "9", "the")
_ALLOWED = ("keep the promise", "tell the truth", "ask first")


@query(
    f"""WITH r AS (SELECT p_partkey, [{_LISTED(_SAID)}][(p_partkey % {len(_SAID)}) + 1] AS text, [{_LISTED(_ALLOWED)}] AS allowed FROM part), n AS (SELECT *, {NORMAL} AS k FROM r),
h AS (SELECT *, list_filter(allowed, lambda a: contains(k, a) OR contains(a, k)) AS held FROM n)
SELECT p_partkey, CASE WHEN k = '' THEN NULL WHEN list_contains(allowed, k) THEN k WHEN regexp_full_match(k, '[0-9]+') AND try_cast(k AS INT) BETWEEN 1 AND len(allowed) THEN allowed[try_cast(k AS INT)] WHEN len(held) = 1 THEN held[1] END AS item FROM h"""
)
def rubric_items(spark: SparkSession, d: str) -> DataFrame:
    said, allowed = F.array(*map(F.lit, _SAID)), F.array(*map(F.lit, _ALLOWED))
    return table(spark, d, "part").select("p_partkey", J.rubric_item(F.get(said, (F.col("p_partkey") % len(_SAID)).cast("int")), allowed).alias("item"))


@query(
    f"""WITH r AS (SELECT p_partkey, x AS text, i, [{_LISTED(_ALLOWED)}] AS allowed FROM part, (SELECT unnest([{_LISTED(_SAID)}]) AS x, unnest(range({len(_SAID)})) AS i) WHERE (p_partkey + i) % 3 = 0), n AS (SELECT *, {NORMAL} AS k FROM r),
h AS (SELECT *, list_filter(allowed, lambda a: contains(k, a) OR contains(a, k)) AS held FROM n WHERE k <> ''),
m AS (SELECT *, CASE WHEN list_contains(allowed, k) THEN k WHEN regexp_full_match(k, '[0-9]+') AND try_cast(k AS INT) BETWEEN 1 AND len(allowed) THEN allowed[try_cast(k AS INT)] WHEN len(held) = 1 THEN held[1] END AS item FROM h)
SELECT p.p_partkey, coalesce((SELECT array_to_string(list(item ORDER BY f), ',') FROM (SELECT item, min(i) AS f FROM m WHERE m.p_partkey = p.p_partkey AND item IS NOT NULL GROUP BY item)), '') AS items, (SELECT count(*) FROM m WHERE m.p_partkey = p.p_partkey AND item IS NULL) AS dropped FROM part p"""
)
def rubric_flag_lists(spark: SparkSession, d: str) -> DataFrame:
    """A grader's lists of broken rules as rubric items, with how many entries mean none."""
    said = F.filter(F.array(*map(F.lit, _SAID)), lambda _, i: (F.col("p_partkey") + i) % 3 == 0)
    read = J.rubric_flags(said, F.array(*map(F.lit, _ALLOWED)))
    return table(spark, d, "part").select("p_partkey", F.array_join(read["items"], ",").alias("items"), F.size(read["dropped"]).cast("long").alias("dropped"))


_CODE = ("```python\ndef area(a, b):\n    return a * b\n```", "def area(a):\n    print(a)", "def volume(a):\n    return a", "area = 3", "def area(a):\n    return (", "s = 'def area(a): return 1'", "def area(a):\n    raise NotImplementedError\n    return a",
         "Look:\n```\nx = 1\n```\nthen\n```py\ndef area(a, *b):\n    if a:\n        return a\n    return b\n```")
_MORE = {
    "exact_words": ("exact_words", {"count": 300}, "w = 300"), "exact_sentences": ("exact_sentences", {"count": 7}, "sentences = 7"), "one_of": ("one_of", {"options": ["Yes", "no"]}, "lower(tok) IN ('yes', 'no')"),
    "all_of": ("all_of", {"checks": [{"kind": "min_words", "params": {"count": 20}}, {"kind": "forbidden_letter", "params": {"letter": "ß"}}]}, "w >= 20 AND NOT contains(lower(t), 'ß')"),
}


@query(
    f"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '"Yes."' WHEN 1 THEN ' no! ' ELSE text END AS text FROM documents), n AS (SELECT doc_id, text AS t, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) AS w,
  trim(regexp_replace(trim(regexp_replace(trim(text), '^["''`‘’“”]+|["''`‘’“”]+$', '', 'g')), '[.,!?;:…]+$', '')) AS tok, e.sentences FROM d JOIN (__SENT__) e USING (doc_id)) SELECT doc_id, {', '.join(f'{sql} AS {name}' for name, (_, _, sql) in _MORE.items())}, doc_id % 8 IN (0, 7) AS python_function FROM n""".replace("__SENT__", sentences_sql("d", "doc_id"))
)
def more_verifiers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id") % 4
    said = table(spark, d, "documents").select("doc_id", F.when(i == 0, '"Yes."').when(i == 1, " no! ").otherwise(F.col("text")).alias("text"))
    code = K.verify("python_function", F.get(F.array(*map(F.lit, _CODE)), (F.col("doc_id") % 8).cast("int")), {"entry_point": "area"})
    return K.verify_all(said, {name: (kind, p) for name, (kind, p, _) in _MORE.items()}).withColumn("python_function", code)


@query(f"WITH n AS (SELECT doc_id, {NORMAL} AS s FROM documents), m AS (SELECT doc_id, replace(replace(s, 'the than', ' '), 'than the', ' ') AS s FROM n) SELECT doc_id, NOT ({_term('than', True)}) AS passed FROM m")
def allowed_terms(spark: SparkSession, d: str) -> DataFrame:
    """A forbidden term that some phrases may hold."""
    found = K.run_checks(table(spark, d, "documents"), [("forbidden_terms", {"terms": ["than"], "allowed_terms": ["than the", "the than"]})])
    return found.select("doc_id", "passed")


# Entries of a grader: whether the dimension is there and applies, the raw score, the quotation, and what it rests on.
_ANSWER = "An answer about something else, which keeps the promise that was made."
_QUOTES = ("", "a quotation that is not there at all", "keeps the promise that", "too short", "keeps the ... that was made", "  ", "KEEPS the promise   that")
_SCORES = ("2", "7", "0", "1.9", "x", " 1 ", "1e10", "nan", "-inf", "99999999999", "1e0")


def _verified_sql(q: str, h: str) -> str:
    """verify_quote in SQL, for quotations of at most two parts."""
    return f"""(SELECT len(f) BETWEEN 1 AND 4 AND length(c) >= 12 AND len(string_split(c, ' ')) >= 3 AND len(list_filter(f, lambda x: length(x) < 8 OR len(string_split(x, ' ')) < 2)) = 0
  AND instr({h}, f[1]) > 0 AND (len(f) < 2 OR instr(substr({h}, instr({h}, f[1]) + length(f[1])), f[2]) > 0) FROM (SELECT f, array_to_string(f, ' ') AS c FROM (SELECT list_filter(list_transform(string_split({q}, '...'), lambda x: trim(x)), lambda x: x <> '') AS f)))"""


_SCORE_SQL = "CASE WHEN try_cast(trunc(try_cast(trim(raw) AS DOUBLE)) AS INT) IN (0, 1, 2) THEN try_cast(trunc(try_cast(trim(raw) AS DOUBLE)) AS INT) END"


@query(
    f"""WITH e AS (SELECT l_orderkey % 9 <> 0 AS found, CASE WHEN l_partkey % 8 > 0 THEN l_partkey % 8 <> 1 END AS applicable, [{_LISTED(_SCORES)}][(l_suppkey % {len(_SCORES)}) + 1] AS raw, [{_LISTED(_QUOTES)}][(l_partkey % {len(_QUOTES)}) + 1] AS text,
  CASE WHEN l_orderkey % 4 = 0 THEN 'Absence ' ELSE 'quote' END AS basis FROM lineitem), n AS (SELECT *, {NORMAL} AS q, {NORMAL.replace("coalesce(text, '')", f"'{_ANSWER}'")} AS h, {_SCORE_SQL} AS score FROM e)
SELECT CASE WHEN NOT found THEN 'omitted' WHEN NOT applicable THEN 'inapplicable' WHEN score IS NULL THEN 'bad_score' WHEN score = 0 AND (lower(trim(basis)) = 'absence' OR trim(text) = '') THEN 'absence' WHEN trim(text) = '' THEN 'quote_missing'
   WHEN {_verified_sql("q", "h")} THEN 'scored' WHEN length(q) < 12 THEN 'quote_too_short' ELSE 'quote_not_found' END AS outcome, score, count(*) AS n FROM n GROUP BY ALL"""
)
def score_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How the entries of graders read, every outcome being there."""
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (F.col(by) % len(values)).cast("int"))
    applicable = F.when(F.col("l_partkey") % 8 > 0, F.col("l_partkey") % 8 != 1)
    basis = F.when(F.col("l_orderkey") % 4 == 0, "Absence ").otherwise("quote")
    raw = pick(_SCORES, "l_suppkey")
    outcome = J.score_outcome(F.col("l_orderkey") % 9 != 0, applicable, raw, pick(_QUOTES, "l_partkey"), basis, F.lit(_ANSWER))
    return table(spark, d, "lineitem").groupBy(outcome.alias("outcome"), J.score_of(raw).alias("score")).agg(F.count("*").alias("n"))


_ERRORS, _KINDS = (None, "", "timeout"), ("object", "object", "list", "object", "str")
_FAILED_SQL = f"""WITH e AS (SELECT o_orderkey AS case_id, CASE o_orderkey % 11 WHEN 2 THEN 'timeout' WHEN 5 THEN '' END AS answer_error, CASE o_orderkey % 7 WHEN 3 THEN '  ' WHEN 4 THEN NULL ELSE 'text' END AS answer, CASE WHEN o_orderkey % 13 = 6 THEN 'ValueError' END AS call_error,
  ['object', 'object', 'list', 'object', 'str'][(o_orderkey % 5) + 1] AS kind, [{', '.join('NULL' if x is None else _LISTED([x]) for x in _RAW)}][(o_orderkey % {len(_RAW)}) + 1] AS raw, o_orderkey % 2 = 0 AS truncated, o_orderkey % 4 AS failures, 3 AS dimensions FROM orders),
n AS (SELECT *, {_KEY_SQL} AS k FROM e), u AS (SELECT *, {UNSCORABLE_SQL} AS unscorable FROM n)
SELECT case_id, unscorable, CASE WHEN coalesce(answer_error, '') <> '' THEN 'no answer was produced: ' || answer_error WHEN trim(coalesce(answer, '')) = '' THEN 'empty answer' WHEN call_error IS NOT NULL THEN 'judge call failed: ' || call_error
  WHEN kind <> 'object' THEN 'judge returned ' || kind || ', not an object' WHEN unscorable = 'unscorable' AND truncated THEN 'answer hit the token limit before reaching a position'
  WHEN unscorable <> 'unscorable' AND failures = dimensions THEN 'judging failed on all ' || failures || ' dimensions' END AS technical_failure FROM u"""


@query(_FAILED_SQL)
def technical_failures(spark: SparkSession, d: str) -> DataFrame:
    """Why a case could not be graded, the first reason that holds."""
    i = F.col("o_orderkey")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))
    unscorable = J.unscorable_verdict(pick(_RAW))
    why = J.technical_failure(
        F.when(i % 11 == 2, "timeout").when(i % 11 == 5, ""), F.when(i % 7 == 3, "  ").when(i % 7 != 4, "text"), F.when(i % 13 == 6, "ValueError"), pick(_KINDS), unscorable, i % 2 == 0, i % 4, F.lit(3),
    )
    return table(spark, d, "orders").select(i.alias("case_id"), unscorable.alias("unscorable"), why.alias("technical_failure"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_id % 2 = 0 END AS moved, event_id % 7 = 0 AS undecidable, event_id % 3 = 0 AS should, event_id % 4 < 2 AS original_first, CASE WHEN event_id % 6 > 0 THEN ' keeps ' || event_type END AS a, CASE event_id % 9 WHEN 0 THEN '' ELSE 'drops it' END AS b, CASE WHEN event_id % 10 = 0 THEN 'by degree' END AS how FROM events),
v AS (SELECT *, CASE WHEN NOT undecidable THEN moved END AS did, trim(coalesce(CASE WHEN original_first THEN a ELSE b END, '')) AS o, trim(coalesce(CASE WHEN original_first THEN b ELSE a END, '')) AS w FROM e)
SELECT event_id, did AS did_change, did = should AS correct, concat_ws(' | ', CASE WHEN o <> '' THEN 'original: ' || o END, CASE WHEN w <> '' THEN 'variant: ' || w END, how) AS evidence FROM v""")
def change_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on whether a position moved, null if undecided, with their evidence in the original's order."""
    i = F.col("event_id")
    did, right = J.change_verdict(F.when(i % 5 > 0, i % 2 == 0), i % 7 == 0, i % 3 == 0)
    a, b = F.when(i % 6 > 0, F.concat(F.lit(" keeps "), "event_type")), F.when(i % 9 == 0, "").otherwise("drops it")
    evidence = J.change_evidence(a, b, i % 4 < 2, F.when(i % 10 == 0, "by degree"))
    return table(spark, d, "events").select("event_id", did.alias("did_change"), right.alias("correct"), evidence.alias("evidence"))


@query("""WITH a AS (SELECT event_type AS arm, user_id AS case_id, event_id, event_id % 3 AS repeat_index FROM events), f AS (SELECT arm, case_id, min(event_id) AS first FROM a WHERE repeat_index = 0 GROUP BY ALL)
SELECT a.arm, a.case_id, a.case_id || '#r' || a.repeat_index || '.' || a.event_id AS answer_id, f.first, f.first IS NULL AS orphan FROM a LEFT JOIN f ON f.arm = a.arm AND f.case_id = a.case_id WHERE repeat_index > 0""")
def consistency_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each repeat that probes for consistency with its arm's answer of record; orphans have none, and are told instead of compared."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("arm"), F.col("user_id").alias("case_id"), "event_id", (F.col("event_id") % 3).alias("repeat_index"))
    record = rows.where("repeat_index = 0").groupBy("arm", "case_id").agg(F.min("event_id").alias("first"))
    named = F.concat(F.col("case_id").cast("string"), F.lit("#r"), F.col("repeat_index").cast("string"), F.lit("."), F.col("event_id").cast("string"))
    return rows.where("repeat_index > 0").join(record, ["arm", "case_id"], "left").select("arm", "case_id", named.alias("answer_id"), "first", F.col("first").isNull().alias("orphan"))


TOKENS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))"
LEXICAL = f"""a AS (SELECT doc_id AS case_id, {TOKENS} AS t FROM documents), b AS (SELECT item_id AS best_id, {TOKENS} AS t FROM benchmark),
x AS (SELECT case_id, len(t) AS na, unnest(t) AS token FROM a), y AS (SELECT best_id, len(t) AS nb, unnest(t) AS token FROM b),
s AS (SELECT case_id, best_id, count(*) / (any_value(na) + any_value(nb) - count(*))::DOUBLE AS s FROM x JOIN y USING (token) GROUP BY case_id, best_id),
m AS (SELECT case_id, max(s) AS s, arg_max(best_id, (s, -best_id)) AS best_id FROM s GROUP BY case_id),
r AS (SELECT case_id, coalesce(m.best_id, -1) AS best_id, coalesce(m.s, 0) AS similarity FROM a LEFT JOIN m USING (case_id))"""


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    return S.best_jaccard(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")


@query(f"WITH {LEXICAL} SELECT case_id, best_id, round(similarity, 6) AS similarity, similarity >= 0.45 AS over_threshold FROM r")
def lexical_contamination(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d).select("case_id", "best_id", F.round("similarity", 6).alias("similarity"), (F.col("similarity") >= S.LEXICAL_THRESHOLD).alias("over_threshold"))


@query(f"WITH {LEXICAL}, q AS (SELECT round(similarity, 6) AS z FROM r) SELECT count(*) AS n, max(z) AS max, round(quantile_disc(z, 0.5 ORDER BY z DESC), 6) AS upper_median, round(avg(z), 4) AS mean, count(*) FILTER (z >= 0.45) AS flagged FROM q".replace("quantile_disc(z, 0.5 ORDER BY z DESC)", "(SELECT list_sort(list(z))[count(*) // 2 + 1] FROM q)"))
def contamination_summary(spark: SparkSession, d: str) -> DataFrame:
    z = cut(_lexical(spark, d).select(F.round("similarity", 6).alias("z")))
    found = z.agg(F.count("*").alias("n"), F.max("z").alias("max"), F.round(F.avg("z"), 4).alias("mean"), F.count_if(F.col("z") >= S.LEXICAL_THRESHOLD).alias("flagged"))
    return found.withColumn("upper_median", F.lit(stats.medians(z, [], "z").first()["upper_median"]))


@query(f"WITH {LEXICAL}, c AS (SELECT greatest(0.35, avg(similarity) + 3 * stddev_pop(similarity)) AS cut FROM r) SELECT round(cut, 6) AS cut, count(*) FILTER (similarity >= cut) AS over FROM r, c GROUP BY cut")
def calibrated_cut(spark: SparkSession, d: str) -> DataFrame:
    report = S.annotated(_lexical(spark, d))
    return report.groupBy(F.round("calibrated_threshold", 6).alias("cut")).agg(F.count_if("over_calibrated").alias("over"))


@query("""WITH a AS (SELECT vec_id AS case_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), b AS (SELECT vec_id AS best_id, embedding AS w FROM embeddings),
s AS (SELECT case_id, best_id, greatest(0, round(list_cosine_similarity(v::DOUBLE[], w::DOUBLE[]), 9)) AS s FROM a, b WHERE case_id <> best_id)
SELECT case_id, arg_max(best_id, (s, -best_id)) AS best_id, round(max(s), 5) AS similarity FROM s GROUP BY case_id""")
def cosine_best(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every twentieth vector against all others."""
    e = table(spark, d, "embeddings")
    found = S.best_cosine(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding")
    return found.select("case_id", "best_id", F.round("similarity", 5).alias("similarity"))


_SETS = f"WITH b AS (SELECT item_id, text, lead(text) OVER (ORDER BY item_id) AS other FROM benchmark), t AS (SELECT item_id, {TOKENS} AS x, {TOKENS.replace('text', 'other')} AS y FROM b WHERE other IS NOT NULL) "


def _neighbours(spark: SparkSession, d: str, texts: bool = False) -> DataFrame:
    b = table(spark, d, "benchmark")
    ranked = b.groupBy("item_id").agg(F.min("text").alias("text"))
    other = ranked.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    if texts:
        return ranked.join(other, "item_id")
    return ranked.join(other, "item_id").select("item_id", X.token_set(F.col("text")).alias("x"), X.token_set(F.col("other")).alias("y"))


@query(_SETS + "SELECT item_id, round(len(list_intersect(x, y)) / least(len(x), len(y))::DOUBLE, 6) AS overlap FROM t")
def overlap_coefficient(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select("item_id", F.round(X.overlap_coefficient(F.col("x"), F.col("y")), 6).alias("overlap"))


@query(_SETS + "SELECT item_id, least(len(x), len(y)) < 3 OR len(list_intersect(x, y)) / least(len(x), len(y))::DOUBLE <= 0.3 AS apart FROM t")
def anchor_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Whether neighbouring anchors can be told apart, at a stricter line than suites have."""
    from assayframe.operators import validate as R

    both = _neighbours(spark, d, texts=True)
    return both.select("item_id", R.discriminating(F.col("text"), F.col("other"), 0.3).alias("apart"))


@query(_SETS + ", v AS (SELECT item_id, round(1 - len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE, 6) AS z FROM t) SELECT count(*) AS n, min(z) AS min, list_sort(list(z))[count(*) // 2 + 1] AS upper_median, max(z) AS max, count(*) FILTER (z < 0.35) AS low, count(*) FILTER (z = 0) AS identical FROM v")
def divergence_summary(spark: SparkSession, d: str) -> DataFrame:
    z = cut(_neighbours(spark, d).select(F.round(1 - X.jaccard(F.col("x"), F.col("y")), 6).alias("z")))
    found = z.agg(F.count("*").alias("n"), F.min("z").alias("min"), F.max("z").alias("max"), F.count_if(F.col("z") < 0.35).alias("low"), F.count_if(F.col("z") == 0).alias("identical"))
    return found.withColumn("upper_median", F.lit(stats.medians(z, [], "z").first()["upper_median"]))


@query("SELECT conv_id, trim(arg_min(text, turn)) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id HAVING trim(arg_min(text, turn)) <> ''")
def training_prompts(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.trim(F.min_by("text", "turn")).alias("prompt"))
    return first.where("prompt <> ''")


@query("SELECT p_partkey, regexp_replace(trim(regexp_replace(lower('The ' || p_name), '[^a-z0-9]+', ' ', 'g')), '^(the|a|an) ', '') AS key, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS loose FROM part")
def situation_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.key_part(F.concat(F.lit("The "), "p_name")).alias("key"), X.loose_id(F.col("p_name")).alias("loose"))


@query("SELECT p_partkey, ('0x' || substr(sha256('13:' || p_partkey), 1, 8))::BIGINT AS seed, ('0x' || substr(sha256(p_partkey || ':1'), 1, 8))::BIGINT % 2 = 1 AS flip FROM part")
def case_seed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", H.case_seed(F.col("p_partkey"), 13).alias("seed"), H.flip(F.col("p_partkey"), "1").alias("flip"))


@query("SELECT item_id, substr(sha256('judge:' || text), 1, 10) AS nonce, substr(sha256(text), 1, 12) AS version FROM benchmark")
def fence_nonce(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", H.fence_nonce(F.col("text"), "judge").alias("nonce"), H.content_hash(F.col("text")).alias("version"))


@query("""SELECT count(DISTINCT h) AS settings, count(*) AS n FROM (SELECT substr(sha256('{"label":' || label || ',"part":' || vec_id % 3 || '}'), 1, 12) AS h FROM embeddings)""")
def settings_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    h = H.record_hash(part=F.col("vec_id") % 3, label=F.col("label"))
    return table(spark, d, "embeddings").agg(F.countDistinct(h).alias("settings"), F.count("*").alias("n"))
