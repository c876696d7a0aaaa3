"""Checks of answers, as a registry of kinds.

A check is a builder (answer, parameters) -> boolean column, native throughout.
New kinds are added with register; an unknown kind is an error row, never a pass.
What checks derive from an answer (its normal form, words, lines) they ask of the Answer,
which over a table gives each a column of its own, worked out once for all checks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions import text as X
from assayframe.functions.code import defines_function


class Answer:
    """An answer's text, and what is derived from it by functions of text, each under a name of its own where names are kept."""

    def __init__(self, text: Column, names: dict[str, Column] | None = None) -> None:
        self.text = text
        self.names = names

    def of(self, derive: Callable[[Column], Column]) -> Column:
        if self.names is None:
            return derive(self.text)
        name = f"_{derive.__name__}"
        if name not in self.names:
            self.names[name] = derive(self.text)
        return F.col(name)


Check = Callable[[Answer | Column, Mapping[str, Any]], Column]
ANSWER_CHECKS: dict[str, Check] = {}
VERIFIERS: dict[str, Check] = {}


def register(kind: str, into: dict[str, Check] | None = None) -> Callable[[Check], Check]:
    """Adds a check under a kind; a kind can be taken once."""
    registry = ANSWER_CHECKS if into is None else into

    def add(check: Check) -> Check:
        if kind in registry:
            raise ValueError(f"check kind {kind!r} is taken")
        registry[kind] = lambda answer, params: check(answer if isinstance(answer, Answer) else Answer(answer), params)
        return check

    return add


def _terms(params: Mapping[str, Any], *names: str) -> list[str]:
    for name in names:
        value = params.get(name)
        if isinstance(value, str):
            return [value] if value.strip() else []
        if isinstance(value, Sequence):
            return [str(v) for v in value if str(v).strip()]
    return []


def _limit(params: Mapping[str, Any], *names: str) -> int | None:
    return next((int(params[n]) for n in names if params.get(n) is not None), None)


@register("forbidden_terms")
def forbidden_terms(answer: Answer, params: Mapping[str, Any]) -> Column:
    body = X.masked(answer.of(X.normalise_unicode), _terms(params, "allowed_terms", "allowed"))
    return F.size(X.found_terms(body, _terms(params, "terms", "forbidden_terms", "term"), stemmed=True)) == 0


@register("max_words")
def max_words(answer: Answer, params: Mapping[str, Any]) -> Column:
    limit = _limit(params, "limit", "max_words", "words")
    return F.lit(False) if limit is None else answer.of(X.count_words) <= limit


@register("min_words")
def min_words(answer: Answer, params: Mapping[str, Any]) -> Column:
    limit = _limit(params, "limit", "min_words", "words")
    return F.lit(False) if limit is None else answer.of(X.count_words) >= limit


@register("must_mention_all")
def must_mention_all(answer: Answer, params: Mapping[str, Any]) -> Column:
    terms = _terms(params, "terms", "phrases", "must_mention")
    return F.size(X.found_terms(answer.of(X.normalise_unicode), terms)) == len(terms) if terms else F.lit(False)


@register("must_choose_one_of")
def must_choose_one_of(answer: Answer, params: Mapping[str, Any]) -> Column:
    """Exactly one option is named, or at least one if several are allowed. An option is a string or has a label and phrases."""
    options = []
    for o in params.get("options") or params.get("choices") or []:
        if isinstance(o, Mapping):
            label = str(o.get("label") or o.get("name") or "")
            options.append(_terms(o, "phrases", "terms") or [label])
        else:
            options.append([str(o)])
    options = [p for p in options if any(t.strip() for t in p)]
    if not options:
        return F.lit(False)
    body = answer.of(X.normalise_unicode)
    chosen = F.lit(0)
    for phrases in options:
        chosen = chosen + (F.size(X.found_terms(body, phrases)) > 0).cast("int")
    return chosen >= 1 if params.get("allow_multiple") else chosen == 1


@register("no_refusal")
def no_refusal(answer: Answer, params: Mapping[str, Any]) -> Column:
    return X.refusal(answer.text, _limit(params, "window_chars")) == ""


def run_checks(answers: DataFrame, checks: Sequence[tuple[str, Mapping[str, Any]]], answer: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, check, passed, error: a row for each answer and check; a kind's second check is named kind#2 and so on."""
    seen: dict[str, int] = {}
    cells, names = [], {}
    shared = Answer(F.col(answer), names)
    for kind, params in checks:
        name = kind or "unnamed"
        seen[name] = seen.get(name, 0) + 1
        label = name if seen[name] == 1 else f"{name}#{seen[name]}"
        check = ANSWER_CHECKS.get(kind)
        passed = F.lit(False) if check is None else F.coalesce(check(shared, params), F.lit(False))
        cells.append(F.struct(F.lit(label).alias("check"), passed.alias("passed"), F.lit(check is None).alias("error")))
    return answers.select(*keys, answer).withColumns(names).select(*keys, F.inline(F.array(*cells)))


def unknown_kinds(checks: DataFrame, kind: str = "kind") -> DataFrame:
    """Kinds in a table of checks that no check is registered for."""
    return checks.where(~F.coalesce(F.col(kind), F.lit("")).isin(*ANSWER_CHECKS)).select(kind).distinct()


# --- verifiers of single instructions -------------------------------------------------

_QUOTES = "\"'`\u2018\u2019\u201c\u201d"
_TRAIL = ".,!?;:\u2026"
_MARKS = "[!-/:-@\\[-`{-~\u2014\u2013\u2018\u2019\u201c\u201d\u2026]"
verifier = lambda kind: register(kind, VERIFIERS)


def bare_token(answer: Answer, trailing: bool = True) -> Column:
    """An answer without white space, quotes and, if allowed, punctuation around it."""
    out = X.collapse_ends(F.btrim(answer.of(X.collapse_ends), F.lit(_QUOTES)))
    return X.collapse_ends(F.rtrim(out, F.lit(_TRAIL))) if trailing else out


def unfenced(answer: Answer) -> Column:
    """An answer without the code fence around it, if it has one."""
    body = answer.of(X.collapse_ends)
    inner = F.regexp_replace(F.substring(body, 4, 2_000_000_000), r"(?s)```(?!.*```).*$", "")
    return F.when(body.startswith("```"), X.collapse_ends(F.regexp_replace(inner, r"^[ \t]*[A-Za-z0-9_+#.-]{0,12}[ \t]*\n", ""))).otherwise(body)


for _kind, _op in (("max_words", "__le__"), ("min_words", "__ge__"), ("exact_words", "__eq__")):

    @verifier(_kind)
    def _words(answer: Answer, params: Mapping[str, Any], op: str = _op) -> Column:
        return getattr(answer.of(X.count_tokens), op)(int(params["count"]))


@verifier("exact_sentences")
def exact_sentences(answer: Answer, params: Mapping[str, Any]) -> Column:
    return answer.of(X.count_sentences) == int(params["count"])


@verifier("all_lowercase")
def all_lowercase(answer: Answer, params: Mapping[str, Any]) -> Column:
    return ~answer.text.rlike(r"\p{Lu}")


@verifier("no_punctuation")
def no_punctuation(answer: Answer, params: Mapping[str, Any]) -> Column:
    return ~answer.text.rlike(_MARKS)


@verifier("forbidden_letter")
def forbidden_letter(answer: Answer, params: Mapping[str, Any]) -> Column:
    return ~F.contains(answer.of(F.lower), F.lit(str(params["letter"]).lower()))


def _pattern(piece: str, params: Mapping[str, Any]) -> str:
    if params.get("stem"):
        return rf"(?iU)\b{re.escape(piece)}"
    return rf"(?iU)\b{re.escape(piece)}\b" if params.get("word_boundary", True) else rf"(?iu){re.escape(piece)}"


@verifier("forbidden_substrings")
def forbidden_substrings(answer: Answer, params: Mapping[str, Any]) -> Column:
    out = F.lit(True)
    for piece in params["substrings"]:
        out = out & ~answer.text.rlike(_pattern(str(piece), params))
    return out


@verifier("contains_all")
def contains_all(answer: Answer, params: Mapping[str, Any]) -> Column:
    out = F.lit(True)
    for piece in params["substrings"]:
        out = out & answer.text.rlike(_pattern(str(piece), params))
    return out


@verifier("no_list_markers")
def no_list_markers(answer: Answer, params: Mapping[str, Any]) -> Column:
    return ~answer.text.rlike(r"(?m)^\s*(?:[-*\u2022+\u2013\u2014]\s+|\d+[.)]\s+)")


def _cased(answer: Answer, params: Mapping[str, Any]) -> tuple[Column, Column]:
    body, wanted = answer.of(X.collapse_ends), str(params["text"])
    return (body, F.lit(wanted)) if params.get("case_sensitive", True) else (F.lower(body), F.lit(wanted.lower()))


@verifier("ends_with")
def ends_with(answer: Answer, params: Mapping[str, Any]) -> Column:
    return F.endswith(*_cased(answer, params))


@verifier("starts_with")
def starts_with(answer: Answer, params: Mapping[str, Any]) -> Column:
    return F.startswith(*_cased(answer, params))


@verifier("code_fence_wrapped")
def code_fence_wrapped(answer: Answer, params: Mapping[str, Any]) -> Column:
    body = answer.of(X.collapse_ends)
    inner = F.regexp_replace(F.substring(body, 4, 2_000_000_000), r"```$", "")
    content = F.when(F.contains(inner, F.lit("\n")), F.regexp_replace(inner, r"^[^\n]*\n", "")).otherwise(inner)
    return body.startswith("```") & body.endswith("```") & (F.length(body) >= 7) & (X.collapse_ends(content) != "")


@verifier("regex_full_match")
def regex_full_match(answer: Answer, params: Mapping[str, Any]) -> Column:
    return answer.of(X.collapse_ends).rlike(f"{'(?i)' if params.get('ignore_case') else ''}^(?:{params['pattern']})\\z")


@verifier("line_count")
def line_count(answer: Answer, params: Mapping[str, Any]) -> Column:
    return F.size(answer.of(X.lines)) == int(params["count"])


@verifier("line_ends_with")
def line_ends_with(answer: Answer, params: Mapping[str, Any]) -> Column:
    at = int(params.get("line", 1))
    line = F.try_element_at(answer.of(X.lines), F.lit(at if at else 1))
    bare = F.regexp_replace(line, f"(?:{_MARKS}|[ \\t])+$", "")
    flags = "(?U)" if params.get("case_sensitive") else "(?iU)"
    return F.coalesce(bare.rlike(rf"{flags}\b{re.escape(str(params['text']))}$"), F.lit(False)) if at else F.lit(False)


@verifier("numbered_list")
def numbered_list(answer: Answer, params: Mapping[str, Any]) -> Column:
    count = int(params["count"])
    rows = answer.of(X.lines)
    numbers = F.filter(F.transform(rows, lambda s: F.regexp_extract(s, r"^(\d+)[.)]\s+\S", 1)), lambda s: s != "")
    right = F.transform(numbers, lambda s: s.try_cast("int")) == F.array(*(F.lit(i) for i in range(1, count + 1)))
    return right if params.get("allow_other_text") else right & (F.size(rows) == count)


@verifier("single_word")
def single_word(answer: Answer, params: Mapping[str, Any]) -> Column:
    raw = bare_token(answer, trailing=False)
    if params.get("allow_trailing_punctuation", True):
        return (raw != "") & bare_token(answer).rlike(r"^\S+$")
    return (raw != "") & raw.rlike(r"^\S+$") & (F.rtrim(raw, F.lit(_TRAIL)) == raw)


@verifier("one_of")
def one_of(answer: Answer, params: Mapping[str, Any]) -> Column:
    token, options = bare_token(answer, params.get("allow_trailing_punctuation", True)), [str(o) for o in params["options"]]
    return token.isin(*options) if params.get("case_sensitive") else F.lower(token).isin(*(o.lower() for o in options))


# What counts as a number, and the phrases that announce an answer.
_NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
_ANNOUNCED = r"final answer|the answer is|answer\s*[:=]|answer is"


def final_number(answer: Column) -> Column:
    """The number that an answer offers: alone on the last line, else boxed, else after the last phrase that announces one, else the last there is."""
    clean = F.regexp_replace(F.regexp_replace(answer, r"\*\*|__", ""), "[$\u00a3\u20ac\u00a5]", "")

    def numbers(s: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(_NUMBER), F.lit(0))

    def last(a: Column) -> Column:
        return F.try_element_at(a, F.lit(-1))

    marker = f"(?is)^.*(?:{_ANNOUNCED})"

    def offered(text: Column) -> Column:
        boxes = F.filter(F.regexp_extract_all(text, F.lit(r"\\boxed\s*\{([^}]*)\}"), F.lit(1)), lambda b: b.rlike(_NUMBER))
        after = F.when(text.rlike(marker), F.regexp_replace(text, marker, ""))

        def first_of(on_last: Column) -> Column:
            return F.coalesce(F.when(F.size(on_last) == 1, on_last[0]), F.get(numbers(last(boxes)), F.lit(0)), F.get(numbers(after), F.lit(0)), last(on_last), last(numbers(text)))

        return X.bound(numbers(last(X.lines(text))), first_of)

    return F.replace(X.bound(clean, offered), F.lit(","), F.lit("")).try_cast("double")


@verifier("numeric_answer")
def numeric_answer(answer: Answer, params: Mapping[str, Any]) -> Column:
    return F.coalesce(F.abs(final_number(answer.text) - float(params["expected"])) <= float(params.get("tolerance", 1e-6)), F.lit(False))


# What schema_of_variant calls the JSON types.
_JSON_TYPES = {"string": "STRING", "number": "BIGINT|DOUBLE|DECIMAL|INT|FLOAT|TINYINT|SMALLINT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


_JSON_PART = r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\z)|[{}]|[^"{}]++'


def balanced(text: Column) -> Column:
    """The first balanced object of a text, from its first brace to the one that closes it, or null. Braces within strings don't count, nor do quotes that are escaped."""

    def further(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(part == "{", 1).when(part == "}", -1).otherwise(0)
        moved = F.struct(depth.alias("depth"), (acc["size"] + F.length(part)).alias("size"), ((part == "}") & (depth == 0)).alias("closed"))
        return F.when(acc["closed"], acc).otherwise(moved)

    first = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("closed"))

    def closed(rest: Column) -> Column:
        read = F.aggregate(F.regexp_extract_all(rest, F.lit(_JSON_PART), F.lit(0)), first, further)
        return X.bound(read, lambda r: F.when(r["closed"], F.substr(rest, F.lit(1), r["size"])))

    return X.bound(text, lambda t: F.when(F.contains(t, F.lit("{")), X.bound(F.substr(t, F.instr(t, "{"), F.length(t)), closed)))


def strict_json(text: Column) -> Column:
    """The one JSON value that a whole text is, as a variant, or null. Parsers stop behind a first value, so it is read as the only field of an object that must end where the text does."""

    def alone(parsed: Column) -> Column:
        return F.when(F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>")) == F.array(F.lit("v")), F.try_variant_get(parsed, "$.v", "variant"))

    whole = F.concat(F.lit('{"v":'), text, F.lit("}"))
    return X.bound(whole, lambda w: X.bound(F.when(balanced(w) == w, F.try_parse_json(w)), alone))


@verifier("json_object")
def json_object(answer: Answer, params: Mapping[str, Any]) -> Column:
    """The whole answer, or else its first balanced object if text around it is allowed, is a JSON object with the keys, types, values and word limits asked for."""
    required = list(params.get("required_keys") or [])

    def read(body: Column) -> Column:
        return F.coalesce(strict_json(body), strict_json(balanced(body))) if params.get("allow_surrounding_text") else strict_json(body)

    def keys(names: Column) -> Column:
        out = F.lit(True)
        for k in required:
            out = out & F.array_contains(names, k)
        return out & (F.size(F.array_except(names, F.array(*map(F.lit, required)))) == 0) if params.get("exact_keys") else out

    def fits(whole: Column) -> Column:
        out = F.schema_of_variant(whole).startswith("OBJECT")
        if required or params.get("exact_keys"):
            out = out & X.bound(F.map_keys(F.try_variant_get(whole, "$", "map<string,variant>")), keys)
        for k, kind in (params.get("types") or {}).items():
            out = out & F.coalesce(F.schema_of_variant(F.try_variant_get(whole, f"$['{k}']", "variant")).rlike(f"^(?:{_JSON_TYPES[kind]})"), F.lit(False))
        for k, options in (params.get("enums") or {}).items():
            out = out & F.coalesce(F.try_variant_get(whole, f"$['{k}']", "string").isin(*map(str, options)), F.lit(False))
        for k, budget in (params.get("max_words") or {}).items():
            out = out & (X.count_tokens(F.try_variant_get(whole, f"$['{k}']", "string")) <= int(budget))
        return F.coalesce(out, F.lit(False))

    return X.bound(X.bound(unfenced(answer), read), fits)


@verifier("python_function")
def python_function(answer: Answer, params: Mapping[str, Any]) -> Column:
    """A static check only: the answer's code parses, and defines the entry point with room for the cases' arguments and a value to return. Answers' code is never run."""
    counts = sorted({len(c["args"] if isinstance(c, Mapping) else c[0]) for c in params.get("cases") or []})
    return defines_function(answer.text, str(params["entry_point"]), counts)


@verifier("all_of")
def all_of(answer: Answer, params: Mapping[str, Any]) -> Column:
    checks = params.get("checks") or []
    if not checks:
        raise ValueError("all_of has no checks")
    out = F.lit(True)
    for c in checks:
        out = out & _verified(c["kind"], answer, c.get("params") or {})
    return out


def _verified(kind: str, answer: Answer, params: Mapping[str, Any]) -> Column:
    if kind not in VERIFIERS:
        raise ValueError(f"unknown verifier {kind!r}")
    return F.coalesce(VERIFIERS[kind](answer, params), F.lit(False))


def verify(kind: str, answer: Column, params: Mapping[str, Any]) -> Column:
    """The verifier of a kind over an answer; null answers count as empty."""
    return _verified(kind, Answer(F.coalesce(answer, F.lit(""))), params)


def verify_all(answers: DataFrame, wanted: Mapping[str, tuple[str, Mapping[str, Any]]], answer: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys and a column for each verifier wanted, name -> (kind, parameters)."""
    names: dict[str, Column] = {}
    shared = Answer(F.col("_answer"), names)
    cells = [_verified(kind, shared, params).alias(name) for name, (kind, params) in wanted.items()]
    return answers.select(*keys, F.coalesce(F.col(answer), F.lit("")).alias("_answer")).withColumns(names).select(*keys, *cells)
