"""Checks, verifiers, parsers and statistics on single values, each with its nearest miss."""

import math

import pytest
from pyspark.sql import functions as F

from assayframe.functions import checks as K
from assayframe.functions import judging as J
from assayframe.functions import labels as L
from assayframe.functions import stats as S
from assayframe.functions import text as X

VERIFIED = [
    ("exact_words", "one two - three", {"count": 3}, True),
    ("exact_words", "one two - three four", {"count": 3}, False),
    ("max_words", "a b", {"count": 1}, False),
    ("exact_sentences", "It costs 1.5 dollars. Yes! And", {"count": 3}, True),
    ("exact_sentences", "It costs 1.5 dollars. Yes!", {"count": 3}, False),
    ("all_lowercase", "abc É", {}, False),
    ("no_punctuation", "a b", {}, True),
    ("no_punctuation", "a, b", {}, False),
    ("forbidden_letter", "Hello", {"letter": "E"}, False),
    ("forbidden_substrings", "the cat sat", {"substrings": ["at"]}, True),
    ("forbidden_substrings", "the cat sat", {"substrings": ["cat"]}, False),
    ("contains_all", "the cat sat", {"substrings": ["cat", "sat"]}, True),
    ("no_list_markers", "a\n- b", {}, False),
    ("ends_with", "hello end. ", {"text": "end."}, True),
    ("starts_with", "Hello", {"text": "hello"}, False),
    ("starts_with", "Hello", {"text": "hello", "case_sensitive": False}, True),
    ("code_fence_wrapped", "```py\nx\n```", {}, True),
    ("code_fence_wrapped", "```py\n\n```", {}, False),
    ("regex_full_match", " ab1 ", {"pattern": "[a-z]+\\d"}, True),
    ("regex_full_match", " ab1x ", {"pattern": "[a-z]+\\d"}, False),
    ("line_count", "a\n\n b \n", {"count": 2}, True),
    ("line_ends_with", "roses red,\nviolets blue!", {"text": "blue", "line": -1}, True),
    ("line_ends_with", "roses red,\nviolets blue!", {"text": "blue", "line": 3}, False),
    ("numbered_list", "1. a\n2) b", {"count": 2}, True),
    ("numbered_list", "1. a\n3) b", {"count": 2}, False),
    ("numbered_list", "so:\n1. a\n2. b", {"count": 2, "allow_other_text": True}, True),
    ("single_word", '"Tokyo."', {}, True),
    ("single_word", "Tokyo.", {"allow_trailing_punctuation": False}, False),
    ("one_of", "Yes.", {"options": ["yes", "no"]}, True),
    ("one_of", "Yes, sir", {"options": ["yes", "no"]}, False),
    ("numeric_answer", "so 12\nAnswer: **1,081**", {"expected": 1081}, True),
    ("numeric_answer", "1 + 2\nthe answer is 7 then 8 9", {"expected": 7}, True),
    ("numeric_answer", "\\boxed{5} and\n1 or 2", {"expected": 5}, True),
    ("numeric_answer", "none", {"expected": 5}, False),
    ("json_object", '```json\n{"a":1,"b":"x y"}\n```', {"required_keys": ["a", "b"], "exact_keys": True, "types": {"a": "number", "b": "string"}, "max_words": {"b": 2}, "enums": {"b": ["x y"]}}, True),
    ("json_object", '{"a":true}', {"types": {"a": "number"}}, False),
    ("json_object", '{"a":1,"c":1}', {"required_keys": ["a"], "exact_keys": True}, False),
    ("json_object", "[1]", {}, False),
    ("json_object", 'Sure: {"a":1}', {"allow_surrounding_text": True, "required_keys": ["a"]}, True),
    ("python_function", "```python\ndef f(x):\n  return x\n```", {"entry_point": "f"}, True),
    ("python_function", "def g(x):\n  return x", {"entry_point": "f"}, False),
    ("all_of", "abc", {"checks": [{"kind": "all_lowercase"}, {"kind": "max_words", "params": {"count": 1}}]}, True),
    ("all_of", "Abc", {"checks": [{"kind": "all_lowercase"}, {"kind": "max_words", "params": {"count": 1}}]}, False),
]


def value(spark, expression, **columns):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())).select(expression).first()[0]


@pytest.mark.parametrize("kind,answer,params,expected", VERIFIED)
def test_verifier(spark, kind, answer, params, expected):
    assert value(spark, K.verify(kind, F.col("a"), params), a=answer) is expected


def test_every_verifier_takes_a_null(spark):
    assert value(spark, K.verify("max_words", F.col("a").cast("string"), {"count": 1}), a=None) is True


def test_registry_refuses_a_kind_twice():
    with pytest.raises(ValueError):
        K.register("max_words")(lambda a, p: a)


@pytest.mark.parametrize(
    "kind,answer,params,expected",
    [
        ("forbidden_terms", "A Stoicism view", {"terms": ["Stoic"]}, False),
        ("forbidden_terms", "we renegotiate", {"terms": ["ren"]}, True),
        ("forbidden_terms", "human-heartedness", {"terms": ["heartedness"], "allowed": ["human-heartedness"]}, True),
        ("must_mention_all", "Due on “Friday”", {"terms": ['"friday"']}, True),
        ("must_choose_one_of", "Take option A", {"options": ["option a", "option b"]}, True),
        ("must_choose_one_of", "option a or option b", {"options": ["option a", {"label": "b", "phrases": ["option b"]}]}, False),
        ("must_choose_one_of", "option a or option b", {"options": ["option a", "option b"], "allow_multiple": True}, True),
        ("max_words", "你好 world", {"limit": 3}, True),
        ("max_words", "你好 world", {"limit": 2}, False),
        ("min_words", "x", {}, False),
        ("no_refusal", "Well. I really can't help with that", {}, False),
        ("no_refusal", 'You can say "I can\'t help" now', {}, True),
        ("no_refusal", "“I can't help with that” is a line", {}, True),
    ],
)
def test_answer_check(spark, kind, answer, params, expected):
    assert value(spark, K.ANSWER_CHECKS[kind](F.col("a"), params), a=answer) is expected


def test_repeated_kinds_are_numbered_and_unknown_ones_are_errors(spark):
    rows = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    got = {r["check"]: (r["passed"], r["error"]) for r in K.run_checks(rows, [("max_words", {"limit": 1}), ("max_words", {"limit": 2}), ("odd", {})]).collect()}
    assert got == {"max_words": (False, False), "max_words#2": (True, False), "odd": (False, True)}


@pytest.mark.parametrize(
    "answer,quote,expected",
    [
        ("The quick brown fox jumps over the lazy dog", "quick brown ... the lazy dog", True),
        ("The quick brown fox jumps over the lazy dog", "the lazy dog ... quick brown", False),
        ("The quick brown fox", "a ... e ... i", False),
        ("The quick brown fox", "quick brown", False),
        ("“The  quick” brown fox", '"the quick" BROWN', True),
    ],
)
def test_quote(spark, answer, quote, expected):
    assert value(spark, J.verify_quote(F.col("a"), F.col("q")), a=answer, q=quote) is expected


@pytest.mark.parametrize("raw,expected", [("No.", "scorable"), ("N/A.", "scorable"), ("0", "scorable"), ("cut off", "unscorable"), ("yes", "unscorable"), ("hm", "unrecognised"), ("none of these", "scorable")])
def test_unscorable(spark, raw, expected):
    assert value(spark, J.unscorable_verdict(F.col("r")), r=raw) == expected


def test_sign_test(spark):
    p = lambda a, b: value(spark, S.sign_test_p(F.col("a"), F.col("b")), a=a, b=b)
    assert p(0, 0) is None
    assert p(5, 0) == pytest.approx(1 / 16)
    assert p(3, 3) == 1
    assert p(10, 0) == pytest.approx(2 / 1024)
    assert p(23, 7) == pytest.approx(0.005, abs=5e-4)
    n, k = 1100, 500
    assert p(600, 500) == pytest.approx(2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def test_exact_tests_beyond_the_tables_of_their_sql(spark):
    """Counts of 60 times sf0.1, for which the SQL's tables of log factorials end too soon."""
    log = lambda n: math.lgamma(n + 1)
    b, w = 330_520, 333_253
    want = 2 * sum(math.exp(log(b + w) - log(i) - log(b + w - i) - (b + w) * math.log(2)) for i in range(b + 1))
    assert value(spark, S.sign_test_p(F.col("a"), F.col("b")), a=b, b=w) == pytest.approx(want, abs=1e-6) and 7e-4 < want < 9e-4
    assert value(spark, S.fisher_exact_p(*map(F.col, "abcd")), a=104754, b=105659, c=104030, d=108516) == pytest.approx(4.7e-8, rel=0.05)


def test_allowed_terms_of_one_length_go_in_the_order_given(spark):
    for allowed, passed in ((["than the", "the than"], True), (["the than", "than the"], False)):
        assert value(spark, K.ANSWER_CHECKS["forbidden_terms"](F.col("a"), {"terms": ["than"], "allowed_terms": allowed}), a="Tionnt than the thanou") is passed


def test_small_losses_keep_their_sign(spark):
    rows = spark.createDataFrame([(0, -0.0027), (1, 0.0027), (2, 0.0), (3, None), (4, -0.126), (5, -0.004999)], "k int, v double")
    assert [r["s"] for r in rows.orderBy("k").select(L.signed(F.col("v")).alias("s")).collect()] == ["-0.00", "+0.00", "+0.00", "n/a", "-0.13", "-0.00"]


def test_fisher(spark):
    p = lambda a, b, c, d: value(spark, S.fisher_exact_p(*map(F.col, "abcd")), a=a, b=b, c=c, d=d)
    assert p(5, 5, 5, 5) == pytest.approx(1)
    assert p(17, 11, 17, 19) == pytest.approx(0.321, abs=5e-4)
    assert p(6, 0, 0, 6) == pytest.approx(0.00216, abs=5e-6)
    assert p(0, 0, 1, 2) is None


def test_log_factorial_on_both_sides_of_the_series(spark):
    for n in (0, 1, 2, 255, 256, 257, 100_000):
        assert value(spark, S.log_factorial(F.col("n")), n=n) == pytest.approx(math.lgamma(n + 1), rel=1e-12, abs=1e-12)


def test_correlations(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 1.0), ("c", 2.0, 2.0)], "g string, x double, y double")
    assert {r["g"]: r["p"] for r in rows.groupBy("g").agg(S.pearson(F.col("x"), F.col("y")).alias("p")).collect()} == {"a": pytest.approx(1), "b": None, "c": None}
    assert {r["g"]: r["spearman"] for r in S.spearman(rows, ["g"], "x", "y").collect()} == {"a": pytest.approx(1), "b": None, "c": None}


def test_medians(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 10), ("b", 5), ("b", None), ("c", 1), ("c", 1), ("c", 9)], "g string, x int")
    assert {r["g"]: (r["median"], r["upper_median"]) for r in S.medians(rows, ["g"], "x").collect()} == {"a": (2.5, 3), "b": (5.0, 5), "c": (1.0, 1)}
    assert S.medians(rows, [], "x").first()["upper_median"] == 3


def test_ranks_over_many_ranges(spark):
    rows = spark.range(2000).select((F.col("id") % 2).alias("g"), (F.col("id") % 37).alias("x"), "id").repartition(7)
    got = S.with_ranks(rows, ["g"], r="x").groupBy("g", "x").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.count("*").alias("n")).orderBy("g", "x").collect()
    for g in (0, 1):
        before = 0
        for r in (r for r in got if r["g"] == g):
            assert r["a"] == r["b"] == before + (r["n"] + 1) / 2
            before += r["n"]
    thirds = {r["tercile"]: r["n"] for r in S.terciles(rows.where("g = 0"), ["g"], ["x", "id"]).groupBy("tercile").agg(F.count("*").alias("n")).collect()}
    assert thirds == {"short": 333, "middle": 334, "long": 333}


def test_words_and_lines(spark):
    assert value(spark, X.count_words(F.col("t")), t="don't well-known 你好 1,000") == 5
    assert value(spark, X.count_tokens(F.col("t")), t="a ** - b") == 2
    assert value(spark, X.lines(F.col("t")), t="a\r\n\n b ") == ["a", "b"]
    assert value(spark, X.key_part(F.col("t")), t="The Old-Mill!") == "old mill"
    assert value(spark, X.normalise_unicode(F.col("t")), t="ﬁne  “x”") == 'fine "x"'


JSON = [
    ('{"a":1}', True, True), ('{"a":1} and more', False, True), ('{"a":1}}', False, True), ('{"a":1}{"b":2}', False, True), ('say {"a":"}{"} so', False, True), ('{"a":"\\\\"}', True, True),
    ('{"a":"\\"}"}', True, True), ('{"a":{"b":[1,{"c":2}]}}', True, True), ('{"a":1', False, False), ('[{"a":1}]', False, False), ("1", False, False), ("", False, False), ('{"a":1,}', False, False),
    ('1, "w": {"a":1}', False, True), ('1}, {"a":2', False, False), ('```json\n{"a":1}\n```', True, True), (' {"a": "x\ty"}'.replace("\t", "t"), True, True), ('{not} then {"a":1}', False, False),
]


def test_json_answers_are_scanned_once_for_each_reading(spark):
    """Whatever is asked of the object, the plan scans the answer, its first object, and that object for trailing text."""
    asked = {"allow_surrounding_text": True, "required_keys": ["a", "b"], "exact_keys": True, "types": {"a": "number", "b": "string"}, "enums": {"b": ["x"]}}
    df = spark.range(1).select(K.verify("json_object", F.col("id").cast("string"), asked).alias("passed"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 3


@pytest.mark.parametrize("answer,whole,within", JSON)
def test_json_objects(spark, answer, whole, within):
    df = spark.createDataFrame([(answer,)], "t string")
    got = df.select(K.verify("json_object", F.col("t"), {}), K.verify("json_object", F.col("t"), {"allow_surrounding_text": True})).first()
    assert tuple(got) == (whole, within)


CODE = [
    ("def area(a):\n    return a * 2", True), ("def area(a):\n    return (", False), ("s = 'def area(a): return 1'", False), ("def area(a):\n    pass", False), ("def area(a):\n    ...\n    return", False),
    ("def area(a):\n    raise NotImplementedError\n    return a", False), ("def area():\n    return 1", False), ("def area(a, b=1, *c):\n    if a:\n        return 1\n    return 2", True), ("def area(a, b):\n    return 1", False),
    ("def outer():\n    def area(a):\n        return 1", False), ("Sure:\n```python\nimport math\n```\nand\n```py\ndef area(a):\n    for i in a:\n        yield i\n```", True), ("def area(a):\n    def inner():\n        return 1\n    inner()", False),
    ("def area(a):\n    while True:\n        try:\n            return a\n        finally:\n            pass", True), ("", False), ("area", False), ("def area(a, *, k):\n    return 1", False), ("def area(a):\n    return 1\ndef area(a):\n    pass", False),
]


@pytest.mark.parametrize("answer,passes", CODE)
def test_code_is_read_as_a_tree(answer, passes):
    from assayframe.functions.code import check

    assert check(answer, "area", [1]) is passes


def test_scores_that_are_no_small_numbers(spark):
    rows = ["2", "1.9", " 0 ", "1e10", "nan", "inf", "-inf", "99999999999", "1e400", "2d", "", None, "x", "-0.5", "3"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string")
    assert [r[0] for r in df.orderBy("i").select(J.score_of(F.col("r"))).collect()] == [2, 1, 0, None, None, None, None, None, None, None, None, None, None, 0, None]


def test_quotes_and_items_meet_in_compatibility_forms(spark):
    df = spark.createDataFrame([("Die Straße bleibt heute gesperrt.", "DIE STRASSE bleibt heute", ["ﬁrst rule", "ｓｅｃｏｎｄ"], ["First rule", "second", "?"])], "a string, q string, allowed array<string>, said array<string>")
    got = df.select(J.verify_quote(F.col("a"), F.col("q")), J.rubric_item(F.lit("SECOND"), F.col("allowed")), J.rubric_flags(F.col("said"), F.col("allowed"))).first()
    assert got[0] and got[1] == "ｓｅｃｏｎｄ" and list(got[2]["items"]) == ["ﬁrst rule", "ｓｅｃｏｎｄ"] and list(got[2]["dropped"]) == ["?"]
