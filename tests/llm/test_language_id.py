import random
import zlib

from pyspark.sql import functions as F

from assayframe.llm import language_id as L
from assayframe.llm.queries import op7_language_id


def corpus(n=120):
    rng = random.Random(4)
    parts = {"aa": ["tion", "ing", "the", "ed", "er"], "bb": ["sch", "ung", "der", "lich", "auf"], "cc": ["eau", "oui", "que", "ette", "ais"]}
    rows = []
    for i in range(n):
        lang = list(parts)[i % 3]
        words = ["".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(8, 120))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_folds_by_the_contract(spark):
    got = spark.range(50).select("id", L.is_training(F.col("id")).alias("t")).collect()
    assert all(r["t"] == (zlib.crc32(str(r["id"]).encode()) % 5 != 0) for r in got)


def test_held_out_accuracy_on_the_small_table(spark, small):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op7_language_id(spark, small).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_synthetic_languages(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(df.where(L.is_training(F.col("doc_id"))))
    assert set(model) == {"aa", "bb", "cc"}
    got = {r["doc_id"]: r for r in L.identify(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.95 * len(held)
    assert not any(got[i]["rejected"] for i, _, _ in rows)


def test_labels_are_not_inputs(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = L.learn(df)
    other = df.withColumn("lang", F.lit("cc")).withColumn("doc_id", -F.col("doc_id"))
    a = [(r["text"], r["lang_pred"], r["score"]) for r in L.identify(df, model).collect()]
    assert a == [(r["text"], r["lang_pred"], r["score"]) for r in L.identify(other, model).collect()]


def test_sample_is_bounded_and_copies_count_once(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text " * 100).alias("text"), F.lit("aa").alias("lang"))
    model = L.learn(df, docs=20, size=5000)
    assert len(model["aa"]) == L.SHARE_CHARS


def test_edges(spark):
    model = L.learn(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    rows = [(1, None), (2, ""), (3, "123 !!! 456"), (4, "é" * 200_000), (5, "x"), (5, "x"), (None, "tion ing the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("rejected", F.lit(7))
    got = L.identify(df, model).collect()
    assert len(got) == len(rows)
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in got[:3]] == [("und", 0.0, True)] * 3
    assert all(r["lang_pred"] in model for r in got[3:])
    assert L.identify(df.limit(0), model).count() == 0
    assert L.learn(df.limit(0).withColumn("lang", F.lit("aa"))) == {}
    assert {r["lang_pred"] for r in L.identify(df, {}).collect()} == {"und"}


def test_numerals_are_no_letters(spark):
    model = L.learn(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    rows = [(1, "²³ ½ ① Ⅷ 12"), (2, "① a"), (3, "ª"), (4, "語")]
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] == "und" and all(got[i] in model for i in (2, 3, 4))


def test_every_label_is_learnt_within_the_model_size(spark, monkeypatch):
    rows = [(i, f"word{i % 40} " * 30, f"l{i % 40}") for i in range(200)]
    monkeypatch.setattr(L, "MODEL_BYTES", 40 * 50)
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model) == 40 and all(0 < len(b) <= 50 for b in model.values())


def test_excerpts_come_from_all_over_the_texts(spark):
    rows = [(i, "header " * 200 + f"mid{i} " * 200, "aa") for i in range(40)]
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["aa"].count(b"header") < model["aa"].count(b"mid") * 3


def test_narrow_margins_are_rejected(spark):
    body = b"tion ing the ed er tioning thed ering edtion " * 20
    docs = spark.createDataFrame([(1, "tion ing the ed er"), (2, "tion ing the ed er tioning thed " * 5)], "doc_id long, text string")
    near, far = ({r["doc_id"]: r["rejected"] for r in L.identify(docs, {"aa": body, "bb": other}).collect()} for other in (body, b"0123456789" * 40))
    assert near == {1: True, 2: True} and far == {1: False, 2: False}


def test_long_text_in_capitals(spark):
    rows = corpus(60)
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    compressors = L._compressors(tuple(model.items()))
    text = " ".join(t for _, t, lang in rows if lang == "bb").upper() * 5
    assert L.classify(text, compressors)[0] == "bb"
