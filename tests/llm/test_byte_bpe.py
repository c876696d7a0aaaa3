import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from assayframe.llm import byte_bpe as B
from assayframe.llm.queries import RANKS

PATH = public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(2)
    alphabet = "ab c  \t\n\x1c\x85\xa0 　'sdé語😀12½!=\x00﻿"
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    long = ["a" * 500, "=" * 3001, " " * 600 + "x", "é" * 300, "xyzzy" * 2000, "語" * 300, "".join(rng.choice("ab") for _ in range(2000)), "<|endoftext|> it's", "word " * 300_000]
    return [None, "", " ", "the the", "the the", *odd, *long]


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_as_the_library(spark, library):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in B.round_trip(df, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(rows):
        assert got[i] == expected(library, t), (t or "")[:40]


def test_small_cache_and_spans_change_nothing(library, monkeypatch):
    monkeypatch.setattr(B, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(B, "QUERY_CHARS", 112)
    monkeypatch.setattr(B, "SPAN_CHARS", 40)
    monkeypatch.setattr(B, "PART_CHARS", 100)
    coder = B.PieceCoder(PATH, public_tokenizers.PATTERN)
    rows = [t or "" for t in texts() if len(t or "") < 700]
    assert [B.digest(s) for s in coder.texts(rows)] == [expected(library, t) for t in rows]


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "aab", "tehinrosa", "áéñç", "0123456789", "-=", "ACGT"])
def test_long_pieces_of_varied_letters(library, alphabet):
    rng = random.Random(len(alphabet))
    pieces = {"".join(rng.choice(alphabet) for _ in range(rng.randint(17, 400))) for _ in range(120)}
    with B.PieceCoder(PATH, public_tokenizers.PATTERN) as coder:
        coder.learn(pieces)
        for p in pieces:
            assert coder.known[p] == ",".join(map(str, library.encode_ordinary(p)))


def test_long_pieces_of_joined_words(library):
    rng = random.Random(4)
    words = ["the", "tion", "house", "wonder", "ing", "queue", "aux", "ähnlich", "ness", "re"]
    pieces = {"".join(rng.choice(words) for _ in range(rng.randint(10, 90))) for _ in range(150)} | {w * 150 for w in words}
    with B.PieceCoder(PATH, public_tokenizers.PATTERN) as coder:
        coder.learn(pieces)
        for p in pieces:
            assert coder.known[p] == ",".join(map(str, library.encode_ordinary(p)))


def test_one_very_long_piece(library):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(60_000))
    with B.PieceCoder(PATH, public_tokenizers.PATTERN) as coder:
        assert [B.digest(s) for s in coder.texts([text])] == [expected(library, text)]


def test_ids_and_decoding(spark, library):
    df = spark.createDataFrame([(1, "Hello, 語 wörld"), (2, None), (3, "")], "doc_id int, text string")
    rows = B.decode(B.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    for r in rows:
        assert list(r["ids"]) == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", "mine")], "text string, n_tokens string")
    assert B.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    assert B.round_trip(df, PATH, public_tokenizers.PATTERN).first()["n_tokens"] == 1


def test_pieces_held_at_once_go_by_the_query(monkeypatch):
    """What a task holds of its texts shrinks with the query that it is given, and the ids stay."""
    import public_tokenizers

    from assayframe.llm import byte_bpe
    from assayframe.llm.queries import RANKS

    held, learn = [], byte_bpe.PieceCoder.learn
    monkeypatch.setattr(byte_bpe.PieceCoder, "learn", lambda self, pieces: (held.append(sum(map(len, pieces))), learn(self, pieces))[1])
    texts = [f"word{k} other{7 * k} third{11 * k}" for k in range(400)]
    found = []
    for query_chars in (100_000, 400):
        held.clear()
        with byte_bpe.PieceCoder(public_tokenizers.path(RANKS), public_tokenizers.PATTERN, 20_000, query_chars) as coder:
            found.append([byte_bpe.digest(spans) for spans in coder.texts(texts)])
    assert max(held) < 2_000 and found[0] == found[1]
