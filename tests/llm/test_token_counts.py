import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayframe.llm import token_counts as T
from assayframe.llm.queries import WORD_BPE

PATH = public_tokenizers.path(WORD_BPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(6)
    words = ["the", "don't", "naïve", "語語", "1234", "...", "á", "<|endoftext|>", "<|startoftext|>", "x'", "'s", " ", "Ünï", "!!", "가"]
    mixed = [" ".join(rng.choices(words, k=3000)) for _ in range(3)] + ["".join(rng.choices(words, k=3000)) for _ in range(3)] + ["\n".join(rng.choices(words, k=4000))]
    return [*mixed, "a" * 40_000, "é b" * 9_000, "...a,b!" * 6_000, "<|endoftext|>x" * 2_000, "語。" * 9_000, " " * 20_000 + "a", "ab<|startoftext|> " * 2_000, "á" * 9_000]


def test_huge_texts_as_in_one_call(library):
    tokenizer = T.load_tokenizer(PATH)
    for t in texts():
        want = len(library.encode(t, add_special_tokens=False))
        for chunk, overlap in ((700, 90), (5_000, 300)):
            assert T.count_huge(tokenizer, t, chunk, overlap) == want, (t[:20], chunk)


def test_chunks_are_bounded_where_words_are_short(library, monkeypatch):
    seen = []
    plain = T._encoded
    monkeypatch.setattr(T, "_encoded", lambda k, t, a, b: seen.append(b - a) or plain(k, t, a, b))
    T.count_huge(T.load_tokenizer(PATH), "some plain words here " * 5_000, 4_000, 200)
    assert max(seen) <= 4_400 and len(seen) > 20


def test_operator(spark, library):
    rows = [(1, None, 0), (2, "", 0), (3, "Hello <|endoftext|> world", 0), (4, "one two " * 6_000, 0), (5, "x", 0), (5, "x", 0), (None, "é", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = T.token_counts(df, PATH, chunk=2_000).collect()
    for r, (_, t, _) in zip(got, rows, strict=True):
        n = len(library.encode(t or "", add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 2048)
    assert T.token_counts(df.limit(0), PATH).count() == 0


def test_texts_that_lower_alone_normalises(library):
    """Every character for which the normaliser is left out, beside others, in words and alone."""
    tokenizer, bare = T.load_tokenizer(PATH), T.load_bare(PATH)
    assert bare is not None
    rng = random.Random(9)
    latin = [chr(c) for c in range(0x17F) if c not in (0x130, 0x149)]
    rows = [f"A{c}b {c} {c}{c}\t{c}'s" for c in latin] + ["".join(rng.choices(latin, k=80)) for _ in range(2000)] + ["İ", "ŉ", "ſ", "Áb", "<|ENDOFTEXT|> x", "ΑΣ Σ"]
    assert T.count_texts(tokenizer, rows, bare=bare) == [len(library.encode(t, add_special_tokens=False)) for t in rows]
