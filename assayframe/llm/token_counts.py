"""Token counts by overlap resynchronisation.

Texts of ordinary length go to the tokenizer whole. A huge text is encoded in
overlapping chunks with offsets: within each overlap the encodings of both chunks
must agree on a run of tokens around a boundary that no token, normalisation or
pre-token can cross, and the count is spliced there. Where no such boundary lies in
the overlap, the overlap is widened, in the end to the whole rest of the text, so
the count always equals that of one call over the whole text.

Defined results: a null or empty text has 0 tokens and 0 bytes; repeated rows are
counted each; other columns, whatever their names, stay as they are, and a column
that has the name of a result is replaced.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: Tokens that both encodings must share right of the boundary, and characters kept clear of either end of the overlap.
AGREE_TOKENS = 4
CLEAR_CHARS = 40
BATCH_CHARS = 400_000


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a .json file, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def load_bare(path: str):
    """The same tokenizer without its normaliser, for texts that lower() alone normalises; None if the normaliser does anything else."""
    import json

    from tokenizers import normalizers

    with open(path, encoding="utf-8") as f:
        steps = json.load(f).get("normalizer") or {}
    kinds = [x.get("type") for x in steps.get("normalizers", [steps])]
    known = kinds == ["NFC", "Replace", "Lowercase"] and steps["normalizers"][1].get("content") == " " and steps["normalizers"][1].get("pattern") == {"Regex": "\\s+"}
    if not known:
        return None
    tokenizer = load_tokenizer.__wrapped__(path)
    tokenizer.normalizer = normalizers.Sequence([])
    return tokenizer


#: What keeps a text from being normalised by lower() alone: characters beyond Latin, which may compose or have a case of more
#: than one character, and marks that could become special tokens.
_NOT_BARE = re.compile("[^\x00-\u012f\u0131-\u0148\u014a-\u017e]|<\\|")


def stable(text: str, at: int) -> bool:
    """Whether nothing left of `at` can change how the text from `at` on is encoded, nor the other way.

    A word starts at `at` after white space, or a letter follows a punctuation mark
    (other than an apostrophe, which contractions take along): no pre-token has both
    sides, and canonical composition never joins them.
    """
    before, here = text[at - 1], text[at]
    if here.isspace() or unicodedata.combining(here) or unicodedata.category(here)[0] == "M":
        return False
    if before.isspace():
        return before in " \t\n\r\f\v"
    return before != "'" and unicodedata.category(before)[0] == "P" and here.isalpha() and here.isascii()


def _encoded(tokenizer, text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(offset in the text, id) of each token of text[start:end]."""
    e = tokenizer.encode(text[start:end], add_special_tokens=False)
    return [(start + a, i) for (a, _), i in zip(e.offsets, e.ids, strict=True)]


def splice_point(text: str, left: list, right: list, low: int, high: int) -> tuple[int, int] | None:
    """Indices in both encodings of the same token, at a stable boundary in text[low:high] after which a run agrees."""
    at_right = {}
    for k, (a, _) in enumerate(right):
        if a >= high:
            break
        at_right.setdefault(a, k)
    for j in range(len(left) - 1, -1, -1):
        a = left[j][0]
        if a < low:
            return None
        if a >= high or (j and left[j - 1][0] == a) or (k := at_right.get(a)) is None or not stable(text, a):
            continue
        if left[j : j + AGREE_TOKENS] == right[k : k + AGREE_TOKENS] and len(left) - j >= AGREE_TOKENS:
            return j, k
    return None


def count_huge(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """The tokens of a huge text, chunk by chunk."""
    start, end = 0, min(len(text), chunk)
    current, skip, total = _encoded(tokenizer, text, start, end), 0, 0
    while end < len(text):
        wide, found = overlap, None
        while found is None:
            next_start, next_end = max(start, end - wide), min(len(text), end - wide + chunk + wide)
            if next_start == start:  # no boundary in the whole chunk: it grows by its own length
                end = min(len(text), start + 2 * (end - start))
                current = _encoded(tokenizer, text, start, end)
                if end == len(text):
                    return total + len(current) - skip
                wide = overlap
                continue
            following = _encoded(tokenizer, text, next_start, next_end)
            found = splice_point(text, current, following, next_start + CLEAR_CHARS, end - CLEAR_CHARS)
            wide *= 2
            if found and found[0] < skip:
                found = None
        total += found[0] - skip
        current, skip, start, end = following, found[1], next_start, next_end
    return total + len(current) - skip


def count_texts(tokenizer, texts: list[str], chunk: int = CHUNK_CHARS, bare=None) -> list[int]:
    """Tokens of each text, in calls of a bounded size. bare: as of load_bare."""
    out = [0] * len(texts)
    for k, text in enumerate(texts):
        if len(text) > chunk:
            out[k] = count_huge(tokenizer, text, chunk)
    short = [k for k, text in enumerate(texts) if 0 < len(text) <= chunk]
    simple = [k for k in short if bare is not None and not _NOT_BARE.search(texts[k])]
    other = sorted(set(short) - set(simple))
    for keys, by, form in ((simple, bare, str.lower), (other, tokenizer, str)):
        batch, size = [], 0
        for at, k in enumerate(keys):
            batch.append(k)
            size += len(texts[k])
            if size >= BATCH_CHARS or at == len(keys) - 1:
                for i, e in zip(batch, by.encode_batch_fast([form(texts[i]) for i in batch], add_special_tokens=False), strict=True):
                    out[i] = len(e)
                batch, size = [], 0
    return out


def counter(path: str, chunk: int = CHUNK_CHARS):
    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer, bare = load_tokenizer(path), load_bare(path)
        for texts in batches:
            yield pd.Series(count_texts(tokenizer, [x or "" for x in texts], chunk, bare), dtype="int64")

    return tokens


def token_counts(df: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 2048, chunk: int = CHUNK_CHARS) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    return (
        df.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"))
        .withColumn("n_tokens", counter(tokenizer_path, chunk)(F.col(text)))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
