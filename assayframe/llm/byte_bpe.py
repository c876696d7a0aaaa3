"""Byte-level BPE by recursive queries in DuckDB, one database a task.

Texts are cut by the vocabulary's pattern, and the distinct pieces that a task hasn't
met yet are encoded together: their token-position rows are joined with the merge
table, each round contracts every piece's leftmost pair of minimum rank, and pieces
leave when no pair merges any more. Pieces of more than LONG_BYTES bytes, whose rounds
would be as many as their tokens, contract all pairs in a round that are proven not to
depend on each other, by one query a round, so that no round's rows stay. Ordered aggregation gives a piece's ids and decodes
them to bytes by the vocabulary. Texts are then put together from pieces.

The merge table has a row for every way in which a vocabulary entry is made of two
others, so that a pair merges exactly if its bytes are an entry; a piece that is itself
an entry is one token from the start, and decoded like any other.

Defined results: null and empty texts have no ids and decode to nothing; repeated rows
get the same result each; other columns stay, a column with the name of a result is
replaced. Memory is bounded by CACHE_BYTES, a batch's pieces and the longest piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.expressions import give_back, small_batches

#: Bytes of pieces that a task remembers, about, once over for those met lately; what a piece takes beside its ids and bytes;
#: characters of pieces that go into one query, and what a query may take.
CACHE_BYTES = 64_000_000
PIECE_BYTES = 320
QUERY_CHARS = 640_000
QUERY_MB = 300
#: Characters of a long text that are worked on at once; cuts lie between pieces.
SPAN_CHARS = 1_000_000
#: Characters of texts whose pieces are coded together, at most and as a multiple of those of a query.
PART_CHARS, PART_QUERIES = 2_000_000, 3.125

#: Bytes from which a piece counts as long.
LONG_BYTES = 64

#: One pair a round: the leftmost of minimum rank. A token's place is 64 times its word's number and its position, so that one
#: sort puts all words in order. A pair's key has its rank, its position and the distance to its second token, each within
#: LONG_BYTES, so that one minimum tells what is contracted and what goes.
ENCODE = """
WITH RECURSIVE step(place, tok, done) AS (
    SELECT place, tok, false FROM start
    UNION ALL
    (
        WITH pairs AS (
            SELECT s.place, s.tok, m.merged::BIGINT * 4096 + (s.place & 63) * 64 + s.next_place - s.place AS key
            FROM (
                SELECT place, tok, lead(tok) OVER w AS next_tok, lead(place) OVER w AS next_place
                FROM step WHERE NOT done WINDOW w AS (ORDER BY place)
            ) s LEFT JOIN merges m ON m.l = s.tok AND m.r = CASE WHEN s.next_place >> 6 = s.place >> 6 THEN s.next_tok END
        ),
        best AS (SELECT place >> 6 AS word, min(key) AS key FROM pairs GROUP BY 1)
        SELECT p.place, CASE WHEN p.key = b.key THEN (b.key >> 12)::INTEGER ELSE p.tok END, b.key IS NULL
        FROM pairs p JOIN best b ON p.place >> 6 = b.word
        WHERE b.key IS NULL OR p.place & 63 <> ((b.key >> 6) & 63) + (b.key & 63)
    )
)
SELECT s.place >> 6 AS word, string_agg(s.tok::VARCHAR, ',' ORDER BY s.place) AS ids, string_agg(v.hex, '' ORDER BY s.place) AS hex
FROM step s JOIN vocabulary v ON v.id = s.tok WHERE s.done GROUP BY 1
"""
#: For long pieces a step of the same fixpoint that contracts many pairs at once, each proven to come before all that could
#: touch it. A pair of rank r can lose a token to a neighbour first only by entries of a rank up to r, which are of at most
#: reach(r) bytes, so only pairs no further away than that matter (calm: none of these has a lower rank). Pairs of one rank
#: in reach of each other are a run, which goes from left to right: if all of it is calm and no new token makes a pair of a
#: lower rank with what stands beside it (falls), the whole run is contracted, of overlapping pairs each second; otherwise
#: its first pair alone, if calm.
STEP_LONG = """
SELECT word, pos, CASE WHEN cut THEN merged ELSE tok END AS tok
FROM (
    SELECT *, coalesce(lag(cut) OVER (PARTITION BY word ORDER BY pos), false) AS gone
    FROM (
        SELECT word, pos, tok, merged,
               coalesce(calm AND (row_number() OVER u = 1 OR bool_and(calm AND NOT falls) OVER (PARTITION BY word, merged, run)
                                  AND row_number() OVER (PARTITION BY word, merged, run, rn - rh ORDER BY pos) % 2 = 1), false) AS cut
        FROM (
            SELECT *, sum(CASE WHEN pos - before <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY word, merged ORDER BY pos) AS run
            FROM (
                SELECT p.*, lag(p.pos) OVER r AS before, row_number() OVER r AS rh, f1.l IS NOT NULL OR f2.l IS NOT NULL OR f3.l IS NOT NULL AS falls
                FROM (
                    SELECT s.*, m.merged, m.reach,
                           m.merged <= min(m.merged) OVER (PARTITION BY word ORDER BY pos RANGE BETWEEN coalesce(m.reach, 0) PRECEDING AND coalesce(next_pos - pos + m.reach, 0) FOLLOWING) AS calm
                    FROM (
                        SELECT word, pos, tok, row_number() OVER w AS rn, lead(pos) OVER w AS next_pos, lead(tok) OVER w AS next_tok, lead(tok, 2) OVER w AS third_tok, lag(tok) OVER w AS prev_tok
                        FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)
                    ) s LEFT JOIN merges m ON m.l = s.tok AND m.r = s.next_tok
                ) p
                LEFT JOIN falls f1 ON f1.l = p.merged AND f1.r = p.third_tok
                LEFT JOIN falls f2 ON f2.l = p.prev_tok AND f2.r = p.merged
                LEFT JOIN falls f3 ON f3.l = p.merged AND f3.r = p.merged
                WINDOW r AS (PARTITION BY p.word, p.merged ORDER BY p.pos)
            )
        )
        WINDOW u AS (PARTITION BY word, merged, run ORDER BY pos)
    )
)
WHERE NOT gone
"""
CODED_LONG = """
SELECT s.word, string_agg(s.tok::VARCHAR, ',' ORDER BY s.pos) AS ids, string_agg(v.hex, '' ORDER BY s.pos) AS hex
FROM state s JOIN vocabulary v ON v.id = s.tok GROUP BY s.word
"""
DECODE = """
SELECT t.word, string_agg(v.hex, '' ORDER BY t.pos) AS hex
FROM (SELECT word, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM coded) t JOIN vocabulary v ON v.id = t.id
GROUP BY t.word
"""


class Vocabulary(NamedTuple):
    """ranks: the id of each entry's bytes; merges: l, r, merged, reach; falls: the merges whose entry has a lower rank than a part."""

    ranks: dict[bytes, int]
    merges: pd.DataFrame
    falls: pd.DataFrame
    single: np.ndarray


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def read_vocabulary(path: str) -> Vocabulary:
    ranks = read_ranks(path)
    made = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    merges = pd.DataFrame(made, columns=["l", "r", "merged"], dtype="int32")
    longest = np.zeros(max(ranks.values()) + 1, dtype=np.int32)
    longest[list(ranks.values())] = list(map(len, ranks))
    merges["reach"] = np.maximum.accumulate(longest)[merges["merged"]]
    falls = merges[(merges["merged"] < merges["l"]) | (merges["merged"] < merges["r"])]
    return Vocabulary(ranks, merges, falls, np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32))


class PieceCoder:
    """Encodes and decodes pieces in a DuckDB database of its own, which a task opens and closes."""

    def __init__(self, path: str, pattern: str, cache_bytes: int | None = None, query_chars: int | None = None) -> None:
        import duckdb
        import regex

        vocabulary = read_vocabulary(path)
        self.ranks, self.single = vocabulary.ranks, vocabulary.single
        # White space as Unicode has it, which is what the vocabulary's pattern means by \s and \S.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # The ids, joined by commas, and the bytes of pieces met lately; and of those from before, from which the ones met again are taken over.
        self.known: dict[str, str] = {}
        self.plain: dict[str, bytes] = {}
        self.before: tuple[dict[str, str], dict[str, bytes]] = {}, {}
        self.held, self.cache_bytes, self.query_chars = 0, cache_bytes or CACHE_BYTES, query_chars or QUERY_CHARS
        self.part_chars = min(PART_CHARS, PART_QUERIES * self.query_chars)
        # No folder for spilling: an executor's own disk takes no files.
        config = {"threads": 1, "memory_limit": f"{QUERY_MB}MB", "temp_directory": "", "preserve_insertion_order": False, "allocator_background_threads": False}
        self.db = duckdb.connect(":memory:", config=config)
        entries = pd.DataFrame({"id": list(self.ranks.values()), "hex": [k.hex() for k in self.ranks]}).astype({"id": "int32"})
        for name, table in (("vocabulary", entries), ("merges", vocabulary.merges), ("falls", vocabulary.falls)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def __enter__(self) -> PieceCoder:
        return self

    def __exit__(self, *_: object) -> None:
        """Lets go of all that a task holds: its worker goes on to other work."""
        self.known, self.plain, self.before = {}, {}, ({}, {})
        self.db.close()
        give_back()

    def rows(self, sql: str, **tables: pd.DataFrame) -> pd.DataFrame:
        for name, table in tables.items():
            self.db.register(name, table)
        out = self.db.execute(sql).df()
        for name in tables:
            self.db.unregister(name)
        return out

    def _fixpoint(self, start: pd.DataFrame) -> pd.DataFrame:
        """Contracts long pieces step by step, of which only the last is kept."""
        self.db.execute(f"SET memory_limit = '{QUERY_MB + len(start) // 1000}MB'")
        self.db.register("start", start)
        self.db.execute("CREATE OR REPLACE TABLE state AS SELECT * FROM start")
        self.db.unregister("start")
        left, before = len(start), -1
        while left != before:
            self.db.execute(f"CREATE OR REPLACE TABLE state AS {STEP_LONG}")
            before, left = left, self.db.execute("SELECT count(*) FROM state").fetchone()[0]
        out = self.db.execute(CODED_LONG).df()
        self.db.execute("DROP TABLE state")
        self.db.execute(f"SET memory_limit = '{QUERY_MB}MB'")
        return out

    def _code(self, pieces: list[str], long: bool) -> None:
        data = [p.encode() for p in pieces]
        # A piece that is an entry itself starts as that one token, others as their bytes.
        entry = np.fromiter((self.ranks.get(b, -1) for b in data), np.int32, len(data))
        size = np.where(entry < 0, np.fromiter(map(len, data), np.int64, len(data)), 1)
        word = np.repeat(np.arange(len(data), dtype=np.int32), size)
        tok = np.repeat(entry, size)
        tok[tok < 0] = self.single[np.frombuffer(b"".join(b for b, i in zip(data, entry, strict=True) if i < 0), np.uint8)]
        pos = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        if long:
            coded = self._fixpoint(pd.DataFrame({"word": word, "pos": pos.astype(np.int32), "tok": tok}))
        else:
            coded = self.rows(ENCODE, start=pd.DataFrame({"place": word * np.int64(LONG_BYTES) + pos, "tok": tok}))
        names = [pieces[k] for k in coded["word"].tolist()]
        self.known.update(zip(names, coded["ids"].tolist(), strict=True))
        self.plain.update(zip(names, map(bytes.fromhex, coded["hex"].tolist()), strict=True))
        self.held += PIECE_BYTES * len(names) + 3 * len(tok)

    def learn(self, pieces: set[str]) -> None:
        """Codes pieces not known yet, in queries of a bounded size."""
        new = [p for p in pieces if p not in self.known]
        if self.held > self.cache_bytes:
            self.before, self.known, self.plain, self.held, new = (self.known, self.plain), {}, {}, 0, list(pieces)
        rest = []
        for p in new:
            if (ids := self.before[0].get(p)) is not None:
                self.known[p], self.plain[p] = ids, self.before[1][p]
            else:
                rest.append(p)
        self.held += PIECE_BYTES * (len(new) - len(rest))
        new = rest
        long = [p for p in new if len(p) > LONG_BYTES // 4 and len(p.encode()) > LONG_BYTES]
        apart = set(long)
        for some in ([p for p in new if p not in apart] if long else new, long):
            part, size = [], 0
            for p in some:
                part.append(p)
                size += 8 + len(p)
                if size >= self.query_chars:
                    self._code(part, some is long)
                    part, size = [], 0
            if part:
                self._code(part, some is long)

    def spans(self, text: str) -> Iterator[list[str]]:
        """The pieces of text, in lists of a bounded size."""
        if len(text) <= SPAN_CHARS:
            yield self.pattern.findall(text)
            return
        part, size = [], 0
        for m in self.pattern.finditer(text):
            part.append(m.group())
            size += len(part[-1])
            if size >= SPAN_CHARS:
                yield part
                part, size = [], 0
        yield part

    def code(self, pieces: list[str]) -> tuple[str, bytes]:
        """The ids of all pieces, joined by commas, and their bytes."""
        try:
            return ",".join(map(self.known.__getitem__, pieces)), b"".join(map(self.plain.__getitem__, pieces))
        except KeyError:
            self.learn(set(pieces))
            return self.code(pieces)

    def texts(self, texts: list[str]) -> Iterator[Iterator[tuple[str, bytes]]]:
        """For each text its ids and bytes, span by span. The pieces of many texts are coded together."""
        part, size = [], 0
        for t in texts:
            part.append(next(self.spans(t)) if len(t) <= SPAN_CHARS else t)
            size += min(len(t), SPAN_CHARS)
            if size >= self.part_chars:
                yield from self._together(part)
                part, size = [], 0
        yield from self._together(part)

    def _together(self, part: list[list[str] | str]) -> Iterator[Iterator[tuple[str, bytes]]]:
        self.learn(set().union(*(x for x in part if isinstance(x, list))))
        for x in part:
            yield map(self.code, [x] if isinstance(x, list) else self.spans(x))


def digest(spans: Iterator[tuple[str, bytes]]) -> tuple[int, str, str]:
    """(tokens, SHA-256 of the ids joined by commas, SHA-256 of the decoded bytes) of a text's spans."""
    ids, plain, n = hashlib.sha256(), hashlib.sha256(), 0
    for some, data in spans:
        if some:
            ids.update((("," if n else "") + some).encode())
            plain.update(data)
            n += some.count(",") + 1
    return n, ids.hexdigest(), plain.hexdigest()


def _digests(path: str, pattern: str, cache_bytes: int | None, query_chars: int | None):
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with PieceCoder(path, pattern, cache_bytes, query_chars) as coder:
            for texts in batches:
                rows = [digest(spans) for spans in coder.texts([x or "" for x in texts])]
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _coded(path: str, pattern: str, cache_bytes: int | None, query_chars: int | None):
    """The digests, and the ids themselves."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with PieceCoder(path, pattern, cache_bytes, query_chars) as coder:
            for texts in batches:
                rows = []
                for spans in coder.texts([x or "" for x in texts]):
                    kept: list[np.ndarray] = []

                    def noted(spans=spans, kept=kept):
                        for some, data in spans:
                            if some:
                                kept.append(np.array(some.split(","), dtype=np.int32))
                            yield some, data

                    row = digest(noted())
                    rows.append((*row, np.concatenate(kept) if kept else np.empty(0, np.int32)))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return run


def _encoder(path: str, pattern: str):
    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with PieceCoder(path, pattern) as coder:
            for texts in batches:
                rows = [[int(i) for ids, _ in spans if ids for i in ids.split(",")] for spans in coder.texts([x or "" for x in texts])]
                yield pd.Series(rows)

    return run


def _decoder(path: str, pattern: str):
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with PieceCoder(path, pattern) as coder:
            for ids in batches:
                given = pd.DataFrame({"word": range(len(ids)), "ids": [[] if x is None else list(map(int, x)) for x in ids]})
                plain = coder.rows(DECODE, coded=given) if len(given) else given
                by_row = dict(zip(plain["word"], plain["hex"], strict=True)) if len(given) else {}
                yield pd.Series([bytes.fromhex(by_row.get(k, "")) for k in range(len(ids))])

    return run


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of text as an array."""
    return small_batches(df).withColumn(out, _encoder(ranks_path, pattern)(F.col(text)))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of an array of ids; ids outside the vocabulary give nothing."""
    return df.withColumn(out, _decoder(ranks_path, pattern)(F.col(ids)))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", cache_bytes: int | None = None, query_chars: int | None = None, ids: bool = False) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256, and the ids themselves if asked for. cache_bytes, query_chars: what a task may hold, by default CACHE_BYTES and QUERY_CHARS."""
    names = [c for c in df.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "_coded", *(["ids"] if ids else []))]
    return small_batches(df).withColumn("_coded", (_coded if ids else _digests)(ranks_path, pattern, cache_bytes, query_chars)(F.col(text))).select(*(F.col(f"`{c}`") for c in names), "_coded.*")
