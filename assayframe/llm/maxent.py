"""A hashed maximum-entropy language model with a class-factored softmax.

P(token | before) = P(class | last two tokens) P(token | class, last token). Classes:
the HOT most frequent tokens in runs of MEMBERS by frequency, all other words by a hash
of their last bytes into TAILS classes. Both factors are softmaxes over sums of weights
whose rows are picked by hashes of the features: a bias, the last token, the one before
it (a skip feature) and both together for the class; a bias and the last token for the
member of a class of frequent tokens. Within a class of other words a token's share is
its add-one count, and a word never met in training is one more word of its class. So
the probabilities of all training tokens and of one unknown word a class sum to 1.

Learning takes every training document. Tasks count tokens, flushing partial counts
at a bounded size, and then the events (context, class), in arrays whose size is set by
the parameters; both are summed in shuffles, so what is gathered grows with the corpus
until it meets that size. Each gradient update is a distributed job over the summed
events, in which a task returns the observed less the expected counts of the feature rows
that it touches; events are laid out by their hashed pair, so most rows are touched by
one task. The weights (ROWS x classes, 10 MB) are broadcast for every update.

Scoring: texts are read in batches of tokens; of each batch's distinct contexts the
softmax is worked out once, in numpy. Tasks hold the counts of HELD tokens of at most
HELD_BYTES bytes, the most frequent ones; all others of a document leave as rows
(document, word, times) and meet the counts in a join, which no frequent word takes part in.

Defined results: a null text is an empty one, whose one token is the end; repeated rows
each get their own result, whatever their ids; without training documents all counts
are 0 and all tokens unknown but equally likely by class; texts of any length are read
whole, in pieces of GROUP_BYTES cut at white space; columns of the table other than
those named don't matter, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.expressions import give_back, small_batches
from assayframe.session import cut, scratch

#: Tokens that are told apart as outputs, and as contexts; members of their classes; classes of all other words.
HOT, CONTEXTS, MEMBERS, TAILS = 512, 256, 32, 64
#: Bytes at a word's end that give its class.
ENDING = 3
ROWS, MEMBER_ROWS = 1 << 15, 1 << 14
UPDATES, STEP, DECAY = 10, 2.0, 0.5
HELD, HELD_BYTES = 1 << 18, 64
#: Distinct words that a task counts before it passes the counts on.
FLUSH = 200_000
GROUP_BYTES = 2 << 20
EVENT_BLOCKS = 24
#: The end of a text among words, which are never empty.
END = b""
_WHITE = re.compile(rb"[\x20\x09-\x0D]")

_COUNTED = "word binary, n long"
_EVENTS = "kind int, block int, payload binary"
_SCORED = "doc_id {}, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,n:long>>"


def is_training(doc_id: Column, folds: int = 7, left_out: int = 2) -> Column:
    """The contract's folds: crc32 of the id as text, modulo `folds`, is not `left_out`. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != left_out


def token_groups(texts: Iterator[bytes | None]) -> Iterator[tuple[list[bytes], list[int], list[int], bool]]:
    """(tokens, starts, rows, goes on): whole texts together, or a piece of a long one, which goes on with the group before but for its first."""
    words: list[bytes] = []
    starts: list[int] = []
    rows: list[int] = []
    size = 0
    for row, text in enumerate(texts):
        text = (text or b"").lower()  # of bytes: A-Z alone
        if size and size + len(text) > GROUP_BYTES:
            yield words, starts, rows, False
            words, starts, rows, size = [], [], [], 0
        if len(text) <= GROUP_BYTES:
            starts.append(len(words))
            rows.append(row)
            words += text.split()
            words.append(END)
            size += len(text) + 1
            continue
        at = 0
        while at < len(text):
            white = _WHITE.search(text, at + GROUP_BYTES)
            end = white.start() if white else len(text)
            piece = text[at:end].split()
            if end == len(text):
                piece.append(END)
            yield piece, [0], [row], at > 0
            at = end
    if rows:
        yield words, starts, rows, False


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for words, *_ in token_groups(iter(_texts(batch))):
            counts.update(words)
            if len(counts) > FLUSH:
                yield flush()
    yield flush()
    give_back()


def token_counts(docs: DataFrame) -> DataFrame:
    """word (bytes; empty for the end), n: over all texts of docs."""
    return small_batches(docs).select("text").mapInArrow(_count, _COUNTED).groupBy("word").agg(F.sum("n").alias("n"))


def _hashed(rows: int, kind: int, a: np.ndarray | int = 0, b: np.ndarray | int = 0) -> np.ndarray:
    """The row of a feature, by multiplying and shifting."""
    with np.errstate(over="ignore"):
        x = np.asarray(a, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(kind + 1) * np.uint64(0x165667B19E3779F9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - rows.bit_length() + 1)).astype(np.int64)


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:]) % TAILS


class Vocabulary:
    """The held tokens, the most frequent first, with their counts; the first HOT are told apart."""

    classes = HOT // MEMBERS + TAILS
    start = CONTEXTS + TAILS
    contexts = CONTEXTS + TAILS + 1

    def __init__(self, words: list[bytes], counts: list[int]) -> None:
        self.words, self.counts = words, np.array(counts, dtype=np.float64)
        tails = np.array([tail_of(w) for w in words], dtype=np.int64)
        at = np.arange(len(words))
        self.context = np.where(at < CONTEXTS, at, CONTEXTS + tails)
        self.label = np.where(at < HOT, at // MEMBERS, HOT // MEMBERS + tails)
        self._places: dict[bytes, int] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_places": None}

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the held ones, -1 for others."""
        if self._places is None:
            self._places = {w: k for k, w in enumerate(self.words)}
        get = self._places.get
        return np.array([get(w, -1) for w in words], dtype=np.int64)

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, contexts, classes) of words."""
        at = self.places(words)
        context, label = self.context[at], self.label[at]
        odd = np.flatnonzero(at < 0)
        if len(odd):
            tails = np.array([tail_of(words[k]) for k in odd], dtype=np.int64)
            context[odd], label[odd] = CONTEXTS + tails, HOT // MEMBERS + tails
        return at, context, label


def _before(context: np.ndarray, starts: list[int], start: int, carry: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The contexts one and two tokens before each token; carry: those before the group's first token, the nearer first."""
    first = np.asarray(starts)
    one, two = np.empty_like(context), np.empty_like(context)
    one[1:], two[2:] = context[:-1], context[:-2]
    after = first + 1
    two[after[after < len(two)]] = start
    one[first], two[first] = start, start
    one[0], two[0] = carry
    if len(two) > 1 and (len(first) == 1 or first[1] > 1):
        two[1] = carry[0]
    return one, two


def _contexts(vocabulary: Vocabulary, texts: list[bytes | None]) -> Iterator[tuple]:
    """(rows, starts, words, places, classes, contexts before, before those) of each group of tokens."""
    carry = (vocabulary.start,) * 2
    for words, starts, rows, goes_on in token_groups(iter(texts)):
        at, context, label = vocabulary.read(words)
        if not goes_on:
            carry = (vocabulary.start,) * 2
        one, two = _before(context, starts, vocabulary.start, carry)
        carry = (int(context[-1]), int(context[-2]) if len(context) > 1 else carry[0])
        yield rows, starts, words, at, label, one, two


class Layout:
    """Every pair of contexts, ordered by the weights' row that the pair hashes to, in blocks."""

    def __init__(self) -> None:
        k = Vocabulary.contexts
        one, two = np.divmod(np.arange(k * k), k)
        order = np.argsort(_hashed(ROWS, 3, one, two), kind="stable")
        self.one, self.two = one[order], two[order]
        self.place = np.empty(k * k, dtype=np.int64)
        self.place[order] = np.arange(k * k)
        self.cuts = np.linspace(0, k * k, EVENT_BLOCKS + 1).astype(np.int64)


def class_rows(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The weights' rows of each context's features: contexts x 4."""
    return np.stack([np.broadcast_to(_hashed(ROWS, 0), one.shape), _hashed(ROWS, 1, one), _hashed(ROWS, 2, two), _hashed(ROWS, 3, one, two)], axis=1)


def member_rows(label: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.stack([_hashed(MEMBER_ROWS, 4, label), _hashed(MEMBER_ROWS, 5, label, one)], axis=1)


def _log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = weights[rows[:, 0]].astype(np.float64)
    for k in range(1, rows.shape[1]):
        out += weights[rows[:, k]]
    out -= out.max(axis=1, keepdims=True)
    out -= np.log(np.exp(out).sum(axis=1, keepdims=True))
    return out


def _events(vocabulary):
    """Counts of (pair of contexts, class) and (context, hot token), as blocks of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, layout = vocabulary.value, Layout()
        pairs = np.zeros(v.contexts**2 * v.classes, dtype=np.int32)
        members = np.zeros(v.contexts * HOT, dtype=np.int32)
        seen = False
        for batch in batches:
            for _, _, _, at, label, one, two in _contexts(v, _texts(batch)):
                np.add.at(pairs, layout.place[one * v.contexts + two] * v.classes + label, 1)
                hot = (at >= 0) & (at < HOT)
                np.add.at(members, one[hot] * HOT + at[hot], 1)
                seen = True
        if seen:
            parts = [(0, b, pairs[layout.cuts[b] * v.classes : layout.cuts[b + 1] * v.classes]) for b in range(EVENT_BLOCKS)] + [(1, 0, members)]
            for kind, block, part in parts:
                yield _packed(kind, block, part)
        del pairs, members
        give_back()

    return run


def _packed(kind: int, block: int, part: np.ndarray) -> pa.RecordBatch:
    """Only what isn't zero: places and counts."""
    at = np.flatnonzero(part)
    payload = zlib.compress(np.diff(at, prepend=0).astype(np.int32).tobytes() + part[at].astype(np.int64).tobytes(), 1)
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([payload], pa.binary())], ["kind", "block", "payload"])


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(payload)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, np.int32, n)).astype(np.int64), np.frombuffer(raw, np.int64, n, 4 * n)


def _length(kind: int, block: int, layout: Layout) -> int:
    return int((layout.cuts[block + 1] - layout.cuts[block]) * Vocabulary.classes) if kind == 0 else Vocabulary.contexts * HOT


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One array for each block of a partition, however many tasks have sent theirs; they come one after another."""
    layout, key, total = Layout(), None, None
    for batch in batches:
        for r in batch.to_pylist():
            here = (r["kind"], r["block"])
            if here != key:
                if key is not None:
                    yield _packed(*key, total)
                key, total = here, np.zeros(_length(*here, layout), dtype=np.int64)
            at, n = _unpacked(r["payload"])
            total[at] += n
    if key is not None:
        yield _packed(*key, total)


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values (contexts x outputs) by each feature's row."""
    found, width = [], values.shape[1]
    for k in range(rows.shape[1]):
        order = np.argsort(rows[:, k], kind="stable")
        own, first = np.unique(rows[order, k], return_index=True)
        found.append((own, np.add.reduceat(values[order], first, axis=0)))
    own = np.unique(np.concatenate([f[0] for f in found]))
    out = np.zeros((len(own), width))
    for at, part in found:
        out[np.searchsorted(own, at)] += part
    return own, out


def _contexts_of(kind: int, block: int, layout: Layout) -> np.ndarray:
    """The feature rows of a block's contexts, in the order of its counts."""
    if kind == 0:
        span = slice(layout.cuts[block], layout.cuts[block + 1])
        return class_rows(layout.one[span], layout.two[span])
    one, label = np.divmod(np.arange(Vocabulary.contexts * (HOT // MEMBERS)), HOT // MEMBERS)
    return member_rows(label, one)


def _gradient(weights, first: bool):
    """Observed less expected counts of the feature rows that a block touches, and the observed ones in the first update."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, w = Layout(), weights.value
        for batch in batches:
            for r in batch.to_pylist():
                kind, block = r["kind"], r["block"]
                rows, width = _contexts_of(kind, block, layout), w[kind].shape[1]
                counts = np.zeros(len(rows) * width)
                at, n = _unpacked(r["payload"])
                counts[at] = n
                counts = counts.reshape(len(rows), width)
                met = np.flatnonzero(counts.sum(axis=1))
                rows, counts = rows[met], counts[met]
                if not len(met):
                    continue
                expected = np.exp(_log_softmax(w[kind], rows)) * counts.sum(axis=1, keepdims=True)
                own, less = _by_row(rows, counts - expected)
                payload = own.astype(np.int32).tobytes() + less.astype(np.float32).tobytes() + (_by_row(rows, counts)[1].astype(np.float32).tobytes() if first else b"")
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([payload], pa.binary())], ["kind", "block", "payload"])
        give_back()

    return run


def update(weights: np.ndarray, observed: np.ndarray, less: np.ndarray, features: int) -> np.ndarray:
    """The weights after a step along the gradient, decayed, each scaled by its own curvature's bound and shared among the features of an event."""
    gradient = less - DECAY * weights
    scale = np.maximum(observed, observed - less) + DECAY
    return weights + np.clip(gradient / scale, -1, 1) * (STEP / features)


#: The weight of outputs that no token has.
NEVER = -30.0


def fit(events: DataFrame, updates: int = UPDATES, words: int = HOT, left: list | None = None) -> list[np.ndarray]:
    """[class weights, member weights] after so many distributed gradient updates. words: tokens held; left: gets the share of the gradient left at each."""
    sc = events.sparkSession.sparkContext
    shapes = ((ROWS, Vocabulary.classes, 4), (MEMBER_ROWS, MEMBERS, 2))
    weights = [np.zeros((rows, width), dtype=np.float32) for rows, width, _ in shapes]
    filled = np.clip(words - MEMBERS * np.arange(HOT // MEMBERS), 0, MEMBERS)
    weights[0][_hashed(ROWS, 0), np.flatnonzero(filled == 0)] = NEVER
    for label, n in enumerate(filled):
        weights[1][_hashed(MEMBER_ROWS, 4, label), n:] = NEVER
    observed = [np.zeros((rows, width), dtype=np.float32) for rows, width, _ in shapes]
    for k in range(updates):
        sent = sc.broadcast(weights)
        less = [np.zeros((rows, width), dtype=np.float32) for rows, width, _ in shapes]
        # As many rows as blocks, each of a size that the parameters set.
        for r in events.mapInArrow(_gradient(sent, k == 0), _EVENTS).toLocalIterator(prefetchPartitions=True):
            n, width = r["block"], shapes[r["kind"]][1]
            at = np.frombuffer(r["payload"], np.int32, n)
            for into, place in ((less, 0), (observed, 1))[: 1 + (k == 0)]:
                into[r["kind"]][at] += np.frombuffer(r["payload"], np.float32, n * width, 4 * n * (1 + place * width)).reshape(n, width)
        sent.destroy()
        if left is not None:
            left.append(float(np.abs(less[0]).sum() / max(1.0, observed[0].sum())))
        weights = [update(w, o, g, f).astype(np.float32) for w, o, g, (_, _, f) in zip(weights, observed, less, shapes, strict=True)]
    return weights


class Model:
    """Counts of all tokens (a table), the held ones, sizes of the classes of other words, and weights."""

    def __init__(self, counts: DataFrame, vocabulary: Vocabulary, tokens: int, distinct: int, tails: np.ndarray, weights: list[np.ndarray]) -> None:
        self.counts, self.vocabulary, self.tokens, self.distinct, self.tails, self.weights = counts, vocabulary, tokens, distinct, tails, weights


def _most_frequent(counts: DataFrame, held: int) -> list[tuple[bytes, int]]:
    """The words of HELD_BYTES at most whose counts are above a line that `held` words pass at most: no task sorts or sends more than those."""
    words = counts.where(F.length("word").between(1, HELD_BYTES)).withColumn("step", F.floor(F.log2("n") * 8).cast("int"))
    line, total = None, 0
    # Eight rows for each doubling of the counts.
    for r in words.groupBy("step").agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        total += r["words"]
        if total > held:
            break
        line = r["step"]
    if line is None:
        return []
    top = words.where(F.col("step") >= line).select("word", "n").toArrow()
    return list(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True))


def learn(training: DataFrame, held: int = HELD, updates: int = UPDATES) -> Model:
    """The model of the texts of `training` (a column `text`)."""
    spark = training.sparkSession
    counts = cut(token_counts(training))
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = counts.where(F.length("word") == 0).first()
    end = (END, ends["n"] if ends else 0)
    ranked = sorted([end, *_most_frequent(counts, held)], key=lambda x: (-x[1], x[0]))
    if ranked.index(end) >= HOT:
        ranked.remove(end)
        ranked.insert(HOT - 1, end)
    vocabulary = Vocabulary([w for w, _ in ranked], [n for _, n in ranked])
    tails = np.zeros((2, TAILS))
    for r in counts.groupBy((F.crc32(F.expr(f"substring(word, -{ENDING})")) % TAILS).cast("int").alias("tail")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tails[:, r["tail"]] = r["n"], r["v"]
    for w, n in ranked[:HOT]:
        tails[:, tail_of(w)] -= n, n > 0
    sent = spark.sparkContext.broadcast(vocabulary)
    events = small_batches(training).select("text").mapInArrow(_events(sent), _EVENTS).repartition(EVENT_BLOCKS + 1, "kind", "block").sortWithinPartitions("kind", "block")
    weights = fit(cut(events.mapInArrow(_summed, _EVENTS)), updates, len(vocabulary.words))
    sent.destroy()
    return Model(counts, vocabulary, whole["n"] or 0, whole["v"], tails, weights)


def _member_table(weights: np.ndarray) -> np.ndarray:
    """log P(member | class, context before): contexts x HOT."""
    return _log_softmax(weights, _contexts_of(1, 0, None)).reshape(Vocabulary.contexts, HOT)


def token_scores(vocabulary: Vocabulary, weights: list[np.ndarray], tails: np.ndarray, members: np.ndarray, at: np.ndarray, label: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """ln P of each token of a batch; of words that aren't held, without their own count's logarithm."""
    code, where = np.unique(one * vocabulary.contexts + two, return_inverse=True)
    out = _log_softmax(weights[0], class_rows(*np.divmod(code, vocabulary.contexts)))[where, label]
    hot = (at >= 0) & (at < HOT)
    out[hot] += members[one[hot], at[hot]]
    other = np.flatnonzero(~hot)
    out[other] -= np.log(tails.sum(axis=0) + 1)[label[other] - HOT // MEMBERS]
    held = other[at[other] >= 0]
    out[held] += np.log(vocabulary.counts[at[held]] + 1)
    return out


def _score(model, tokens: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, weights, tails = model.value
        members, common = _member_table(weights[1]), math.log10(tokens + distinct + 1)
        for batch in batches:
            texts = _texts(batch)
            n = len(texts)
            n_tokens, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
            base, score = np.zeros(n), np.zeros(n)
            rare: list[Counter] = [Counter() for _ in range(n)]
            for rows, starts, words, at, label, one, two in _contexts(v, texts):
                first, own = np.asarray(starts), np.asarray(rows)
                held = at >= 0
                counts = np.where(held, v.counts[at], 0.0)
                n_tokens[own] += np.diff(first, append=len(words))
                known[own] += np.add.reduceat((counts > 0).astype(np.int64), first)
                base[own] += np.add.reduceat(np.log10(counts + 1) - common, first)
                score[own] += np.add.reduceat(token_scores(v, weights, tails, members, at, label, one, two), first) / math.log(10)
                odd = np.flatnonzero(~held)
                for k, row in zip(odd, own[np.searchsorted(first, odd, "right") - 1], strict=True):
                    rare[row][words[k]] += 1
            found = pa.array([[{"word": w, "n": m} for w, m in c.items()] for c in rare], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(score), found], ["doc_id", "n_tokens", "n_known", "base", "score", "rare"]
            )
        give_back()

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (the model's) of every row of docs; both log10."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast((model.vocabulary, model.weights, model.tails))
    parts = small_batches(docs).select("doc_id", "text").mapInArrow(_score(sent, model.tokens, model.distinct), _SCORED.format(kind))
    # Written once: from then on a row's number stays, whatever is lost.
    path = scratch(spark, "scored")
    parts.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    counted = rare.join(model.counts.withColumnRenamed("n", "c"), "word", "left")
    sums = counted.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("log"))
    log = F.coalesce("log", F.lit(0.0))
    return rows.drop("rare").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"), (F.col("score") + log).alias("score"),
    )
