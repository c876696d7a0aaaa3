"""Repair of conversation structure by shortest paths with a bucket queue.

A conversation's rows, in order, are kept, given another role, deleted, or preceded by
inserted turns, so that the roles follow a grammar: nothing, or an optional system turn
and then user and assistant in turn. The states between two rows (how far the grammar has come)
are the nodes of a graph and the edits its arcs, whose costs are whole numbers of at most
4. Dial's queue, a ring of five buckets, gives every node's distance to the end; then a
walk from the beginning takes, among the arcs on which the distance falls by just the arc's
cost, the one of the least letter, which spells the audit: the least of all cheapest ones.

Faults, copies and order are worked out with Spark's own functions: repeated rows are
added up before they are shuffled, and all rows are sorted by ranges of (conversation,
turn, role, digest of the text), so that a conversation of any size is cut into pieces of
at most PIECE rows. Each piece is a row of one letter a turn. Tasks work out a piece's
distances from its four entries to its four exits, a conversation's pieces are joined by these
16 numbers, and pieces are walked for all entries at once. What is gathered in one row
is 4 numbers for each entry and exit and the audit itself, a letter or two for each turn.
The hash of a repaired conversation, which only one task can compute, is made in one pass over
sorted rows that holds one batch.

Defined results: a null role or text is one space, also within the drawn number, and so
is a null id or turn there; conversations of a null id are one; rows of equal turn go by role
and then by the digest of the text; a role without a letter s, u or a first can't be kept;
a repeated row is damaged like the first of it and then counts as its copy; empty tables give
no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.expressions import small_batches
from assayframe.session import cut

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: States of the grammar: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept role's initial leads from each state.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where a turn that an edit makes leads, and its role.
MADE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated")
#: Rows of a piece, as a power of 2.
PIECE_BITS = 11
FAR = 1 << 40
_RING = max(DELETE_COST, INSERT_COST, REROLE_COST + TRUNCATED_COST) + 1
_BLANK = r"^[\x20\x09-\x0D]*$"
_LAST = r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after the contract's damage."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("draw"))
    body = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("draw <> 0").select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), F.when(F.col("draw") == 3, 2).otherwise(1).alias("copies")
    )


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault, letter, at: every row in order, numbered within the conversation's pieces; kept by a checkpoint.

    rows: conv_id, turn, role, text, copies. Texts of rows that must be deleted are left out.
    """
    digest = F.sha2(F.col("text").cast("binary"), 256)
    one = rows.withColumn("digest", digest).groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.first("text").alias("text"))
    place = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    firsts = one.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"))
    same = (F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
    joined = one.withColumn("place", place).alias("a").join(firsts.alias("b"), same).select("a.*", (F.col("place").eqNullSafe(F.col("first"))).alias("is_first"))
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    fault = (
        F.when(F.col("text").rlike(_BLANK), "blank")
        .when(~F.col("is_first") | (F.col("copy") > 1), "duplicate")
        .when(~F.regexp_extract("text", _LAST, 1).isin(".", "!", "?"), "truncated")
    )
    told = copies.withColumn("fault", fault).withColumn("text", F.when(F.coalesce("fault", F.lit("")).isin("blank", "duplicate"), "").otherwise(F.col("text")))
    keys = ("conv_id", "turn", "role", "digest", "copy")
    placed = told.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    initial = F.substring("role", 1, 1)
    # One letter a row: the initial, other roles being x; capitals for truncated rows; digits for those that go.
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(F.col("fault") == "truncated", F.upper(letter)).when(F.col("fault").isNotNull(), F.translate(letter, "suax", "0123")).otherwise(letter)
    return cut(placed.select("conv_id", "turn", "role", "text", "fault", letter.alias("letter"), "at"))


def _arcs(letter: str, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(edit, cost, rows taken, state after) from a state before a row of this letter."""
    if letter.isdigit():
        yield DELETE, DELETE_COST, 1, state
    else:
        cut_off = TRUNCATED_COST * letter.isupper()
        if (after := KEPT.get((state, letter.lower()))) is not None:
            yield KEEP, cut_off, 1, after
        yield REROLE, REROLE_COST + cut_off, 1, MADE[state]
        yield DELETE, DELETE_COST, 1, state
    yield INSERT, INSERT_COST, 0, MADE[state]


_ARCS = {letter: [list(_arcs(letter, state)) for state in range(4)] for letter in "suaxSUAX0123"}
_BACK = {
    (letter, rows): [[(cost, before) for before in range(4) for _, cost, taken, after in arcs[before] if after == state and taken == rows] for state in range(4)]
    for letter, arcs in _ARCS.items()
    for rows in (0, 1)
}


def _tail(state: int) -> int:
    """How many turns must be inserted behind the last row."""
    n = 0
    while state not in ACCEPTED:
        state, n = MADE[state], n + 1
    return n


def distances(letters: str, ends: list[int]) -> list[int]:
    """For each node (the four states before each row, then those behind the last), the least cost to the end, where a state costs what `ends` says.

    Dial's queue over the graph turned round: nodes wait in a ring of buckets by their distance, and no arc is longer than the ring.
    """
    n = len(letters)
    known = [FAR] * (4 * n + 4)
    ring: list[list[int]] = [[] for _ in range(_RING)]
    fresh, pending, now = sorted((d, 4 * n + s) for s, d in enumerate(ends) if d < FAR), 0, 0
    while fresh or pending:
        if not pending:
            now = fresh[0][0]
        while fresh and fresh[0][0] == now:
            node = fresh.pop(0)[1]
            if now < known[node]:
                known[node] = now
                ring[now % _RING].append(node)
                pending += 1
        bucket = ring[now % _RING]
        while bucket:
            node = bucket.pop()
            pending -= 1
            if known[node] != now:
                continue
            row, state = divmod(node, 4)
            nearer = [(cost, 4 * row + before) for cost, before in _BACK[letters[row], 0][state]] if row < n else []
            if row:
                nearer += [(cost, 4 * row - 4 + before) for cost, before in _BACK[letters[row - 1], 1][state]]
            for cost, other in nearer:
                if now + cost < known[other]:
                    known[other] = now + cost
                    ring[(now + cost) % _RING].append(other)
                    pending += 1
        now += 1
    return known


def walk(letters: str, known: list[int], state: int) -> tuple[str, int]:
    """(audit, state behind the last row): from a state along the arcs on which the distance falls by their cost, the least letter first."""
    row, out = 0, []
    while row < len(letters):
        here = known[4 * row + state]
        edit, _, taken, state = min(a for a in _ARCS[letters[row]][state] if known[4 * (row + a[2]) + a[3]] == here - a[1])
        out.append(edit)
        row += taken
    return "".join(out), state


_COSTS = pa.list_(pa.int64())
_PIECE = [("piece", pa.int64()), ("letters", pa.string())]
_SPANS = "conv_id {}, piece long, letters string, costs array<long>"
_LINKED = "conv_id {}, piece long, letters string, ends array<long>, cost long"
_WALKED = "conv_id {}, piece long, cost long, walks array<struct<audit:string,state:int>>"
_CHOSEN = "conv_id {}, piece long, audit string, cost long"
_REPAIRED = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _rows(batch: pa.RecordBatch, rows: list[dict], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", batch.schema.field("conv_id").type), *fields]))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece, the least cost from each state before its first row to each behind its last."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            per_end = [distances(r["letters"], [0 if s == end else FAR for s in range(4)]) for end in range(4)]
            r["costs"] = [per_end[end][start] for start in range(4) for end in range(4)]
        yield _rows(batch, rows, [*_PIECE, ("costs", _COSTS)])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cost of leaving each piece by each state, from a conversation's last piece back, and its whole cost."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            ends, own = [INSERT_COST * _tail(s) for s in range(4)], []
            for p in reversed(r["pieces"]):
                own.append({"conv_id": r["conv_id"], "piece": p["piece"], "letters": p["letters"], "ends": ends})
                ends = [min(FAR, *(p["costs"][4 * s + e] + ends[e] for e in range(4))) for s in range(4)]
            out += [x | {"cost": ends[START]} for x in own]
        yield _rows(batch, out, [*_PIECE, ("ends", _COSTS), ("cost", pa.int64())])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of a piece and the state behind it, for each state before it from which the end can be reached."""
    walks = pa.list_(pa.struct([("audit", pa.string()), ("state", pa.int32())]))
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            known = distances(r["letters"], r["ends"])
            told = [walk(r["letters"], known, s) if known[s] < FAR else ("", s) for s in range(4)]
            r["walks"] = [{"audit": audit, "state": state} for audit, state in told]
        yield _rows(batch, rows, [("piece", pa.int64()), ("cost", pa.int64()), ("walks", walks)])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's audit, by the state that the pieces before it lead to; inserts behind the last row go with the last piece."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            state, own = START, []
            for p in r["pieces"]:
                own.append({"conv_id": r["conv_id"], "piece": p["piece"], "audit": p["walks"][state]["audit"], "cost": p["cost"]})
                state = p["walks"][state]["state"]
            own[-1]["audit"] += INSERT * _tail(state)
            out += own
        yield _rows(batch, out, [("piece", pa.int64()), ("audit", pa.string()), ("cost", pa.int64())])


class _Repair:
    """What a conversation adds up to as its pieces' audits and rows come by, in order."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.hash, self.lines, self.state = conv_id, hashlib.sha256(), 0, START
        self.faults = dict.fromkeys(FAULTS, 0)
        self.turns, self.least, self.most, self.distinct = 0, None, None, 0
        self.illegal, self.initial, self.cost = 0, None, 0
        self.audits: list[str] = []
        self.edits = iter("")

    def line(self, role: str, text: str) -> None:
        self.hash.update((b"\n" if self.lines else b"") + f"{role}:{text}".encode())
        self.lines += 1

    def edit(self, row: dict | None) -> None:
        """The edits up to that of the next row, or all that are left."""
        for letter in self.edits:
            if letter in (INSERT, REROLE):
                self.state = MADE[self.state]
                self.line(ROLE[self.state], row["text"] if letter == REROLE else "")
            elif letter == KEEP:
                self.state = KEPT[self.state, row["role"][:1]]
                self.line(row["role"], row["text"])
            if letter != INSERT:
                return

    def take(self, r: dict) -> None:
        if r["audit"] is not None:
            self.edits, self.cost = iter(r["audit"]), r["cost"]
            self.audits.append(r["audit"])
            return
        self.edit(r)
        if r["fault"]:
            self.faults[r["fault"]] += 1
        if (turn := r["turn"]) is not None:
            self.distinct += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        initial = r["role"][:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL
        self.initial = initial

    def row(self) -> dict:
        self.edit(None)
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.distinct
        return {"conv_id": self.conv_id, "gaps": gaps, **self.faults, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audits), "repaired_sha256": self.hash.hexdigest()}


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of a sorted partition: each piece's audit comes before its rows."""
    now = None
    fields = [(name, pa.int64()) for name in ("gaps", *FAULTS, "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now is None or r["conv_id"] != now.conv_id:
                if now is not None:
                    out.append(now.row())
                now = _Repair(r["conv_id"])
            now.take(r)
        if out:
            yield _rows(batch, out, fields)
    if now is not None:
        yield _rows(batch, [now.row()], fields)


def repair(rows: DataFrame, piece_bits: int = PIECE_BITS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows (conv_id, turn, role, text, copies)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    placed = ordered(rows).withColumn("piece", F.shiftright("at", piece_bits))
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "")
    spans = placed.groupBy("conv_id", "piece").agg(letters.alias("letters")).mapInArrow(_spans, _SPANS.format(kind))
    per_conv = spans.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "letters", "costs"))).alias("pieces"))
    linked = per_conv.mapInArrow(_link, _LINKED.format(kind)).repartition("conv_id", "piece")
    walked = linked.mapInArrow(_walk, _WALKED.format(kind)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "cost", "walks"))).alias("pieces"))
    chosen = walked.mapInArrow(_choose, _CHOSEN.format(kind)).withColumn("at", F.lit(-1).cast("long"))
    # An audit sorts before the rows of its piece.
    both = chosen.unionByName(placed.select("conv_id", "piece", "at", "turn", "role", "text", "fault"), allowMissingColumns=True)
    sorted_rows = both.select("conv_id", "piece", "at", F.col("turn").cast("long").alias("turn"), "role", "text", "fault", "audit", "cost").repartition("conv_id").sortWithinPartitions("conv_id", "piece", "at")
    return small_batches(sorted_rows).mapInArrow(_apply, _REPAIRED.format(kind))


def repaired(conversations: DataFrame, piece_bits: int = PIECE_BITS) -> DataFrame:
    """The same for every conv_id of the conversations, after the contract's damage; zeros and empty texts where no row is left."""
    found = repair(damaged(conversations), piece_bits)
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    joined = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return joined.select(F.col("_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
