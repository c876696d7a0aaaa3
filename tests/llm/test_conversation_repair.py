import hashlib
import heapq
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from assayframe.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, audit string, piece int"
WHITE = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
MADE = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def after_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own, draw = out.setdefault(conv, []), zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw:
            text = "" if draw == 1 else "".join(c for c in text if c not in ".!?") if draw == 2 else text
            own += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def brute(rows):
    """By best first search over (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, told = set(), []
    for turn, role, text in rows:
        bare = text.strip(WHITE)
        told.append((turn, role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None))
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(told) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        made = MADE[state]
        heapq.heappush(heap, (cost + 2, audit + "I", i, made, (*lines, NAMES[made] + ":")))
        if i < len(told):
            _, role, text, fault = told[i]
            more = fault == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, made, (*lines, f"{NAMES[made]}:{text}")))
                if (state, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[state, role[:1]], (*lines, f"{role}:{text}")))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(sum(r[3] == f for r in told) for f in R.FAULTS), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def repaired(spark, rows, bits=R.PIECE_BITS):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {r[0]: tuple(r[1:]) for r in R.repaired(df, bits).collect()}


def conversations(n=60):
    roles, texts = ("system", "user", "assistant", "tool", None, "user", "assistant"), ("Yes.", "no", "", None, " \t", "Why?", "One. Two", "ümlaut!\x0b", "a\nb", "Yes.", "x" * 3000)
    return [(c, None if t == 5 else t * (1 + c % 2), roles[(c * 7 + t * 3 + c // 5) % 7], texts[(c * 5 + t * 4 + c // 7) % 11]) for c in range(n) for t in range(c % 9)]


def test_as_by_brute_force(spark):
    rows = conversations()
    rows += rows[40:60] + [(None, 1, "user", "Hm."), (None, None, "assistant", "Ah."), (None, None, "assistant", "Ah.")]
    want = {c: brute(r) for c, r in after_damage(rows).items()}
    assert repaired(spark, rows) == want
    assert repaired(spark, rows, 1) == want  # pieces of two rows


def test_a_long_conversation_in_many_pieces(spark):
    rows = [(1, t, ("user", "assistant", "user")[t % 3], f"Turn {t}{'.' if t % 5 else ''}") for t in range(3000)]
    want = brute(after_damage(rows)[1])
    assert repaired(spark, rows, 6) == {1: want}


def test_empty_table_and_conversations_of_which_nothing_is_left(spark):
    assert repaired(spark, []) == {}
    gone = next(t for t in range(200) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    assert repaired(spark, [(3, gone, "user", "Hi.")]) == {3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@settings(max_examples=60, deadline=None)
@given(st.text("suaxSUAX0123", max_size=9), st.integers(0, 3))
def test_the_queue_finds_the_least_costs(letters, state):
    """Against relaxing all arcs until nothing changes."""
    ends = [0 if s == state else R.FAR for s in range(4)]
    want, changed = [R.FAR] * (4 * len(letters)) + ends, True
    while changed:
        changed = False
        for row, letter in enumerate(letters):
            for s in range(4):
                for _, cost, taken, after in R._arcs(letter, s):
                    if (d := want[4 * (row + taken) + after] + cost) < want[4 * row + s]:
                        want[4 * row + s], changed = d, True
    assert R.distances(letters, ends) == want
