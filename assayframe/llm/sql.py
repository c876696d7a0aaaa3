"""DuckDB SQL for hard negatives and for the repair of conversations."""

from __future__ import annotations

from assayframe.llm import conversation_repair, hard_negatives

#: CRC-32 of a list of bytes `b`, by a table `t` that is worked out first.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"

HARD_NEGATIVES = f"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {hard_negatives.POSITIVES}),
n AS (
    SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN {hard_negatives.LOW} * p.positive_score AND {hard_negatives.HIGH} * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {hard_negatives.NEGATIVES}
"""

_NEVER = "{'c': 1000000000, 'a': '', 't': ''}"
_OWN, _UP = "chr(10) || g.role || ':' || g.text", "(g.fault IS NOT DISTINCT FROM 'truncated')::INT"
_MAY = "(g.fault IS NULL OR g.fault = 'truncated')"


def _added(best: str, letter: str, cost: str, line: str = "''") -> str:
    return f"{{'c': {best}.c + {cost}, 'a': {best}.a || '{letter}', 't': {best}.t || {line}}}"


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _kept(best: str, initial: str) -> str:
    return f"CASE WHEN {_MAY} AND g.role[1] = '{initial}' THEN {_added(best, 'K', _UP, _OWN)} ELSE {_NEVER} END"


def _reroled(best: str, role: str) -> str:
    return f"CASE WHEN {_MAY} THEN {_added(best, 'R', f'2 + {_UP}', f"chr(10) || '{role}:' || g.text")} ELSE {_NEVER} END"


def _inserted(states: str) -> str:
    """With turns inserted behind the last row taken: first the user's, then the assistant's."""
    users = _least("s2", *(_added(x, "I", "2", "chr(10) || 'user:'") for x in ("s0", "s1", "s3")))
    return f"SELECT conv_id, i, s0, s1, u AS s2, {_least('s3', _added('u', 'I', '2', "chr(10) || 'assistant:'"))} AS s3 FROM (SELECT *, {users} AS u FROM ({states}))"


_DELETED = [_added(f"p.s{k}", "D", "3") for k in range(4)]
_COUNTS = (*conversation_repair.FAULTS, "illegal")
#: A state of the grammar holds the least (cost, audit, text) with which the rows so far lead to it.
CONVERSATION_REPAIR = f"""
WITH RECURSIVE {CRC_TABLE},
b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM conversations),
d AS (SELECT *, {CRC} % 20 AS draw FROM b, crc_table),
m AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE draw <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM m),
g AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault,
             lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
ids AS (SELECT DISTINCT conv_id FROM conversations),
p(conv_id, i, s0, s1, s2, s3) AS (
    {_inserted(f"SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, {_NEVER} AS s1, {_NEVER} AS s2, {_NEVER} AS s3 FROM ids")}
    UNION ALL
    {_inserted(f'''SELECT g.conv_id, g.i, {_DELETED[0]} AS s0, {_least(_DELETED[1], _kept("p.s0", "s"))} AS s1,
        {_least(_DELETED[2], *(f(f"p.s{k}", y) for k in (0, 1, 3) for f, y in ((_kept, "u"), (_reroled, "user"))))} AS s2,
        {_least(_DELETED[3], _kept("p.s2", "a"), _reroled("p.s2", "assistant"))} AS s3
        FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i + 1''')}
),
n AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, {", ".join(f"count(*) FILTER (fault = '{x}') AS {x}" for x in conversation_repair.FAULTS)},
             count(*) FILTER (pair IS NOT NULL AND pair NOT IN ({", ".join(f"'{x}'" for x in conversation_repair.LEGAL)})) AS illegal, count(*) AS n_rows FROM g GROUP BY conv_id),
e AS (SELECT p.conv_id, n.* EXCLUDE (conv_id), {_least("s0", "s3")} AS best FROM p LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(n.n_rows, 0))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, {", ".join(f"coalesce({x}, 0)::BIGINT AS {x}" for x in _COUNTS)}, best.c::BIGINT AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256 FROM e
"""
