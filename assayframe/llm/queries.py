"""The queries of the operators over the shared tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.llm import (
    byte_bpe, conversation_repair, decontamination, hard_negatives, impact_search, language_id, maxent, sanitisation, simhash, sql, token_counts, url_filters, virtual_slots, warc,
)
from assayframe.session import cut, scratch

#: The URL rules as (host, path, action).
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
SHARDS = 24
RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "words", "start", "n_items")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sanitisation.inspect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in sanitisation.KINDS]
    found = [F.size("base").cast("long").alias("n_found"), F.size("all_spans").cast("long").alias("n_spans")]
    return rows.select("doc_id", *counts, F.sha2(sanitisation.joined(F.col("base")), 256).alias("base_sha256"), sanitisation.joined(F.col("all_spans")).alias("spans"), *found)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 of the slot map places the documents; version 2, an edit of it for one shard more, says where each would then be."""
    rows = virtual_slots.describe(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    path, slots = scratch(spark, "slot-map"), cut(virtual_slots.slot_bytes(rows))
    first = virtual_slots.save_map(virtual_slots.place(slots, SHARDS), path)
    second = virtual_slots.save_map(virtual_slots.rebalance(first, slots, SHARDS + 1), path)
    after = second.select("virtual_slot", F.col("shard").alias("next_shard"), F.col("map_version").alias("next_version"))
    placed = virtual_slots.assign(rows, virtual_slots.load_map(spark.read.parquet(path), 1), slots=slots).join(F.broadcast(after), "virtual_slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version", "next_shard", "next_version")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).drop("text")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = impact_search.quantised(table(spark, sf_dir, "embeddings"))
    return impact_search.top_k(vectors, vectors.where(impact_search.is_query(F.col("vec_id"))))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    training = language_id.is_training(F.col("doc_id"))
    model = language_id.learn(docs.where(training))
    return language_id.identify(docs, model).select("doc_id", (~training).alias("held_out"), "lang_pred", "score", "rejected")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.captures_of(warc.assemble(warc.read_records(spark, path)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "request")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path(WORD_BPE)).drop("text")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = maxent.is_training(F.col("doc_id"))
    scored = maxent.score(docs, maxent.learn(docs.where(training)))
    return scored.select("doc_id", (~training).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved on by one, so that some rows stand among others' nearest."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.prepared(table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 50 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_decontamination, op3_pii, op4_sharding, op5_byte_bpe, op6_exact_top_k, op7_language_id, op8_simhash, op9_warc, op10_token_counts, op11_lm_scoring, op12_hard_negatives, op13_conversation_repair)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {**OPERATORS, "pipeline": corpus_pipeline.run}


_RULE_CASES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h + p}', 'action': '{a}'}}" for h, p, a in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
)
_HOST = "coalesce(translate(regexp_extract({0}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract({0}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
_NODE = "CASE WHEN regexp_matches({0}, '^[^:/?#]+://') THEN lower(regexp_extract({0}, '^([^:/?#]+://[^/?#]*)', 1)) || regexp_replace(regexp_extract({0}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract({0}, '^[^?#]*(\\?[^#]*)', 1) END"
_TAG, _EACH, _REFERENCE = (p.replace("'", "''") for p in (url_filters.TAG, url_filters.ATTRIBUTE, url_filters.REFERENCE))


def _attribute_sql(tag: str, name: str) -> str:
    own = f"list_filter(regexp_extract_all({tag}, '{_EACH}'), lambda a: regexp_matches(a, '(?i)^{name}\\s*='))[1]"
    bare = f"regexp_replace({own}, '(?s)^[^=]*=\\s*', '')"
    value = f"""CASE WHEN regexp_matches({bare}, '^["'']') THEN substr({bare}, 2, length({bare}) - 2) ELSE {bare} END"""
    code = "CASE WHEN regexp_matches(r, '^&#[xX]') THEN ('0x' || regexp_extract(r, '^&#[xX]([0-9a-fA-F]+)', 1))::BIGINT ELSE try_cast(regexp_extract(r, '^&#([0-9]+)', 1) AS BIGINT) END"
    named = " ".join(f"WHEN '&{n};' THEN '{c.replace(chr(39), chr(39) * 2)}'" for n, c in url_filters.REFERENCES.items())
    decoded = f"CASE r {named} ELSE CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr(({code})::INT) ELSE r END END"
    return f"(SELECT nullif(trim(array_to_string(list_transform(regexp_split_to_array(v, '{_REFERENCE}'), lambda g, i: g || coalesce(list_transform(regexp_extract_all(v, '{_REFERENCE}'), lambda r: {decoded})[i], '')), '')), '') FROM (SELECT {value} AS v))"


def _resolved_sql(target: str, page: str) -> str:
    site, path = f"regexp_extract({page}, '^([^:/?#]+://[^/?#]*)', 1)", f"regexp_extract({page}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
    own = f"regexp_extract({target}, '^[^?#]*')"
    names = f"string_split(CASE WHEN starts_with({own}, '/') THEN {own} ELSE coalesce(nullif(regexp_replace({path}, '[^/]*$', ''), ''), '/') || {own} END, '/')"
    clean = f"array_to_string(list_reduce(list_transform({names}, lambda x: [x]), lambda kept, x: CASE x[1] WHEN '..' THEN kept[:greatest(len(kept) - 1, 1)] WHEN '.' THEN kept ELSE kept || x END), '/')"
    return f"""CASE WHEN regexp_matches({target}, '^[^:/?#]+://') THEN {target} WHEN starts_with({target}, '//') THEN regexp_extract({page}, '^([^:/?#]+):', 1) || ':' || {target}
        WHEN starts_with({target}, '?') THEN {site} || {path} || {target}
        WHEN NOT regexp_matches({target}, '^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)') THEN {site} || {clean} || substr({target}, length({own}) + 1) END"""


#: The base findings' plain patterns, as the contract has them.
_PII = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+",
    "ip": "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)",
    "card": "[0-9](?:[\\x20-]?[0-9])+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
_TERM = "\\p{L}{3,}"


def _located_sql(kind: str, pattern: str, source: str) -> str:
    """doc_id, key, kind, value, s (start), e (end), b and a (the gaps around) of every match."""
    return f"""SELECT doc_id, key, '{kind}' AS kind, value, e - length(value) AS s, e, b, a FROM (
    SELECT doc_id, key, value, b, a, sum(length(b) + length(value)) OVER (PARTITION BY doc_id, key ORDER BY i) AS e FROM (
        SELECT doc_id, key, unnest(m) AS value, unnest(g[:len(m)]) AS b, unnest(g[2:]) AS a, unnest(range(len(m))) AS i
        FROM (SELECT doc_id, key, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM {source}) WHERE len(m) > 0))"""


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END * {_DIGITS}[length({_DIGITS}) - i]::INT + CASE WHEN i % 2 = 1 THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][{_DIGITS}[length({_DIGITS}) - i]::INT + 1] ELSE 0 END)) % 10 = 0"
_PII_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS key FROM documents),
o AS (SELECT doc_id, key, coalesce(array_to_string(list_transform(g, lambda x, i: x || coalesce(repeat('.', length(m[i])), '')), ''), '') AS other
      FROM (SELECT doc_id, key, regexp_extract_all(text, '{_PII["email"]}') AS m, regexp_split_to_array(text, '{_PII["email"]}') AS g FROM d)),
f AS (SELECT * FROM ({" UNION ALL ".join(_located_sql(k, p, "d") for k, p in _PII.items())})
      WHERE kind = 'email' OR (kind = 'ip' AND len(list_filter(string_split(value, '.'), lambda x: x::HUGEINT > 255)) = 0)
         OR (kind = 'card' AND length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}) OR (kind = 'phone' AND length({_DIGITS}) BETWEEN 8 AND 15)),
n AS (SELECT doc_id, key, kind || ':' || lower(value) AS entity,
             CASE WHEN s > {sanitisation.NEAR_CHARS} THEN regexp_replace(substr(other, (s - {sanitisation.NEAR_CHARS})::BIGINT, {sanitisation.NEAR_CHARS + 1}), '^\\p{{L}}+', '') ELSE left(other, s::BIGINT) END || ' | ' ||
             CASE WHEN length(other) - e > {sanitisation.NEAR_CHARS} THEN regexp_replace(substr(other, (e + 1)::BIGINT, {sanitisation.NEAR_CHARS + 1}), '\\p{{L}}+$', '') ELSE substr(other, (e + 1)::BIGINT) END AS near FROM f JOIN o USING (doc_id, key)),
c AS (SELECT DISTINCT doc_id, key, entity, unnest(regexp_extract_all(lower(near), '{_TERM}')) AS term FROM n),
ent AS (SELECT entity, count(DISTINCT doc_id) AS n_entity FROM n GROUP BY entity),
joint AS (SELECT entity, term, count(*) AS n_joint FROM c GROUP BY entity, term HAVING count(DISTINCT key) >= {sanitisation.MIN_TEXTS}),
words AS (SELECT term, count(*) AS n_term FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{_TERM}')) AS term FROM d) WHERE term IN (SELECT term FROM joint) GROUP BY term),
told AS (SELECT entity, term, ln(n_joint * t.n / (n_entity * n_term)) / ln(t.n / n_entity) AS share FROM joint JOIN ent USING (entity) JOIN words USING (term), (SELECT count(*)::DOUBLE AS n FROM documents) t WHERE n_entity < t.n),
bad AS (SELECT key, term, max(share) AS share FROM (SELECT DISTINCT key, entity, term FROM c) JOIN told USING (entity, term) WHERE share >= {sanitisation.GENERALISE} GROUP BY key, term),
w AS ({_located_sql("term", _TERM, "(SELECT * FROM d WHERE key IN (SELECT key FROM bad))")}),
t AS (SELECT w.doc_id, CASE WHEN share >= {sanitisation.REMOVE} THEN 'term_removed' ELSE 'term_generalised' END AS kind, w.s, w.e FROM w JOIN bad ON bad.key = w.key AND bad.term = lower(w.value)
      WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = w.doc_id AND f.s < w.e AND w.s < f.e)),
k AS (SELECT * FROM (VALUES ('email', 1), ('ip', 2), ('card', 3), ('phone', 4), ('term_generalised', 5), ('term_removed', 6)) v(kind, o)),
x AS (SELECT doc_id, kind, s, e, true AS base FROM f UNION ALL SELECT doc_id, kind, s, e, false FROM t),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in sanitisation.KINDS)},
             count(*) FILTER (base) AS n_found, count(*) AS n_spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (base) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans FROM x JOIN k USING (kind) GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in sanitisation.KINDS)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_found, 0)::BIGINT AS n_found, coalesce(n_spans, 0)::BIGINT AS n_spans FROM d LEFT JOIN g USING (doc_id)
"""

ORACLE_SQL = {
    "op12_hard_negatives": sql.HARD_NEGATIVES,
    "op13_conversation_repair": sql.CONVERSATION_REPAIR,
    "op3_pii": _PII_SQL,
    "op1_url_filters": f"""
WITH RECURSIVE tags AS (SELECT url, list_filter(t, lambda x: regexp_matches(x, '(?i)^<base\\b'))[1] AS base_tag, unnest(list_filter(t, lambda x: regexp_matches(x, '(?i)canonical|http-equiv'))) AS tag
    FROM (SELECT url, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g'), '{_TAG}') AS t FROM pages)),
told AS (SELECT url, tag, {_attribute_sql("base_tag", "href")} AS base, {_attribute_sql("tag", "rel")} AS rel, {_attribute_sql("tag", "href")} AS href, {_attribute_sql("tag", "http-equiv")} AS equiv, {_attribute_sql("tag", "content")} AS content FROM tags),
wanted AS (SELECT url, coalesce({_resolved_sql("base", "url")}, url) AS page, CASE WHEN regexp_matches(tag, '(?i)^<link') AND list_contains(regexp_split_to_array(lower(rel), '\\s+'), 'canonical') THEN href
           WHEN regexp_matches(tag, '(?i)^<meta') AND lower(equiv) = 'refresh' THEN nullif(regexp_extract(content, '(?i)\\burl\\s*=\\s*["'']?([^\\s"''>]+)', 1), '') END AS target FROM told),
whole AS (SELECT url AS a_url, {_resolved_sql("target", "page")} AS b_url FROM wanted),
edges AS (SELECT a_url, b_url, {_NODE.format("a_url")} AS a, {_NODE.format("b_url")} AS b FROM whole),
named AS (SELECT a AS node, a_url AS u FROM edges WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, b_url FROM edges WHERE a IS NOT NULL AND b IS NOT NULL),
step AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(node, other) AS (SELECT node, node FROM named UNION SELECT r.node, s.b FROM reach r JOIN step s ON s.a = r.other),
judged AS (SELECT node, (CASE {_RULE_CASES} END).action AS action FROM (SELECT node, {_HOST.format("u")} AS host, {_PATH.format("u")} AS path FROM named)),
said AS (SELECT r.node, min(j.action) AS action FROM reach r JOIN judged j ON j.node = r.other GROUP BY r.node),
p AS (SELECT page_id, host, path, CASE {_RULE_CASES} END AS r, {_NODE.format("url")} AS node FROM (SELECT page_id, url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM pages))
SELECT page_id, host, path, r.rule AS rule, coalesce(r.action, said.action, 'allow') AS verdict FROM p LEFT JOIN said ON said.node = p.node
""",
    "op4_sharding": f"""
WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
b AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
c AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, crc_table),
d AS (SELECT *, (('0x' || substr(md5(doc_id || ':' || text_crc32), 1, 8))::BIGINT % {virtual_slots.N_SLOTS})::INT AS virtual_slot FROM c),
s AS (SELECT virtual_slot, sum(size)::BIGINT AS n_bytes, count(*) AS n_rows, row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) AS rn FROM d GROUP BY virtual_slot),
p(rn, loads, shard, virtual_slot) AS (
    SELECT 0::BIGINT, list_transform(range({SHARDS}), lambda x: 0::BIGINT), -1, -1
    UNION ALL
    SELECT s.rn, list_transform(p.loads, lambda v, i: CASE WHEN i = list_position(p.loads, list_min(p.loads)) THEN v + s.n_bytes ELSE v END), list_position(p.loads, list_min(p.loads)) - 1, s.virtual_slot FROM p JOIN s ON s.rn = p.rn + 1
),
u AS (SELECT s.virtual_slot, s.n_bytes, p.shard, sum(s.n_bytes) OVER (PARTITION BY p.shard ORDER BY s.n_bytes DESC, s.virtual_slot) <= (SELECT sum(n_bytes) FROM s) / {SHARDS + 1}.0::DOUBLE AS stays FROM p JOIN s USING (virtual_slot)),
v AS (SELECT virtual_slot, n_bytes, row_number() OVER (ORDER BY n_bytes DESC, virtual_slot) AS rn FROM u WHERE NOT stays),
q(rn, loads, shard, virtual_slot) AS (
    SELECT 0::BIGINT, list(b ORDER BY i), -1, -1 FROM (SELECT i, coalesce(sum(n_bytes) FILTER (stays), 0)::BIGINT AS b FROM range({SHARDS + 1}) t(i) LEFT JOIN u ON u.shard = i GROUP BY i)
    UNION ALL
    SELECT v.rn, list_transform(q.loads, lambda w, i: CASE WHEN i = list_position(q.loads, list_min(q.loads)) THEN w + v.n_bytes ELSE w END), list_position(q.loads, list_min(q.loads)) - 1, v.virtual_slot FROM q JOIN v ON v.rn = q.rn + 1
),
n AS (SELECT virtual_slot, shard::INT AS next_shard FROM u WHERE stays UNION ALL SELECT virtual_slot, shard::INT FROM q WHERE rn > 0),
m AS (SELECT p.virtual_slot, p.shard, coalesce(sum(s.n_rows) OVER (PARTITION BY p.shard ORDER BY p.virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p JOIN s USING (virtual_slot))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard, (start + row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id, text_crc32) - 1)::BIGINT AS slot, NULL::INT AS grown_shard,
       virtual_slot, 1 AS map_version, next_shard, 2 AS next_version FROM d JOIN m USING (virtual_slot) JOIN n USING (virtual_slot)
""",
    "op6_exact_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op9_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                  'GET ' || regexp_replace(coalesce(url, ''), '[\r\n]', '%20', 'g') || ' HTTP/1.1' AS request FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first > page_id THEN first END AS refers_to, request
FROM m
""",
}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {**ORACLE_SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
