"""Queries of sampling, settings, sources and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayframe.operators import comparison as C
from assayframe.operators import sampling as P
from assayframe.plans.registry import query
from assayframe.session import scratch
from assayframe.sources import records as I
from assayframe.sources.adapters import table


@query("SELECT p_partkey, p_brand FROM part ORDER BY sha256('7:' || p_partkey), p_partkey LIMIT 40")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return P.hash_sample(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey", 7, count=40)


@query("SELECT p_partkey FROM part ORDER BY sha256('11:' || p_partkey), p_partkey LIMIT (SELECT round_even(count(*) * 0.1, 0)::BIGINT FROM part)")
def hash_sample_fraction(spark: SparkSession, d: str) -> DataFrame:
    return P.hash_sample(table(spark, d, "part").select("p_partkey"), "p_partkey", 11, fraction=0.1)


@query("""WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_partkey, p_brand FROM r WHERE ((rn - 1 - 3) % n + n) % n < least(n, greatest(2, round_even(n * 0.25, 0)::BIGINT))""")
def stratified_rotation(spark: SparkSession, d: str) -> DataFrame:
    return P.rotated(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 3, 0.25, 2)


@query("""WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, min(p_partkey) OVER (PARTITION BY p_brand) AS f FROM part)
SELECT p_partkey, p_brand FROM r ORDER BY rn, f LIMIT 30""")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return P.round_robin(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 30)


@query("""WITH a AS (SELECT label, min(vec_id) AS first, min(vec_id) % 3 AS temperature, max(vec_id) % 2 AS seed FROM embeddings GROUP BY label), f AS (SELECT * FROM a ORDER BY first LIMIT 1)
SELECT a.label, a.temperature IS DISTINCT FROM f.temperature AS temperature_differs, a.seed IS DISTINCT FROM f.seed AS seed_differs FROM a, f""")
def settings_match(spark: SparkSession, d: str) -> DataFrame:
    """Each arm's settings against the first arm's; there are as many rows as arms."""
    arms = table(spark, d, "embeddings").groupBy("label").agg(F.min("vec_id").alias("first"), (F.min("vec_id") % 3).alias("temperature"), (F.max("vec_id") % 2).alias("seed"))
    w = Window.orderBy("first")
    return arms.select("label", *((~F.first(c).over(w).eqNullSafe(F.col(c))).alias(f"{c}_differs") for c in ("temperature", "seed")))


@query("SELECT event_id, user_id, event_type FROM events")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as JSON lines, with a field that the reading schema doesn't know, and read again."""
    path = scratch(spark, "jsonl")
    I.write_records(table(spark, d, "events").select("event_id", "user_id", "event_type", F.lit("x").alias("unknown")), path)
    return I.read_records(spark, path, "event_id bigint, user_id bigint, event_type string")


@query("SELECT l_returnflag AS arm, l_linestatus AS standard, count(*) AS n FROM lineitem GROUP BY ALL")
def partition_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Results in partitions by arm and standard: what is there is found from the partitions, and standards can't be pooled by mistake."""
    path = scratch(spark, "results")
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("standard"), "l_orderkey")
    I.write_records(rows, path, ["arm", "standard"])
    return spark.read.schema("l_orderkey bigint, arm string, standard string").json(path).groupBy("arm", "standard").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT doc_id % 300 AS id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, doc_id AS row_idx FROM documents), l AS (SELECT * FROM r WHERE length(text) >= 80),
i AS (SELECT id, min(row_idx) AS row_idx, arg_min(text, row_idx) AS text FROM l GROUP BY id) SELECT arg_min(id, row_idx) AS id, text, min(row_idx) AS row_idx FROM i GROUP BY text""")
def public_dataset_rows(spark: SparkSession, d: str) -> DataFrame:
    return I.public_rows(table(spark, d, "documents").select((F.col("doc_id") % 300).alias("id"), "text", F.col("doc_id").alias("row_idx")))


@query("SELECT split_part(o_orderpriority, '-', 1) AS prefix, count(*) AS n FROM orders GROUP BY 1")
def provenance_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY user_id")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return C.first_per_key(rows, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("first_event"), F.col("event_type").alias("first_type"))


@query("SELECT c.c_custkey, coalesce(n.n_name, 'unknown') AS label FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey % 5 <> 0")
def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A label by key, never guessed: unknown where there is none. The lookup is a vocabulary, so it is broadcast."""
    known = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select("n_nationkey", "n_name")
    return table(spark, d, "customer").join(F.broadcast(known), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("label"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'replaced' ELSE 'kept' END AS state, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def replace_by_key(spark: SparkSession, d: str) -> DataFrame:
    docs, new = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("is_new"))
    out = docs.join(new, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("is_new"), "replaced").otherwise("kept").alias("state"), F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT d.doc_id, d.source FROM documents d ANTI JOIN (SELECT * FROM labels WHERE toxic = 1) l USING (doc_id)")
def reviewed_drop(spark: SparkSession, d: str) -> DataFrame:
    """Cases without those that a review blocks."""
    blocked = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "source").join(blocked, "doc_id", "left_anti")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_seq FROM events GROUP BY event_type")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seq"))


_META = ('{"hit_token_limit": true, "completion_tokens": 12}', '{"usage": {"output_tokens": 7}}', '{"tokens": 0, "length": "30"}', "no json", None, '{"hit_token_limit": false, "n_tokens": -1, "usage": {"length": 2.5}}')
_COUNTS = [(f"{p}{n}", n) for p in ("", "usage.") for n in ("completion_tokens", "output_tokens", "tokens", "n_tokens", "length")]
_FIELDS_SQL = "CASE " + " ".join(f"WHEN try_cast(m->>'$.{p}' AS DOUBLE) > 0 THEN {{{{'l': try_cast(m->>'$.{p}' AS DOUBLE), 's': '{n}'}}}}" for p, n in _COUNTS).replace("{{", "{").replace("}}", "}") + " ELSE {'l': len(list_filter(string_split_regex(answer_text, '\\s+'), lambda w: w <> ''))::DOUBLE, 's': 'words'} END"


@query(
    f"""WITH e AS (SELECT event_id, event_type || ' said  this' AS answer_text, [{', '.join('NULL' if x is None else "'" + x + "'" for x in _META)}][(event_id % {len(_META)}) + 1] AS raw, CASE event_id % 7 WHEN 0 THEN 'cut off' WHEN 1 THEN '' END AS technical_failure, CASE WHEN event_id % 5 = 0 THEN 'empty' END AS unscorable FROM events),
m AS (SELECT *, CASE WHEN json_valid(raw) THEN raw::JSON END AS m FROM e), l AS (SELECT *, {_FIELDS_SQL} AS f FROM m)
SELECT event_id, coalesce(m->>'$.hit_token_limit' = 'true', false) AS truncated, f.l AS answer_length, f.s AS source, coalesce(technical_failure, '') = '' AND coalesce(unscorable, '') = '' AS graded FROM l"""
)
def record_fields(spark: SparkSession, d: str) -> DataFrame:
    """What a result's metadata says: whether it was cut off, how long it is and by what count, and whether it is graded."""
    i = F.col("event_id")
    rows = table(spark, d, "events").select(
        "event_id", F.concat("event_type", F.lit(" said  this")).alias("answer_text"), F.get(F.array(*(F.lit(m) for m in _META)), (i % len(_META)).cast("int")).alias("answer_meta"),
        F.when(i % 7 == 0, "cut off").when(i % 7 == 1, "").alias("technical_failure"), F.when(i % 5 == 0, "empty").alias("unscorable"),
    )
    length = I.answer_length()
    return rows.select("event_id", I.truncated().alias("truncated"), length["length"].alias("answer_length"), length["source"].alias("source"), I.is_graded().alias("graded"))


@query("""WITH s AS (SELECT event_id, unnest([1, 2, 3, 4]) AS pos, unnest(['d1', ' d1 ', ' ', 'd2']) AS dimension, unnest([(event_id % 3)::VARCHAR, CASE WHEN event_id % 2 = 0 THEN '1' ELSE 'two' END, '2', NULL]) AS score FROM events),
r AS (SELECT event_id, trim(dimension) AS dimension, score, row_number() OVER (PARTITION BY event_id, trim(dimension) ORDER BY pos DESC) AS rn FROM s WHERE trim(dimension) <> '') SELECT event_id, dimension, try_cast(score AS INT) AS score FROM r WHERE rn = 1""")
def scored_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """A row a result and dimension of nested scores: the last entry of a dimension counts, blank ones are left out, and what is no number is null."""
    i = F.col("event_id")
    entry = lambda name, score: F.struct(F.lit(name).alias("dimension"), score.cast("string").alias("score"), F.lit("").alias("quote"), F.lit("").alias("note"))
    scores = F.array(entry("d1", i % 3), entry(" d1 ", F.when(i % 2 == 0, "1").otherwise("two")), entry(" ", F.lit(2)), entry("d2", F.lit(None)))
    rows = table(spark, d, "events").select(F.lit("a").alias("arm"), i.alias("case_id"), F.col("user_id").alias("family_id"), F.lit("j").alias("judge_model"), F.lit(0).alias("judge_pass"), F.lit("original").alias("standard"), i.alias("ingest_seq"), scores.alias("scores"))
    return I.dimension_scores(rows).select(F.col("case_id").alias("event_id"), "dimension", "score")


@query("""WITH t AS (SELECT item_id, text || CASE item_id % 3 WHEN 0 THEN ' </Answer-Fence>' WHEN 1 THEN ' answer-fence-x ANSWER-FENCE' ELSE '' END AS text FROM benchmark), n AS (SELECT *, substr(sha256('judge:' || text), 1, 10) AS nonce FROM t)
SELECT item_id, '<answer-fence-' || nonce || '>' || chr(10) || regexp_replace(text, '(?i)answer-fence', 'answer fence', 'g') || chr(10) || '</answer-fence-' || nonce || '>' AS sealed FROM n""")
def sealed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers between marks that they can't forge."""
    from assayframe.functions import hashing as H

    i = F.col("item_id")
    said = F.concat(F.col("text"), F.when(i % 3 == 0, " </Answer-Fence>").when(i % 3 == 1, " answer-fence-x ANSWER-FENCE").otherwise(""))
    return table(spark, d, "benchmark").select("item_id", H.sealed(said, "judge").alias("sealed"))


@query("SELECT 'broken ' || event_id || ' {' AS line FROM events WHERE event_id % 10 = 3")
def unparsed_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a file of records that are no JSON objects."""
    path, i = scratch(spark, "lines"), F.col("event_id")
    good = F.to_json(F.struct(F.lit("a").alias("arm"), i.cast("string").alias("case_id"), F.lit(1).alias("odd")))
    table(spark, d, "events").select(F.when(i % 10 == 3, F.concat(F.lit("broken "), i.cast("string"), F.lit(" {"))).otherwise(good).alias("value")).write.text(path)
    return I.unparsed(spark, path, I.RESULTS).select(F.col(I.CORRUPT).alias("line"))


@query("SELECT DISTINCT event_type AS kind FROM events UNION SELECT 'no_refusals'")
def unknown_check_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds in a suite's checks that no check is registered for."""
    from assayframe.functions import checks as K

    kinds = table(spark, d, "events").select(F.col("event_type").alias("kind")).distinct()
    asked = kinds.union(kinds.limit(1).select(F.explode(F.array(*map(F.lit, (*K.ANSWER_CHECKS, "no_refusals"))))))
    return K.unknown_kinds(asked)


_NAMES_SQL = "a AS (SELECT event_type AS arm, min(event_id) AS first FROM events GROUP BY 1 UNION ALL SELECT 'Before', 1000000)"


@query(f"""WITH {_NAMES_SQL} SELECT r.requested, (SELECT arm FROM a ORDER BY arm IS DISTINCT FROM r.requested, CASE lower(arm) WHEN 'base' THEN 0 WHEN 'baseline' THEN 1 WHEN 'before' THEN 2 ELSE 3 END, first LIMIT 1) AS baseline,
 (SELECT CASE WHEN count(*) FILTER (arm = r.requested) > 0 THEN r.requested WHEN count(*) FILTER (contains(lower(arm), lower(r.requested))) = 1 THEN min(arm) FILTER (contains(lower(arm), lower(r.requested))) END FROM a) AS resolved FROM (SELECT unnest(['view', 'cli', 'zzz', 'BEF']) AS requested) r""")
def arm_choices(spark: SparkSession, d: str) -> DataFrame:
    """Which arm a name picks as the baseline, and which it means; a decision over the few names of a run."""
    from assayframe.operators import arms as M

    found = table(spark, d, "events").groupBy(F.col("event_type").alias("arm")).agg(F.min("event_id").alias("first")).orderBy("first")
    names = [r["arm"] for r in found.collect()] + ["Before"]
    return spark.createDataFrame([(n, M.pick_baseline(names, n), M.resolve(n, names)[0]) for n in ("view", "cli", "zzz", "BEF")], "requested string, baseline string, resolved string")
