"""Readers and writers of evaluation records: line-delimited JSON with a fixed schema, partitioned results, and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RESULTS = (
    "case_id string, family_id string, task string, variant string, arm string, model_id string, answer_text string, "
    "scores array<struct<dimension:string,score:string,quote:string,note:string>>, missed_must_notice array<string>, overapplied array<string>, "
    "unacceptable_reasoning_hit array<string>, unscorable string, technical_failure string, judge_model string, judge_pass int, rubric_version string, "
    "standard string, answer_meta string, ingest_seq bigint"
)
VERDICTS = (
    "family_id string, task string, variant string, arm string, original_case_id string, variant_case_id string, measures string, should_change boolean, "
    "did_change boolean, correct boolean, evidence string, judge_model string, order_presented string, judge_pass int, ingest_seq bigint"
)
CORRUPT = "_corrupt"


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a fixed schema: unknown fields are dropped, absent ones null, blank lines skipped, and a missing path gives no rows."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()  # noqa: SLF001
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(conf).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def unparsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that the schema can't read, blank ones left out."""
    read = F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    return spark.read.text(path).where(F.trim("value") != "").select(read.alias("r")).where(F.col("r")[CORRUPT].isNotNull()).select(F.col("r")[CORRUPT].alias(CORRUPT))


def write_records(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> int:
    """One JSON object a line; results go into partitions by arm and standard, which keeps standards apart. Gives the rows written, counted on their way."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    (writer.partitionBy(*by) if by else writer).json(path)
    return seen.get["rows"]


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def arms_present(results: DataFrame) -> DataFrame:
    return results.select("arm").distinct()


def dimension_scores(results: DataFrame) -> DataFrame:
    """A row a result and dimension: blank dimensions are left out, scores that aren't whole numbers are null, and the last entry of a dimension counts."""
    keys = ["arm", "case_id", "family_id", "judge_model", "judge_pass", "standard", "ingest_seq"]
    rows = results.select(*keys, F.posexplode("scores").alias("pos", "s")).where(F.trim(F.coalesce("s.dimension", F.lit(""))) != "")
    last = rows.groupBy(*keys, F.trim("s.dimension").alias("dimension")).agg(F.max_by("s", "pos").alias("s"))
    return last.select(*keys, "dimension", F.col("s.score").try_cast("int").alias("score"), F.col("s.note").alias("note"))


def is_graded():
    """Neither a technical failure nor unscorable; an empty string says neither."""
    return (F.coalesce("technical_failure", F.lit("")) == "") & (F.coalesce("unscorable", F.lit("")) == "")


def standard_of():
    return F.lower(F.trim(F.coalesce(F.nullif(F.col("standard"), F.lit("")), F.lit("original"))))


def truncated():
    return F.coalesce(F.get_json_object("answer_meta", "$.hit_token_limit") == "true", F.lit(False))


def answer_length():
    """struct(length, source): the first positive token count in the answer's metadata, else its words."""
    names = ("completion_tokens", "output_tokens", "tokens", "n_tokens", "length")
    found = [(f"$.{p}{n}", n) for p in ("", "usage.") for n in names]
    out = F.lit(None).cast("struct<length:double,source:string>")
    for path, n in reversed(found):
        v = F.get_json_object("answer_meta", path).try_cast("double")
        out = F.when(v > 0, F.struct(v.alias("length"), F.lit(n).alias("source"))).otherwise(out)
    words = F.size(F.filter(F.split(F.coalesce("answer_text", F.lit("")), r"\s+"), lambda w: w != "")).cast("double")
    return F.coalesce(out, F.struct(words.alias("length"), F.lit("words").alias("source")))


def public_rows(pages: DataFrame, min_chars: int = 80) -> DataFrame:
    """Situations of a public dataset's pages (rows of row_idx, id, text): single spaces, long enough, the first of each id and then of each text."""
    rows = pages.select(F.col("id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), "row_idx").where(F.length("text") >= min_chars)
    by_id = rows.groupBy("id").agg(F.min(F.struct("row_idx", "text")).alias("r")).select("id", "r.*")
    return by_id.groupBy("text").agg(F.min(F.struct("row_idx", "id")).alias("r")).select("r.id", "text", "r.row_idx")


ANSWER_KEYS = ("prompt_id", "text")


def read_answers(spark: SparkSession, path: str, model: str) -> DataFrame:
    """prompt_id, model, text of answers written elsewhere, a JSON object a line; model where the line names none.

    ValueError if there are no answers or a line lacks one of ANSWER_KEYS; the message names its keys.
    """
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", "map<string,string>").alias("r"))
    has = F.coalesce(F.forall(F.array(*map(F.lit, ANSWER_KEYS)), lambda k: F.map_contains_key("r", k)), F.lit(False))
    lost = rows.where(~has).select(F.array_join(F.sort_array(F.coalesce(F.map_keys("r"), F.array().cast("array<string>"))), ", ").alias("keys")).first()
    if lost is not None:
        raise ValueError(f"answers need {' and '.join(ANSWER_KEYS)}, a line has: {lost['keys'] or 'none'}")
    if rows.isEmpty():
        raise ValueError("no answers")
    return rows.select(F.col("r")["prompt_id"].alias("prompt_id"), F.coalesce(F.col("r")["model"], F.lit(model)).alias("model"), F.col("r")["text"].alias("text"))


def as_json(df: DataFrame, column: str = "record") -> DataFrame:
    """Every row as one JSON object, however nested; nulls stay as such."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias(column))


def merge_record(record: dict, stage: str, payload: dict) -> dict:
    """A run's record with one stage set; other stages stay."""
    return {**record, "stages": {**record.get("stages", {}), stage: payload}}


def save_done(rows: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> None:
    """Stores rows as a bucketed table, so that later joins on the key at as many partitions leave them where they are."""
    writer = rows.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def pending(items: DataFrame, done: str, key: str, buckets: int) -> DataFrame:
    """The items that a resumed stage has yet to do. Only they are shuffled, to the buckets of what is done, which isn't moved."""
    keys = items.sparkSession.table(done).select(key)
    return items.repartition(buckets, key).join(keys.hint("merge"), key, "left_anti")


def resumed(done: DataFrame, new: DataFrame) -> DataFrame:
    """What a resumed stage writes: the rows done before, all kept, and the new ones."""
    return done.unionByName(new, allowMissingColumns=True)


PAGE = "rows array<struct<row_idx:bigint,row:struct<id:string,text:string>>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """row_idx, id, text of a public dataset kept as files of pages, a JSON object each. A page that can't be read as one gives no rows, and the others all theirs."""
    pages = spark.read.text(path, wholetext=True)
    rows = pages.select(F.explode(F.from_json("value", PAGE)["rows"]).alias("r"))
    return rows.select("r.row_idx", "r.row.id", "r.row.text").where("row_idx is not null and text is not null")
