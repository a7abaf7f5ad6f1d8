"""Files of the evaluation: question sets, contexts, logs, results, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.judging import RESULT_COLUMNS

QUESTION_SCHEMA = "id string, scene_id string, text string, question_type string, question_style string, pair_id string, key_facts array<struct<fact:string,weight:double>>"
RESPONSE_SCHEMA = "question_id string, scene_id string, question_text string, question_type string, question_style string, key_facts array<struct<fact:string,weight:double>>, representation string, repetition int, responder string, raw_answer string, prompt_tokens int, completion_tokens int, latency_ms double, error string"
RESULT_SCHEMA = ", ".join(f"{c} {'int' if c == 'repetition' else 'double' if c in ('answer_correctness', 'answer_correctness_detail', 'latency_ms') else 'string'}" for c in RESULT_COLUMNS)
#: The file's fixed columns, in order.
AGGREGATE_COLUMNS = ["dataset", "representation", "question_type", "n", "error_count", "context_exceeded", "n_scored", "coverage", "answer_correctness_mean", "answer_correctness_std", "answer_correctness_q_range", "answer_correctness_detail_mean", "answer_correctness_detail_std", "n_detail"]
_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_questions(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """JSON lines, blank ones skipped; empty strings of optional columns are null, a fact's weight is 1 by default."""
    q = spark.read.schema(QUESTION_SCHEMA).json(path)
    q = q.withColumns({c: F.nullif(c, F.lit("")) for c in ("question_type", "question_style", "pair_id")})
    q = q.withColumn("key_facts", F.transform("key_facts", lambda f: F.struct(f["fact"].alias("fact"), F.coalesce(f["weight"], F.lit(1.0)).alias("weight"))))
    return q.where(F.col("id").isin(ids)) if ids else q


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, representation, text) from path/SCENE/REPRESENTATION.ext."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("__f", F.input_file_name())
    part = lambda k: F.url_decode(F.regexp_extract("__f", r"([^/]+)/([^/]+?)(?:\.[^./]*)?$", k))
    return rows.select(part(1).alias("scene_id"), part(2).alias("representation"), F.col("value").alias("text"))


def context_problems(wanted: DataFrame, contexts: DataFrame) -> DataFrame:
    """(scene_id, representation, n): wanted contexts of which there is none, or more than one."""
    n = contexts.groupBy("scene_id", "representation").agg(F.count(F.lit(1)).alias("n"))
    return wanted.select("scene_id", "representation").distinct().join(n, ["scene_id", "representation"], "left").fillna(0, ["n"]).where("n <> 1")


def write_contexts(contexts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    contexts.write.mode(mode).partitionBy("representation").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result CSV; the header must hold the 17 columns in order."""
    for row in spark.read.text(path).where(F.col("value").startswith("question_id,")).select("value").distinct().limit(2).collect():
        if row[0].strip().split(",") != RESULT_COLUMNS:
            raise ValueError(f"unexpected header: {row[0]}")
    return spark.read.schema(RESULT_SCHEMA).options(**_CSV, enforceSchema=False).csv(path)


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    results.select(*RESULT_COLUMNS).write.mode(mode).options(**_CSV).csv(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The append log; lines that don't parse are left out."""
    rows = spark.read.schema(f"{RESPONSE_SCHEMA}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt IS NULL AND question_id IS NOT NULL").drop("_corrupt")


def append_responses(responses: DataFrame, path: str) -> None:
    responses.write.mode("append").option("ignoreNullFields", False).json(path)


def write_aggregate(groups: DataFrame, total: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The 14-column aggregate of one run: sorted groups, then the operational total. Both are a few hundred rows."""
    f4 = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).otherwise("")
    span = F.when(F.col("ac_lo").isNotNull(), F.concat(f4("ac_lo"), F.lit(".."), f4("ac_hi"))).otherwise("")
    counts = ["n", "error_count", "context_exceeded", "n_scored"]
    named = [F.col(a).alias(b) for a, b in (("host", "dataset"), ("rep", "representation"), ("qt", "question_type"))]
    rows = groups.select(*named, *counts, f4("coverage").alias("coverage"), f4("ac_mean").alias("answer_correctness_mean"), f4("ac_std").alias("answer_correctness_std"), span.alias("answer_correctness_q_range"), f4("detail_mean").alias("answer_correctness_detail_mean"), f4("detail_std").alias("answer_correctness_detail_std"), F.col("n_detail").cast("string").alias("n_detail"), F.lit(0).alias("__last"))
    last = total.where("qt = 'operational-total'").select(*named, *counts, f4("coverage").alias("coverage"), *[F.lit("").alias(c) for c in AGGREGATE_COLUMNS[8:]], F.lit(1).alias("__last"))
    rows.unionByName(last).orderBy("__last", *AGGREGATE_COLUMNS[:3]).coalesce(1).select(*AGGREGATE_COLUMNS).write.mode(mode).option("header", True).csv(path)


def pool_results(spark: SparkSession, pattern: str) -> DataFrame:
    """All result files of model/…/scene folders, question ids prefixed by their scene, model from the path's first wildcard folder."""
    rows = read_results(spark, pattern).withColumn("__f", F.input_file_name())
    fixed = pattern.split("*")[0].rstrip("/").split("/")[-1]
    model = F.regexp_extract("__f", rf"/{fixed}/([^/]+)/", 1)
    return rows.withColumn("model", F.url_decode(model)).withColumn("question_id", F.concat_ws(":", "scene_id", "question_id")).drop("__f")


def report_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """A section as markdown lines (line_no, line), from a table that is already small and sorted by the caller's columns."""
    from pyspark.sql import Window

    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"), F.row_number().over(Window.orderBy(*columns)).alias("line_no"))
    spark = df.sparkSession
    head = spark.createDataFrame([("| " + " | ".join(columns) + " |", -1), ("|" + " --- |" * len(columns), 0)], "line string, line_no int")
    return head.unionByName(body).select("line_no", "line")
