"""Result files of a run: questions and answers, coverage, summaries, and a log that is read and cleared."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "timestamp string, query string, collections string, reason string, agent_response string"
CUT = 200  # characters of an uncovered text in a file


def envelope(pairs: DataFrame, dataset: str) -> DataFrame:
    """One row: dataset_type, created_at, total_pairs. The pairs themselves are files beside it, so no row holds them all."""
    return pairs.agg(F.count("*").alias("total_pairs")).select(F.lit(dataset).alias("dataset_type"), F.current_timestamp().alias("created_at"), "total_pairs")


def save_pairs(pairs: DataFrame, folder: str, dataset: str) -> dict[str, str]:
    """Pairs as CSV and as lines of JSON, and their envelope as JSON; paths by kind. What is there already is replaced."""
    paths = {"csv": f"{folder}/qa_pairs_{dataset}.csv", "json": f"{folder}/qa_pairs_{dataset}.json", "envelope": f"{folder}/envelope_{dataset}.json"}
    pairs.write.mode("overwrite").csv(paths["csv"], header=True, escape='"')
    pairs.write.mode("overwrite").json(paths["json"])
    envelope(pairs, dataset).coalesce(1).write.mode("overwrite").json(paths["envelope"])
    return paths


def save_run(pairs: DataFrame, best: DataFrame, chunks: DataFrame, folder: str, dataset: str, threshold: float = 0.7, key: str = "chunk_id", text: str = "text") -> dict[str, str]:
    """`save_pairs`, and of best (key, best) and chunks (key, text): coverage (rate, covered, total), uncovered chunks with their gap and the first CUT characters, and a summary.

    A chunk without a similarity has 0.
    """
    paths = save_pairs(pairs, folder, dataset)
    both = chunks.select(key, F.col(text).alias("_t")).join(best.select(F.col(key).alias("_k"), "best"), F.col(key) == F.col("_k"), "left").select(key, "_t", F.coalesce("best", F.lit(0.0)).alias("similarity"))
    ok = F.col("similarity") >= threshold
    one = both.agg(F.count_if(ok).alias("covered"), F.count("*").alias("total_chunks")).withColumn("coverage_rate", F.coalesce(F.try_divide("covered", "total_chunks"), F.lit(0.0)))
    left = both.where(~ok).select(F.col(key).alias("chunk_id"), "similarity", F.round(threshold - F.col("similarity"), 6).alias("gap"), F.concat(F.substring(F.coalesce("_t", F.lit("")), 1, CUT), F.lit("...")).alias("text_preview"))
    paths |= {k: f"{folder}/{k}_{dataset}.json" for k in ("coverage", "uncovered", "summary")}
    one.coalesce(1).write.mode("overwrite").json(paths["coverage"])
    left.write.mode("overwrite").json(paths["uncovered"])
    files = F.struct(*[F.lit(v).alias(k) for k, v in paths.items()])
    head = envelope(pairs, dataset).withColumnRenamed("total_pairs", "total_qa_pairs")
    head.withColumn("coverage_rate", F.lit(one.first()["coverage_rate"])).withColumn("files", files).coalesce(1).write.mode("overwrite").json(paths["summary"])
    return paths


def unanswered(rows: DataFrame, path: str) -> None:
    """Questions that had no answer (query, collections: an array, reason, agent_response) added to a log, with the time."""
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    rows.select(at, "query", F.array_join("collections", ", ").alias("collections"), "reason", F.coalesce("agent_response", F.lit("")).alias("agent_response")).write.mode("append").json(path)


def unanswered_log(spark: SparkSession, path: str) -> DataFrame:
    """The log, newest first; no rows where there is none yet."""
    try:
        return spark.read.schema(LOG).json(path).orderBy(F.desc("timestamp"), "query")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], LOG)
        raise


def clear_log(spark: SparkSession, path: str) -> None:
    """The log without rows."""
    spark.createDataFrame([], LOG).write.mode("overwrite").json(path)


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file, or several, of a list of objects or one object, a row for each object; any other content is an error."""
    texts = spark.read.text(path, wholetext=True)
    kind = F.substring(F.ltrim(F.regexp_replace("value", r"^\s+", "")), 1, 1)
    bad = texts.where(~kind.isin("[", "{") | F.try_parse_json("value").isNull()).limit(1).count()
    if bad:
        raise ValueError("JSON must be a list of objects or an object")
    return spark.read.json(path, multiLine=True)
