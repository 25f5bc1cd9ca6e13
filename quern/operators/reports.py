"""Reports on runs, collections, test cases and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an answer says when nothing was found.
NOT_FOUND = ["見つかりませんでした", "情報がありません", "該当する結果がありません", "関連性スコアが低い", "回答が見つかりませんでした", "情報源の中には", "情報が見つかりませんでした"]

# What texts of a domain are asked for, letters in either case.
DOMAIN_TERMS = {
    "wiki": ["==", "[[", "]]"],
    "academic": ["research", "study", "method", "result", "conclusion", "研究", "方法", "結果", "考察"],
    "medical": ["patient", "treatment", "disease", "clinical", "患者", "治療", "疾患", "臨床"],
    "code": ["def ", "class ", "import ", "function", "return"],
    "support": ["python", "javascript", "java", "error", "function", "code"],
}


def statuses(results: DataFrame, plan: str, order: str) -> DataFrame:
    """(plan, status, answer): success, partial or failed by the steps' statuses; the output of the last reasoning step that succeeded, else null.

    `results` has step rows (plan, order, status, action, output, cancelled); a cancelled plan is "cancelled".
    """
    good = F.col("status") == "success"
    told = good & F.col("action").isin("reasoning", "run_legacy_agent")
    status = F.when(F.bool_or("cancelled"), "cancelled").when(F.bool_and(good), "success").when(F.bool_or(good), "partial").otherwise("failed")
    return results.groupBy(plan).agg(status.alias("status"), F.max_by("output", F.when(told, F.col(order))).alias("answer"))


def collected(results: DataFrame) -> DataFrame:
    """One row (success, failed, error, pairs): how tasks (success boolean, error string, pairs int) ended; a task with an error counts as an error only."""
    error = F.col("error").isNotNull()
    good = F.coalesce("success", F.lit(False))
    return results.agg(F.count_if(~error & good).alias("success"), F.count_if(~error & ~good).alias("failed"), F.count_if(error).alias("error"), F.coalesce(F.sum(F.when(~error & good, F.col("pairs"))), F.lit(0)).alias("pairs"))


def run_summary(documents: DataFrame) -> DataFrame:
    """One row of a run's documents (pairs, coverage, seconds): how many, pairs in all and a document, documents a second, coverage at its mean, least and most."""
    n, pairs, seconds = F.count("*"), F.coalesce(F.sum("pairs"), F.lit(0)), F.sum("seconds")
    return documents.agg(
        n.alias("documents"), pairs.alias("pairs"), F.round(F.when(n > 0, pairs / n).otherwise(0.0), 6).alias("pairs_each"), F.round(F.when(seconds > 0, n / seconds), 6).alias("per_second"),
        F.round(F.avg("coverage"), 6).alias("mean"), F.min("coverage").alias("least"), F.max("coverage").alias("most"),
    )


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """(column, n): a column's n most frequent values; ties by value. Nulls don't count."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def tags(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """(column, n): the n most frequent tags of a comma-joined column."""
    return top_values(df.select(F.explode(F.split(column, ",")).alias(column)), column, n)


def collections(points: DataFrame, name: str, vector: str) -> DataFrame:
    """(name, points, dims): each collection's rows and its vectors' greatest size."""
    return points.groupBy(name).agg(F.count("*").alias("points"), F.max(F.size(vector)).alias("dims"))


def text_checks(df: DataFrame, by: list[str], text: str, short: int = 100) -> DataFrame:
    """(by, rows, mean, short, a count for each kind of DOMAIN_TERMS): lengths and domain terms of texts. Null texts count as rows only."""
    lower = F.lower(text)
    has = {k: F.count_if(F.exists(F.array(*[F.lit(t) for t in v]), lambda t: F.contains(lower, t))) for k, v in DOMAIN_TERMS.items()}
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.round(F.avg(F.length(text)), 6).alias("mean"), F.count_if(F.length(text) < short).alias("short"), *[c.alias(k) for k, c in has.items()])


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """One row (repeats): how many rows have a value that another row has already, as titles; nulls are one value."""
    return df.groupBy(column).agg((F.count("*") - 1).alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("repeats"))


def _as_expected(expected: Column, actual: Column) -> Column:
    return expected.isNull() | F.coalesce(expected == actual, F.lit(False))


def compared(cases: DataFrame, results: DataFrame, case: str) -> DataFrame:
    """(case, passed, failures): whether a case's route, collection, tool and behaviour are as expected; nothing expected always passes.

    `cases` has (expected_tool_use, expected_collection, expected_tool, expected_behavior), `results` (tool_used, collection, tool, answer).
    A case without a result fails what it expects.
    """
    both = cases.join(results.withColumnRenamed(case, "_case"), F.col(case) == F.col("_case"), "left")
    said = F.exists(F.array(*[F.lit(w) for w in NOT_FOUND]), lambda w: F.contains(F.coalesce("answer", F.lit("")), w))
    ok = {
        "route": _as_expected(F.col("expected_tool_use"), F.col("tool_used")),
        "collection": _as_expected(F.col("expected_collection"), F.col("collection")),
        "tool": _as_expected(F.col("expected_tool"), F.col("tool")),
        "behavior": F.coalesce(F.col("expected_behavior") != "not_found_response", F.lit(True)) | said,
    }
    failures = F.array_compact(F.array(*[F.when(~c, k) for k, c in ok.items()]))
    return both.select(case, (F.size(failures) == 0).alias("passed"), F.concat_ws("; ", failures).alias("failures"))


def source_shares(sample: DataFrame, source: str, total: int) -> DataFrame:
    """(source, sampled, percent, estimated): each source's rows in a sample, their share, and how many of `total` rows that makes, cut to a whole number; a null source is unknown."""
    counts = sample.groupBy(F.coalesce(F.col(source), F.lit("unknown")).alias("source")).agg(F.count("*").alias("sampled"))
    n = max(counts.agg(F.sum("sampled")).first()[0] or 0, 1)
    return counts.select("source", "sampled", F.round(100 * F.col("sampled") / n, 6).alias("percent"), F.floor(total * F.col("sampled") / n).cast("bigint").alias("estimated"))
