"""Results of searches by query: fallbacks, cuts, statistics, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_collection(found: DataFrame, query: str, collection: str, order: list) -> DataFrame:
    """Of each query's results those of the first collection, in `order`, that has any; collections not in it come last, by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(collection)), F.lit(0)), F.lit(len(order) + 1))
    rank = F.dense_rank().over(W.partitionBy(query).orderBy(place, collection))
    return found.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def confident_only(found: DataFrame, query: str, score: str, ties: list, sure: float = 0.98) -> DataFrame:
    """Only the best result of a query whose best score is at least `sure`; all results of the others."""
    w = W.partitionBy(query).orderBy(F.desc(score), *ties)
    ranked = found.withColumn("_rank", F.row_number().over(w)).withColumn("_top", F.max(score).over(W.partitionBy(query)))
    return ranked.where((F.col("_rank") == 1) | (F.col("_top") < sure)).drop("_rank", "_top")


def score_statistics(queries: DataFrame, found: DataFrame, query: str, score: str) -> DataFrame:
    """(query, n, mean, variance, most, least) for every query; without results 0, the variance 1."""
    s = F.col(score)
    each = found.groupBy(F.col(query).alias("_q")).agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.var_pop(s).alias("variance"), F.max(s).alias("most"), F.min(s).alias("least"))
    both = queries.select(query).distinct().join(each, F.col(query) == F.col("_q"), "left").drop("_q")
    return both.na.fill({"n": 0, "mean": 0.0, "variance": 1.0, "most": 0.0, "least": 0.0})


def agreement(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, agreement): the mean cosine of all pairs in a group; 1 for a single one.

    The pairs' sum is half of what the squared length of the sum of unit vectors has over the sum of their squared lengths,
    so a group of any size takes one combinable sum for each dimension.
    """
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = vectors.select(group, F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0)).alias("_u"), (norm > 0).cast("bigint").alias("_one"))
    sums = unit.select(group, "_one", F.posexplode("_u").alias("_k", "_x")).groupBy(group, "_k").agg(F.sum("_x").alias("_s"), F.sum("_one").alias("_sq"), F.count("*").alias("n"))
    one = sums.groupBy(group).agg(F.max("n").alias("n"), F.sum(F.col("_s") * F.col("_s")).alias("_all"), F.max("_sq").alias("_sq"))
    return one.select(group, "n", F.when(F.col("n") < 2, 1.0).otherwise((F.col("_all") - F.col("_sq")) / (F.col("n") * (F.col("n") - 1))).alias("agreement"))


def shortened(c: Column, most: int = 200) -> Column:
    """A preview of a long text, marked where cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def sources(found: DataFrame, query: str, source: str) -> DataFrame:
    """(query, sources): the distinct sources of each query's results, sorted; empty ones left out."""
    own = F.when(F.col(source) != "", F.col(source))
    return found.groupBy(query).agg(F.sort_array(F.collect_set(own)).alias("sources"))


def as_text(rank: Column, score: Column, question: Column, answer: Column, source: Column) -> Column:
    """A result as a block of text for a prompt."""
    return F.format_string("--- Result %d [score: %.2f] ---\nQ: %s\nA: %s\nSource: %s\n", rank.cast("int"), score.cast("double"), question, answer, source)


def status(n: Column, top: Column, least: float = 0.7) -> Column:
    """no_result, low_score or found, of a query's number of results and best score."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, "no_result").when(top < least, "low_score").otherwise("found")
