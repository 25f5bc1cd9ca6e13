"""Profiles, deduplication and collections of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def columns(df: DataFrame) -> DataFrame:
    """(column, rows, empty, distinct) for every column, in one pass; empty: null or, as text, blank."""
    text = {c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in df.columns}
    one = df.agg(F.count("*").alias("_rows"), *[F.count_if(t == "").alias(f"e_{c}") for c, t in text.items()], *[F.count_distinct(F.col(c)).alias(f"d_{c}") for c in text])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"e_{c}").alias("empty"), F.col(f"d_{c}").alias("distinct")) for c in text])
    return one.select(F.inline(rows))


def first_of(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the stated order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def lengths(df: DataFrame, text: str) -> DataFrame:
    """One row: mean, most, least and exact quartiles of text lengths."""
    n = F.length(text)
    q = F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(F.round(F.avg(n), 6).alias("mean"), F.max(n).cast("bigint").alias("most"), F.min(n).cast("bigint").alias("least"), q.alias("q")).select("mean", "most", "least", *[F.round(F.get("q", F.lit(k)), 6).alias(f"q{k + 1}") for k in range(3)])


def upserted(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`table` with the rows of `new` in place of those with their keys."""
    return table.join(new.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti").unionByName(new, allowMissingColumns=True)


def merged(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """All rows of several collections with where they come from, their old ids, and new ids from both."""
    each = [df.withColumn("source_collection", F.lit(n)).withColumn("original_id", F.col(key).cast("string")) for n, df in parts.items()]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.withColumn(key, F.xxhash64("source_collection", "original_id").bitwiseAND(F.lit(2**63 - 1)))


def newest(df: DataFrame, at: str, ties: list, n: int = 100, ttl: str | None = None) -> DataFrame:
    """The n newest rows, of those no older than `ttl` before the newest of all."""
    top = df.orderBy(F.desc(at), *ties).limit(n)
    if not ttl:
        return top
    last = F.max(at).over(W.partitionBy(F.lit(1)))  # over n rows, the newest of all among them
    return top.withColumn("_last", last).where(F.col(at) >= F.col("_last") - F.expr(f"INTERVAL {ttl}")).drop("_last")
