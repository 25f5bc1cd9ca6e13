"""Seeded samples of exactly n rows, and totals estimated from a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 32


def lot(seed: int, *keys: Column) -> Column:
    """The number that a row draws: md5 of the seed and its keys, a null key being a dash."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("-")) for k in keys]).cast("binary"))


def sampled(df: DataFrame, n: int, keys: list[str], seed: int = 42, by: str | None = None) -> DataFrame:
    """n rows of `df`, or of each value of `by`: those that draw lowest (see `lot`), all where there are fewer.

    The same rows for any partitioning: rows that draw alike go by a hash of their columns. Every task keeps n rows at most, of each stratum in each of SALTS parts, and
    the best of those are taken, so a stratum of any size is no one task's work.
    """
    order = [lot(seed, *[F.col(k) for k in keys]), F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns])]
    if by is None:
        return df.orderBy(*order).limit(n)
    drawn = df.withColumns({"_lot": order[0], "_row": order[1]})
    for part in ([by, F.pmod("_row", F.lit(SALTS))], [by]):
        drawn = drawn.withColumn("_rank", F.row_number().over(W.partitionBy(*part).orderBy("_lot", "_row"))).where(F.col("_rank") <= n)
    return drawn.drop("_lot", "_row", "_rank")


def estimated_total(df: DataFrame, keys: list[str], size: Column, value: Column, share: float, seed: int = 42) -> DataFrame:
    """One row: rows, sampled, total (of `value`, estimated), error (its standard error), low and high (95 %), size (of all).

    `size` is known of all rows, `value` is asked of the sample only: the rows, about `share` of all, whose lot is under that share of its range. total is the ratio of
    both in the sample times the size of all; error is by the residuals from that ratio. All in one pass, of sums that combine before any shuffle.
    Null sizes and values count 0. An empty sample, or one of size 0, gives null.
    """
    picked = F.conv(F.substring(lot(seed, *[F.col(k) for k in keys]), 1, 8), 16, 10).cast("bigint") < int(share * (1 << 32))
    x = F.coalesce(size.cast("double"), F.lit(0.0))
    y = F.when(picked, F.coalesce(value.cast("double"), F.lit(0.0)))  # not asked of the others
    mine = F.when(picked, x)
    s = df.select(picked.alias("p"), x.alias("x"), mine.alias("mx"), y.alias("y")).agg(
        F.count("*").alias("rows"), F.count_if("p").alias("sampled"), F.sum("x").alias("size"), F.sum("mx").alias("sx"), F.sum("y").alias("sy"),
        F.sum(F.col("mx") * F.col("mx")).alias("sxx"), F.sum(F.col("mx") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy"),
    )
    n, all_rows = F.col("sampled"), F.col("rows")
    r = F.try_divide(F.col("sy"), F.col("sx"))
    left = F.greatest(F.col("syy") - 2 * F.col("r") * F.col("sxy") + F.col("r") * F.col("r") * F.col("sxx"), F.lit(0.0))
    error = F.when(n > 1, F.sqrt(left / (n - 1) * (1 - n / all_rows) / n) * all_rows)
    out = s.withColumn("r", r).withColumn("total", F.col("r") * F.col("size")).withColumn("error", error)
    cut = lambda c: F.round(c, 3)
    return out.select(
        "rows", "sampled", cut(F.coalesce("size", F.lit(0.0))).alias("size"), cut(F.col("total")).alias("total"), cut(F.col("error")).alias("error"),
        cut(F.col("total") - 1.96 * F.col("error")).alias("low"), cut(F.col("total") + 1.96 * F.col("error")).alias("high"),
    )
