"""How much of a set of chunks a set of question-and-answer vectors covers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.vectors import unit

# Least similarity by level, in the profiles that results are compared under.
PROFILES = {
    "rule": {"strict": 0.5, "standard": 0.4, "lenient": 0.3},
    "default": {"strict": 0.8, "standard": 0.7, "lenient": 0.6},
    "cc_news": {"strict": 0.8, "standard": 0.7, "lenient": 0.6},
    "japanese_text": {"strict": 0.75, "standard": 0.65, "lenient": 0.55},
    "wikipedia_ja": {"strict": 0.85, "standard": 0.75, "lenient": 0.65},
    "livedoor": {"strict": 0.78, "standard": 0.68, "lenient": 0.58},
}


def levels(best: DataFrame, profile: str = "default") -> DataFrame:
    """(level, threshold, covered, total, rate) in one pass over (.., best)."""
    cuts = PROFILES[profile]
    one = best.agg(F.count("*").alias("total"), *[F.count_if(F.col("best") >= t).alias(n) for n, t in cuts.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(t).alias("threshold"), F.col(n).alias("covered")) for n, t in cuts.items()])
    return one.select("total", F.inline(rows)).select("level", "threshold", "covered", "total", F.round(F.col("covered") / F.greatest("total", F.lit(1)), 6).alias("rate"))


def uncovered(best: DataFrame, threshold: float) -> DataFrame:
    """Chunks under the threshold, and by how much."""
    return best.where(F.col("best") < threshold).withColumn("gap", F.round(threshold - F.col("best"), 6))


def by_class(best: DataFrame, group, threshold: float) -> DataFrame:
    """(class, chunks, covered, rate) by a class column."""
    return best.groupBy(group.alias("class")).agg(F.count("*").alias("chunks"), F.count_if(F.col("best") >= threshold).alias("covered"), F.round(F.avg((F.col("best") >= threshold).cast("double")), 6).alias("rate"))


def by_position(best: DataFrame, key: str, threshold: float, ranges: int = 1_000) -> DataFrame:
    """(class, chunks, covered, mean, rate) of the first 33 %, the next 34 % and the last 33 % of all chunks by `key`, a number without repeats.

    Where the cuts fall is found by counts in equal ranges of keys; only the ranges that hold a cut are ranked, so no window has all rows.
    """
    ends = best.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")).first()
    if not ends.n:
        return by_class(best, F.lit(""), threshold).select("class", "chunks", "covered", F.col("rate").alias("mean"), "rate")
    width = max(1, -(-(ends.hi - ends.lo + 1) // ranges))
    placed = best.withColumn("_r", F.floor((F.col(key) - ends.lo) / width))
    counts = placed.groupBy("_r").count().orderBy("_r").collect()  # `ranges` rows at most
    cuts = []
    for share in (0.33, 0.67):
        before = 0  # keys at a smaller place than share * n are before the cut
        for r in counts:
            if before + r["count"] >= share * ends.n:
                own = placed.where(F.col("_r") == r["_r"]).withColumn("_i", F.row_number().over(Window.orderBy(key)) - 1 + before)
                last = own.where(F.col("_i") < share * ends.n).agg(F.max(key)).first()[0]
                cuts.append(ends.lo + int(r["_r"]) * width - 1 if last is None else last)
                break
            before += r["count"]
    b = F.col("best")
    name = F.when(F.col(key) <= cuts[0], "beginning").when(F.col(key) <= cuts[1], "middle").otherwise("end")
    return best.groupBy(name.alias("class")).agg(
        F.count("*").alias("chunks"), F.count_if(b >= threshold).alias("covered"), F.round(F.avg(b), 6).alias("mean"), F.round(F.avg((b >= threshold).cast("double")), 6).alias("rate")
    )


def insights(classes: DataFrame, least: float = 0.7) -> DataFrame:
    """The classes whose rate is under `least`: where questions are missing."""
    return classes.where(F.col("rate") < least)


def grades(best: DataFrame) -> DataFrame:
    """(grade, chunks) by similarity."""
    b = F.col("best")
    return best.groupBy(F.when(b >= 0.9, "excellent").when(b >= 0.8, "good").when(b >= 0.7, "fair").when(b >= 0.6, "poor").otherwise("uncovered").alias("grade")).agg(F.count("*").alias("chunks"))


def quality(best: DataFrame, strict: float) -> DataFrame:
    """One row: the mean, the strict rate and evenness, weighted 0.4, 0.3 and 0.3."""
    b = F.col("best")
    score = F.avg(b) * 0.4 + F.avg((b >= strict).cast("double")) * 0.3 + F.greatest(F.lit(0.0), 1 - F.stddev_pop(b)) * 0.3
    return best.agg(F.round(F.avg(b), 6).alias("mean"), F.round(F.median(b), 6).alias("median"), F.min(b).alias("least"), F.max(b).alias("most"), F.round(score, 6).alias("quality"))


def by_document(chunks: DataFrame, pairs: DataFrame, doc: str, key: str, vector: str, threshold: float, block: int = 2_048) -> DataFrame:
    """(doc, chunks, covered, rate, mean): each document's chunks against its own pairs only; documents without pairs have similarity 0.

    A document's chunks and pairs are cut into blocks of about `block`; blocks meet two by two, so a document of any size is dealt to several tasks.
    """
    have = lambda df: df.where(F.col(doc).isNotNull() & F.col(vector).isNotNull())
    parts = lambda df, name: have(df).groupBy(F.col(doc).alias(f"_{name}")).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = parts(chunks, "_m").join(parts(pairs, "_n"), F.col("__m") == F.col("__n")).select(F.col("__m").alias("_doc"), "_m", "_n")
    number = lambda of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    a, b = ([have(df).join(sizes, F.col(doc) == F.col("_doc")).select(F.col("_doc").alias("_of"), F.col(key).alias("_key"), F.col(vector).alias("_v"), number(own).alias(own), every(other).alias(other)).groupBy("_of", "_m", "_n")
             for df, own, other in ((chunks, "_m", "_n"), (pairs, "_n", "_m"))])

    def most(c: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(p):
            return pd.DataFrame({"_key": [], "_best": []})
        return pd.DataFrame({"_key": c["_key"], "_best": np.round((unit(c["_v"]) @ unit(p["_v"]).T).max(axis=1), 6)})

    best = a.cogroup(b).applyInPandas(most, "_key bigint, _best double").groupBy("_key").agg(F.max("_best").alias("_best"))
    s = F.coalesce("_best", F.lit(0.0))
    one = chunks.select(doc, key).join(best, F.col(key) == F.col("_key"), "left").groupBy(doc)
    return one.agg(F.count("*").alias("chunks"), F.count_if(s >= threshold).alias("covered"), F.round(F.avg((s >= threshold).cast("double")), 6).alias("rate"), F.round(F.avg(s), 9).alias("mean"))


def report(best: DataFrame, key: str, profile: str = "default", standard: float = 0.7) -> DataFrame:
    """One row of all: chunks, covered and rate at the standard, counts at the profile's levels, mean, uncovered, and the positions whose rate is under 0.7."""
    b = F.col("best")
    levels_ = F.create_map(*[x for k, v in PROFILES[profile].items() for x in (F.lit(k), F.count_if(b >= v))])
    weak = ",".join(sorted(r["class"] for r in insights(by_position(best, key, standard)).collect()))  # three rows at most
    return best.agg(F.count("*").alias("chunks"), F.count_if(b >= standard).alias("covered"), F.round(F.avg((b >= standard).cast("double")), 6).alias("rate"), F.round(F.avg(b), 6).alias("mean"), F.count_if(b < standard).alias("uncovered"), levels_.alias("levels"), F.lit(weak).alias("weak"))


def bands(best: DataFrame, threshold: float = 0.65) -> DataFrame:
    """One row: chunks, covered and rate at the threshold, mean, least and most similarity, and how many are high (0.7 or more), medium (0.5 or more) and low."""
    b = F.col("best")
    rate = F.coalesce(F.round(F.avg((b >= threshold).cast("double")), 6), F.lit(0.0))
    return best.agg(
        F.count("*").alias("chunks"), F.count_if(b >= threshold).alias("covered"), rate.alias("rate"), F.round(F.avg(b), 6).alias("mean"), F.min(b).alias("least"), F.max(b).alias("most"),
        F.count_if(b >= 0.7).alias("high"), F.count_if((b >= 0.5) & (b < 0.7)).alias("medium"), F.count_if(b < 0.5).alias("low"),
    )
