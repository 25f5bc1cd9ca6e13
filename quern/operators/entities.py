"""Named things in texts: found by how they are written, or by a dictionary that is walked once a text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How names are written, in Japanese and in other languages.
WRITTEN = {"ja": r"[ァ-ヴー]{3,}|[一-龥]{4,}", "": r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b|[A-Z]{2,}"}
NAMES = 100_000  # names of one automaton


def key_entities(df: DataFrame, key: str, text: str, lang: Column | None = None, n: int = 10) -> DataFrame:
    """(key, rank, entity, hits): the n most frequent names of each text, by how they are written; ties go to the one that stands first.

    `lang` is "ja" or anything else. Names are counted by (key, name) with partial sums, so a long text is no one row's work. Null texts and keys have none.
    """
    ja = F.coalesce(lang == "ja", F.lit(False)) if lang is not None else F.lit(False)
    japanese, other = (F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for p in (WRITTEN["ja"], "(?U)" + WRITTEN[""]))
    each = df.where(F.col(key).isNotNull()).select(key, F.posexplode(F.when(ja, japanese).otherwise(other)).alias("_i", "entity"))
    counts = each.groupBy(key, "entity").agg(F.count("*").alias("hits"), F.min("_i").alias("_i"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("hits"), "_i"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).select(key, "rank", "entity", "hits")


def automaton(names: list[str]) -> ahocorasick.Automaton:
    """All of these names as one automaton."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, name in enumerate(names):
        out.add_word(name, k)
    out.make_automaton()
    return out


def by_dictionary(df: DataFrame, names: DataFrame, key: str, text: str, name: str = "name", most: int = NAMES) -> DataFrame:
    """(key, entity, hits, first): how often each of `names` stands in each text, overlaps included, and where first (characters from 0).

    Names become automata of `most` names, sent to the tasks one at a time; a text is walked once for each, whatever the number of its names, so a dictionary of `most` names or fewer
    takes one pass. Names are taken as they are, null and empty ones not; repeated names count once. Null texts have none.
    """
    spark = df.sparkSession
    known = names.where(F.col(name) != "").select(F.col(name).alias("n")).distinct()
    blocks = max(1, -(-known.count() // most))
    known = known.withColumn("b", F.pmod(F.xxhash64("n"), F.lit(blocks)))
    of = df.schema[key].dataType.simpleString()
    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    parts = []
    for k in range(blocks):
        own = sorted(r.n for r in known.where(F.col("b") == k).select("n").collect())  # about `most`
        if own:
            parts.append(texts.mapInArrow(_walked(spark.sparkContext.broadcast(own)), f"_key {of}, entity string, hits bigint, first int"))
    found = parts[0] if parts else texts.select("_key", F.lit("").alias("entity"), F.lit(0).cast("bigint").alias("hits"), F.lit(0).alias("first")).limit(0)
    for p in parts[1:]:
        found = found.unionAll(p)
    return found.withColumnRenamed("_key", key)


def _walked(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names.value
        walk = automaton(known)
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                hits: dict[int, list[int]] = {}
                for end, k in walk.iter(t):
                    own = hits.setdefault(k, [0, end + 1 - len(known[k])])
                    own[0] += 1
                at += [i] * len(hits)
                rows += [(known[k], *v) for k, v in hits.items()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.string(), pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(at, pa.int64())), *columns], ["_key", "entity", "hits", "first"])

    return run


def most_named(found: DataFrame, key: str, n: int = 10) -> DataFrame:
    """(key, rank, entity, hits): of each text's names (key, entity, hits, first) the n most frequent, ties to the one that stands first, then by name."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("hits"), "first", "entity"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).select(key, "rank", "entity", "hits")
