"""Splits and bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: UTF-8 bytes of a sample's texts together, and of one of them; longer texts are not learned from.
BYTES, LONGEST = 64_000_000, 1_000_000


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text is `part` modulo `parts`; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, parts: int, part: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled rows outside the held-out part, and of at most BYTES: those whose ids hash lowest.

    A document with several labels gets the largest; null labels and texts are left out. Of texts that share a doc_id one is taken, that whose hash is least.
    Only `rows` ids are broadcast; the sum of bytes runs over `rows` rows at most.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", parts, part))
    some = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "k")
    texts = documents.where(F.octet_length("text") <= LONGEST).select("doc_id", "text")
    met = texts.join(F.broadcast(some), F.col("doc_id") == F.col("k"))
    one = met.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "x.text", "label")
    so_far = F.sum(F.octet_length("text")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0))
    return one.withColumn("_bytes", so_far).where(F.col("_bytes") <= BYTES).drop("_bytes")
