"""Rows named by doc_id and text, for stages that drop some."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import written

BROADCAST_ROWS = 500_000  # names of dropped rows that are broadcast (16 bytes each); more are joined by a shuffle


def versions(documents: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tells rows apart that share a doc_id or have none."""
    return documents.select("doc_id", "text", F.xxhash64("text").alias("version"))


def without(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """`documents` without the rows named in `gone` (doc_id, version). Equal rows go together; a null doc_id is a name like any other."""
    names = written(gone.select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version")).distinct(), "gone")
    if names.count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_version"))
    left = packed.join(names, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_version") == F.col("gone_version")), "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
