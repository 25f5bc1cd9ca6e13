"""Tables kept up to date by key: a batch rewrites the buckets that its keys are in, and no others."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 64
STATES = ("staged", "done")


def bucket(key: str, buckets: int) -> Column:
    """The bucket of a key."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _note(spark: SparkSession, path: str, number: int, state: str, buckets: int) -> None:
    row = spark.range(1).select(F.lit(number).cast("bigint").alias("number"), F.lit(state).alias("state"), F.lit(buckets).alias("buckets"), F.current_timestamp().alias("at"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(number, state, buckets, at): what became of each batch; None before the first."""
    return _read(spark, f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows, without their buckets."""
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/rows").drop("bucket")


def last_of(rows: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """One row for each key, the first by `order`; ties, and all where there is no order, go by a hash of the row, so any partitioning gives the same."""
    whole = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in rows.columns])
    rank = F.row_number().over(W.partitionBy(key).orderBy(*(order or []), whole))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(batch: DataFrame, path: str, key: str, number: int, buckets: int = BUCKETS, order: list[Column] | None = None) -> bool:
    """Puts the rows of batch `number` in place of those with their keys; False if that batch is in the table already.

    Only the buckets that the batch has keys in are read and replaced (dynamic partition overwrite); their new content is written
    beside the table first and noted in the manifest, so a run that broke off is taken up where it was: before the note nothing has changed, after it
    the staged rows are put in again. A batch that is noted as done changes nothing. Of several rows with a key the first by `order` counts (see `last_of`);
    null keys are one key; columns that only one side has are null in the other's rows. The number of buckets is that of the first batch. One writer at a time.
    """
    spark = batch.sparkSession
    notes = manifest(spark, path)
    known = {} if notes is None else {r.state: r.buckets for r in notes.where(F.col("number") == number).select("state", "buckets").distinct().collect()}
    if "done" in known:
        return False
    if notes is not None:
        buckets = notes.select("buckets").first()[0]
    if "staged" not in known:
        new = last_of(batch, key, order).withColumn("bucket", bucket(key, buckets))
        old = _read(spark, f"{path}/rows")
        if old is not None:
            touched = [r[0] for r in batch.select(bucket(key, buckets).alias("b")).distinct().collect()]  # `buckets` at most
            keep = old.where(F.col("bucket").isin(touched))
            names = new.select(F.col(key).alias("_key"))
            new = keep.join(names, keep[key].eqNullSafe(F.col("_key")), "left_anti").unionByName(new, allowMissingColumns=True)
        new.repartition("bucket").write.mode("overwrite").parquet(f"{path}/staged")
        _note(spark, path, number, "staged", buckets)
    staged = spark.read.parquet(f"{path}/staged")
    staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    _note(spark, path, number, "done", buckets)
    return True


def upsert_stream(stream: DataFrame, path: str, key: str, checkpoint: str, buckets: int = BUCKETS, order: list[Column] | None = None) -> StreamingQuery:
    """A stream's rows put into the table, a batch at a time, all that is there now; a batch that is repeated after a failure changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        upsert(batch, path, key, number, buckets, order)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
