"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.words import let
from quern.sources.tables import shared_folder, written

LEAST = 10  # code points of a key below which lines are left alone
BATCHES = 4  # ranges of doc_id that op11 takes one after the other
FAN = 2  # runs of a level that are merged into one of the next
# White space at a line's ends, and the letters that are folded.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split(text: Column) -> Column:
    """A text's lines; null and empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def hashed(documents: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, version, pos, h, g, *more): every line with a key of LEAST code points or more; h and g are 128 bits of hash of the key.

    version is a hash of the text: it tells rows apart that share a doc_id.
    """
    named = documents.select("doc_id", "text", F.xxhash64("text").alias("version"), *more)  # beforehand, or every line's row would carry the text along
    lines = named.select(*[c for c in named.columns if c != "text"], F.posexplode_outer(F.transform(split(F.col("text")), key)).alias("pos", "line"))
    return lines.where(F.length("line") >= LEAST).select(
        "doc_id", "version", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(LEAST), "line").alias("g"), *[c for c in lines.columns if c not in ("doc_id", "version", "pos", "line")]
    )


@contextmanager
def _ordered(spark: SparkSession):
    """Bucketed files count as sorted: each bucket of a run is one file."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Runs:
    """Sorted runs of line hashes by level, each a table (h, g, owner) bucketed and sorted by (h, g) in the shared folder.

    No hash is in two runs. Before a batch, a level with FAN runs is merged into a run of the next one, so a batch meets at most
    FAN - 1 runs a level and a hash is rewritten once a level. All joins and merges read the buckets in order: the runs are neither
    shuffled nor sorted again.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.levels = spark, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame) -> str:
        name = f"quern_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("path", f"{shared_folder(self.spark)}/{name}").saveAsTable(name)
        return name

    def add(self, lines: DataFrame) -> DataFrame:
        """The new run of a batch's lines: (h, g, owner) of the hashes that no run has, the owner being the smallest doc_id in the batch (null if all are).

        The batch's hashes are combined before the shuffle, so that a common line is a row a task; then they are merge-anti-joined with each run.
        The anti-join is said as an outer join without a match, or it would be moved below the aggregation, to all lines.
        """
        with _ordered(self.spark):
            self._compact()
            fresh = lines.groupBy("h", "g").agg(F.min("doc_id").alias("owner"))
            for k, name in enumerate(r for level in self.levels for r in level):
                run = self.spark.table(name).select("h", "g", F.lit(True).alias(f"old{k}"))
                fresh = fresh.join(run.hint("merge"), ["h", "g"], "left").where(F.col(f"old{k}").isNull()).select("h", "g", "owner")
            name = self._write(fresh)
            self._put(name, 0)
        return self.spark.read.schema(fresh.schema).parquet(f"{shared_folder(self.spark)}/{name}")

    def _put(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)

    def _compact(self) -> None:
        """Merges the runs of each full level, in order, into one run of the next."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= FAN:
                first, *rest = self.levels[level]
                merged = self.spark.table(first).select("h", "g", "owner")
                for name in rest:
                    other = self.spark.table(name).select("h", "g", F.col("owner").alias("other"))
                    merged = merged.join(other.hint("merge"), ["h", "g"], "full").select("h", "g", F.coalesce("owner", "other").alias("owner"))
                name = self._write(merged)
                self._forget(level)
                self._put(name, level + 1)
            level += 1

    def _forget(self, level: int) -> None:
        for name in self.levels[level]:
            self.spark.sql(f"DROP TABLE {name}")
        self.levels[level] = []

    def close(self) -> None:
        """Takes the tables out of the catalogue; their files stay in the shared folder."""
        for level in range(len(self.levels)):
            self._forget(level)


def dropped(lines: DataFrame, owners: DataFrame) -> DataFrame:
    """(doc_id, version, pos) of the batch's lines that another document owns: those without a match in the batch's own run.

    The document is part of the join's key, so a common line is spread over all tasks.
    """
    mine = (F.col("h") == F.col("oh")) & (F.col("g") == F.col("og")) & F.col("doc_id").eqNullSafe(F.col("owner"))
    return lines.join(owners.select(F.col("h").alias("oh"), F.col("g").alias("og"), "owner"), mine, "left_anti").select("doc_id", "version", "pos")


def _batch(documents: DataFrame, batches: int) -> Column:
    """Which of `batches` ranges of doc_id a row is in, ranges of about as many rows each; null ids are in the last."""
    row = documents.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1_000)).head()
    cuts = sorted(set(row[0] or []))
    at = F.lit(0)
    for c in cuts:
        at = at + (F.col("doc_id") > F.lit(c)).cast("int")
    return F.coalesce(at, F.lit(len(cuts)))


def deduplicate(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per row of `documents`: doc_id, n_lines, n_dropped, kept_sha256 and kept (the text left).

    A line goes if its key (see `key`) has LEAST code points or more and a document with a smaller doc_id has it; repeats within a
    document stay. Batches are taken by rising doc_id, so the batch whose run has a key first has its smallest doc_id.
    Rows that share a doc_id are one document; rows with a null doc_id are one that comes last. Null and empty texts are one empty line.
    Equal rows get equal results; other columns are ignored.
    """
    spark = documents.sparkSession
    folder = f"{shared_folder(spark)}/quern-lines-{uuid.uuid4().hex}"
    lines = hashed(documents, _batch(documents, batches).alias("batch"))
    lines.write.partitionBy("batch").parquet(folder)
    lines = spark.read.schema(lines.schema).parquet(folder)
    runs, gone = Runs(spark), None
    for k in range(batches):
        own = lines.where(F.col("batch") == k)
        out = written(dropped(own, runs.add(own)), "dropped")
        gone = out if gone is None else gone.union(out)
    runs.close()
    each = gone.groupBy(F.col("doc_id").alias("own_id"), F.col("version").alias("own_version")).agg(F.collect_set("pos").alias("gone"))
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("version"))
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("version") == F.col("own_version"))

    def left(x: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.coalesce("gone", F.array().cast("array<int>")))
        return F.struct(F.size(x).cast("bigint").alias("n_lines"), F.array_join(F.transform(stay, lambda i: F.get(x, i)), "\n").alias("kept"))

    done = docs.join(each, same, "left").select("doc_id", "gone", let(split(F.col("text")), left).alias("x"))
    return done.select(
        "doc_id", "x.n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(F.col("x.kept").cast("binary"), 256).alias("kept_sha256"), "x.kept",
    )
