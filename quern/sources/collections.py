"""Collections of points: Parquet tables parted by domain, and what is known of them from names and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"^[a-zA-Z0-9_-]+$"
# Embedding models by the size of their vectors; name parts of known domains.
MODELS = {1536: "text-embedding-3-small", 3072: "gemini-embedding-001"}
DOMAINS = ("cc_news", "livedoor")


def domain(file: Column) -> Column:
    """The domain that a file's name tells, else custom."""
    return F.coalesce(*[F.when(F.lower(file).contains(d), d) for d in DOMAINS], F.lit("custom"))


def valid_name(name: Column) -> Column:
    """Whether a collection may have this name; false for null."""
    return F.coalesce(name.rlike(NAME), F.lit(False))


def embedding_model(vector: Column) -> Column:
    """The model whose vectors have this size."""
    return F.coalesce(*[F.when(F.size(vector) == n, m) for n, m in MODELS.items()], F.lit("unknown-embedding-model"))


def points(pairs: DataFrame, order: str, vector: str, of: str, source: str) -> DataFrame:
    """(id, vector, payload, domain) of questions and answers; the id is a 63-bit hash of domain, file and `order`, so that a second
    run gives the same ids. Rows without a vector, as when fewer came back than were asked for, raise an error."""
    checked = F.when(F.col(vector).isNull(), F.raise_error(F.lit("a row has no vector"))).otherwise(F.col(vector))
    file = source.rsplit("/", 1)[-1]
    payload = F.struct(F.lit(of).alias("domain"), "question", "answer", F.lit(file).alias("source"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"), F.lit("qa:v1").alias("schema"))
    number = F.xxhash64(F.lit(of), F.lit(file), F.col(order)).bitwiseAND(F.lit((1 << 63) - 1))
    return pairs.select(number.alias("id"), checked.alias("vector"), payload.alias("payload"), F.lit(of).alias("domain"))


def matching(rows: DataFrame, **equal: str | None) -> DataFrame:
    """The points whose payload has all these values, as `matching(points, domain="cc_news")`; a filter of None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col("domain" if name == "domain" else f"payload.{name}") == value)
    return rows


def create(rows: DataFrame, path: str, again: bool = False) -> None:
    """A collection parted by domain; an existing one only if `again`."""
    rows.write.mode("overwrite" if again else "error").partitionBy("domain").parquet(path)


def delete_domain(spark: SparkSession, path: str, of: str, dry_run: bool = False) -> int:
    """How many points a domain has; unless `dry_run` they are deleted. Only that domain's folder is read and removed."""
    own = spark.read.parquet(path)
    n = own.where(F.col("domain") == of).count()
    if n and not dry_run:
        jvm = spark._jvm.org.apache.hadoop.fs
        folder = jvm.Path(f"{path}/domain={of}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return n


def to_drop(collections: DataFrame, excluded: DataFrame, name: str = "name") -> DataFrame:
    """`collections` but for the excluded names."""
    return collections.join(excluded.select(name).distinct(), name, "left_anti")


def files_of(collections: DataFrame, rows: DataFrame, files: DataFrame) -> DataFrame:
    """(collection, file): the source that a collection's points name first by name, else a file called as it is, with or without qa_.

    collections: collection; rows: collection, source; files: file (base names).
    """
    told = rows.where("source IS NOT NULL AND source <> ''").groupBy(F.col("collection").alias("_c")).agg(F.min("source").alias("_source"))
    bare = lambda c: F.regexp_replace(c, r"^qa_|\.csv$", "")
    named = files.groupBy(bare(F.regexp_replace("file", r"\.csv$", "")).alias("_n")).agg(F.min("file").alias("_file"))
    both = collections.join(told, F.col("collection") == F.col("_c"), "left").join(named, bare(F.col("collection")) == F.col("_n"), "left")
    return both.select("collection", F.coalesce("_source", "_file").alias("file"))


def save_pairs(pairs: DataFrame, folder: str, name: str) -> None:
    """Questions and answers as CSV and as lines of JSON, with one row about them as JSON."""
    pairs.write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True, escape='"')
    pairs.write.mode("overwrite").json(f"{folder}/{name}.json")
    pairs.agg(F.count("*").alias("total_pairs")).withColumns({"dataset": F.lit(name), "created_at": F.current_timestamp()}).write.mode("overwrite").json(f"{folder}/{name}.metadata")


def merged_maps(first: Column, *more: Column) -> Column:
    """JSON objects of strings as one map; a later one's value of a key wins, and what is no object counts as empty."""
    parse = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    out = parse(first)
    for c in map(parse, more):
        out = F.map_concat(_without(out, c), c)
    return out


def _without(a: Column, b: Column) -> Column:
    return F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k))
