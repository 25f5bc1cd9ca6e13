"""Collections of points with several named vectors: their names, sizes and distances are kept with the table and checked."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import cells, retrieval
from quern.sources import buckets

DISTANCES = ("cosine", "sparse")
KIND = "name string, size int, distance string, place string"


@dataclass(frozen=True)
class Vector:
    """A named vector: its size (0 if sparse: a map of indices to weights) and its distance."""

    size: int
    distance: str = "cosine"


def create(spark: SparkSession, path: str, vectors: dict[str, Vector], again: bool = False) -> None:
    """The catalogue of a new collection; one that is there already is an error unless `again`, which starts it anew, empty; its old points' files stay, out of reach."""
    for name, v in vectors.items():
        if v.distance not in DISTANCES or (v.size > 0) == (v.distance == "sparse"):
            raise ValueError(f"{name}: no such vector: {v}")
    place = f"points-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(n, v.size, v.distance, place) for n, v in sorted(vectors.items())], KIND)
    rows.coalesce(1).write.mode("overwrite" if again else "error").parquet(f"{path}/vectors")


def _catalogue(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.parquet(f"{path}/vectors").collect()  # a few rows
    except AnalysisException as e:
        raise ValueError(f"no collection at {path}") from e


def catalogue(spark: SparkSession, path: str) -> dict[str, Vector]:
    """The collection's vectors by name."""
    return {r.name: Vector(r["size"], r.distance) for r in _catalogue(spark, path)}


def _place(spark: SparkSession, path: str) -> str:
    """The folder of the collection's points, another one each time it is started anew."""
    return f"{path}/{_catalogue(spark, path)[0].place}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The collection's points."""
    return buckets.read(spark, _place(spark, path))


def _checked(column: Column, name: str, v: Vector) -> Column:
    if v.distance == "sparse":
        return column.cast("map<int,float>")
    wrong = F.concat(F.lit(f"{name} has vectors of {v.size} numbers, not of "), F.size(column).cast("string"))
    return F.when(column.isNull() | (F.size(column) == v.size), column.cast("array<double>")).otherwise(F.raise_error(wrong))


def put(points: DataFrame, path: str, number: int, key: str = "id") -> bool:
    """Points (key, a column for each named vector, any others) put into the collection as batch `number` (see `buckets.upsert`); False if it has that batch.

    A vector of another size than the catalogue says ends the write, as does a column that is missing; null vectors are points without them.
    """
    known = catalogue(points.sparkSession, path)
    missing = [n for n in known if n not in points.columns]
    if missing:
        raise ValueError(f"no vectors called {', '.join(sorted(missing))}")
    return buckets.upsert(points.withColumns({n: _checked(F.col(n), n, v) for n, v in known.items()}), _place(points.sparkSession, path), key, number)


def merged(spark: SparkSession, sources: list[str], path: str, key: str = "id") -> None:
    """A new collection of all points of `sources`, later ones' in place of earlier ones' with their keys. Vectors of one name must be alike; those that a source lacks are null."""
    every: dict[str, Vector] = {}
    for source in sources:
        for name, v in catalogue(spark, source).items():
            if every.setdefault(name, v) != v:
                raise ValueError(f"{name} is {every[name]} in one collection and {v} in another")
    create(spark, path, every)
    kind = lambda v: "map<int,float>" if v.distance == "sparse" else "array<double>"
    for number, source in enumerate(sources):
        rows = read(spark, source)
        put(rows.withColumns({n: F.lit(None).cast(kind(v)) for n, v in every.items() if n not in rows.columns}), path, number, key)


def search(spark: SparkSession, path: str, queries: DataFrame, name: str, k: int, key: str = "id") -> DataFrame:
    """(query_id, rank, key, sim) by the vector called `name`: queries are (key, name). An unknown name, or a query of another size, is an error."""
    known = catalogue(spark, path)
    if name not in known:
        raise ValueError(f"the collection has no vectors called {name}")
    asked = queries.select(key, _checked(F.col(name), name, known[name]).alias(name))
    rows = read(spark, path).select(key, name)
    if known[name].distance == "sparse":
        return retrieval.sparse_top_k(rows, asked, k, key, name)
    return cells.search(cells.built(rows, key, name), asked, k, key, name)
