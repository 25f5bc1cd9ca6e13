"""Exact cosine search over an inverted file of cells, pruned by the triangle inequality between angles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import vectors
from quern.sources.tables import written

CELLS, PER_CELL = 1_024, 16  # cells at most, and vectors of the fit's sample for each
FIT_BYTES = 64_000_000  # of vectors in that sample
ROUNDS = 4  # of the fit
BLOCK = 4_096  # vectors of a cell that one task holds at once
TOGETHER = 256  # queries multiplied with a block at once
OUT = 4_096  # rows of a batch of queries on their way to cells
COPIES = 2 * vectors.SIDE  # of the vectors of both sides: where queries would be copied more often, blocks meet blocks
PLACES, SLACK = 6, 1e-6  # similarities are rounded; a bound that comes so near to the k-th one doesn't prune


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    x = np.asarray(x, float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch's vectors, all of one size."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(set(lengths.tolist())) > 1:
        raise ValueError("vectors of several sizes")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


@dataclass
class Shape:
    """Centroids, and by cell the number of vectors and blocks, and the least and greatest angle between vectors and centroid.

    All is bounded by CELLS and FIT_BYTES and sent to every task. Zero vectors are a cell of their own, the last.
    """

    centroids: np.ndarray
    size: np.ndarray
    blocks: np.ndarray
    low: np.ndarray
    high: np.ndarray


@dataclass
class Index:
    """The shape of the cells and the table of vectors: cell, block, key, vector."""

    shape: Shape
    vectors: DataFrame


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of about `cells` groups of the sample's unit vectors: rounds of assignment by cosine and means. Rows that begin it are spread evenly over the sample."""
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    at = np.unique(np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)) if len(sample) else []
    own = sample[at]
    for _ in range(ROUNDS if len(own) else 0):
        near = np.argmax(sample @ own.T, axis=1)
        sums = np.zeros_like(own)
        np.add.at(sums, near, sample)
        own = unit(np.where((np.linalg.norm(sums, axis=1) > 0)[:, None], sums, own))
    return own


def built(points: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> Index:
    """The index of `points`; null keys and vectors are left out. Centroids are fitted on the PER_CELL * `cells` vectors whose keys hash lowest, all vectors are indexed.

    Without `cells` there are about as many as the root of the number of points, CELLS at most. A cell's vectors are dealt to blocks
    of about BLOCK by a hash of the key, so a cell of any size is the work of many tasks.
    """
    have = points.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    n, width = have.agg(F.count("*"), F.max(F.size("vector"))).first()
    cells = cells or min(CELLS, math.isqrt(n) + 1)
    rows = min(PER_CELL * cells, FIT_BYTES // (8 * max(width or 1, 1)))
    sample = have.orderBy(F.xxhash64("key"), "key").limit(rows).select("vector").toPandas()["vector"]
    centroids = fitted(unit(np.stack(sample)) if len(sample) else np.zeros((0, 1)), cells)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = unit(_matrix(b.column("vector")))
            cos = x @ centroids.T if len(centroids) else np.zeros((len(x), 1))
            cell = np.where(np.linalg.norm(x, axis=1) > 0, np.argmax(cos, axis=1), len(centroids))
            angle = np.where(cell < len(centroids), np.arccos(np.clip(cos.max(axis=1), -1, 1)), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(angle), b.column("key"), b.column("vector")], ["cell", "angle", "key", "vector"])

    placed = written(have.mapInArrow(dealt, "cell int, angle double, key bigint, vector array<double>"), "cells")
    size, low, high = np.zeros(len(centroids) + 1, np.int64), np.zeros(len(centroids) + 1), np.zeros(len(centroids) + 1)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # a row for each cell
        size[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
    blocks = -(-size // BLOCK)
    counts = F.get(F.array(*[F.lit(int(x)) for x in blocks]), F.col("cell"))
    return Index(Shape(centroids, size, blocks, low, high), placed.withColumn("block", F.pmod(F.xxhash64("key"), counts).cast("int")).select("cell", "block", "key", "vector"))


def bounds(shape: Shape, x: np.ndarray) -> np.ndarray:
    """Queries times cells: what the cosine of a unit query with any vector of the cell is at most. A zero vector has 0 with all."""
    if not len(shape.centroids):
        return np.zeros((len(x), 1))
    to = np.arccos(np.clip(x @ shape.centroids.T, -1, 1))
    apart = np.maximum(np.maximum(to - shape.high[:-1], shape.low[:-1] - to), 0)
    most = np.concatenate([np.cos(np.minimum(apart, np.pi)), np.zeros((len(x), 1))], axis=1)
    return np.where((np.linalg.norm(x, axis=1) > 0)[:, None], most, 0.0)


def first_cells(shape: Shape, most: np.ndarray, k: int) -> np.ndarray:
    """Queries times cells, as booleans: those with the greatest bounds that have k vectors together."""
    order = np.argsort(-np.where(shape.size > 0, most, -2), axis=1, kind="stable")
    before = np.cumsum(shape.size[order], axis=1) - shape.size[order]
    out = np.zeros(most.shape, bool)
    np.put_along_axis(out, order, before < k, axis=1)
    return out & (shape.size > 0)


def _places(shape: Shape, b: pa.RecordBatch, k: int, second: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, cell) that the queries of a batch go to, TOGETHER queries at once."""
    for i in range(0, len(b), TOGETHER):
        part = b.slice(i, TOGETHER)
        most = bounds(shape, unit(_matrix(part.column("vector"))))
        to = first_cells(shape, most, k)
        if second:
            kth = np.array([-2.0 if x is None else x for x in part.column("kth").to_pylist()])
            to = ~to & (shape.size > 0) & (most + SLACK >= kth[:, None])
        at, cell = np.nonzero(to)
        yield at + i, cell


def _visited(shape: Shape, k: int):
    """(n): how many blocks the queries of a batch would go to the second time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = sum(int(shape.blocks[cell].sum()) for _, cell in _places(shape, b, k, True)) if len(b) else 0
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return run


def _routed(shape: Shape, k: int, second: bool):
    """(cell, block, query_id, vector) of queries (query_id, vector, kth): to the first cells, or to all others that can have one of the k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            for at, cell in _places(shape, b, k, second):
                n = shape.blocks[cell]
                at, block = np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                cell = np.repeat(cell, n)
                for i in range(0, len(at), OUT):
                    own = pa.array(at[i : i + OUT])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[i : i + OUT], pa.int32()), pa.array(block[i : i + OUT], pa.int32()), b.column("query_id").take(own), b.column("vector").take(own)], ["cell", "block", "query_id", "vector"])

    return run


def _scanned(k: int):
    """The k best of a block for each query that comes by; rows are sorted by block, its vectors before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, held, x, ids = None, [], [], None, None
        for b in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            names = list(zip(b.column("cell").to_pylist(), b.column("block").to_pylist(), (q is None for q in b.column("query_id").to_pylist()), strict=True))
            for (cell, block, is_vector), own in groupby(range(len(b)), key=names.__getitem__):
                own = list(own)
                part = b.slice(own[0], len(own))
                if (cell, block) != now:
                    now, keys, held, x = (cell, block), [], [], None
                if is_vector:
                    keys.append(part.column("key").to_numpy(zero_copy_only=False).astype(np.int64))
                    held.append(_matrix(part.column("vector")))
                    continue
                if not held:
                    continue
                if x is None:
                    ids, x = np.concatenate(keys), unit(np.concatenate(held)).T
                query = part.column("query_id").to_numpy(zero_copy_only=False).astype(np.int64)
                asked = unit(_matrix(part.column("vector")))
                for q0 in range(0, len(query), TOGETHER):
                    sim = np.round(asked[q0 : q0 + TOGETHER] @ x, PLACES) + 0.0
                    for q, row in zip(query[q0 : q0 + TOGETHER], sim, strict=True):
                        some = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                        best = some[np.lexsort((ids[some], -row[some]))[:k]]
                        out.append((np.full(len(best), q), ids[best], row[best]))
            query, key, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(key, pa.int64()), pa.array(s)], ["query_id", "key", "sim"])

    return run


def _met(index: Index, queries: DataFrame, k: int, second: bool) -> DataFrame:
    """(query_id, key, sim): the k best of each block that a query goes to. Each vector is moved once, whatever the queries; a query once for each block."""
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "cell int, block int, query_id bigint, vector array<double>"
    asked = queries.mapInArrow(_routed(index.shape, k, second), kind).withColumn("key", F.lit(None).cast("bigint"))
    both = index.vectors.withColumn("query_id", F.lit(None).cast("bigint")).unionByName(asked)
    dealt = both.repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", F.col("query_id").asc_nulls_first())
    return dealt.mapInArrow(_scanned(k), "query_id bigint, key bigint, sim double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _asked(queries: DataFrame, key: str, vector: str) -> DataFrame:
    have = queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    return have.select(F.col(key).cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))


def search(index: Index, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, sim): the k nearest vectors of the index for each query, exactly; ties by the smaller key. A zero vector is at 0 from all.

    A query first goes to the cells that may have the nearest vectors and have k of them; the k-th best there is a bound. Then it goes to
    the cells that its angle to the centroid and the cell's range of angles don't rule out; if those are so many that the queries would be copied
    more than COPIES times over all vectors, blocks of queries meet blocks of vectors instead (`vectors.top_k`). Null keys and vectors are left out;
    other columns are ignored; queries have different keys. With an empty index there are no rows.
    """
    asked = _asked(queries, key, vector)
    near = written(_met(index, asked.withColumn("kth", F.lit(None).cast("double")), k, False), "near")
    kth = _best(near, k).groupBy(F.col("query_id").alias("q")).agg(F.min("sim").alias("kth"), F.count("*").alias("n"))
    known = written(asked.join(kth, F.col("query_id") == F.col("q"), "left").select("query_id", "vector", F.when(F.col("n") >= k, F.col("kth")).alias("kth")), "asked")
    visits_, n = known.mapInArrow(_visited(index.shape, k), "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], known.count()
    if visits_ > COPIES * (n + int(index.shape.size.sum())):
        points = index.vectors.select(F.col("key").alias(key), F.col("vector").alias(vector))
        return vectors.top_k(points, known.select(F.col("query_id").alias(key), F.col("vector").alias(vector)), k, key, vector)
    return _best(near.unionAll(_met(index, known, k, True)), k).select("query_id", "rank", F.col("key").alias(key), "sim")


def visits(index: Index, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, cells, vectors): the cells that a search looks into for each query, of all that have vectors, and how many vectors those have."""
    asked = _asked(queries, key, vector)
    kth = search(index, queries, k, key, vector).groupBy(F.col("query_id").alias("q")).agg(F.min("sim").alias("kth"))
    known = asked.join(kth, F.col("query_id") == F.col("q")).select("query_id", "vector", "kth")
    went = asked.withColumn("kth", F.lit(None).cast("double")).mapInArrow(_routed(index.shape, k, False), "cell int, block int, query_id bigint, vector array<double>")
    went = went.unionAll(known.mapInArrow(_routed(index.shape, k, True), "cell int, block int, query_id bigint, vector array<double>")).select("query_id", "cell").distinct()
    size = F.get(F.array(*[F.lit(int(x)) for x in index.shape.size]), F.col("cell"))
    return went.groupBy("query_id").agg(F.count("*").alias("cells"), F.sum(size).alias("vectors"))


def best(chunks: DataFrame, others: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, best): each chunk's greatest cosine with any of `others`; 0 without others or without a vector."""
    found = search(built(others, key, vector), chunks, 1, key, vector).select(F.col("query_id").alias("q"), "sim")
    return chunks.select(key).join(found, F.col(key) == F.col("q"), "left").select(key, F.coalesce("sim", F.lit(0.0)).alias("best"))
