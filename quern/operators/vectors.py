"""Cosine search and similarity between sets of vectors, in bounded blocks; rank fusion."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4_096  # vectors of a pair of tiles, half of them from each side: what is multiplied at once
SIDE = 8  # blocks of a side, as long as those have a tile or more and hold no more than
ROWS, BYTES = 131_072, 64_000_000  # so many vectors, as doubles of so many bytes


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in rows])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _blocks(side: DataFrame, vector: str) -> int:
    rows, width = side.agg(F.count("*"), F.max(F.size(vector))).first()
    held = min(ROWS, max(1, BYTES // (8 * max(width or 1, 1))))
    return max(-(-rows // held), min(SIDE, -(-rows // (BLOCK // 2))))


def _pairs(left: DataFrame, right: DataFrame, left_key: str, key: str, left_vector: str, vector: str, product, schema: str) -> DataFrame | None:
    """`product(left block, right block)` of all pairs of blocks, dealt to tasks by an equality of block numbers; None if a side is empty.

    A vector is copied once for each block of the other side, so SIDE times until that many blocks are full.
    """
    n, m = (_blocks(side, vector) for side, vector in ((left, left_vector), (right, vector)))
    if not n or not m:
        return None
    number = lambda k, parts: F.pmod(F.xxhash64(k), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    a = left.select("*", number(left_key, n).alias("_l"), every(m).alias("_r")).groupBy("_l", "_r")
    b = right.select("*", every(n).alias("_l"), number(key, m).alias("_r")).groupBy("_l", "_r")

    def run(x: pd.DataFrame, y: pd.DataFrame):
        return product(x, y)

    return a.cogroup(b).applyInPandas(run, schema)


def top_k(points: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, sim): the k nearest points of each query by cosine; ties by the smaller id. A zero vector is at 0 from all.

    Blocks of queries meet blocks of points as products; each product keeps the k best of its points, and the ranks are taken of those.
    """

    def near(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"query_id": [], key: [], "sim": []})
        p = p.sort_values(key, kind="stable")
        own, x, out = p[key].to_numpy(), unit(p[vector]), []
        for i in range(0, len(q), BLOCK // 2):
            asked_, u = q["query_id"].to_numpy()[i : i + BLOCK // 2], unit(q["_vector"].iloc[i : i + BLOCK // 2])
            ids, sims = np.zeros((len(u), 0), own.dtype), np.zeros((len(u), 0))
            for j in range(0, len(x), BLOCK // 2):
                sim = np.round(u @ x[j : j + BLOCK // 2].T, 6) + 0.0
                sim[np.isnan(sim)] = -np.inf  # stand last
                kth = np.partition(sim, -k, axis=1)[:, -k, None] if sim.shape[1] > k else np.full((len(u), 1), -np.inf)
                equal = sim == kth
                keep = np.cumsum(equal, axis=1, dtype=np.int32) <= k - (sim > kth).sum(axis=1)[:, None]
                at = np.nonzero((sim > kth) | (equal & keep))[1].reshape(len(u), -1)
                ids, sims = np.hstack([ids, own[j + at]]), np.hstack([sims, np.take_along_axis(sim, at, 1)])
                order = np.lexsort((ids, -sims), axis=1)[:, :k]
                ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            out.append(pd.DataFrame({"query_id": np.repeat(asked_, ids.shape[1]), key: ids.ravel(), "sim": np.where(np.isneginf(sims), np.nan, sims).ravel()}))
        return pd.concat(out)

    asked = queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("query_id"), F.col(vector).alias("_vector"))
    found = _pairs(asked, points.where(F.col(vector).isNotNull()).select(key, vector), "query_id", key, "_vector", vector, near, f"query_id bigint, {key} bigint, sim double")
    if found is None:
        return points.sparkSession.createDataFrame([], f"query_id bigint, rank int, {key} bigint, sim double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "sim")


def best(chunks: DataFrame, others: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, best): each chunk's greatest cosine with any of `others`; 0 without others or without a vector. Blocks of both meet as products."""

    def most(c: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(o):
            return pd.DataFrame({key: [], "best": []})
        y, top = unit(o["_vector"]).T, np.full(len(c), -np.inf)
        for i in range(0, len(c), BLOCK // 2):
            x = unit(c[vector].iloc[i : i + BLOCK // 2])
            for j in range(0, y.shape[1], BLOCK // 2):
                top[i : i + len(x)] = np.maximum(top[i : i + len(x)], (x @ y[:, j : j + BLOCK // 2]).max(axis=1))
        return pd.DataFrame({key: c[key], "best": np.round(top, 6) + 0.0})

    other = others.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_other"), F.col(vector).alias("_vector"))
    have = F.col(vector).isNotNull() & F.col(key).isNotNull()
    found = _pairs(chunks.where(have).select(key, vector), other, key, "_other", vector, "_vector", most, f"{key} bigint, best double")
    if found is None:
        return chunks.select(key, F.lit(0.0).alias("best"))
    return found.groupBy(key).agg(F.max("best").alias("best")).unionByName(chunks.where(~have).select(key, F.lit(0.0).alias("best")))


def fuse(lists: list[DataFrame], k: int, k0: int = 60, key: str = "vec_id") -> DataFrame:
    """(query_id, rank, key, score): reciprocal ranks of several ranked lists, added up."""
    each = reduce(DataFrame.unionAll, [x.select("query_id", key, "rank") for x in lists])
    total = each.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (F.lit(k0) + F.col("rank"))), 9).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))
    return total.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
