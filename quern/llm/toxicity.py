"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.labels import held_out, sample

ROWS = 12_000  # bound of the labelled sample
SHARD_ROWS, EPOCHS = 4_000, 8  # about so many rows are learned from in one task; more tasks' weights are averaged
BITS = 22
ALPHA, BETA, L1, L2 = 3.0, 1.0, 8.0, 1.0
TOXIC_WEIGHT = 2.0  # of a toxic row's gradient: they are the fewer
#: ASCII that is no letter or digit parts words; A-Z are lower-cased; other bytes stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def features(text: str | None) -> np.ndarray:
    """Hashed words, pairs of neighbours, and pairs with a word between; repeats included."""
    digest = xxhash.xxh32_intdigest
    h = np.array([digest(w) for w in (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()], np.uint64)
    pair = lambda d, m: (h[:-d] * np.uint64(m) + h[d:]) * np.uint64(0x9E3779B97F4A7C15)
    parts = [h * np.uint64(0xD6E8FEB86659FD93), pair(1, 0xA0761D6478BD642F), pair(2, 0xE7037ED1A0B428DB)]
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def train(rows: list[tuple[np.ndarray, int]]) -> dict[int, float]:
    """Weights after EPOCHS passes of FTRL-proximal; the key -1 is the intercept. Each coordinate has its own rate."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(EPOCHS):
        for idx, y in rows:
            w = np.where(np.abs(z[idx]) <= L1, 0.0, -(z[idx] - np.sign(z[idx]) * L1) / ((BETA + np.sqrt(n[idx])) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (TOXIC_WEIGHT if y else 1.0)
            z[idx] += g - (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / ALPHA * w
            n[idx] += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return {int(i) if i < 1 << BITS else -1: float(w[i]) for i in np.flatnonzero(w)}


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "text"])
    bias = np.array([1 << BITS])
    got = train([(np.concatenate([np.unique(features(t)), bias]), int(y)) for t, y in zip(pdf["text"], pdf["label"], strict=True)])
    return pd.DataFrame({"feature": np.array(list(got), np.int64), "w": np.array(list(got.values()), float)})


def fit(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights): the mean over shards of what each learned from its part of a bounded sample; sparse by L1 alone, at most one for each of 2 ** BITS."""
    rows = sample(documents, labels, "toxic", ROWS, 5, 0)
    shards = max(1, -(-min(ROWS, labels.where("toxic IS NOT NULL").count()) // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    each = rows.groupBy("shard").applyInPandas(_shard, "feature bigint, w double")
    got = each.groupBy("feature").agg((F.sum("w") / shards).alias("w")).orderBy("feature").toPandas()
    return got["feature"].to_numpy(np.int64), got["w"].to_numpy(float)


def _score(idx: np.ndarray, weights: np.ndarray):
    def run(batches):
        dense = np.zeros(1 << BITS, np.float32)
        dense[idx[idx >= 0]] = weights[idx >= 0]
        bias = float(weights[idx < 0].sum())
        for b in batches:
            out = np.empty(len(b))
            for i, t in enumerate(b["text"]):
                f = features(t)
                f = np.unique(f[dense[f] != 0])
                out[i] = bias + float(dense[f].astype(float).sum())
            p = np.round(1 / (1 + np.exp(-np.clip(out, -35, 35))), 9)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    return run


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `documents`: doc_id, held_out, score (probability of toxic), predicted.

    Null and empty texts have no features and get the intercept's score; without labels every score is 0.5. Whole texts
    are read; repeated rows each get a row; other columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text")
    return rows.mapInPandas(_score(*fit(documents, labels)), f"doc_id {kind}, held_out boolean, score double, predicted int")
