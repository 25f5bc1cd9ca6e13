"""Quality by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quern.llm.labels import held_out, sample

ROWS = 3_000  # bound of the labelled sample, all of it broadcast as vectors
HASHED, FACTORS, NEIGHBOURS, SHARPNESS = 2_048, 48, 15, 8
SUB = 512  # documents in a block of products
PLACES = 6  # of a cosine
#: Bytes by kind: letters of either case, digits and bytes outside ASCII are four kinds; each other byte is its own.
KIND = np.array([65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else 97 if c > 127 else c for c in range(256)], np.uint32)


def counts(text: str | None) -> np.ndarray:
    """Log counts of hashed byte trigrams and of hashed runs of five kinds."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(2 * HASHED, np.float32)
    for k, (n, b) in enumerate(((3, raw.astype(np.uint32)), (5, KIND[raw]))):
        if len(b) >= n:
            h = b[: len(b) - n + 1].copy()
            for j in range(1, n):
                h = h * np.uint32(0x01000193) ^ b[j : len(b) - n + 1 + j]
            h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 11)
            out[k * HASHED : (k + 1) * HASHED] = np.log1p(np.bincount(h, minlength=HASHED))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _rows(batches):
    for b in batches:
        for k in range(0, len(b), SUB):
            part = b.iloc[k : k + SUB]
            yield pd.DataFrame({"doc_id": part["doc_id"], "label": part["label"], "x": [counts(t).astype("<f2").tobytes() for t in part["text"]]})


def fit(documents: DataFrame, labels: DataFrame):
    """(weights of the hashed terms, projection, unit vectors of the sample, their labels), or None without labels.

    The factors are those of a randomised singular-value decomposition of the bounded sample's weighted counts.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    got = sample(documents, labels, "quality", ROWS, 5, 0).mapInPandas(_rows, f"doc_id {kind}, label int, x binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["doc_id", "x"])
    x = np.stack([np.frombuffer(v, "<f2") for v in got["x"]]).astype(np.float32)
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x = _unit(x * weights)
    q = np.random.default_rng(7).standard_normal((x.shape[1], FACTORS + 16)).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    project = (q @ v[:FACTORS].T).astype(np.float32)
    return weights, project, _unit(x @ project), got["label"].to_numpy(np.float32)


def votes(x: np.ndarray, model) -> np.ndarray:
    """The weighted share of label 1 among each row's NEIGHBOURS nearest: cosines to PLACES places, ties to the smaller doc_id of the sample.

    A row without any terms is as near to all: it gets the sample's own share.
    """
    weights, project, known, labels = model
    own = _unit((x * weights).astype(float) @ project)
    near = np.rint(own @ known.T.astype(float) * 10**PLACES).astype(np.int64)
    n, all_ = min(NEIGHBOURS, near.shape[1]), near.shape[1]
    top = np.argpartition(-(near * all_ - np.arange(all_)), n - 1, axis=1)[:, :n]
    top.sort(axis=1)
    vote = np.maximum(np.take_along_axis(near, top, 1) / 10**PLACES, 1e-3) ** SHARPNESS
    return np.where(x.any(axis=1), (vote * labels[top]).sum(axis=1) / vote.sum(axis=1), labels.mean())


def _score(model):
    def run(batches):
        for b in batches:
            out = np.full(len(b), 0.5)
            for k in range(0, len(b) if model else 0, SUB):
                out[k : k + SUB] = votes(np.stack([counts(t) for t in b["text"].iloc[k : k + SUB]]), model)
            p = np.clip(np.round(out, 6), 0, 1)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": p, "predicted": (p >= 0.3).astype(np.int32)})

    return run


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `documents`: doc_id, held_out, score (share of the neighbours' votes for quality 1), predicted.

    Every document is held against every vector of the sample, in blocks. Of equally near neighbours those with the smaller doc_id
    vote. Null and empty texts, and those too short for any term, are as near to all and get the sample's share; without labels every
    score is 0.5. Repeated rows each get a row, with the same score; other columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text")
    return rows.mapInPandas(_score(fit(documents, labels)), f"doc_id {kind}, held_out boolean, score double, predicted int")
