"""Questions asked until a corpus is covered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import coverage, questions, vectors
from quern.operators.models import Model, embedded
from quern.sources.tables import written


def until_covered(chunks: DataFrame, pairs: DataFrame, key: str, text: str, threshold: float, target: float = 0.95, rounds: int = 3, n: int = 5, model: Model | None = None) -> tuple[DataFrame, float]:
    """(pairs with their round, rate of chunks covered): in each round up to `n` questions on the least covered chunks are added.

    A chunk (key bigint, text) is covered if a pair (question, answer) has a cosine of `threshold` to it. Only rates come to the
    driver; each round's pairs are written, and only they are compared, as a chunk keeps its best similarity so far.
    """
    own = written(embedded(chunks.select(key, text), key, text, model), "chunk-vectors")
    new = written(pairs.select("question", "answer", F.lit(0).alias("round")), "pairs")
    every, best = new, own.select(key, F.lit(0.0).alias("best"))
    for k in range(rounds + 1):
        said = new.select(F.xxhash64("question", "answer").alias(key), F.concat_ws(" ", "question", "answer").alias("_said"))
        seen = vectors.best(own, embedded(said, key, "_said", model), key, "vector")
        best = written(best.unionAll(seen).groupBy(key).agg(F.max("best").alias("best")), "best")
        rate = float(best.agg(F.avg((F.col("best") >= threshold).cast("double")).alias("r")).first().r or 0.0)
        if rate >= target or k == rounds:
            break
        asked = questions.for_uncovered(chunks, coverage.uncovered(best, threshold), key, text, n)
        new = written(asked.select("question", "answer", F.lit(k + 1).alias("round")), "pairs")
        every = every.unionAll(new)
    return every, rate
