"""Windows of tokens with their text, cut by offsets."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how the byte-level vocabularies cut a text before pairs are joined.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
OUT = "chunk_idx int, first int, tokens int, at int, text string"
Offsets = Callable[[str], np.ndarray]


def by_estimate(text: str) -> np.ndarray:
    """Where each token of a text begins, by the estimate of a quarter of a token for an ASCII character and half a one for any other."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    before = np.concatenate([[0], np.cumsum(1 + (code > 127))])[:-1] // 4
    return np.flatnonzero(np.diff(before, prepend=-1))


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_vocabulary(path: str) -> Offsets:
    """Where each token begins by a file of ranked byte pairs, which executors can read. A token that begins inside a character counts from that character."""

    def offsets(text: str) -> np.ndarray:
        own = _encoding(path)
        return np.array(own.decode_with_offsets(own.encode_ordinary(text))[1], np.int64)

    return offsets


def cut(text: str, starts: np.ndarray, size: int, overlap: int) -> Iterator[tuple[int, int, int, int, str]]:
    """(chunk_idx, first token, tokens, first character, text) of windows of `size` tokens that overlap; the last one is that which reaches the end."""
    n, at = len(starts), 0
    edge = np.append(starts, len(text))
    for k in range(n):
        end = min(at + size, n)
        yield k, at, end - at, int(edge[at]), text[edge[at] : edge[end]]
        if end == n:
            return
        at = end - overlap


def token_windows(df: DataFrame, key: str, text: str, size: int = 300, overlap: int = 50, vocabulary: str | None = None) -> DataFrame:
    """(key, id, chunk_idx, first, tokens, at, position, text): windows of `size` tokens, each `overlap` tokens into the one before.

    Tokens are those of the vocabulary file, else the estimate's (see `by_estimate`). A window's text is a slice of the whole one, from its first character `at`; position is full, start,
    middle or end; id is the key with _chunk_ and the number. Null and empty texts have no windows; a null key gives a null id.
    A text is taken by itself in its row: nothing is shuffled.
    """
    if not 0 <= overlap < size:
        raise ValueError("a window must be longer than its overlap")
    offsets = by_vocabulary(vocabulary) if vocabulary else by_estimate
    of = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows, total = [], [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                own = list(cut(t, offsets(t), size, overlap)) if t else []
                at += [i] * len(own)
                total += [len(own)] * len(own)
                rows += own
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(at, pa.int64())), pa.array(total, pa.int32()), *columns], ["_key", "_n", "chunk_idx", "first", "tokens", "at", "text"])

    each = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {of.simpleString()}, _n int, {OUT}")
    i = F.col("chunk_idx")
    position = F.when(F.col("_n") == 1, "full").when(i == 0, "start").when(i == F.col("_n") - 1, "end").otherwise("middle")
    return each.select(F.col("_key").alias(key), F.concat(F.col("_key").cast("string"), F.lit("_chunk_"), i).alias("id"), "chunk_idx", "first", "tokens", "at", position.alias("position"), "text")


def fixed_windows(df: DataFrame, key: str, text: str, size: int = 500, vocabulary: str | None = None) -> DataFrame:
    """The same without overlap: a text in parts of `size` tokens, in order."""
    return token_windows(df, key, text, size, 0, vocabulary)
