"""Relations between the terms of a sentence."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.keywords import STOPS, sentence_parts
from quern.functions.text import BLANKS
from quern.operators.keywords import apart

PIECES = 256  # texts of a batch that are Python objects at once

# What a sentence looks like, and the relation it states; the first that matches counts.
PATTERNS = [
    (r".+?は.+?である", "is_a"),
    (r".+?は.+?を.+?する", "uses"),
    (r".+?により.+?が.+?", "enables"),
    (r".+?のため.+?を", "for"),
    (r".+?を用いて.+?を", "uses"),
    (r".+?から.+?へ", "transforms"),
    (r".+?における.+?", "in_context"),
    (r".+?による.+?", "by_means_of"),
]


def _linear(pattern: str) -> tuple[list[str], re.Pattern]:
    """A pattern's words, and the same test without backtracking: after a line's begin each word is taken where it first stands, a character or more on."""
    words = pattern.split(".+?")[1:]
    return [w for w in words if w], re.compile("(?m)^" + "".join(f"(?>.+?{re.escape(w)})" if w else "." for w in words))


def _stated(sentence: str, tests: list) -> str | None:
    return next((name for words, test, name in tests if all(w in sentence for w in words) and test.search(sentence)), None)


def _pairs(text: str | None, terms: list[str] | None, tests: list) -> list[tuple[str, str, str, int]]:
    """(source, target, relation, sentence from 0) of a text's terms, each relation once, by its first sentence."""
    found: dict[tuple[str, str, str], int] = {}
    parts = (p.strip(BLANKS) for p in re.split(STOPS, text or ""))
    for i, s in enumerate(p for p in parts if p):
        own = [t for t in terms or [] if t is not None and t in s]
        told = _stated(s, tests) if len(own) > 1 else None
        if told:
            for a, b in zip(own, own[1:], strict=False):
                found.setdefault((a, b, told) if s.index(a) < s.index(b) else (b, a, told), i)
        else:
            for k, a in enumerate(own):
                for b in own[k + 1 :]:
                    found.setdefault((a, b, "co_occurs"), i)
    return [(*k, i) for k, i in found.items()]


def relations(df: DataFrame, key: str, text: str, terms: str) -> DataFrame:
    """(key, source, target, relation, context) of terms that stand in one sentence, each relation once, by its first sentence.

    `terms` is an array in order of rank. Where a pattern states the relation, each term goes with the next one, in order of place;
    else all terms of the sentence occur together, in order of rank. All in the row, but for rows that share their key.
    """
    tests = [(*_linear(p), name) for p, name in PATTERNS]
    names, kinds = ["source", "target", "relation", "i"], (pa.string(), pa.string(), pa.string(), pa.int32())

    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for at in range(0, max(len(texts), 1), PIECES):
            rows = [_pairs(t, own, tests) for t, own in zip(texts.slice(at, PIECES).to_pylist(), lists.slice(at, PIECES).to_pylist(), strict=True)]
            flat = [x for r in rows for x in r]
            columns = [pa.array(c, t) for c, t in zip(zip(*flat, strict=True) if flat else [[]] * 4, kinds, strict=True)]
            out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r) for r in rows]), pa.int32()), pa.StructArray.from_arrays(columns, names)))
        return pa.concat_arrays(out)

    def found(rows: DataFrame) -> DataFrame:
        pairs = F.arrow_udf(run, "array<struct<source: string, target: string, relation: string, i: int>>")(F.col(text), F.col(terms))
        both = rows.select(key, sentence_parts(F.col(text)).alias("_p"), pairs.alias("_q"))
        return both.select(key, F.inline(F.transform("_q", lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), x["relation"].alias("relation"), x["i"].alias("_i"), F.get("_p", x["i"]).alias("context")))))

    alone, shared = apart(df, key)
    out = found(alone).drop("_i")
    if shared is None:
        return out
    return out.unionByName(found(shared).groupBy(key, "source", "target", "relation").agg(F.min_by("context", "_i").alias("context")))


def related(found: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, term, others): for each of a document's terms (key, term) the terms at the other end of its relations (key, source, target), in either direction, once, sorted."""
    ways = [edges.select(F.col(key).alias("_k"), F.col(a).alias("_t"), F.col(b).alias("_o")) for a, b in (("source", "target"), ("target", "source"))]
    both = found.select(key, "term").join(ways[0].unionByName(ways[1]), (F.col(key) == F.col("_k")) & (F.col("term") == F.col("_t")), "left")
    return both.groupBy(key, "term").agg(F.sort_array(F.collect_set("_o")).alias("others"))
