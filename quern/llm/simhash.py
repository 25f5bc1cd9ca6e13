"""SimHash near-duplicates through deletion variants of the fingerprint's segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.rows import versions, without
from quern.operators.components import components
from quern.sources.tables import written

WORDS, SEED, DISTANCE = 4, 42, 4
#: (lowest bit, bits): half as many as differing bits, and one; then one of them differs in one bit at most.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text: a bit is 1 if over half of the shingles' XXH64 have it; 0 without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(batches):
    """(doc_id, version, fp) of batches of (doc_id, text, version)."""
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "version": b["version"], "fp": np.array([fingerprint(t) for t in b["text"]], "<u8").view("<i8")})


def with_fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, version, fp) of every row; fp is the fingerprint as a signed bigint."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return versions(documents).mapInPandas(fingerprints, f"doc_id {kind}, version bigint, fp bigint")


def _variants(fp: Column) -> Column:
    """The 64 deletion variants: a segment without one of its bits, and above it which bit that was."""
    return F.array(*[(F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit(((1 << n) - 1) & ~(1 << b)))).bitwiseOR(F.lit((lo + b) << 32)) for lo, n in SEGMENTS for b in range(n)])


def _first_shared(x: Column) -> Column:
    """Of the variants that two fingerprints share, by their differing bits x: the bit left out in the first."""
    out = F.lit(-1)
    for lo, n in reversed(SEGMENTS):
        part = F.shiftrightunsigned(x, lo).bitwiseAND(F.lit((1 << n) - 1))
        at = F.when(part == 0, F.lit(lo)).otherwise(F.lit(lo) + F.bit_count(part - 1))
        out = F.when(F.bit_count(part) <= 1, at).otherwise(out)
    return out


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of distinct values of `fp` that differ in 1 to DISTANCE bits, each once.

    Of the segments, one differs in a bit at most, so that the pair shares a variant; it is verified, and given out by its first one.
    Variants are joined by a shuffle whatever their number: Spark sizes a table before its arrays are exploded, and would broadcast 64 times what it reckons.
    """
    each = prints.select("fp").distinct().select("fp", F.explode(_variants(F.col("fp"))).alias("v"))
    a, b = each.select(F.col("fp").alias("a"), "v"), each.select(F.col("fp").alias("b"), F.col("v").alias("u"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("v") == F.col("u")) & (F.col("a") < F.col("b")) & (F.bit_count(x) <= DISTANCE) & (_first_shared(x) == F.shiftrightunsigned("v", 32))
    return a.join(b.hint("merge"), near).select("a", "b")


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, version, fp, first) of every row: first is the struct<none,doc_id,version> of its component that is least, null ids last."""
    prints = written(with_fingerprints(documents), "fingerprints")
    roots = components(links(prints))
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    nodes = prints.groupBy("fp").agg(F.min(name).alias("least")).join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    nodes = written(nodes, "nodes")
    names = nodes.groupBy("root").agg(F.min("least").alias("first"))
    return prints.join(nodes.join(names, "root").select(F.col("fp").alias("k"), "first"), F.col("fp") == F.col("k")).select("doc_id", "version", "fp", "first")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per row of `documents`: doc_id, fingerprint (hex), component_id (smallest doc_id reachable over links).

    Null and empty texts and those of white space have fingerprint zero and are linked like any other; equal texts are one
    node of the graph, so copies give no pairs; repeated rows each get a row; null doc_ids get their component's id, null if it has
    none; other columns are ignored.
    """
    return classes(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """`documents` without those that aren't the first of their component: of it the smallest doc_id stays, null ids coming last.

    Rows that share a doc_id and differ in their text are told apart, as are those with a null doc_id; equal rows stay or go together.
    """
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("version").eqNullSafe(F.col("first.version"))
    return without(documents, classes(documents).where(~own))
