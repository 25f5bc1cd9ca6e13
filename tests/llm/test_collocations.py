import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from quern.llm import collocations

UP = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, inside, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        g = "und" if lang is None else lang
        for p in re.split("[.,;:!?\n-\r]", (text or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", p)
            n[g] += len(w)
            for k in (1, 2, 3):
                f[g].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for g, c in f.items():
        some = []
        for p, a in c.items():
            if len(p) == 1 or a < least:
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and b >= least and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in c.items()):
                some.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(g, i + 1, p.decode(), -a, x, y, n[g], -s) for i, (s, a, p, x, y) in enumerate(sorted(some)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


WORDS = ["The", "the", "of", "a", "aa", "a-a", "Ä", "ä", "x|y", "new", "york", "ﬁ", " z", "é", "k9"]


def made(n):
    r = random.Random(5)
    return [(r.choice(["en", "de", None, "und", "x"]), "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b "]) for _ in range(r.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 6])
def test_against_plain(spark, parts):
    rows = made(300) + [("en", None), ("en", ""), (None, None), ("zz", "..."), ("en", "a of new york. " * 3_000), ("en", "a of new york. " * 3_000)]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("doc_id", "g", "n", "word", "phrase", "chunk", "data", "a", "l", "r", "score", "rank", "salt", "k", "sub")}).repartition(parts)
    assert got(collocations.mined(docs)) == plain(rows, 10, 50, 2_000)
    assert got(collocations.mined(docs, least=3, inside=90, top=7)) == plain(rows, 3, 90, 7)


def test_large_counts_are_exact(spark):
    big = 3_037_000_501  # its square times 1,000,000 passes 64 bits
    row = spark.createDataFrame([(big, big + 1, big + 3)], "a bigint, x bigint, y bigint")
    assert row.select(collocations._score(F.col("a"), F.col("x"), F.col("y"))).head()[0] == 1_000_000 * big * big // ((big + 1) * (big + 3))


def test_full_sketch_only_lets_more_through(spark, monkeypatch):
    rows = made(200)
    docs = spark.createDataFrame(rows, "lang string, text string")
    expect = got(collocations.mined(docs))
    monkeypatch.setattr(collocations, "frequent", lambda sketches, least: np.full((1 << collocations.BITS) // 8, 255, np.uint8))
    assert got(collocations.mined(docs)) == expect == plain(rows, 10, 50, 2_000)


def test_sketch_is_an_upper_bound_over_tasks(spark):
    rows = [("en", f"common pair here {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(20)
    found = docs.mapInArrow(collocations.learned, "lang string, word string, n bigint, chunk int, data binary").where("chunk IS NOT NULL").select("chunk", "data")
    bits = np.unpackbits(collocations.frequent(found, 40))
    at = collocations.cells(["common", "pair", "here"], {"common", "pair", "here"}, collocations._salt("en"), {})
    assert bits[at[2]].all() and bits[at[3]].all() and bits.sum() == 3


def test_matches_overlap():
    assert collocations.matches(collocations.tokens(["A a\ta.a", "b  a a"]), {"a a", "a a a", "a b"}) == {"a a": 3, "a a a": 1, "a b": 0}


def test_empty(spark):
    assert collocations.mined(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_rows_are_summed_and_longer_phrases_need_the_shorter_ones(monkeypatch):
    texts = [f"word{i % 40_000} of{i % 40_000} many" for i in range(120_000)]
    batch = pa.record_batch({"lang": ["en"] * len(texts), "text": texts})
    monkeypatch.setattr(collocations, "SHARD", 1 << 18)
    bits = np.full((1 << collocations.BITS) // 8, 255, np.uint8)
    found = pa.Table.from_batches(collocations.counted(iter([batch]), bits))
    assert found.num_rows == 120_000 and sum(found["n"].to_pylist()) == 360_000
    words = collocations.tokens(["a b c"])
    at = collocations.cells(words, set(words), collocations._salt("en"), {})
    few = np.zeros(1 << collocations.BITS, np.uint8)
    few[[at[2][0], at[3][0]]] = 1  # not the counter of "b c"
    seen = []
    monkeypatch.setattr(collocations, "matches", lambda w, p: seen.append(p) or {})
    list(collocations.counted(iter([pa.record_batch({"lang": ["en"], "text": ["a b c"]})]), np.packbits(few)))
    assert seen == [{"a b"}]


def test_sums_of_a_task_are_no_python_objects(monkeypatch):
    """Many keys wait in little memory, are added up over shards, and leave by number and by bytes."""
    sums = collocations.Sums(collocations._COUNTED)
    tracemalloc.start()
    for k in range(25):
        assert not list(sums.add("en", {f"w{i} x{k % 2}": 1 for i in range(10_000)}))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 2_000_000  # 20,000 keys as Python objects take more
    found = pa.Table.from_batches(sums.rest())
    assert found.num_rows == 20_000 and sorted(set(found["n"].to_pylist())) == [12, 13] and not list(sums.rest())
    monkeypatch.setattr(collocations, "KEY_BYTES", 1_000_000)
    out = [b for k in range(4) for b in sums.add("en", {f"{k} {'y' * 700_000}": 1})]
    assert sum(b.num_rows for b in out) == 3 and sum(b.num_rows for b in sums.rest()) == 1


def test_sketch_grows_with_the_corpus(spark, monkeypatch):
    """A larger sketch, given out by a task in many parts, gives the same result."""
    rows = made(300)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    sizes = []
    monkeypatch.setattr(collocations, "LOAD", 1e-4)  # as a corpus of 37,500 times the bytes
    monkeypatch.setattr(collocations, "HELD", 500)
    whole = collocations.frequent
    monkeypatch.setattr(collocations, "frequent", lambda *a: sizes.append(a[2:]) or whole(*a))
    assert got(collocations.mined(docs)) == plain(rows, 10, 50, 2_000)
    assert sizes[0][0] > collocations.BITS


def test_a_task_holds_counters_it_meets_only():
    """Whatever the size of the sketch, no table of it is made in a task."""
    batch = pa.record_batch({"lang": ["en"] * 3, "text": ["a b c", "a b", "c d. a b"]})
    tracemalloc.start()
    found = pa.Table.from_batches(collocations.learned(iter([batch]), collocations.MOST_BITS))
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()
    chunks = found.filter(pa.compute.is_valid(found["chunk"])).select(["chunk", "data"]).sort_by("chunk")
    bits = [np.unpackbits(collocations._unpacked(x)).sum() for t in (1, 3, 4) for b in collocations._flags(iter(chunks.to_batches()), t) for x in b["data"].to_pylist()]
    assert sum(bits) == 4 + 1 + 0
