import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from quern.llm import repeats


def brute(rows):
    """By row: what is at a greater (doc_id, start) than an equal string of any row goes."""
    first, out = {}, {}
    raws = [(doc, text, (text or "").encode()) for doc, text in rows]
    for doc, _, raw in raws:
        for p in range(len(raw) - 99 if doc is not None else 0):
            s = raw[p : p + 100]
            first[s] = min(first.get(s, (doc, p)), (doc, p))
    for doc, text, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99 if doc is not None else 0):
            if first[raw[p : p + 100]] < (doc, p):
                gone[p : p + 100] = b"\1" * 100
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        own = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
        out.setdefault(doc, []).append(own)
    return {doc: sorted(own) for doc, own in out.items()}


def results(got):
    out = {}
    for r in got:
        out.setdefault(r.doc_id, []).append(tuple(r)[1:])
    return {doc: sorted(own) for doc, own in out.items()}


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, passage = prose(12), prose(80)
    rows = [(0, passage), (1, None), (2, ""), (3, "a" * 700), (4, prose(30) + "a" * 150)]
    for i in range(5, 60):
        t = [prose(r.randint(0, 40))]
        if i % 3 == 0:
            t.insert(r.randint(0, 1), line)
        if i % 4 == 0:
            w = passage.split()
            w[r.randrange(80)] = "x"
            t.append(" ".join(w[r.randint(0, 20) :]))
        rows.append((i, " ".join(t)))
    twice = [(70, prose(60)), (71, prose(9) + passage)]
    shared = [(72, "q" * 7 + passage), (72, passage + " " + line + line)]
    return [*rows, (60, rows[20][1]), (61, rows[20][1]), (62, (passage + " ") * 5), *twice, *twice, *shared, (73, twice[0][1]), (None, passage)]


def check(spark, parts=3):
    rows = texts()
    random.Random(parts).shuffle(rows)
    got = repeats.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)).collect()
    assert results(got) == brute(rows)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_against_brute_force(spark, parts):
    check(spark, parts)


def test_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SUB", 150)
    check(spark)


def test_hot_anchors_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    check(spark)


def test_edges(spark):
    df = spark.createDataFrame([(None, "x" * 300, 1), (1, None, 2), (2, "é" * 60, 3), (3, "é" * 60, 3)], "doc_id bigint, text string, runs int")
    got = {r.doc_id: r for r in repeats.deduplicate(df).collect()}
    assert got[None].n_removed == 0 and got[1].n_bytes == 0 and got[3].n_removed == 120
    assert repeats.deduplicate(df.limit(0)).collect() == []


def test_pieces_that_differ_between_evaluations(spark):
    """Two rows a piece, dealt anew whenever the documents are read."""

    def dealt(batches):
        for b in [pd.concat(batches)]:
            yield b.iloc[np.random.default_rng().permutation(len(b))]

    text = texts()[0][1]
    rows = [(i, text) for i in range(40)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1).mapInPandas(dealt, "doc_id bigint, text string")
    before = spark.conf.get(size)
    spark.conf.set(size, "2")
    try:
        got = repeats.deduplicate(docs).collect()
    finally:
        spark.conf.set(size, before)
    assert results(got) == brute(rows)


def test_merge_sort_by_common_extensions():
    r = np.random.default_rng(2)
    pool = [bytes(r.integers(97, 99, 30, dtype=np.uint8)) * 4 for _ in range(6)] + [b"a" * 120]
    raw = np.frombuffer(b"".join(pool[k] for k in r.integers(0, len(pool), 60)), np.uint8)
    p = repeats.Prefixes(raw, 0)
    at = r.integers(0, len(raw) - repeats.LENGTH + 1, 900)
    group = np.sort(r.integers(0, 25, 900))
    order = repeats.merge_sorted(p, raw, at, group)
    text = raw.tobytes()
    assert order.tolist() == sorted(range(900), key=lambda i: (group[i], text[at[i] : at[i] + 100]))
    assert repeats.merge_sorted(p, raw, at[:0], group[:0]).tolist() == []


def test_hashes_that_clash_make_nothing_equal(monkeypatch):
    """With hashes that call all substrings of one size equal, strings are equal only if their bytes are."""
    raw = np.frombuffer(b"".join(bytes([97 + k % 3]) * 37 + bytes([100 + k % 2]) for k in range(40)), np.uint8)
    monkeypatch.setattr(repeats.Prefixes, "of", lambda self, start, size: np.broadcast_to(np.asarray(size, np.uint64), np.shape(start)))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(0, len(raw) - 100, 19), np.arange(0, len(raw) - 100, 19)))
    same = repeats.compared(repeats.Prefixes(raw, 0), raw, a, b) == 0
    text = raw.tobytes()
    assert same.tolist() == [text[i : i + 100] == text[j : j + 100] for i, j in zip(a, b, strict=True)] and len(a) > same.sum() > len(set(a.tolist()))
