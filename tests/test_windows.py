"""Windows of tokens with text, and named things."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.operators import entities, windows

TEXTS = ["", "a", "word " * 40, "日本語のテキストです。" * 9, "mixed 日本 text, né à Paris\n" * 12, "x" * 83, "🙂 wide" * 20]
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def by_hand(text):
    starts, weight = [], 0
    for i, c in enumerate(text):
        if weight // 4 == len(starts):
            starts.append(i)
        weight += 2 if ord(c) > 127 else 1
    return starts


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (10, 0), (7, 6), (300, 50)])
def test_windows_by_estimate(spark, size, overlap):
    df = spark.createDataFrame([*enumerate(TEXTS), (None, "no key " * 20), (99, None)], "doc_id int, text string").withColumns({c: F.lit(1) for c in ("at", "first", "tokens", "_n", "id")})
    expect = []
    for i, t in [*enumerate(TEXTS), (None, "no key " * 20)]:
        starts = by_hand(t)
        edge, n, at, own = [*starts, len(t)], len(starts), 0, []
        while n:
            end = min(at + size, n)
            own.append((i, at, end - at, edge[at], t[edge[at] : edge[end]]))
            if end == n:
                break
            at = end - overlap
        for k, x in enumerate(own):
            place = "full" if len(own) == 1 else "start" if k == 0 else "end" if k == len(own) - 1 else "middle"
            expect.append((x[0], None if i is None else f"{i}_chunk_{k}", k, *x[1:4], place, x[4]))
    got = [tuple(r) for r in windows.token_windows(df, "doc_id", "text", size, overlap).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expect))


def test_fixed_windows_hold_the_whole_text(spark):
    df = spark.createDataFrame([*enumerate(TEXTS)], "doc_id int, text string")
    rows = sorted(windows.fixed_windows(df, "doc_id", "text", 8).collect(), key=lambda r: (r.doc_id, r.chunk_idx))
    assert {i: "".join(r.text for r in rows if r.doc_id == i) for i, _ in enumerate(TEXTS)} == dict(enumerate(TEXTS))
    assert windows.fixed_windows(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError, match="longer"):
        windows.token_windows(df, "doc_id", "text", 5, 5)


@pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary file")
def test_windows_by_vocabulary(spark):
    own = windows._encoding(VOCABULARY)
    df = spark.createDataFrame([*enumerate(TEXTS)], "doc_id int, text string")
    rows = sorted(windows.token_windows(df, "doc_id", "text", 10, 3, VOCABULARY).collect(), key=lambda r: (r.doc_id, r.chunk_idx))
    for i, t in enumerate(TEXTS):
        ids = own.encode_ordinary(t)
        mine = [r for r in rows if r.doc_id == i]
        assert [r.first for r in mine] == [7 * k for k in range(len(mine))] and sum(r.tokens for r in mine) - 3 * max(len(mine) - 1, 0) == len(ids)
        for r in mine:
            assert t[r["at"] :].startswith(r.text)
            if t.isascii():
                assert r.text == own.decode(ids[r.first : r.first + r.tokens])


def test_key_entities(spark):
    texts = ["Ada Lovelace met Ada Lovelace in Paris. NASA, NASA, NASA", "Élan Vital iPhone AbC éParis Paris Lyon", "", None, "テスト テスト カタカナ 東京特許許可局 漢字"]
    df = spark.createDataFrame([(i, t, "ja" if i == 4 else None) for i, t in enumerate(texts)], "doc_id int, text string, lang string")
    got = sorted((r.doc_id, r.rank, r.entity, r.hits) for r in entities.key_entities(df, "doc_id", "text", F.col("lang"), 3).collect())
    expect = []
    for i, t in enumerate(texts):
        found = re.findall(r"[ァ-ヴー]{3,}|[一-龥]{4,}" if i == 4 else r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b|[A-Z]{2,}", t or "")
        expect += [(i, k + 1, e, n) for k, (e, n) in enumerate(Counter(found).most_common(3))]
    assert got == sorted(expect)


@pytest.mark.parametrize("most", [2, 100])
def test_dictionary(spark, most):
    names = ["aa", "aaa", "ab", "b", "日本", "", None, "b", "zz"]
    texts = ["aaaa", "abab 日本日本", "", None, "b" * 5_000, "none"]
    df = spark.createDataFrame([*enumerate(texts), (None, "zz")], "doc_id int, text string").withColumns({c: F.lit(1) for c in ("name", "entity", "hits", "first")})
    dictionary = spark.createDataFrame([(n,) for n in names], "name string")
    got = sorted(map(str, map(tuple, entities.by_dictionary(df, dictionary, "doc_id", "text", most=most).collect())))
    expect = [(i, n, sum(t.startswith(n, k) for k in range(len(t))), t.find(n)) for i, t in [*enumerate(texts), (None, "zz")] if t for n in {*names} if n and n in t]
    assert got == sorted(map(str, expect))
    assert entities.by_dictionary(df, dictionary.limit(0), "doc_id", "text").count() == 0
    top = entities.most_named(entities.by_dictionary(df, dictionary, "doc_id", "text"), "doc_id", 1).where("doc_id = 0").first()
    assert (top.entity, top.hits) == ("aa", 3)
