"""Relations of terms: patterns in linear time, rows that share a key."""

import re
import time

import pytest

from quern.operators import relations

TEXTS = ["aはbである", "は b である", "aはbで\nある", "xはyをzする", "aによりbがc", "aによりbが", "aから\nbへ", "aからbへ", "ははである", "はaはである", "は\naはbである", "のためaを", "aのためbを", "aを用いてbを", "aにおけるb", "aによる", "aは\rbである"]


@pytest.mark.parametrize("text", TEXTS)
def test_linear_patterns_match_alike(text):
    for p, _ in relations.PATTERNS:
        words, test = relations._linear(p)
        assert bool(all(w in text for w in words) and test.search(text)) == bool(re.search(p, text)), p


def test_long_sentences_take_time_in_proportion(spark):
    long = "x " * 60_000 + "検索 と データ は " + "y " * 60_000
    df = spark.createDataFrame([(i, long, ["検索", "データ"]) for i in range(8)], "k int, x string, t array<string>")
    began = time.time()
    assert {r.relation for r in relations.relations(df, "k", "x", "t").collect()} == {"co_occurs"}
    assert time.time() - began < 30


def test_rows_that_share_a_key(spark):
    rows = [(1, "a b. b c a", ["a", "b", "c"]), (2, "a x b", ["a", "b"]), (2, "zz. b a", ["a", "b"]), (3, None, ["a", "b"]), (4, "a b", None), (5, "bはaである", ["a", "b"])]
    got = relations.relations(spark.createDataFrame(rows, "k int, x string, t array<string>"), "k", "x", "t")
    assert {tuple(r) for r in got.select("k", "source", "target", "relation", "context").collect()} == {
        (1, "a", "b", "co_occurs", "a b"), (1, "a", "c", "co_occurs", "b c a"), (1, "b", "c", "co_occurs", "b c a"), (2, "a", "b", "co_occurs", "a x b"), (5, "b", "a", "is_a", "bはaである")
    }
