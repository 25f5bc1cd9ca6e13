import random

import pytest
from pyspark.sql import functions as F

from quern.llm import decontamination


def word(r):
    return "".join(r.choice("abcdefgh") for _ in range(6))


def pairs(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    return {(x.doc_id, x.item_id): x for x in decontamination.overlaps(d, b).collect()}


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_long_items(spark, monkeypatch, limit):
    """Items of 6,000 and 50,000 words: only their seeds are sent about."""
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", limit)
    r = random.Random(1)
    long, longer = [word(r) for _ in range(6_000)], [word(r) for _ in range(50_000)]
    docs = [(1, "nothing in common with any of the items here"), (2, " ".join(word(r) for _ in range(300))), (3, " ".join(longer[40_000:40_020])), (4, " ".join([word(r), *long[100:160], word(r)]))]
    got = pairs(spark, docs, [(7, " ".join(long)), (8, " ".join(longer))])
    assert set(got) == {(3, 8), (4, 7)}
    assert (got[3, 8].equal, got[4, 7].equal, got[4, 7].first_word, got[4, 7].last_word) == (20, 60, 1, 60)


def test_items_that_share_a_seed(spark):
    """100,000 items begin alike; documents with that beginning meet all of them, and overlap those they hold."""
    items = spark.range(100_000).select(F.col("id").alias("item_id"), F.concat(F.lit("which of the following is "), F.concat_ws(" ", *[F.concat(F.lit(c), F.col("id").cast("string")) for c in "pqrst"])).alias("text"))
    head = "which of the following is"
    rows = [(1, f"{head} it"), (2, f"so {head} p7 q7 r7 s7 t7 then"), (3, f"{head} p5 q6 r7 s8 t9"), (4, " ".join(f"{c}99999" for c in "pqrst"))]
    got = decontamination.overlaps(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(2, 7)}


def test_seeds_repeated_in_both(spark):
    phrase = "a b c d e"
    got = pairs(spark, [(1, f"{phrase} " * 300)], [(1, f"x {phrase} " * 100), (2, "a b c d e f g h i")])
    assert (1, 2) not in got and (1, 1) not in got


def test_item_names(spark):
    text = "one two three four five six seven eight nine"
    items = [(1, text), (1, text.replace("one", "uno") + " ten"), (None, text), (None, text), (5, "one two three"), (6, None)]
    got = pairs(spark, [(9, text), (None, text), (9, text)], items)
    assert set(got) == {(9, 1), (9, None), (None, 1), (None, None)} and got[9, 1].equal == 9
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, decontamination.overlooked(b).collect())) == [(5, 3), (6, 0)]


def test_recall_on_long_stretches(spark):
    """Stretches of 20 to 60 words with a fifth of them changed at random places: nearly all have a place that a mask hits."""
    r = random.Random(8)
    items = [[word(r) for _ in range(r.randint(20, 60))] for _ in range(300)]

    def changed(ws):
        at = set(r.sample(range(1, len(ws) - 1), len(ws) // 5))
        return [word(r) if i in at else w for i, w in enumerate(ws)]

    docs = [(i, " ".join([word(r) for _ in range(10)] + changed(ws) + [word(r)])) for i, ws in enumerate(items)]
    got = pairs(spark, docs, [(i, " ".join(ws)) for i, ws in enumerate(items)])
    assert set(got) <= {(i, i) for i in range(300)} and len(got) >= 297
    print(len(got))
