"""Bounds of labelled samples where rows share a doc_id, texts are long or languages many."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import decontamination, labels, language, simhash
from tests.llm import plain


def test_sample_counts_rows_not_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(100)] + [(2, "a"), (2, "a"), (3, None)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (None, 1)], "doc_id bigint, toxic int")
    got = [labels.sample(docs.repartition(p), marks, "toxic", 10, 5, 4).orderBy("doc_id").collect() for p in (1, 5)]
    assert got[0] == got[1] and [(r.doc_id, r.label) for r in got[0]] == [(1, 1), (2, 0)]
    assert labels.sample(docs, marks, "toxic", 1, 5, 4).count() == 1


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(labels, "BYTES", 1_000)
    monkeypatch.setattr(labels, "LONGEST", 300)
    docs = spark.createDataFrame([(i, "x" * (50 * i)) for i in range(1, 30)], "doc_id bigint, text string")
    marks = docs.select("doc_id", F.lit(1).alias("toxic"))
    got = labels.sample(docs, marks, "toxic", 100, 5, 4).collect()
    assert got and sum(len(r.text) for r in got) <= 1_000 and max(len(r.text) for r in got) <= 300


def test_language_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {'abcdefghij'[i % 10]}{i}", "en") for i in range(100)] + [(4, "same", "de")] * 50, "doc_id bigint, text string, lang string")
    got = language.labelled(docs)
    assert len(got["en"].split("\0")) - 1 == language.ROWS and got["de"] == "\0same"


@pytest.mark.parametrize("n", [1, 9])
def test_language_characters(spark, monkeypatch, n):
    monkeypatch.setattr(language, "CHARS", 90_000)
    docs = spark.createDataFrame([(4, "ab " * 50_000, f"l{k}") for k in range(n)] + [(5, "cd " * 3_000, "l0")], "doc_id bigint, text string, lang string")
    got = language.labelled(docs)
    assert len(got) == n and sum(map(len, got.values())) <= 90_000 + n
    assert all(got.values())
    many = spark.createDataFrame([(4, "abc", f"l{k}") for k in range(100)], "doc_id bigint, text string, lang string")
    assert len(language.labelled(many)) == 22


@pytest.mark.parametrize("block", [3, 16, 1_024])
def test_parse_goes_on_over_blocks(monkeypatch, block):
    """A text of any length is parsed as one, also where a match is longer than a block."""
    monkeypatch.setattr(language, "BLOCK", block)
    r = random.Random(4)
    some = lambda n: "".join(r.choice("abc é") for _ in range(n))
    texts = {"x": "\0" + some(400) + "\0" + "ab" * 60, "y": "\0" + some(90)}
    model = plain.model_of(texts)
    asked = [texts["x"][1:], texts["x"][5:300] + "zz" + texts["y"][3:80], "ab" * 700, some(3_000), "a", "b" * block, "?"]
    got, n = model.entropies(asked)
    for row, size, t in zip(got, n, asked, strict=True):
        every, symbols = plain.all_bits(model, t)
        assert symbols == size and np.allclose(row, every)


def test_exploded_tables_are_not_broadcast(spark, monkeypatch, tmp_path):
    """Spark sizes a table before its arrays are exploded: 64 variants a fingerprint, and seeds beyond their limit, would all come to the driver."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    prints = table("prints", [(0,), (1,), (7,), (-1,)], "fp bigint")
    assert "Broadcast" not in plan(simhash.links(prints))
    assert sorted(map(tuple, simhash.links(prints).collect())) == [(0, 1), (0, 7), (1, 7)]
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
    docs, items = table("docs", [(1, 2, [3] * 9)], "doc_id int, version bigint, d array<bigint>"), table("items", [(1, [3] * 9)], "item int, b array<bigint>")
    assert "Broadcast" not in plan(decontamination.hits(docs, items))
