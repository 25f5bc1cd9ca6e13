"""Models by batch, their failures, and what is made of their answers."""

import pytest
from pyspark.sql import functions as F

from quern.functions import keywords as K
from quern.operators import chunks, models, questions


def test_a_failing_row_does_not_take_its_batch_along(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, " "), (5, "b")], "k int, t string").coalesce(1)

    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("model")
        return [t.upper() for t in texts]

    got = {r.k: r.value for r in models.answered(df, "k", "t", model, batch=10, times=2).collect()}
    assert got == {1: "A", 2: None, 3: None, 4: None, 5: "B"}
    assert models.answered(df.limit(0), "k", "t", model).count() == 0


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, ""), (4, None)], "k int, t string")
    got = {r.k: r.vector for r in models.embedded(df, "k", "t", dims=16).collect()}
    assert got[1] == got[2] and sum(x * x for x in got[1]) == pytest.approx(1.0)
    assert got[3] == got[4] == [0.0] * 16


def test_sparse_weights(spark):
    df = spark.createDataFrame([(1, "tea Tea milk"), (2, ""), (3, None)], "k int, t string")
    got = {r.k: r.weights for r in models.sparse(df, "k", "t").collect()}
    assert sorted(got[1].values()) == [1.0, 2.0] and got[2] == got[3] == {}


def test_reordered(spark):
    df = spark.createDataFrame([(1, 1, "x y", "x"), (1, 2, "x y", "y x"), (1, 3, "x y", "z"), (1, 4, "x y", "x q")], "q int, id int, a string, b string")
    got = models.reordered(df, "q", models.shared_words(F.col("a"), F.col("b")), ["id"], 2)
    assert sorted((r["rank"], r.id, r.score) for r in got.collect()) == [(1, 2, 1.0), (2, 1, 0.5)]


@pytest.mark.parametrize(("answer", "want"), [('so: {"a": {"b": 1}}\nend', '{"a": {"b": 1}}'), ("none", None), (None, None)])
def test_json_object(spark, answer, want):
    assert spark.createDataFrame([(answer,)], "t string").select(K.json_object(F.col("t")).alias("x")).first().x == want


@pytest.mark.parametrize(("answer", "want"), [("Thought: a\nFinal Answer: b ", "b"), ("Answer: c", "c"), ("Thought: d", "d"), ("e", "e")])
def test_final_answer(spark, answer, want):
    assert spark.createDataFrame([(answer,)], "t string").select(K.final_answer(F.col("t")).alias("x")).first().x == want


def test_templates_by_difficulty_and_category(spark):
    df = spark.createDataFrame([(1, "技術", "intermediate", "core_concept"), (1, "API", "advanced", "technical_term"), (1, "本", "basic", "other")], "k int, term string, difficulty string, category string")
    got = {(r.term, r.question, r.answer_length) for r in questions.by_template(df, "k").collect()}
    assert ("技術", "技術の仕組みを説明してください。", "2-3文") in got and ("API", "APIの技術的な詳細を説明してください。", "3-5文") in got and ("本", "本とは何ですか？", "1-2文") in got
    assert len(got) == 6


def test_negated(spark):
    row = questions.negated(spark.createDataFrame([("本とは何ですか？", "紙")], "question string, answer string")).first()
    assert tuple(row) == ("本とは何ではありませんか？", "紙ではないものを指します。")


def test_chunks_join_forward(spark):
    df = spark.createDataFrame([(1, 0, 20, "a"), (1, 1, 20, "b"), (1, 2, 100, "c"), (1, 3, 10, "d"), (2, 0, 5, "e"), (2, 1, 600, "f")], "doc_id bigint, chunk_idx int, tokens int, text string")
    got = sorted((r.doc_id, r.chunk_idx, r.tokens, r.text, r.last_idx) for r in chunks.merged_forward(df).collect())
    assert got == [(1, 0, 140, "a b c", 2), (1, 3, 10, "d", 3), (2, 0, 5, "e", 0), (2, 1, 600, "f", 1)]
