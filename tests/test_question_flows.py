"""Questions from entities, parses, phases and samples of chunks; complexity by score; token counts."""

import os

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import models, questions


def out(df):
    return [tuple(r) for r in df.collect()]


def test_scored_complexity(spark):
    dense = "DeepLearning NeuralNetwork internationalization. 12 3.5% 7"
    df = spark.createDataFrame([(dense,), ("tiny. text here",), ("",), (None,), ("これは人工知能技術です。私が本を机に置き、彼と話す。",)], "t string")
    got = [tuple(r[0]) for r in out(df.select(T.scored_complexity(F.col("t"))))]
    assert got[0] == ("en", 4, "medium", True)
    assert got[1] == ("en", 1, "low", False)
    assert got[2] == got[3] == ("en", 1, "low", False)
    assert got[4] == ("ja", 3, "medium", False)


def test_looked_up(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "m string")
    limits = T.looked_up(F.col("m"), {"a": {"tokens": 10, "answer": 2}}, {"tokens": 1, "answer": 1})
    assert [tuple(r[0]) for r in out(df.select(limits))] == [(10, 2), (1, 1), (1, 1)]
    assert out(df.select(T.looked_up(F.col("m"), {}, 0.5))) == [(0.5,)] * 3


def test_counted_tokens(spark, tmp_path):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    own = Tokenizer(WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    own.pre_tokenizer = Whitespace()
    own.save(os.fspath(tmp_path / "words.json"))
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "t string")
    assert out(df.select(models.counted_tokens(F.col("t"), os.fspath(tmp_path / "words.json")))) == [(3,), (0,), (0,)]
    assert out(df.select(models.counted_tokens(F.col("t")))) == [(1,), (0,), (0,)]


def test_entities_and_facts(spark):
    docs = spark.createDataFrame([(1, "First. Ada wrote it. Ada left"), (2, None)], "doc_id int, text string")
    found = spark.createDataFrame([(1, "Ada", "PERSON"), (1, "Bob", "ORG"), (1, "wrote", None), (2, "Ada", "ORG"), (1, "", "ORG")], "doc_id int, entity string, kind string")
    got = out(questions.by_entity(docs, found, "doc_id", "text").select("entity", "question", "answer"))
    assert sorted(got) == sorted([("Ada", q.replace("{}", "Ada"), "Ada wrote it") for q in questions.ENTITIES["PERSON"]] + [("wrote", q.replace("{}", "wrote"), "Ada wrote it") for q in questions.ENTITIES[""]])
    kind = "doc_id int, subjects array<string>, verbs array<string>, dates array<string>, places array<string>"
    parsed = spark.createDataFrame([(1, ["彼"], ["行き"], ["昨日"], ["東京", "大阪"]), (1, [], ["x"], ["y"], ["z"]), (2, None, None, None, None)], kind)
    assert out(questions.by_facts(parsed, "doc_id")) == [(1, "彼はいつ行きましたか？", "昨日です。", "temporal", 0.7), (1, "彼はどこで行きますか？", "東京です。", "location", 0.7)]


def test_keyword_questions(spark):
    docs = spark.createDataFrame([(1, "token model token model token model zeta"), (2, ""), (3, None)], "doc_id int, text string")
    got = out(questions.for_keywords(docs, "doc_id", "text", 2, [], ["token"], {"intermediate": 0.5, "advanced": 0.5}))
    assert {r[1] for r in got} == {"token", "zeta"} and len(got) == 4 and {r[0] for r in got} == {1}


def test_phases_fill_up(spark):
    docs = spark.createDataFrame([(1, "red fox and blue hen"), (2, None)], "doc_id int, text string")
    kind = "doc_id int, question string, answer string, type string, confidence double"
    rules = spark.createDataFrame([(1, "what is red?", "red fox", "r", 0.9), (1, "what is low?", "blue hen", "r", 0.1), (1, "what is odd?", "green cow", "r", 0.9)], kind)
    model = spark.createDataFrame([(1, "what is red?", "blue hen", "m", 1.0), (1, "what is blue?", "blue hen", "m", 1.0), (1, "why so red?", "the red fox", "m", 1.0), (2, "what is it?", "nothing", "m", 1.0)], kind)
    got = out(questions.in_phases(docs, [rules, model], "doc_id", "text", 2).select("doc_id", "question", "answer", "type"))
    assert {r[1:] for r in got} in ({("what is red?", "red fox", "r"), ("what is blue?", "blue hen", "m")}, {("what is red?", "red fox", "r"), ("why so red?", "the red fox", "m")})
    assert questions.in_phases(docs, [rules.limit(0)], "doc_id", "text").count() == 0


@pytest.mark.parametrize("most", [2, 10])
def test_chunks_are_spaced_and_topped_up(spark, most):
    text = lambda i: f"The letter{i} is the first thing that is said for the record here. And the next{i} is that it was so for the others"
    rows = [(1, i, text(i)) for i in range(5)] + [(2, 0, None), (3, 0, text(0))]
    chunks = spark.createDataFrame(rows, "doc int, pos int, text string")
    got = out(questions.topped_up(chunks, "doc", "pos", "text", most, 1).select("doc", "pos", "i"))
    assert [r for r in got if r[0] == 3] == [(3, 0, 0)] and not [r for r in got if r[0] == 2]
    mine = {r[1] for r in got if r[0] == 1}
    assert mine == ({0, 2, 3, 4} if most == 2 else {0})
