"""Result files, the log of unanswered questions, JSON that is no list, and small operators."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import confidence, coverage, keywords, questions, reports
from quern.sources import outputs


def test_files_of_a_run(spark, tmp_path):
    pairs = spark.createDataFrame([("q1", 'a "x"', 1), ("q2", None, 2)], "question string, answer string, chunk_id int")
    chunks = spark.createDataFrame([(1, "x" * 300), (2, None), (3, "short")], "chunk_id int, text string")
    best = spark.createDataFrame([(1, 0.5), (3, 0.9)], "chunk_id int, best double")
    for _ in range(2):
        paths = outputs.save_run(pairs, best, chunks, str(tmp_path), "news")
    assert spark.read.json(paths["json"]).count() == 2 and spark.read.csv(paths["csv"], header=True, escape='"').where("answer = 'a \"x\"'").count() == 1
    assert spark.read.json(paths["envelope"]).first().total_pairs == 2
    summary = spark.read.json(paths["summary"]).first()
    assert summary.total_qa_pairs == 2 and abs(summary.coverage_rate - 1 / 3) < 1e-9 and summary.files.csv == paths["csv"]
    left = {r.chunk_id: r for r in spark.read.json(paths["uncovered"]).collect()}
    assert set(left) == {1, 2} and left[1].text_preview == "x" * 200 + "..." and left[2].gap == 0.7


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert outputs.unanswered_log(spark, path).count() == 0
    for k in range(2):
        outputs.unanswered(spark.createDataFrame([(f"q{k}", ["a", "b"], "Low score", None)], "query string, collections array<string>, reason string, agent_response string"), path)
    rows = outputs.unanswered_log(spark, path).collect()
    assert {(r.query, r.collections, r.agent_response) for r in rows} == {("q0", "a, b", ""), ("q1", "a, b", "")} and rows[0].timestamp >= rows[1].timestamp
    outputs.clear_log(spark, path)
    assert outputs.unanswered_log(spark, path).count() == 0


def test_json_rows(spark, tmp_path):
    for name, value in {"list": [{"a": 1}, {"a": 2}], "one": {"a": 3}, "number": 5, "text": "x"}.items():
        (tmp_path / name).write_text(f"\n {json.dumps(value)}")
    (tmp_path / "broken").write_text('[{"a": 1')
    assert outputs.json_rows(spark, str(tmp_path / "list")).count() == 2 and outputs.json_rows(spark, str(tmp_path / "one")).first().a == 3
    for name in ("number", "text", "broken"):
        with pytest.raises(ValueError, match="list"):
            outputs.json_rows(spark, str(tmp_path / name))


def test_small_operators(spark):
    one = coverage.bands(spark.createDataFrame([(0.7,), (0.5,), (0.1,)], "best double")).first()
    assert (one.chunks, one.covered, one.high, one.medium, one.low) == (3, 1, 1, 1, 1)
    assert coverage.bands(spark.createDataFrame([], "best double")).first().rate == 0.0
    shares = reports.source_shares(spark.createDataFrame([("a",), ("a",), (None,)], "source string"), "source", 100)
    assert sorted(map(tuple, shares.collect())) == [("a", 2, 66.666667, 66), ("unknown", 1, 33.333333, 33)]
    score = spark.createDataFrame([(0.96,), (0.7,), (0.5,), (0.1,), (None,)], "c double")
    assert [r[0] for r in score.select(confidence.level(F.col("c"), F.lit(0.95), F.lit(0.6), F.lit(0.4))).collect()] == ["silent", "notify", "confirm", "escalate", "escalate"]
    pairs = spark.createDataFrame([(1, k, "それは何ですか", "x") for k in range(7)], "k int, o int, question string, answer string")
    got = questions.adversarial(pairs, "k", "o").collect()
    assert len(got) == 7 and sum(r.type == "adversarial_negation" and "ではありませんか" in r.question for r in got) == 5
    df = spark.createDataFrame([(1, "BERT と 深層学習モデル 概念"), (2, None)], "doc_id int, text string")
    found = spark.createDataFrame([(1, 1, "BERT"), (1, 2, "概念"), (1, 3, "ない")], "doc_id int, rank int, term string")
    assert {r.doc_id: r.concepts for r in keywords.concepts(found, df, "doc_id", "text").collect()} == {1: ["BERT", "概念", "ない", "深層学習"], 2: []}
    assert tuple(keywords.potential(found, df, "doc_id", "text").first()) == (1, 3, 0.666667, 0.333333, 0.333333)
