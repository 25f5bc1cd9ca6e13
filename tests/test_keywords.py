"""Small fixtures for what the tables don't show: scripts, nulls, ties, empty tables."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import keywords as K
from quern.operators import keywords, questions, results


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_metrics_by_hand(spark):
    m = K.metrics(F.col("t"), F.col("s"))
    row = spark.createDataFrame([(["API", "データ", "機械学習"], "APIとデータ"), ([], "x"), (["a"], "a")], "t array<string>, s string").select(*[c.alias(k) for k, c in m.items()], K.total(m).alias("total")).collect()
    assert row[0].coverage == pytest.approx(2 / 3) and row[0].technicality == 1.0 and row[0].coherence == 0.0 and row[0].length_balance == 1.0
    assert row[0].diversity == pytest.approx(math.sqrt(1 / 3) / 3)
    assert row[1].total == 0.0
    assert row[2].diversity == 0.5 and row[2].length_balance == 0.0


def test_weighted_total(spark):
    given = dict(zip(K.WEIGHTS, (1.0, 0.5, 0.8, 0.5, 0.8), strict=True))
    assert spark.range(1).select(K.total({k: F.lit(v) for k, v in given.items()}).alias("x")).first().x == pytest.approx(0.745)


@pytest.mark.parametrize(("text", "least", "most"), [("短い", 3, 3), ("あ" * 200, 5, 5), ("あ" * 700, 10, 12), ("あ" * 1500, 15, 15), ("あ" * 9000, 22, 22)])
def test_more_keywords_for_longer_texts(spark, text, least, most):
    assert least <= one(spark, K.auto_count(F.col("t")), t=text) <= most


@pytest.mark.parametrize(("term", "kind"), [("BERT", "specific_name"), ("API", "technical_term"), ("トランス", "technical_term"), ("深層技術", "core_concept"), ("データ型", "general_term"), ("空", "other")])
def test_category(spark, term, kind):
    assert one(spark, K.category(F.col("t")), t=term) == kind


def test_difficulty(spark):
    of = lambda term, text: one(spark, K.difficulty(F.col("t"), F.col("s")), t=term, s=text)
    assert of("知識", "知識とは何か。知識と知識") == "basic"
    assert of("API", "API API API API API API") == "advanced"
    assert of("知識", "知識") == "advanced"
    assert of("知識", "知識 知識") == "intermediate"


def test_usable_terms(spark):
    df = spark.createDataFrame([(x,) for x in ("技術書", "第一", "本等", "私的", "12", "x", "その")], "t string")
    assert [r.t for r in df.where(K.usable(F.col("t"), ["その"])).collect()] == ["技術書"]


def test_question_difficulty(spark):
    assert one(spark, K.question_difficulty(F.col("q")), q="比較と違い") == pytest.approx(0.6)
    assert one(spark, K.question_difficulty(F.col("q")), q="x" * 201) == pytest.approx(0.5)


def test_rules(spark):
    text = "検索とは情報を探すことである。これはRAGと呼ばれる。箱には、赤、青、緑があります。"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    got = {r.type: r for r in questions.by_rule(df, "k", "t").collect()}
    assert got["definition"].question == "検索とは何ですか？" and got["definition"].answer == "検索とは情報を探すことです。"
    assert got["terminology"].answer == "RAGと呼ばれます。"
    assert got["enumeration"].answer == "箱には、赤、青、緑があります。"
    assert {r.k for r in got.values()} == {1}


def test_best_sentence_ties_to_the_first(spark):
    df = spark.createDataFrame([(1, "猫がいる。猫がいる。犬。")], "k int, t string")
    found = spark.createDataFrame([(1, "猫"), (1, "鳥")], "k int, term string")
    assert [(r.term, r.sentence) for r in questions.best_sentences(df, found, "k", "t").collect()] == [("猫", "猫がいる。")]


def test_asked_twice_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 9))) for _ in range(150)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    first = {}
    for i, t in enumerate(texts):
        if t is not None:
            first.setdefault(t, i)
    sets = [(i, set(t.split())) for t, i in first.items() if t.split()]
    want = {(min(a, b), max(a, b)) for a, x in sets for b, y in sets if a < b and len(x & y) / len(x | y) > 0.7}
    got = [(r.a, r.b) for r in questions.asked_twice(df, "id", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert questions.asked_twice(df.limit(0), "id", "t").count() == 0


def test_confident_only(spark):
    rows = [(1, 0.99996805, 1), (1, 0.81257004, 2), (2, 0.95, 1), (2, 0.9, 2), (3, 0.99, 1)]
    df = spark.createDataFrame(rows, "q int, s double, id int")
    assert sorted((r.q, r.id) for r in results.confident_only(df, "q", "s", ["id"]).collect()) == [(1, 1), (2, 1), (2, 2), (3, 1)]


def test_statistics_without_results(spark):
    asked, found = spark.createDataFrame([(1,), (2,)], "q int"), spark.createDataFrame([(1, 0.5)], "q int, s double")
    got = {r.q: r for r in results.score_statistics(asked, found, "q", "s").collect()}
    assert (got[1].n, got[1].variance) == (1, 0.0) and (got[2].n, got[2].variance) == (0, 1.0)


def test_agreement_of_one_and_of_opposites(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [2.0, 0.0]), ("c", [3.0, 0.0])], "g string, v array<double>")
    got = {r.g: r.agreement for r in results.agreement(df, "g", "v").collect()}
    assert got == {"a": 1.0, "b": pytest.approx(0.0), "c": pytest.approx(1.0)}


def test_enough_terms(spark):
    df = spark.createDataFrame([(1, r, t, "aabbccddee") for r, t in enumerate(("aa", "bb", "cc", "dd"), 1)], "k int, rank int, term string, t string")
    assert keywords.enough(df, "k", "t", 0.6).collect()[0][1:] == (3, 0.6)
    assert keywords.enough(df, "k", "t", 0.99).collect()[0][1:] == (4, 0.8)


def test_any_word(spark):
    df = spark.createDataFrame([("the licence",), ("none",)], "t string")
    assert df.where(K.contains_any(F.col("t"), "a licence x")).count() == 1
    assert df.where(K.contains_any(F.col("t"), "a")).count() == 2


def test_covered_share_against_marks(spark):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab.c") for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, "", "aaaa", "猫𝄞猫"]
    asked = ["aa", "aba", "a.", "b", "\\E", "猫"]
    want = []
    for t in texts:
        t = t or ""
        marks = {j for k in asked for i in range(len(t)) if t.startswith(k, i) for j in range(i, i + len(k))}
        want.append(round(len(marks) / len(t), 6) if t else 0.0)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = df.select("k", F.explode(F.array(*map(F.lit, asked))).alias("term"))
    got = {r.k: r.covered for r in keywords.covered_share(df, found, "k", "t").collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_synonyms(spark):
    df = spark.createDataFrame([(1, "AI"), (1, "人工知能"), (2, "AI"), (2, "ML")], "k int, term string")
    assert sorted((r.k, r.term) for r in keywords.without_synonyms(df, "k").collect()) == [(1, "人工知能"), (2, "AI"), (2, "ML")]
    new = spark.createDataFrame([(1, "人工知能"), (1, "本"), (1, "AI"), (2, "AI")], "k int, term string")
    old = spark.createDataFrame([(1, "AI"), (2, "本")], "k int, term string")
    assert sorted((r.k, r.term) for r in keywords.only_new(new, old, "k").collect()) == [(1, "本"), (2, "AI")]
