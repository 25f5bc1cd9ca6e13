"""Sentences about terms and names are told within a row."""

from quern.operators import questions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_sentences_of_rows_that_share_a_key(spark):
    df = spark.createDataFrame([(1, "猫がいる。猫とはである。犬。"), (2, "犬。"), (2, "犬とはであるという。犬"), (3, None), (None, "猫。")], "k int, t string")
    found = spark.createDataFrame([(1, "猫"), (1, "犬"), (1, None), (2, "犬"), (3, "猫"), (None, "猫")], "k int, term string")
    got = questions.best_sentences(df, found, "k", "t")
    assert {(r.k, r.term, r.sentence) for r in got.collect()} == {(1, "猫", "猫とはである。"), (1, "犬", "犬。"), (2, "犬", "犬とはであるという。")}
    alone = questions.best_sentences(df.where("k = 1"), found, "k", "t")
    assert "BroadcastNestedLoop" not in plan(alone) and "max_by" not in plan(alone)


def test_names_are_found_in_their_first_sentence(spark):
    df = spark.createDataFrame([(1, " Bob came! Ann saw Bob. x"), (1, "Bob"), (2, None), (3, "a.b Bob")], "k int, t string")
    names = spark.createDataFrame([(1, "Bob", "PERSON"), (1, "Ann", "x"), (1, "Zoe", "x"), (2, "Bob", "x"), (3, "a.b", "x"), (3, "Bob", "x")], "k int, entity string, kind string")
    got = questions.by_entity(df, names, "k", "t")
    assert sorted({(r.k, r.entity, r.answer) for r in got.collect()}) == [(1, "Ann", "Ann saw Bob"), (1, "Bob", "Bob"), (1, "Bob", "Bob came"), (3, "Bob", "b Bob")]
    assert got.count() == 12 and plan(got).count("split(") == 0
