"""Terms are counted within a row, and rows that share a key are one text."""

import duckdb

from quern.operators import keywords
from quern.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXTS = [(1, "data Data data the of データ ab cd"), (2, "ab"), (2, "cd ab ab ef"), (3, None), (4, ""), (None, "xy xy zz"), (None, "zz zz"), (5, "the of x 12")]


def test_terms_are_counted_in_their_rows(spark):
    df = spark.createDataFrame(TEXTS, "k int, t string")
    alone = df.where("k IN (1, 3, 4, 5)")
    assert "HashAggregate" not in plan(keywords.by_frequency(alone, "k", "t", 3, ["the", "of"]))
    assert "Exchange" not in plan(keywords.by_score(alone, "k", "t", 3, ["the", "of"], ["ab"]))


def test_rows_that_share_a_key_are_one_text(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS, "k int, t string")
    want = {(1, 1, "data", 2), (1, 2, "Data", 1), (1, 3, "データ", 1), (2, 1, "ab", 3), (2, 2, "cd", 1), (2, 3, "ef", 1), (None, 1, "zz", 3), (None, 2, "xy", 2)}
    for most in (keywords.REPEATED, 0):
        monkeypatch.setattr(keywords, "REPEATED", most)
        assert {tuple(r) for r in keywords.by_frequency(df, "k", "t", 3, ["the", "of"]).collect()} == want
    score = {(r.k, r.rank, r.term): r.score for r in keywords.by_score(df, "k", "t", 2, ["the", "of"], ["ab"]).collect()}
    assert set(score) == {(1, 1, "ab"), (1, 2, "データ"), (2, 1, "ab"), (2, 2, "cd"), (None, 1, "zz"), (None, 2, "xy")}
    assert score[2, 1, "ab"] == 0.875 and score[1, 1, "ab"] == 0.675


def test_batches_add_up_in_order_of_rank(spark):
    """Of 480 characters 26, 24 and 24 are covered: in order of rank the second batch adds 0.04999999999999999."""
    counts = [("a" * 10, 1), ("b" * 8, 1), ("c" * 8, 1), ("d" * 8, 1), ("e" * 8, 1), ("f" * 8, 1), ("g" * 8, 3)]
    text = " ".join(t for t, n in counts for _ in range(n)).ljust(480, "-")
    rows = [(1, i + 1, t, text) for i, (t, _) in enumerate(counts)]
    total, shares = 0.0, []
    for t, n in counts:
        total += len(t) * n / 480
        shares.append(total)
    stop = 3 if shares[2] < 0.05 else 6 if shares[5] - shares[2] < 0.05 else 7
    df = spark.createDataFrame(rows, "k int, rank int, term string, x string")
    for parts in (1, 3):
        got = keywords.progressive(df.orderBy("term", ascending=False).repartition(parts), "k", "x", (3, 6, 10)).count()
        assert got == stop
    assert "collect_list" in plan(keywords.progressive(df, "k", "x", (3, 6, 10)))  # one order, however the rows come


def test_batches_equal_their_sql_where_the_order_of_sums_tells(spark, tmp_path):
    """Of 960 characters the second batch covers 48: added up by falling rank that is under 0.05, in order of rank it isn't."""
    sizes = [40, 62, 12, 12, 16, 20, 10, 16, 22, 16]
    text = " ".join(chr(97 + i) * n for i, n in enumerate(sizes)).ljust(960, "-")
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLES["keywords_by_batches"]).fetchall()
    got = [(r.doc_id, r["rank"], r.term) for r in registry.QUERIES["keywords_by_batches"](spark, str(tmp_path)).collect()]
    assert len(want) == 6 and sorted(got) == sorted(want)


def test_budgets_judge_the_rounded_difficulty(spark, tmp_path):
    """Three sentences whose difficulty is 0.29999963: their SQL rounds it to 0.3, which isn't under 0.3."""
    text = "".join("a" * n + "." for n in (886, 104, 111))
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.QUERIES["question_budgets"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == con.sql(registry.ORACLES["question_budgets"]).fetchall() == [(1, 4)]
