import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunks, coverage, keywords, plans, questions, relations, reports, retrieval
from quern.operators.models import shared_words
from quern.sources import collections, files


def out(df):
    return [tuple(r) for r in df.collect()]


def test_sentences_end_at_marks_only(spark):
    df = spark.createDataFrame([("a. b!! c。 d",), ("",), (None,)], "t string")
    assert out(df.select(T.marked_sentences(F.col("t")))) == [(["a. b!", "!", "c。", "d"],), ([],), (None,)]
    levels = [r[0] for r in out(df.select(T.length_level(F.col("t"))))]
    assert [(r.level, r.sentences) for r in levels] == [("low", 4), ("low", 0), ("low", 0)]


def test_required_terms(spark):
    df = spark.createDataFrame([("東 東京タワー is 高い",)], "t string")
    assert out(df.select(T.required_terms(F.col("t")))) == [(["東", "東京タワー"],)]


def test_integrated_takes_an_analysers_terms(spark):
    df = spark.createDataFrame([(1, "the model token model x"), (2, ""), (3, None)], "doc_id int, text string")
    more = spark.createDataFrame([(1, 1, "token model"), (1, 2, "the")], "doc_id int, rank int, term string")
    got = out(keywords.integrated(df, "doc_id", "text", 3, ["the"], ["token"], more))
    assert got == [(1, 1, "token", 0.625), (1, 2, "model", 0.325), (1, 3, "token model", 0.3)]
    every = keywords.by_all_methods(df, "doc_id", "text", 2, ["the"], ["token"], more)
    assert {r.method for r in every.collect()} == {"analyser", "frequency", "score", "integrated"}
    best = keywords.best_method(every, df, "doc_id", "text").collect()
    assert len(best) == 1 and best[0].doc_id == 1 and best[0].terms


def test_sparse_search_equals_all_products(spark):
    rng = np.random.default_rng(3)
    maps = [{int(i): float(rng.integers(1, 5)) for i in rng.choice(8, 3, replace=False)} for _ in range(60)]
    points = spark.createDataFrame([*enumerate(maps), (None, {1: 1.0}), (99, None)], "doc_id int, weights map<int,double>")
    got = out(retrieval.sparse_top_k(points, points.where("doc_id % 20 = 0"), 4).orderBy("query_id", "rank"))
    want = []
    for q in (0, 20, 40):
        score = {p: sum(w * m.get(i, 0) for i, w in maps[q].items()) for p, m in enumerate(maps)}
        best = sorted((p for p in score if score[p]), key=lambda p: (-score[p], p))[:4]
        want += [(q, r, p, score[p]) for r, p in enumerate(best, 1)]
    assert got == want


def test_retrieval_ranks_again_and_measures(spark):
    lists = [spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 9, 3)], "query_id int, doc_id int, rank int")]
    asked = spark.createDataFrame([(0, "red fox"), (5, "none")], "query_id int, q string")
    told = spark.createDataFrame([(1, "a red hen"), (2, "the red fox"), (3, "red fox")], "doc_id int, a string")
    found = retrieval.retrieved(lists, asked, told, "doc_id", shared_words(F.col("q"), F.col("a")))
    assert out(found.orderBy("rank")) == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert out(retrieval.search_metrics(asked, found).orderBy("query_id")) == [(0, 2, 1.0, 0.75), (5, 0, 0.0, 0.0)]


def test_document_coverage_in_any_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 3), i, rng.normal(size=4).tolist()) for i in range(40)]
    v = spark.createDataFrame([*rows, (7, 100, None), (7, 102, [1.0, 0.0, 0.0, 0.0])], "doc int, vec_id int, v array<double>")
    a, b = v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1")
    one, many = (sorted(out(coverage.by_document(a, b, "doc", "vec_id", "v", 0.5, n))) for n in (2_048, 3))
    assert one == many and [r[1] for r in one] == [7, 6, 7, 2] and one[3][2:] == (0, 0.0, 0.0)
    unit = {i: np.array(x) / np.linalg.norm(x) for _, i, x in rows}
    best = [max(unit[i] @ unit[j] for j in range(1, 40, 2) if j % 3 == 0) for i in range(0, 40, 2) if i % 3 == 0]
    assert one[0][2] == sum(x >= 0.5 for x in best) and abs(one[0][4] - np.mean(best)) < 1e-5


def test_quotas_then_the_rest(spark):
    rows = [(1, "a", "basic", 9), (1, "b", "basic", 8), (1, "c", "advanced", 1), (1, "d", "other", 7), (1, "e", None, 6)]
    items = spark.createDataFrame(rows, "k int, t string, level string, w int")
    got = questions.by_quota(items, "k", "level", "w", ["t"], 4, {"basic": 0.25, "advanced": 0.25}).orderBy("rank")
    assert [r.t for r in got.collect()] == ["a", "c", "b", "d"]


def test_relations_in_either_direction(spark):
    k = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc_id int, term string")
    e = spark.createDataFrame([(1, "b", "a"), (1, "a", "c"), (1, "a", "c")], "doc_id int, source string, target string")
    assert sorted(out(relations.related(k, e, "doc_id"))) == [(1, "a", ["b", "c"]), (1, "b", ["a"]), (2, "a", [])]


def test_plan_checks(spark):
    steps = spark.createDataFrame([(1, 1, []), (1, 2, [1, 5]), (1, 3, [3, 2])], "plan_id int, step_id int, depends_on array<int>")
    assert sorted(out(plans.invalid_dependencies(steps))) == [(1, 2, 5, "backward"), (1, 2, 5, "unknown"), (1, 3, 3, "backward")]
    done = spark.createDataFrame([(1, 1, "success", "x"), (1, 2, "failed", "y")], "plan_id int, step_id int, status string, output string")
    assert sorted(out(plans.step_inputs(steps, done))) == [(1, 1, []), (1, 2, ["x"]), (1, 3, [])]


def test_statuses_and_the_last_answer(spark):
    rows = [(1, 1, "success", "reasoning", "a", False), (1, 2, "success", "search", "b", False), (2, 1, "failed", "reasoning", "c", False), (3, 1, "success", "reasoning", "d", True), (4, 1, "failed", "search", "e", False), (4, 2, "success", "search", "f", False)]
    df = spark.createDataFrame(rows, "p int, i int, status string, action string, output string, cancelled boolean")
    assert sorted(out(reports.statuses(df, "p", "i"))) == [(1, "success", "a"), (2, "failed", None), (3, "cancelled", "d"), (4, "partial", None)]


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "success boolean, error string, pairs int, coverage double, seconds double")
    assert out(reports.collected(none)) == [(0, 0, 0, 0)]
    assert out(reports.run_summary(none)) == [(0, 0, 0.0, None, None, None, None)]
    assert out(reports.repeated_values(none, "error")) == [(0,)]


def test_cases(spark):
    cases = spark.createDataFrame([(1, True, "c", "t", "not_found_response"), (2, False, None, None, None), (3, True, None, None, None)], "id int, expected_tool_use boolean, expected_collection string, expected_tool string, expected_behavior string")
    ran = spark.createDataFrame([(1, True, None, "t", "情報がありません。"), (2, False, "x", None, None)], "id int, tool_used boolean, collection string, tool string, answer string")
    assert sorted(out(reports.compared(cases, ran, "id"))) == [(1, False, "collection"), (2, True, ""), (3, False, "route")]


def test_chunks_sampled_evenly(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 0)], "doc_id int, chunk_idx int")
    assert sorted(out(chunks.sampled(df, 4))) == [(1, 0), (1, 2), (1, 4), (1, 6), (2, 0)]


def test_answers(spark):
    df = spark.createDataFrame([("t", "basic", "h", ["a"]), ("t", "advanced", "h", ["a", "b", "c"]), ("t", "advanced", None, []), ("t", "basic", "h", [])], "t string, l string, h string, o array<string>")
    c = [F.col(x) for x in "tlho"]
    got = out(df.select(questions.answer_by_level(*c[:3]), questions.answer_with_related(*c)))
    assert got == [("tは、h", "h "), ("tのh", "h 関連する概念として、a、bがあります。"), ("tの技術的な詳細や応用例が文書内で議論されています。", "tに関する説明"), ("tは、h", "h")]


def test_files_by_name_and_time(spark, tmp_path):
    import os

    for i, (name, n) in enumerate([("b_2.csv", 10), ("b_1.csv", 2048), ("c.txt", 1)]):
        (tmp_path / name).write_text("x" * n)
        os.utime(tmp_path / name, (1_000 + i, 1_000 + i))
    assert [(r["name"], r["size"]) for r in files.history(spark, str(tmp_path)).collect()] == [("c.txt", "1 B"), ("b_1.csv", "2.0 KB"), ("b_2.csv", "10 B")]
    assert files.newest(spark, str(tmp_path), "b_*").endswith("b_2.csv")
    assert files.newest(spark, str(tmp_path), "b_*", by_time=True).endswith("b_1.csv")
    assert files.newest(spark, str(tmp_path), "z*") is None


def test_preprocessing(spark):
    df = spark.createDataFrame([("a  b", "x"), ("a  b", "x"), (None, None), (" ", "y"), ("c", None)], "Question string, other string")
    assert sorted(out(files.preprocessed(df, ["question"]).select("Combined_Text"))) == [("a b",), ("c",)]
    assert files.matching_columns(df, ["questions"]) == ["Question"]
    pairs = spark.createDataFrame([("q", "a"), (" ", "a"), ("q", None)], "question string, answer string")
    assert out(files.complete_pairs(pairs)) == [("q", "a")]
    assert out(files.preview(pairs, ["question"], 1)) == [("q",)]


def test_corpora(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\nline\n\n\n\ntwo ")
    assert sorted(out(files.paragraphs_of(spark, str(tmp_path / "t.txt")))) == [("one\nline",), ("two",)]
    df = spark.createDataFrame([(0, "q", " "), (1, "r", "a")], "n int, question string, answer string")
    assert out(files.entries(df, "n")) == [("## Entry 0\n**question**: q\n\n---\n",), ("## Entry 1\n**question**: r\n**answer**: a\n\n---\n",)]
    (tmp_path / "p.csv").write_text("id,question,answer\n1,q,a\n")
    files.project(spark, str(tmp_path / "p.csv"), str(tmp_path / "o"))
    assert out(spark.read.csv(str(tmp_path / "o"), header=True)) == [("q", "a")]
    with pytest.raises(ValueError):
        files.read(spark, "x.bin")


def test_points_by_payload(spark):
    df = spark.createDataFrame([("a", ("m",)), ("a", ("n",)), ("b", ("m",))], "domain string, payload struct<method string>")
    assert collections.matching(df, domain="a", method="m").count() == 1 and collections.matching(df, domain=None).count() == 3
