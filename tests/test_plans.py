import re

import pytest
from pyspark.sql import functions as F

from quern.operators import confidence, feedback, plans, questions, relations, results
from quern.sources import collections

STEP = "step_id int, action string, description string, depends_on array<int>, fallback string"


def ask(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_relations(spark):
    rows = [(1, "猫は動物である。犬と猫と鳥。犬と猫と鳥", ["動物", "猫", "犬", "鳥"]), (2, None, ["a", "b"]), (3, "a b", []), (4, "x", None)]
    got = relations.relations(spark.createDataFrame(rows, "id int, text string, t array<string>"), "id", "text", "t").collect()
    assert {tuple(r) for r in got} == {
        (1, "猫", "動物", "is_a", "猫は動物である"),
        (1, "猫", "犬", "co_occurs", "犬と猫と鳥"), (1, "猫", "鳥", "co_occurs", "犬と猫と鳥"), (1, "犬", "鳥", "co_occurs", "犬と猫と鳥"),
    }


def plain(text, n=5):
    phrase = lambda s: (re.findall(questions.PHRASE, s or "", re.ASCII) or [None])[0]
    s = [x.strip() for x in text.split(". ")]
    s = [x for x in s if len(x) > 20]
    out = [(questions.ASKED_EN["whole"], text[:500])] if s and len(text) > 50 else []
    for i, x in enumerate(s[: n - 1]):
        c = phrase(x[:50])
        out.append((questions.ASKED_EN["fact"].format(c) if c else questions.ASKED_EN["context"].format(x[:50]), " ".join(s[i : i + 2])))
        if i:
            a, b = phrase(x[:30]), phrase(s[i - 1][:30])
            out.append((questions.ASKED_EN["relation"].format(a, b) if a and b else questions.ASKED_EN["before"].format(x[:30]), " ".join(s[i - 1 : i + 1])))
        if phrase(x):
            out.append((questions.ASKED_EN["about"].format(phrase(x)), x))
    if s and len(text) > 100:
        c = phrase(s[0][:50])
        out.append((questions.ASKED_EN["theme"].format(c) if c else questions.ASKED_EN["themes"], text[:400]))
    return out[:n]


def test_questions_by_chunk(spark):
    texts = [
        "The Great Wall is a very long wall. it was built by many people over time. The Moon and Mars are far from here",
        "Short is the text and the end is near. ok. And the Second Sentence is also long enough", "the a. the b", "",
    ]
    got = {}
    for r in questions.by_chunk(spark.createDataFrame([*enumerate(texts), (9, None)], "id int, text string"), "id", "text", 20).collect():
        got.setdefault(r.id, []).append((r.i, r.question, r.answer))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: plain(t, 20) for k, t in enumerate(texts) if plain(t, 20)}
    ja = questions.by_chunk(spark.createDataFrame([(1, "東京タワーは日本の首都である東京にある高い電波塔です。次の文")], "id int, text string"), "id", "text").collect()
    assert [r.type for r in ja] == ["factual_detailed", "keyword_based", "keyword_based"]


def test_triggers_and_strategies(spark):
    c = F.col
    rows = [("failed", 0.9, 0, None), ("success", 0.1, 0, None), ("success", 0.9, 1, "別の方法"), ("failed", 0.0, 3, None), (None, None, 0, None)]
    assert ask(spark, rows, "s string, x double, n int, f string", plans.trigger(c("s"), c("x"), c("n"), c("f"))) == ["step_failed", "low_confidence", "user_feedback", None, None]
    rows = [("step_failed", 3, 1, "r", None), ("step_failed", 0, 1, "r", None), ("timeout", 0, 3, None, None), ("user_feedback", 0, 1, None, "最初から別の"), ("user_feedback", 0, 1, None, "別の"), ("step_failed", 0, 1, None, None), ("low_confidence", 0, 2, "", None)]
    got = ask(spark, rows, "w string, n int, s int, b string, f string", plans.strategy(c("w"), c("n"), c("s"), F.lit(3), c("b"), c("f")))
    assert got == ["abort", "fallback", "full", "full", "partial", "full", "partial"]


def test_rewritten_plans(spark):
    steps = [(1, "rag_search", "find", [], "web_search"), (2, "reasoning", "think", [1], None)]
    df = spark.createDataFrame([(1, steps), (None, steps)], f"failed int, steps array<struct<{STEP}>>")
    of = lambda d: [tuple(map(tuple, r.steps)) for r in d.collect()]
    plain_steps = tuple((a, b, c, d, e) for a, b, c, d, e in steps)
    assert of(plans.with_fallback(df, "failed")) == [((1, "web_search", "[代替] find", [], None), plain_steps[1]), plain_steps]
    assert of(plans.without_step(df, "failed")) == [((2, "reasoning", "think", [], None),), plain_steps]
    again = of(plans.renumbered(df.withColumn("done", F.lit(2)), "done"))[0]
    assert [(s[0], s[3]) for s in again] == [(3, [2]), (4, [3])]
    assert [(s[0], s[3]) for s in of(plans.renumbered(df.withColumn("done", F.lit(0)), "done"))[0]] == [(1, []), (2, [1])]


def test_inherited(spark):
    steps = spark.createDataFrame([(1, 1, "rag_search", []), (1, 2, "reasoning", [1]), (1, 3, "reasoning", [2]), (1, 4, "rag_search", [1])], "plan_id int, step_id int, action string, depends_on array<int>")
    done = spark.createDataFrame([(1, 1, "success", 3, 0.8), (1, 2, "success", 0, 0.2), (1, 3, "failed", 0, 0.5), (1, 4, "success", 0, 0.1)], "plan_id int, step_id int, status string, n_results int, confidence double")
    assert {r.step_id: r.confidence for r in plans.inherited(steps, done).collect()} == {1: 0.8, 2: 0.8, 3: 0.0, 4: 0.1}


def test_confidence_and_results(spark):
    rows = [(0.8, 0.99, True), (0.8, 0.7, True), (0.8, 0.99, False)]
    assert ask(spark, rows, "j double, f double, s boolean", confidence.overridden(F.col("j"), F.col("f"), F.col("s"))) == [0.99, 0.8, 0.8]
    found = spark.createDataFrame([(1, "b"), (1, "a"), (1, ""), (1, "b"), (2, None)], "q int, source string")
    assert {r.q: r.sources for r in results.sources(found, "q", "source").collect()} == {1: ["a", "b"], 2: []}
    assert ask(spark, [(0, None), (2, 0.5), (2, 0.9), (None, None)], "n int, top double", results.status(F.col("n"), F.col("top"))) == ["no_result", "low_score", "found", "no_result"]
    text = spark.range(1).select(results.as_text(F.lit(1), F.lit(0.5), F.lit("q"), F.lit("a"), F.lit("s"))).first()[0]
    assert "0.50" in text and "Q: q\nA: a\n" in text


def test_collections(spark, tmp_path):
    pairs = spark.createDataFrame([(0, "q", "a", [1.0]), (1, "p", "b", [2.0])], "i int, question string, answer string, v array<double>")
    one, two = (collections.points(pairs, "i", "v", "news", f"/x/{f}.csv") for f in ("f", "f"))
    assert [r.id for r in one.collect()] == [r.id for r in two.collect()] and all(r.id >= 0 and r.payload.source == "f.csv" for r in one.collect())
    with pytest.raises(Exception, match="no vector"):
        collections.points(pairs.withColumn("v", F.when(F.col("i") == 0, F.col("v"))), "i", "v", "news", "f").collect()
    path = str(tmp_path / "c")
    collections.create(one.unionByName(collections.points(pairs, "i", "v", "other", "g")), path)
    assert collections.delete_domain(spark, path, "news", dry_run=True) == 2 and spark.read.parquet(path).count() == 4
    assert collections.delete_domain(spark, path, "news") == 2 and [r.domain for r in spark.read.parquet(path).collect()] == ["other"] * 2
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert collections.to_drop(names, names.limit(1)).count() == 1
    of = collections.files_of(
        spark.createDataFrame([("qa_x",), ("y",), ("z",)], "collection string"), spark.createDataFrame([("y", "own.csv"), ("z", "")], "collection string, source string"), spark.createDataFrame([("x.csv",), ("qa_y.csv",)], "file string")
    )
    assert {r.collection: r.file for r in of.collect()} == {"qa_x": "x.csv", "y": "own.csv", "z": None}
    collections.save_pairs(pairs.select("question", "answer"), str(tmp_path), "p")
    assert spark.read.json(str(tmp_path / "p.json")).count() == 2 and spark.read.json(str(tmp_path / "p.metadata")).first().total_pairs == 2
    merged = ask(spark, [('{"a":"1","b":"2"}', '{"b":"3"}'), ("no", None)], "x string, y string", collections.merged_maps(F.col("x"), F.col("y")))
    assert merged == [{"a": "1", "b": "3"}, {}]
    assert ask(spark, [([0.0] * 1536,), ([1.0],)], "v array<double>", collections.embedding_model(F.col("v"))) == ["text-embedding-3-small", "unknown-embedding-model"]


def plain_layers(text):
    out = [(1, questions.LAYERS_EN[0], text[:500])]
    parts = text.split("\n\n") if "\n\n" in text else [text[i : i + 500] for i in range(0, len(text), 400)]
    out += [(2, questions.LAYERS_EN[1].format(p[:30]), p) for p in parts[:4] if len(p.strip()) > 50]
    for e in list(dict.fromkeys(re.findall(questions.LAYERS_EN[3], text, re.ASCII)))[:6]:
        out.append((3, questions.LAYERS_EN[2].format(e), next(s for s in re.split("[。.!?]", text) if e in s)))
    return out


def test_layered_questions(spark):
    texts = ["", "New York is far. NASA and Old\nTown! New York again", "word " * 330, "a " * 40 + "\n\n" + "b " * 20 + "\n\n" + "C d " * 30]
    got = {}
    for r in questions.layered(spark.createDataFrame([*enumerate(texts), (9, None)], "id int, text string"), "id", "text").collect():
        got.setdefault(r.id, []).append((r.layer, r.question, r.answer))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(plain_layers(t)) for k, t in enumerate(texts)}


def test_until_covered(spark):
    chunks = spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k} delta{k}") for k in range(7)], "id bigint, text string")
    none = chunks.limit(0).select(F.col("text").alias("question"), F.col("text").alias("answer"))
    pairs, rate = feedback.until_covered(chunks, none, "id", "text", 0.7, target=1.0, n=3)
    assert rate == 1.0 and sorted(r["round"] for r in pairs.collect()) == [1, 1, 1, 2, 2, 2, 3]
    pairs, rate = feedback.until_covered(chunks, none, "id", "text", 0.7, rounds=1, n=3)
    assert pairs.count() == 3 and 0.4 < rate < 0.5
