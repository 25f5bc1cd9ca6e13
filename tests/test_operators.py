import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunks, confidence, coverage, profile, vectors
from quern.operators.components import components
from quern.sources import files
from quern.streaming import events


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def plain_sentences(text):
    parts = re.findall(r"[^。．.！？!?]+[。．.！？!?]\s*", text)
    at = 0
    for p in parts:
        at = text.index(p, at) + len(p)
    return [s for s in (x.strip(" \t\n\r") for x in ([*parts, text[at:]] if parts else [text])) if s]


def test_sentences(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("ab .!?。\n") for _ in range(r.randint(0, 25))) for _ in range(300)] + ["これは文です。次？はい！", ""]
    got = spark.createDataFrame([(t,) for t in texts], "v string").select("v", T.sentences(F.col("v")).alias("s")).collect()
    assert all(x.s == plain_sentences(x.v) for x in got)
    assert all(chunks.split_sentences(t) == plain_sentences(t) for t in texts)


def test_text_functions(spark):
    assert one(spark, T.clean, "  a\n\n b ") == "a b" and one(spark, T.clean, None) == ""
    assert one(spark, T.half_width, "ＡＢ　１。。、、") == "AB 1。、"
    assert [one(spark, T.estimated_tokens, v) for v in ("ABCD", "あいう", "", "a")] == [1, 1, 0, 1]
    assert one(spark, T.paragraphs, "a\n\n b \n \nc") == ["a", "b", "c"]
    assert one(spark, T.terms, "カタカナ漢字 abc A1") == ["カタカナ", "漢字", "abc"]


def test_chunks():
    assert [c[0] for c in chunks.pack("あ" * 100 + "。\n\n" + "b" * 240, 200, 50)] == ["paragraph", "paragraph"]
    assert {c[0] for c in chunks.pack("x" * 5000, 200, 50)} == {"forced_split"}
    assert chunks.pack("", 200, 50) == []
    cut = chunks.pack("あ" * 2000, 200, 50)
    assert "".join(c[1] for c in cut) == "あ" * 2000 and all(c[2] <= 200 for c in cut) and len(cut) == 5
    assert chunks.pack("a b.\n\n" + "c" * 40, 200, 50) == [("paragraph", "a b. " + "c" * 40, 11)]
    assert chunks.pack_sentences("One. Two! " + "x" * 700 + ". End.", 100) == [("One. Two!", 2, 0, 1), ("x" * 700 + ".", 175, 2, 2), ("End.", 1, 3, 3)]
    assert chunks.joined_small([(0, "a" * 400), (1, "b" * 41), (2, "c" * 41), (3, "d" * 1000), (4, "e")], 150, 400) == [
        (0, 121, "a" * 400 + "\n\n" + "b" * 41 + "\n\n" + "c" * 41, [0, 1, 2]), (3, 250, "d" * 1000, [3]), (4, 1, "e", [4]),
    ]


def test_confidence_of_a_step(spark):
    rows = [(True, 0.8, 0.5, 0.9, 0.0, 1.0, 0, 3), (True, 0.8, 0.5, 0.9, 0.0, 0.5, 0, 0), (False, 0.9, 0.8, 0.7, 0.5, 1.0, 2, 0), (False, 0.0, 0.0, 0.5, 0.0, 1.0, 0, 0), (False, 0.0, 0.0, 0.8, 0.0, 1.0, 0, 0)]
    df = spark.createDataFrame(rows, "search boolean, quality double, agreement double, own double, covered double, success double, sources int, found int")
    c = F.col
    factor, names = confidence.penalties(c("search"), c("found"), c("success"), c("sources"), c("own"))
    got = df.select(confidence.score(c("search"), c("quality"), c("agreement"), c("own"), c("covered"), c("success"), c("sources"), factor).alias("s"), names.alias("n")).collect()
    assert [r.s for r in got] == [0.8, 0.126, 0.85, 0.7, round((0.4 + 0.24) / 0.7, 3)]
    assert got[1].n == ["no_search_results", "tool_failures(rate=0.50)", "no_sources"] and got[3].n == ["no_sources"] and not got[0].n


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.sim for r in vectors.top_k(v, v.where("vec_id = 1"), 3).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (1, 3): 0.0}
    best = vectors.best(v.where("vec_id < 3"), v.where("vec_id < 3"))
    assert {r.level: r.rate for r in coverage.levels(best).collect()} == {"strict": 1.0, "standard": 1.0, "lenient": 1.0}
    assert vectors.top_k(v, v.limit(0), 3).collect() == []


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(200, 200 + i) for i in range(1, 30)]
    root = {n: n for e in edges for n in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: c for n, c in root.items() if n != c}


def test_confidence(spark):
    s = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.6), (2, 1, 0.2)], "p int, i int, s double")
    got = {r.p: r for r in confidence.aggregated(s, "p", "i", "s").collect()}
    assert (got[1].mean, got[1].least, got[1].weighted, got[1].critical) == (0.75, 0.6, 0.7, False) and got[2].checked == 0.14
    fed = spark.createDataFrame([(1, i, 0.95, False) for i in range(10)], "user_id bigint, ts int, confidence double, was_correct boolean")
    assert tuple(confidence.thresholds(fed).first()) == (1, 0.95, 0.75, 0.45)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Question,Answer\nq,"x\ny"\nq,"x\ny"\n')
    (tmp_path / "a.txt").write_text("one\n\n two \n")
    (tmp_path / "a.jsonl").write_text('{"text": "abc"}\n{"text": " "}\n')
    assert files.questions(files.read(spark, str(tmp_path / "a.csv"))).count() == 1
    assert [r.text for r in files.read(spark, str(tmp_path / "a.txt")).collect()] == ["one", "two"]
    docs = files.combined(files.read(spark, str(tmp_path / "a.jsonl")))
    assert [r.Combined_Text for r in docs.collect()] == ["abc"]
    files.save(docs, str(tmp_path / "out"), "d")
    assert spark.read.text(str(tmp_path / "out/d.txt")).first()[0] == "abc"
    (tmp_path / "tree/c").mkdir(parents=True)
    (tmp_path / "tree/c/x.txt").write_text("u\nd\nt\nbody\nmore\n")
    assert tuple(files.articles(spark, str(tmp_path / "tree")).first()) == ("u", "d", "t", "body\nmore", "c")
    with pytest.raises(ValueError):
        files.read(spark, "x.bin")


def test_upsert_stream(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "id int, v string")
    rows((1, "a"), (2, "b")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id int, v string").parquet(str(tmp_path / "in"))
    run = lambda: events.upsert_into(stream(), str(tmp_path / "t"), "id", str(tmp_path / "c")).awaitTermination()
    run()
    rows((2, "c"), (3, "d")).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "t/v=1")).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert profile.merged({"a": rows((1, "x")), "b": rows((1, "y"))}, "id").select("id").distinct().count() == 2


def test_vectors_stay_in_tasks(spark, monkeypatch):
    """Several blocks on both sides, and no vectors fetched by the driver."""
    monkeypatch.setattr(vectors, "BLOCK", 32)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", None)
    r = np.random.default_rng(1)
    x, y = r.normal(size=(70, 5)), r.normal(size=(50, 5))
    frame = lambda v, first: spark.createDataFrame([(first + i, row.tolist()) for i, row in enumerate(v)], "vec_id bigint, embedding array<double>")
    sim = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T, 6)
    best = {b.vec_id: b.best for b in vectors.best(frame(x, 0), frame(y, 100)).collect()}
    assert best == dict(enumerate(sim.max(axis=1)))
    got = {(b.query_id, b.rank): (b.vec_id, b.sim) for b in vectors.top_k(frame(y, 100), frame(x, 0), 4).collect()}
    want = {(i, k + 1): (100 + j, row[j]) for i, row in enumerate(sim) for k, j in enumerate(np.argsort(-row, kind="stable")[:4])}
    assert got == want
