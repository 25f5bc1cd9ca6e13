"""Points read page by page, named vectors, compound nouns."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.operators import compounds, keywords
from quern.sources import named, points


def test_pages_ranges_and_pushed_filters(spark, tmp_path):
    rows = [(i, "news" if i % 3 else "wiki", float(i)) for i in range(1, 500)] + [(None, "news", None)]
    spark.createDataFrame(rows, "id bigint, domain string, x double").repartition(3).write.parquet(str(tmp_path / "p"))
    points.register(spark)
    read = spark.read.format(points.NAME).option("partitions", 5).option("page", 16).load(str(tmp_path / "p"))
    assert read.rdd.getNumPartitions() == 5 and sorted(map(str, map(tuple, read.collect()))) == sorted(map(str, rows))
    asked = read.where("domain = 'wiki' AND id > 100 AND x IS NOT NULL AND length(domain) = 4")
    assert {r.id for r in asked.collect()} == {i for i in range(101, 500) if i % 3 == 0}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan(asked)  # the store has been asked for all of it
    assert "Filter (" in plan(read.where("length(domain) = 4"))
    reader = points.Reader({"path": str(tmp_path / "p")})
    left = list(reader.pushFilters([points.EqualTo(("domain",), "wiki")]))
    assert not left and sum(len(b) for p in reader.partitions() for b in reader.read(p)) == 166  # the store gives no other points
    assert read.where("domain IN ('a', 'wiki')").count() == 166 and read.where("x IS NULL").count() == 1


def test_pages_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "id bigint, domain string").write.parquet(str(tmp_path / "p"))
    points.register(spark)
    assert spark.read.format(points.NAME).load(str(tmp_path / "p")).count() == 0


def test_named_vectors(spark, tmp_path):
    kind = "id bigint, dense array<double>, words map<int,float>, note string"
    a, b, c = (str(tmp_path / x) for x in "abc")
    for p in (a, b):
        named.create(spark, p, {"dense": named.Vector(2), "words": named.Vector(0, "sparse")})
    assert named.put(spark.createDataFrame([(1, [1.0, 0.0], {1: 1.0}, "x"), (2, [0.0, 1.0], None, "y"), (4, None, {2: 1.0}, "n")], kind), a, 0)
    assert named.put(spark.createDataFrame([(2, [1.0, 1.0], {1: 2.0}, "z"), (3, [-1.0, 0.0], {2: 5.0}, "w")], kind), b, 0)
    named.merged(spark, [a, b], c)
    q = spark.createDataFrame([(9, [1.0, 0.1], {1: 1.0})], "id bigint, dense array<double>, words map<int,float>")
    assert [r.id for r in sorted(named.search(spark, c, q, "dense", 2).collect(), key=lambda r: r.rank)] == [1, 2]
    assert [(r.id, r.score) for r in sorted(named.search(spark, c, q, "words", 5).collect(), key=lambda r: r.rank)] == [(2, 2.0), (1, 1.0)]
    assert named.read(spark, c).count() == 4
    with pytest.raises(PySparkException, match="2 numbers, not of 3"):
        named.put(spark.createDataFrame([(5, [1.0, 2.0, 3.0], None, "")], kind), a, 1)
    with pytest.raises(PySparkException, match="2 numbers, not of 1"):
        named.search(spark, a, spark.createDataFrame([(9, [1.0])], "id bigint, dense array<double>"), "dense", 1).collect()
    with pytest.raises(ValueError, match="no vectors called"):
        named.put(spark.createDataFrame([(5, "")], "id bigint, note string"), a, 1)
    with pytest.raises(ValueError, match="no vectors called other"):
        named.search(spark, a, q, "other", 1)
    named.create(spark, b, {"dense": named.Vector(3)}, again=True)
    with pytest.raises(ValueError, match="in one collection"):
        named.merged(spark, [a, b], str(tmp_path / "d"))
    with pytest.raises(ValueError, match="no collection"):
        named.catalogue(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no such vector"):
        named.create(spark, str(tmp_path / "e"), {"x": named.Vector(3, "sparse")})
    assert named.put(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id bigint, dense array<double>"), b, 0) and named.read(spark, b).count() == 1


DICTIONARY = [("東", "noun", 4.0), ("京", "noun", 4.0), ("東京", "noun", 3.0), ("京都", "noun", 3.0), ("都", "suffix", 2.0), ("に", "particle", 1.0), ("ab", "noun", 2.0), ("b", "verb", 1.5), ("a", "other", 1.0), ("ab", "verb", 2.5)]
LINKS = {("noun", "suffix"): -1.0, ("noun", "verb"): 0.5, ("", "verb"): 3.0}


def all_paths(text):
    if not text:
        yield 0.0, []
        return
    for s, pos, cost in [*DICTIONARY, (text[0], compounds.UNKNOWN, compounds.UNKNOWN_COST)]:
        if text.startswith(s):
            for rest, path in all_paths(text[len(s) :]):
                yield cost + rest, [(s, pos), *path]


def cost(path):
    known = {(s, p): c for s, p, c in DICTIONARY}
    before = ["", *[p for _, p in path]]
    return sum(known.get(w, compounds.UNKNOWN_COST) for w in path) + sum(LINKS.get((a, b), 0.0) for a, b in zip(before, before[1:], strict=False))


def test_cheapest_of_all_paths():
    r = random.Random(6)
    for _ in range(150):
        text = "".join(r.choice("東京都にabz") for _ in range(r.randint(0, 8)))
        ending = {}
        for end in range(1, len(text) + 1):
            ending[end] = [w for w in DICTIONARY if text[:end].endswith(w[0])]
        path = compounds.cheapest(text, ending, LINKS)
        assert "".join(s for s, _ in path) == text
        assert abs(cost(path) - min(cost(p) for _, p in all_paths(text))) < 1e-9


def test_compounds_feed_keywords(spark):
    dictionary = spark.createDataFrame([*DICTIONARY, ("", "noun", 0.0), (None, "noun", 0.0), ("ab", "noun", 9.0)], "surface string, pos string, cost double")
    df = spark.createDataFrame([(1, "東京京都に東京、東京"), (2, None), (3, ""), (4, "zzz")], "doc_id int, text string")
    got = compounds.compounds(df, dictionary, "doc_id", "text", connections=LINKS)
    assert sorted(map(tuple, got.collect())) == [(1, "東京", 2, 5), (1, "東京京都", 1, 0)]
    more = compounds.ranked(got, "doc_id", 5)
    assert [(r["rank"], r.term) for r in more.orderBy("rank").collect()] == [(1, "東京"), (2, "東京京都")]
    assert {"東京", "東京京都"} <= {r.term for r in keywords.integrated(df, "doc_id", "text", 5, [], [], more).collect()}
    assert compounds.compounds(df, dictionary.where(F.lit(False)), "doc_id", "text").count() == 0


def test_compounds_by_stretches_are_those_of_whole_texts(spark):
    r = random.Random(7)
    texts = [(i, "".join(r.choice("東京都にab zé\n") for _ in range(r.randint(0, 40)))) for i in range(300)] + [(300, "ab" * 50 + " b"), (301, "z]-^ab")]
    df = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    rows = [*DICTIONARY, ("-", "other", 1.0), ("]", "noun", 1.0), ("^", "noun", 1.0)]
    dictionary = spark.createDataFrame(rows, "surface string, pos string, cost double")
    links = LINKS | {("noun", "unknown"): 2.0, ("unknown", "verb"): -1.5, ("unknown", "noun"): 0.5}
    for nouns in (("noun",), ("noun", "unknown")):
        expect = []
        for i, t in texts:
            ending = {e: [(s, p, c) for s, p, c in rows if t[:e].endswith(s)] for e in range(1, len(t) + 1)} if i < 20 or i > 299 else None
            if ending and any(ending.values()):
                expect += [(i, c, p) for c, p in compounds.joined(compounds.cheapest(t, ending, links), frozenset(nouns))]
        firsts = {}
        for i, c, p in expect:
            firsts.setdefault((i, c), []).append(p)
        got = compounds.compounds(df, dictionary, "doc_id", "text", nouns, links)
        assert {(x.doc_id, x.term): (x.n, x["at"]) for x in got.collect() if x.doc_id < 20 or x.doc_id > 299} == {k: (len(v), v[0]) for k, v in firsts.items()}
        top = compounds.ranked(compounds.compounds(df, dictionary, "doc_id", "text", nouns, links, most=2), "doc_id", 2)
        assert sorted(map(tuple, top.collect())) == sorted(map(tuple, compounds.ranked(got, "doc_id", 2).collect()))


def test_stretches_that_come_again_are_walked_once(spark, monkeypatch):
    walked = []
    monkeypatch.setattr(compounds, "cheapest", lambda *a, f=compounds.cheapest: walked.append(a[0]) or f(*a))
    lexicon = compounds.Lexicon([("ab", "noun", 1.0)], frozenset(["noun"]), {}).ready()
    found = [lexicon.known(m[0], compounds.UNKNOWN, compounds.UNKNOWN) for m in lexicon.stretches(" ab" * 1_000 + " ")]
    assert found == [[("ab", 0)]] * 1_000 and walked == ["ab"]
