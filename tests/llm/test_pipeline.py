import corpus_pipeline
from pyspark.sql import functions as F

from quern.llm import language, segmentation
from tests.llm import plain

D = "/root/testdata/sf0.001"


def test_run(spark):
    got = corpus_pipeline.run(spark, D).toPandas()
    assert got.round_trip.all() and 0 < got.doc_id.nunique() < spark.read.parquet(f"{D}/documents.parquet").count()


def test_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    some = spark.read.parquet(f"{D}/documents.parquet").where(F.length("text") < 900)
    item = spark.read.parquet(f"{D}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    extra = [(9001, "", "en"), (9002, None, "en"), (9003, "1234 !? 99", None), (9004, "wkqz pvxj mmkk zzzt qqwj " * 10, None), (9005, f"some words before it {item}", "en"), (None, "the house of the man is here", "en")]
    docs = some.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, lang string"), allowMissingColumns=True)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{D}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tests = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    left = [(r.doc_id, r.text) for r in docs.collect()]
    model = plain.model_of(language.labelled(docs))

    def fits(text):
        if not language.has_letters(text):
            return False
        (bits, _), n = plain.bits_of(model, text)
        return not (bits > corpus_pipeline.REJECT_BITS and n >= corpus_pipeline.LEAST_SYMBOLS)

    left = sorted((x for x in left if fits(x[1])), key=lambda x: (x[0] is None, x[0] or 0))
    root = plain.roots({k: plain.fingerprint(t) for k, (_, t) in enumerate(left)})
    left = [x for k, x in enumerate(left) if root[k] == k]
    left = [(i, t) for i, t in left if not any(plain.leaks(t, x) for x in tests)]
    want = {i: plain.masked(t) for i, t in left}

    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == set(want) and None in want and 9005 not in want and 9004 not in want
    assert all(r.round_trip for r in got)
    rows = segmentation.encode(spark.createDataFrame(list(want.items()), "doc_id bigint, text string")).collect()
    assert all(r.decoded == want[r.doc_id] for r in rows)
    assert {(r.doc_id, r.sample, tuple(r.ids), r.decoded) for r in got} == {(r.doc_id, r.sample, tuple(r.ids), want[r.doc_id]) for r in rows}


def test_edges_of_the_whole_run(spark, tmp_path):
    """Rows with null ids, shared ids, null and repeated texts through all stages; extra columns; empty tables."""
    some = spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 60").select("doc_id", "text", "lang")
    texts = {r.doc_id: r.text for r in some.collect()}
    item = spark.read.parquet(f"{D}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    own = "quiet rivers carry seventeen painted boats toward the northern harbour while children count lanterns"
    extra = [(None, None, "en"), (None, "", "en"), (None, f"before it {item}", "en"), (8000, f"first {item}", "en"), (8000, own, "en"), (None, own, "en"), (8001, own, "en")]
    extra += [(8002, "a key token = abcdef123456 is here and more words follow it", None)] * 2
    docs = some.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, lang string")).withColumns({c: F.lit(7) for c in ("row", "gone_id", "own_id", "fp", "seed", "own_version")})
    docs.repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.read.parquet(f"{D}/benchmark.parquet").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").where("sample = 0").select("doc_id", "decoded", "round_trip").collect()
    out = [(r.doc_id, r.decoded) for r in got if r.doc_id is None or r.doc_id >= 8000]
    assert all(r.round_trip for r in got) and not any(item in t for _, t in out)
    assert sorted(out, key=str) == sorted([(8000, own), *[(8002, "a key <secret> is here and more words follow it")] * 2], key=str)
    assert {r.doc_id for r in got if r.doc_id is not None} <= set(texts) | {8000, 8002}
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.read.parquet(f"{D}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []
