"""The three classifiers against plain versions of what they compute, and their defined results at the edges."""

import math
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quern.llm import language, quality, toxicity
from tests.llm import plain

D = "/root/testdata/sf0.001"
EDGES = [(-1, None), (-2, ""), (-3, "² ½ ³ 12 !?"), (-4, "zß"), (-5, "word " * 30_000), (-6, "the house"), (-6, "the house"), (None, "the house")]


def both(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    edges = spark.createDataFrame(EDGES, "doc_id bigint, text string")
    return docs, docs.unionByName(edges, allowMissingColumns=True), spark.read.parquet(f"{D}/labels.parquet")


def test_languages_and_scores(spark):
    docs, rows, _ = both(spark)
    model = plain.model_of(language.labelled(docs))
    rows = rows.where("length(text) < 700 OR text IS NULL OR doc_id < 0")
    seen = 0
    for x in language.identify(rows, docs).join(rows.distinct().withColumnRenamed("doc_id", "k"), F.col("doc_id").eqNullSafe(F.col("k"))).collect():
        if len(x.text or "") > 1_000:
            assert x.lang_pred in model.names
        elif not any(map(str.isalpha, x.text or "")):
            assert (x.lang_pred, x.score) == ("und", 0.0)
        else:
            every, n = plain.all_bits(model, x.text)
            share = [(min(every) / b) ** 4 for b in every]
            assert x.lang_pred == model.names[every.index(min(every))] and x.symbols == n
            assert abs(x.score - 1 / sum(share)) < 1e-9 and abs(x.bits - min(every)) < 1e-9
            seen += 1
    assert seen > 30


def test_ties_go_to_the_first_name(spark):
    learnt = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    docs = spark.createDataFrame([(learnt[0], "abc abd", "y"), (learnt[1], "abc abd", "x")], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in language.identify(docs).collect()] == ["x", "x"]


def ftrl(rows):
    """FTRL-proximal, coordinate by coordinate, in dictionaries."""
    z, n = {}, {}

    def weight(i):
        v = z.get(i, 0.0)
        if abs(v) <= toxicity.L1:
            return 0.0
        return -(v - math.copysign(toxicity.L1, v)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for own, y in rows:
            w = {i: weight(i) for i in own}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values())))))
            g = (p - y) * (toxicity.TOXIC_WEIGHT if y else 1.0)
            for i in own:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def words_and_pairs(text):
    mask = (1 << 64) - 1
    w = [xxhash.xxh32_intdigest(x) for x in (text or "").encode().translate(toxicity.TABLE).split()]
    pair = lambda d, m: [((a * m + b) * 0x9E3779B97F4A7C15 & mask) for a, b in zip(w, w[d:], strict=False)]
    every = [x * 0xD6E8FEB86659FD93 & mask for x in w] + pair(1, 0xA0761D6478BD642F) + pair(2, 0xE7037ED1A0B428DB)
    return {x >> (64 - toxicity.BITS) for x in every}


def test_toxicity_by_dictionaries(spark):
    docs, rows, labels = both(spark)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    label = {r.doc_id: r.toxic for r in labels.where("toxic IS NOT NULL").collect() if not held(r.doc_id)}
    texts = sorted((r.doc_id, r.text) for r in docs.where("text IS NOT NULL").collect() if r.doc_id in label)
    weights = ftrl([([*sorted(words_and_pairs(t)), -1], label[i]) for i, t in texts])
    texts_of = {(r.doc_id, r.text) for r in rows.collect()}
    want = {(i, round(1 / (1 + math.exp(-sum(weights.get(f, 0.0) for f in [*words_and_pairs(t), -1]))), 6)) for i, t in texts_of}
    got = toxicity.classify(rows, labels).collect()
    assert len(got) == rows.count() and {(r.doc_id, round(r.score, 6)) for r in got} == want
    assert all(r.predicted == (r.score >= 0.5) for r in got) and weights


def test_quality_by_all_pairs(spark):
    docs, rows, labels = both(spark)
    weights, project, known, label = model = quality.fit(docs, labels)
    unit = lambda v: v / max(float(np.linalg.norm(v)), 1e-12)
    want = {}
    for r in rows.collect():
        x = quality.counts(r.text)
        if not x.any():
            want[r.doc_id] = float(label.mean())
            continue
        v = unit((x * weights).astype(float) @ project)
        near = sorted((-round(float(v @ k.astype(float)), quality.PLACES), i) for i, k in enumerate(known))[: quality.NEIGHBOURS]
        vote = [(max(-c, 1e-3) ** quality.SHARPNESS, label[i]) for c, i in near]
        want[r.doc_id] = float(sum(a * b for a, b in vote) / sum(a for a, _ in vote))
    got = quality.classify(rows, labels).collect()
    assert len(got) == rows.count() and all(abs(r.score - want[r.doc_id]) < 1e-4 for r in got)  # sums of floats differ in the last places
    assert all(r.predicted == (r.score >= 0.3) for r in got) and model


def test_equally_near_neighbours():
    """Forty equal vectors: the first fifteen vote, wherever the row stands in its block."""
    x = np.zeros((3, 2 * quality.HASHED), np.float32)
    x[1:, 5] = 1
    project = np.zeros((2 * quality.HASHED, 2))
    project[5, 0] = 1
    labels = np.array([1.0] * 5 + [0.0] * 35, np.float32)
    model = (np.ones(2 * quality.HASHED, np.float32), project, np.tile([1.0, 0.0], (40, 1)), labels)
    assert np.allclose(quality.votes(x, model), [5 / 40, 1 / 3, 1 / 3])


def test_sample_without_labels(spark):
    docs, rows, labels = both(spark)
    for op in (toxicity, quality):
        assert {r.score for r in op.classify(rows.where("doc_id < 0"), labels.limit(0)).collect()} == {0.5}
    assert {x.lang_pred for x in language.identify(rows.where("doc_id < 0"), docs.limit(0)).collect()} == {"und"}
