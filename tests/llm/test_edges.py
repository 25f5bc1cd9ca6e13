import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontamination, language, licenses, quality, repeats, search, secrets, segmentation, simhash, toxicity

NAMES = ["row", "h", "k", "l", "r", "seed", "w", "s", "at", "_doc", "_a", "_b", "secret_spans", "label", "term", "terms", "size", "fp", "node", "x", "hit", "held_out", "score", "component_id"]
ROWS = [(1, None), (2, ""), (3, "token = abcdef12 the mit license"), (3, "token = abcdef12 the mit license"), (None, "a b c d e f g h i j k"), (None, None), (40, "word " * 20_000)]


@pytest.fixture(scope="module")
def parts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("bigint")} | {n: F.lit(7) for n in NAMES})
    tests = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, None), (None, "")], "item_id bigint, text string").withColumns({n: F.lit(7) for n in NAMES})
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 1, 1), (None, 1, 1), (2, None, None), (40, 0, 0)], "doc_id bigint, quality int, toxic int").withColumns({n: F.lit(7) for n in NAMES if n != "label"})
    return docs, tests, labels


ROWWISE = {
    "repeats": lambda d, t, y: repeats.deduplicate(d),
    "licenses": lambda d, t, y: licenses.scan(d),
    "secrets": lambda d, t, y: secrets.scan(d),
    "masked": lambda d, t, y: secrets.masked(d),
    "simhash": lambda d, t, y: simhash.near_duplicates(d),
    "language": lambda d, t, y: language.identify(d),
    "toxicity": lambda d, t, y: toxicity.classify(d, y),
    "quality": lambda d, t, y: quality.classify(d, y),
}


@pytest.mark.parametrize("name", ROWWISE)
def test_row_by_row(spark, parts, name):
    docs, tests, labels = parts
    assert ROWWISE[name](docs, tests, labels).count() == len(ROWS)
    assert ROWWISE[name](docs.limit(0), tests.limit(0), labels.limit(0)).count() == 0


def test_others(spark, parts):
    docs, tests, _ = parts
    assert [(r.doc_id, r.item_id) for r in decontamination.overlaps(docs, tests).collect()] == [(None, 1)]
    assert decontamination.clean(docs, tests).columns == docs.columns
    assert simhash.one_of_each(docs).columns == docs.columns == secrets.masked(docs).columns
    assert corpus_pipeline.known_language(spark, docs, "").columns == docs.columns
    assert {r.sample for r in segmentation.encode(docs).collect()} == {0, 1}
    assert {(r.query_id, r.doc_id) for r in search.top_k(docs, search.every_twentieth(docs)).collect()} == {(40, 40)}
    for op in (decontamination.clean, decontamination.overlaps):
        assert op(docs.limit(0), tests).count() == op(docs.limit(0), tests.limit(0)).count() == 0
    assert decontamination.clean(docs, tests.limit(0)).count() == len(ROWS)
    assert simhash.one_of_each(docs.limit(0)).count() == segmentation.encode(docs.limit(0)).count() == 0
