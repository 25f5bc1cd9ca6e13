import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import lines

LINES = ["A shared line here", "  a SHARED line here\t", "short", "exactly10c", "exactly9c", "ÄÖ other letters stay", "äö other letters stay", "", " ", "x  padded by nbsp  ", "one more line\r"]


def key(x):
    return re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", x).translate({c: c + 32 for c in range(65, 91)})


def plain(rows):
    owner = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(k := key(x)) >= 10 and i is not None:
                owner[k] = min(i, owner.get(k, i))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not (key(x) in owner and (i is None or owner[key(x)] < i))]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(map(str, out))


def made(n):
    rows = []
    for i in range(n):
        own = [LINES[(i * a + a * a) % len(LINES)] for a in range(1, i % 7 + 1)] + [f"line of document number {i}"] * (i % 3)
        rows.append(((i * 37) % n if i % 5 else (i * 37) % n // 10, "\n".join(own)))
    return rows + [(None, "one more line\nnull only line"), (None, "null only line\nanother text"), (None, None), (3, None), (4, ""), (7, "A shared line here"), (7, "A shared line here")]


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("batches", [1, 4, 7])
def test_against_plain(spark, parts, batches):
    rows = made(150)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("batch", "pos", "h", "g", "owner", "version")}).repartition(parts)
    got = lines.deduplicate(docs, batches).select("doc_id", "n_lines", "n_dropped", "kept_sha256", "kept").collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows)


def test_one_line_in_all_and_one_id_for_all(spark):
    rows = [(i, f"the line of all\nown line number {i}") for i in range(500)] + [(1_000, f"the line of all\ntext number {i}") for i in range(300)]
    got = lines.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_lines", "n_dropped", "kept_sha256", "kept").collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows)


def test_empty(spark):
    assert lines.deduplicate(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_runs_are_merged_by_level_and_disjoint(spark):
    runs, seen = lines.Runs(spark), defaultdict(int)
    for k in range(6):
        docs = spark.createDataFrame([(k * 100 + i, f"line number {(k * 7 + i) % 30} of it") for i in range(12)], "doc_id bigint, text string")
        for r in runs.add(lines.hashed(docs)).collect():
            seen[r.h, r.g] += 1
    assert [len(x) for x in runs.levels] == [2, 0, 1]  # 4 + 2 batches
    assert len(seen) == 30 and set(seen.values()) == {1}
    assert sum(spark.table(t).count() for level in runs.levels for t in level) == 30
    runs.close()


def test_merge_reads_runs_as_they_are(spark):
    runs = lines.Runs(spark)
    docs = spark.createDataFrame([(i, f"line number {i} of it") for i in range(50)], "doc_id bigint, text string")
    runs.add(lines.hashed(docs))
    with lines._ordered(spark):
        run = spark.table(runs.levels[0][0])
        plan = run.join(run.hint("merge"), ["h", "g"], "full")._jdf.queryExecution().executedPlan().toString()
    runs.close()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
