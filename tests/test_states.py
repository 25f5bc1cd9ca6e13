"""Thresholds in one fold, in two and as a stream; results that expire; confidences along a plan."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import confidence
from quern.streaming import events


def plain(rows, last=10):
    state, recent = confidence.START, []
    for _, x, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        recent = [*recent, (x, ok)][-last:]
        state = confidence.moved(state, recent, last)
    return state


def feedback(seed, n):
    r = random.Random(seed)
    return [(i // 2, round(r.random(), 2), r.random() < (0.1 if i // 40 % 2 else 0.95)) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 2, 7, 40, 90])
def test_thresholds_do_not_depend_on_the_cut(spark, parts):
    rows = {1: feedback(1, 400), 2: feedback(2, 9), 3: feedback(3, 30), None: feedback(4, 12)}
    df = spark.createDataFrame([(k, *r) for k, of in rows.items() for r in of], "user_id bigint, ts int, confidence double, was_correct boolean")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r[0]: tuple(r)[1:] for r in confidence.thresholds(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {k: plain(of) for k, of in rows.items()}
    assert confidence.thresholds(df.limit(0)).count() == 0


def test_null_feedback(spark):
    df = spark.createDataFrame([(1, i, None, None) for i in range(12)], "user_id bigint, ts int, confidence double, was_correct boolean")
    assert tuple(confidence.thresholds(df).first()) == (1, *confidence.START)


def drained(stream, name, mode, folder):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_thresholds_of_a_stream(spark, tmp_path):
    kind = "user_id bigint, ts int, confidence double, was_correct boolean"
    rows = feedback(5, 60)
    for i in range(3):
        spark.createDataFrame([(7, *r) for r in rows[20 * i : 20 * i + 20]], kind).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    drained(events.adjusting(source), "adjusting", "update", tmp_path / "c")
    got = spark.table("adjusting").collect()
    assert len(got) == 3 and tuple(got[-1])[1:] == plain(rows)


def test_results_expire(spark, tmp_path):
    steps = [[("a", "10:00"), ("b", "10:30"), ("n", None)], [("a", "10:20"), ("b", "10:10")], [("c", "12:00")], [("d", "12:01"), ("old", "10:59")], [("d", "12:02")]]
    for i, rows in enumerate(steps):
        df = spark.createDataFrame([(k, t and f"2024-01-01 {t}:00") for k, t in rows], "task_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema("task_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    drained(events.expiring(source, late="1 minute"), "expiring", "append", tmp_path / "c")
    got = {(r.task_id, f"{r.ts:%H:%M}", r.status) for r in spark.table("expiring").collect()}
    assert {("a", "10:00", "kept"), ("a", "10:20", "kept"), ("b", "10:30", "kept"), ("a", "10:20", "expired"), ("b", "10:30", "expired"), ("c", "12:00", "kept"), ("d", "12:01", "kept")} <= got
    assert not {r for r in got if r[:2] in {("b", "10:10"), ("c", "12:00")} and r[2] == "expired"} and not any(k == "n" for k, _, _ in got)


def test_confidence_runs_along_a_plan(spark):
    kind = "plan_id int, step_id int, action string, depends_on array<int>, status string, n_results int, top double, mean double, variance double, n_sources int, agreement double"
    rows = [
        (1, 1, "rag_search", [], "success", 3, 0.8, 0.5, 0.01, 3, 0.5),
        (1, 2, "reasoning", [1], "success", 0, None, None, None, None, None),
        (1, 3, "reasoning", [2], "success", None, None, None, None, 2, 0.4),
        (1, 4, "web_search", [1], "success", 0, None, None, None, 0, None),
        (1, 5, "reasoning", [4], "failed", 0, None, None, None, 0, None),
        (2, 1, "reasoning", None, "success", 0, None, None, None, 0, None),
    ]
    got = {(r.plan_id, r.step_id): r.confidence for r in confidence.assembled(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(1, 1): 0.8, (1, 2): 0.616, (1, 3): 0.708, (1, 4): 0.0, (1, 5): 0.0, (2, 1): 0.7}
