"""Search over cells, tables upserted by bucket, spending limits, samples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import cells, samples, vectors
from quern.sources import buckets
from quern.streaming import limits

KIND = "vec_id bigint, embedding array<double>"


def grouped(n, width=8, groups=12, seed=1):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(groups, width))
    x = mid[r.integers(groups, size=n)] + 0.05 * r.normal(size=(n, width))
    return [(i, row.tolist()) for i, row in enumerate(x)]


def nearest(points, queries, k):
    unit = lambda rows: cells.unit(np.array([v for _, v in rows]))
    sim, ids = np.round(unit(queries) @ unit(points).T, 6) + 0.0, np.array([i for i, _ in points])
    out = []
    for (q, _), row in zip(queries, sim, strict=True):
        best = np.lexsort((ids, -row))[:k]
        out += [(q, r + 1, int(ids[b]), float(row[b])) for r, b in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("k", "block"), [(1, 4_096), (5, 16), (40, 7)])
def test_search_equals_all_products(spark, monkeypatch, k, block):
    monkeypatch.setattr(cells, "BLOCK", block)
    points = grouped(300) + [(1_000, [0.0] * 8), (1_001, [0.0] * 8)] + [(2_000 + i, [1.0] * 8) for i in range(50)]
    queries = points[::9] + [(5_000, [-1.0] * 8), (5_001, [0.0] * 8)]
    df = spark.createDataFrame([*points, (7_000, None), (None, [1.0] * 8)], KIND).withColumns({c: F.lit(1) for c in ("cell", "block", "key", "query_id", "kth", "sim", "rank")})
    got = cells.search(cells.built(df, cells=9), spark.createDataFrame([*queries, (7_000, None)], KIND), k)
    assert sorted(map(tuple, got.collect())) == nearest(points, queries, k)


def test_cells_are_skipped(spark):
    points = grouped(2_000, groups=40)
    df = spark.createDataFrame(points, KIND)
    index = cells.built(df, cells=40)
    seen = cells.visits(index, df.where("vec_id % 20 = 0"), 5).agg(F.count("*"), F.avg("cells"), F.avg("vectors")).first()
    assert seen[0] == 100 and seen[1] < 8 and seen[2] < 600  # of 40 cells and 2,000 vectors


def test_search_of_nothing(spark):
    none, some = spark.createDataFrame([], KIND), spark.createDataFrame(grouped(5), KIND)
    assert cells.search(cells.built(none), some, 3).count() == cells.search(cells.built(some), none, 3).count() == 0
    assert [r.best for r in cells.best(some, none).collect()] == [0.0] * 5
    assert sorted(map(tuple, cells.best(some, some).collect())) == sorted(map(tuple, vectors.best(some, some).collect()))


def files(spark, path):
    return {r.f for r in spark.read.parquet(f"{path}/rows").select(F.input_file_name().alias("f")).distinct().collect()}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "id bigint, v string"
    put = lambda rows, n, kind=kind: buckets.upsert(spark.createDataFrame(rows, kind), path, "id", n, 8)
    now = lambda: {r[0]: tuple(r)[1:] for r in buckets.read(spark, path).collect()}
    assert put([(i, "a") for i in range(100)] + [(None, "n")], 0)
    before = files(spark, path)
    assert put([(5, "b"), (5, "c"), (None, "m")], 1)
    touched = {r[0] for r in spark.createDataFrame([(5,), (None,)], "id bigint").select(buckets.bucket("id", 8)).collect()}
    after = files(spark, path)
    changed = {f.split("bucket=")[1].split("/")[0] for f in before ^ after}
    assert changed == {str(t) for t in touched} and len(before & after) >= 6
    state = now()
    assert len(state) == 101 and state[5][0] in "bc" and state[None] == ("m",) and state[6] == ("a",)
    assert not put([(5, "again")], 1) and files(spark, path) == after and now() == state
    assert put([(200, "z", 1)], 2, "id bigint, v string, more int") and now()[200] == ("z", 1) and now()[6] == ("a", None)


def test_broken_upsert_is_taken_up(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    put = lambda rows, n: buckets.upsert(spark.createDataFrame(rows, "id bigint, v string"), path, "id", n, 4, [F.desc("v")])
    put([(i, "a") for i in range(20)], 0)
    noted = buckets._note

    def broken(spark, path, number, state, n):
        if state == "done":
            raise RuntimeError("lost")
        noted(spark, path, number, state, n)

    monkeypatch.setattr(buckets, "_note", broken)
    with pytest.raises(RuntimeError):
        put([(3, "b"), (3, "c"), (30, "d")], 1)
    monkeypatch.setattr(buckets, "_note", noted)
    assert put([(3, "b"), (3, "c"), (30, "d")], 1)
    got = dict(map(tuple, buckets.read(spark, path).collect()))
    assert got == {i: "a" for i in range(20)} | {3: "c", 30: "d"}


def test_upsert_stream(spark, tmp_path):
    for i, rows in enumerate([[(1, "a"), (2, "a")], [(2, "b")]]):
        spark.createDataFrame(rows, "id bigint, v string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("id bigint, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    for _ in range(2):
        buckets.upsert_stream(stream, str(tmp_path / "t"), "id", str(tmp_path / "c"), 4).awaitTermination()
    assert dict(map(tuple, buckets.read(spark, str(tmp_path / "t")).collect())) == {1: "a", 2: "b"}


def plain(rows, request, hour, day):
    sums, out = {}, []
    for k, at, cost in rows:
        a, b = (k, "h", at // 3600), (k, "d", at // 86400)
        v = "request" if cost > request else "hour" if sums.get(a, 0.0) + cost > hour else "day" if sums.get(b, 0.0) + cost > day else "ok"
        if v == "ok":
            sums[a], sums[b] = sums.get(a, 0.0) + cost, sums.get(b, 0.0) + cost
        out.append((k, at, cost, sums.get(a, 0.0), sums.get(b, 0.0), v))
    return sorted(out)


def requests(seed, n, days):
    r = random.Random(seed)
    return [(r.choice("abc"), r.randrange(days * 86_400), r.choice([0.1, 0.2, 0.4, 0.7])) for _ in range(n)]


def as_rows(got):
    return sorted((r.user_id, int(r.ts.timestamp()), r.cost, r.hour_spent, r.day_spent, r.verdict) for r in got)


def test_spending_over_a_table(spark):
    rows = requests(1, 800, 4)
    df = spark.createDataFrame([*rows, ("a", None, 1.0), (None, 5, 1.0)], "user_id string, t bigint, value double").withColumn("ts", F.timestamp_seconds("t"))
    expect = plain(sorted(rows, key=lambda x: (x[1], x[2])), 0.5, 0.6, 3.0)
    assert as_rows(limits.spent(df, request=0.5, hour=0.6, day=3.0).collect()) == expect
    assert {x[-1] for x in expect} == {"ok", "request", "hour", "day"}
    assert limits.spent(df.limit(0)).count() == 0


def test_spending_of_a_stream(spark, tmp_path):
    rows = sorted(requests(2, 240, 3), key=lambda x: (x[1], x[2]))
    last = [("z", 40 * 86_400, 0.1), ("z", 41 * 86_400, 0.1)]
    for i, part in enumerate([rows[:80], rows[80:160], rows[160:], last[:1], last[1:]]):
        df = spark.createDataFrame(part, "user_id string, t bigint, value double").select("user_id", F.timestamp_seconds("t").alias("ts"), "value")
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema("user_id string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, limits.STORE)
    try:
        q = limits.limited(source, request=0.5, hour=0.6, day=3.0).writeStream.format("memory").queryName("spending").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        q.stop()
    finally:
        spark.conf.set(name, before)
    assert as_rows(spark.table("spending").collect()) == sorted(plain(rows + last, 0.5, 0.6, 3.0))
    assert max(held) > 10 and held[-1] <= 4  # only the last key's hours and days are left


def test_samples(spark):
    df = spark.range(1_000).select("id", (F.col("id") % 3).alias("g"), F.lit("x").alias("_lot"))
    df = df.drop("_lot").unionByName(df.drop("_lot").where("id < 5"))
    one = [sorted(map(tuple, samples.sampled(df.repartition(p), 20, ["id"]).collect())) for p in (1, 7)]
    assert one[0] == one[1] and len(one[0]) == 20
    assert samples.sampled(df, 20, ["id"], seed=1).exceptAll(samples.sampled(df, 20, ["id"])).count() > 10
    by = [sorted(map(tuple, samples.sampled(df.repartition(p), 9, ["id"], by="g").collect())) for p in (1, 7)]
    assert by[0] == by[1] and len(by[0]) == 27
    assert samples.sampled(df, 5_000, ["id"]).count() == 1_005 and samples.sampled(df.limit(0), 5, ["id"]).count() == 0


def test_estimated_total(spark):
    r = random.Random(3)
    rows = [(i, n := r.randrange(10, 900), n * r.uniform(0.2, 0.3)) for i in range(4_000)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, size bigint, value double")
    got = [samples.estimated_total(df, ["id"], F.col("size"), F.col("value"), 0.1, seed=s).first() for s in range(12)]
    true = sum(v or 0 for *_, v in rows)
    assert sum(x.low <= true <= x.high for x in got) >= 10 and all(x.error < 0.02 * true for x in got)
    whole = samples.estimated_total(df, ["id"], F.col("size"), F.col("value"), 1.0).first()
    assert whole.sampled == whole.rows == 4_001 and abs(whole.total - true) < 0.01 and whole.error == 0
    none = samples.estimated_total(df.limit(0), ["id"], F.col("size"), F.col("value"), 0.5).first()
    assert (none.rows, none.total, none.error) == (0, None, None)
