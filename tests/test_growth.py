"""What searches move: pairs stay in their blocks, and a vector has few copies."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quern.operators import cells, retrieval, vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sparse_pairs_stay_in_their_blocks(spark, monkeypatch):
    rng = random.Random(5)
    maps = {i: {f"t{rng.randrange(40)}": rng.choice([-2.0, -1.0, 1.0, 1.0, 2.0]) for _ in range(rng.randint(0, 6))} for i in range(300)}
    rows = [*maps.items(), (None, {"t1": 1.0}), (300, None), (301, {"t1": None, "t2": None})]
    points = spark.createDataFrame(rows, "doc_id bigint, weights map<string,double>")
    for name, value in {"ROWS": 60, "TILE": 16, "COLUMNS": 3, "PAIRS": 20}.items():
        monkeypatch.setattr(retrieval, name, value)
    found = retrieval.sparse_top_k(points, points.where("doc_id % 4 = 0"), 5, parts=3)
    want = []
    for q in range(0, 300, 4):
        met = sorted((-sum(w * maps[p][t] for t, w in maps[q].items() if t in maps[p]), p) for p in maps if maps[q].keys() & maps[p].keys())
        want += [(q, i + 1, p, -s) for i, (s, p) in enumerate(met[:5])]
    assert [tuple(r) for r in found.orderBy("query_id", "rank").collect()] == want
    assert "Join" not in plan(found) and "HashAggregate" not in plan(found)


@pytest.mark.parametrize("rows", [0, 1])
def test_sparse_without_points(spark, rows):
    points = spark.createDataFrame([(1, {"a": 1.0})][:rows], "doc_id bigint, weights map<string,double>")
    assert retrieval.sparse_top_k(points, points, 3).count() == rows


def test_copies_of_vectors_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rng = random.Random(6)
    v = spark.createDataFrame([(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(200)], "vec_id bigint, embedding array<float>")
    assert vectors._blocks(v, "embedding") == vectors.SIDE
    monkeypatch.setattr(vectors, "BYTES", 8 * 3 * 20)
    assert vectors._blocks(v, "embedding") == 10
    x = {r.vec_id: vectors.unit([r.embedding])[0] for r in v.collect()}
    near = {q: sorted((-round(float(x[q] @ x[p]), 6) + 0.0, p) for p in x)[:7] for q in range(0, 200, 10)}
    got = vectors.top_k(v, v.where("vec_id % 10 = 0"), 7).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(q, i + 1, p) for q in near for i, (_, p) in enumerate(near[q])]
    best = {r.vec_id: r.best for r in vectors.best(v.where("vec_id < 50"), v.where("vec_id >= 50")).collect()}
    assert best == {c: pytest.approx(max(round(float(x[c] @ x[p]), 6) for p in range(50, 200)), abs=2e-6) for c in range(50)}


def test_queries_leave_for_their_cells_in_small_batches(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 4))
    v = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>")
    index = cells.built(v, cells=20)
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(x.tolist()), pa.array([None] * 900, pa.float64())], ["query_id", "vector", "kth"])
    monkeypatch.setattr(cells, "OUT", 500)
    sizes = [len(b) for b in cells._routed(index.shape, 1, True)(iter([batch]))]
    assert max(sizes) <= 500 and sum(sizes) == sum(b.column("n")[0].as_py() for b in cells._visited(index.shape, 1)(iter([batch]))) == 900 * (int(index.shape.blocks.sum()) - 1)
    by_cells = cells.search(index, v, 3).collect()
    monkeypatch.setattr(cells, "COPIES", 0)
    by_blocks = cells.search(index, v, 3)
    assert "FlatMapCoGroups" in plan(by_blocks)
    assert sorted(map(tuple, by_blocks.collect())) == sorted(map(tuple, by_cells))
