import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.errors import ParseError
from lodestar.functions.vector import cosine_similarity, dot_product, l2_norm, literal
from lodestar.operators import search
from lodestar.operators.search import Query, top_k, top_k_batched, top_k_each


def records(spark, vectors, metadata=None):
    rows = [(i, [float(x) for x in v], (metadata or {}).get(i, "{}")) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, vector array<float>, metadata string")


def f32_scores(q, vectors):
    """The sequential 32-bit model."""
    def dot(a, b):
        s = np.float32(0)
        for x, y in zip(np.float32(a), np.float32(b)):
            s = np.float32(s + np.float32(x * y))
        return s
    out = []
    for v in vectors:
        d = np.float32(np.sqrt(dot(q, q)) * np.sqrt(dot(v, v)))
        out.append(np.float32(0) if d == 0 else np.float32(dot(q, v) / d))
    return out


SMALL = [(1, 0), (0, 1), (0.9, 0.1), (-1, 0)]


def ids(df):
    return [r["id"] for r in df.collect()]


def test_order_k_and_predicate(spark):
    r = records(spark, SMALL)
    assert ids(top_k(r, [1.0, 0.0], 10)) == [0, 2, 1, 3]
    assert ids(top_k(r, [1.0, 0.0], 2)) == [0, 2]
    assert ids(top_k(r, [1.0, 0.0], 0)) == []
    assert ids(top_k(r, [1.0, 0.0], 10, F.col("id") % 2 == 0)) == [0, 2]
    for bad in (-1, 1 << 31, True, 1.5):
        with pytest.raises(ParseError):
            top_k(r, [1.0, 0.0], bad)


def test_zero_vectors_score_zero(spark):
    r = records(spark, [(0, 0), (1, 0)])
    assert [(x["id"], x["score"]) for x in top_k(r, [0.0, 0.0]).collect()] == [(0, 0.0), (1, 0.0)]
    assert [(x["id"], x["score"]) for x in top_k(r, [1.0, 0.0]).collect()] == [(1, 1.0), (0, 0.0)]


def test_ties_take_the_smaller_id(spark):
    r = records(spark, [(1, 1)] * 7).repartition(5)
    assert ids(top_k(r, [1.0, 1.0], 3)) == [0, 1, 2]
    assert ids(top_k_batched(r, [1.0, 1.0], 3)) == [0, 1, 2]


def test_scores_are_bit_exact(spark):
    rng = np.random.default_rng(3)
    vectors = rng.uniform(-1, 1, (200, 64)).astype(np.float32)
    vectors[3] = 0
    vectors[4] *= np.float32(1e-30)
    got = {x["id"]: np.float32(x["score"]) for x in top_k(records(spark, vectors), vectors[0].tolist(), 200).collect()}
    want = f32_scores(vectors[0], vectors)
    assert [got[i] for i in range(200)] == want


def test_nan_ranks_first(spark):
    r = records(spark, [(1, 0), (math.nan, 0), (0, 1)])
    assert ids(top_k(r, [1.0, 0.0])) == [1, 0, 2]


def test_batched_and_each_agree(spark):
    rng = np.random.default_rng(4)
    vectors = rng.uniform(-1, 1, (300, 16)).astype(np.float32)
    r = records(spark, vectors).repartition(7)
    probes = spark.createDataFrame([(i, vectors[i].tolist()) for i in (0, 5, 9)], "probe_id long, probe array<float>")
    each = {}
    for x in top_k_each(r, probes, 4).collect():
        each.setdefault(x["probe_id"], []).append((x["score"], x["id"]))
    for i in (0, 5, 9):
        want = ids(top_k(r, vectors[i].tolist(), 4))
        assert ids(top_k_batched(r, vectors[i].tolist(), 4)) == want
        assert [b for _, b in sorted(each[i], key=lambda t: (-t[0], t[1]))] == want
    # more probes than a block holds are asked in blocks
    assert sorted(map(tuple, top_k_each(r, probes, 4, max_probes=1).collect())) == sorted(map(tuple, top_k_each(r, probes, 4).collect()))


def test_each_memory_does_not_grow_with_probes(spark, monkeypatch):
    """A task scores in tiles: its memory is far below that of all probes against a batch."""
    rng = np.random.default_rng(5)
    r = records(spark, [(1, 0)])
    kind, tasks = type(r), []
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **kw: (tasks.append(f), real(self, f, *a, **kw))[1])
    probes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 4)))], "probe_id long, probe array<float>")
    top_k_each(r, probes, 3)
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=40_000).astype(np.float32)), 4).cast(pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), vectors], names=["id", "vector"])
    assert len(tasks) == 1
    tracemalloc.start()
    try:
        got = sum(b.num_rows for b in tasks[0](iter([batch, batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == 4500
    assert peak < 64e6  # all at once: 15 million cells, over 600 MB


@pytest.mark.parametrize("k", [0, 1, 3, 40, 5000])
def test_each_against_brute_force(spark, monkeypatch, k):
    """More probes and records than a tile, many equal vectors, k beyond the records and beyond what a block allows for."""
    rng = np.random.default_rng(6)
    vectors = rng.integers(-2, 3, (2300, 3)).astype(np.float32)  # few different ones, some zero
    q = vectors[:: 8 if k < 100 else 200]
    if k == 5000:
        monkeypatch.setattr(search, "HELD", 1000)
        monkeypatch.setattr(search, "LEAST_PROBES", 5)
    probes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "probe_id long, probe array<float>")
    got = {}
    for x in top_k_each(records(spark, vectors).repartition(2), probes, k).collect():
        got.setdefault(x["probe_id"], []).append((-x["score"], x["id"]))
    wide = vectors.astype(np.float64)
    for i, p in enumerate(q.astype(np.float64)):
        d = np.sqrt((p * p).sum()) * np.sqrt((wide * wide).sum(axis=1))
        s = np.divide((wide * p).sum(axis=1), d, out=np.zeros(len(wide)), where=d != 0).astype(np.float32)
        best = np.lexsort((np.arange(len(s)), -s))[:k]
        assert sorted(got.get(i, [])) == [(-s[b], b) for b in best]


def test_each_ranks_nan_first(spark):
    r = records(spark, [(1, 0), (math.nan, 0), (0, 1), (0.5, 0)]).coalesce(1)
    probes = spark.createDataFrame([(7, [1.0, 0.0])], "probe_id long, probe array<float>")
    for k in (1, 2, 3):
        assert {x["id"] for x in top_k_each(r, probes, k).collect()} == set(ids(top_k(r, [1.0, 0.0], k)))


def test_each_without_probes(spark):
    probes = spark.createDataFrame([], "probe_id long, probe array<float>")
    assert top_k_each(records(spark, SMALL), probes, 3).collect() == []


def test_plan_is_bounded(spark):
    plan = top_k(records(spark, SMALL), [1.0, 0.0], 2, "a = 1")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


@pytest.mark.parametrize("a,b,want", [((1, 2), (1, 2), 1), ((1, 0), (0, 1), 0), ((1, 0), (-1, 0), -1), ((1, 2), (10, 20), 1), ((0, 0), (1, 1), 0)])
def test_cosine(spark, a, b, want):
    assert spark.range(1).select(cosine_similarity(literal(a), literal(b))).first()[0] == pytest.approx(want, abs=1e-6)


def test_norm_and_dot(spark):
    r = spark.range(1).select(l2_norm(literal((3, 4))), dot_product(literal((1, 2)), literal((3, 4)))).first()
    assert tuple(r) == (5.0, 11.0)


def test_query_defaults():
    q = Query("c", [1.0])
    assert (q.k, q.where) == (10, None)
    assert str(q.filter("a = 1").where) == "a = 1"
