import math

import numpy as np

from lumisync.llm import vector_search as V


def brute_force(rows, k):
    known = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(1024 * x) for x in v]
            if sum(x * x for x in whole) < 2 ** 62:
                known[i] = min(known.get(i, whole), whole)
    out = []
    for q in (i for i in known if i % 100 == 0):
        scored = [(-sum(a * b for a, b in zip(known[q], v)), i) for i, v in known.items() if i != q and len(v) == len(known[q])]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def _got(spark, rows, k):
    frame = spark.createDataFrame([(i, v, 1, 1.0) for i, v in rows],
                                  "vec_id long, embedding array<float>, rank int, lower double").repartition(3)
    vectors = V.materialize(V.whole_vectors(frame), "v")
    from pyspark.sql import functions as F
    return sorted(tuple(r) for r in V.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k).collect())


def test_brute_force_with_ties_copies_and_bad_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(700, 8)).astype(np.float32)
    vectors[200:500] = vectors[3]  # copies: a third and more
    vectors[500:520] = np.round(vectors[500:520])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(800, None), (801, [1.0, None] * 4), (802, [float("nan")] * 8), (803, [float("inf")] * 8), (900, [1.0, 2.0]),
             (901, [1.0, -2.0]), (None, rows[0][1]), (1000, []), (1100, [0.0] * 8), (5, rows[6][1]), (5, rows[5][1]),
             (803, [3e9] + [0.0] * 7), (804, [1e10] * 8), (1200, [-1e30] * 8), (1300, [1e5] * 8), (805, [-1e5] * 8)]
    for k in (1, 10):
        assert _got(spark, rows, k) == brute_force(rows, k)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 3)  # several blocks of queries
    monkeypatch.setattr(V, "PACK_ROWS", 50)
    assert _got(spark, rows, 10) == brute_force(rows, 10)


def test_few_and_no_rows(spark):
    assert _got(spark, [(0, [1.0]), (100, [2.0])], 10) == [(0, 1, 100, 2048 * 1024), (100, 1, 0, 2048 * 1024)]
    assert _got(spark, [(0, [1.0])], 10) == []
    assert _got(spark, [], 10) == []
