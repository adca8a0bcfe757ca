import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisync.operators import search as S
from lumisync.schemas import VECTOR

SCHEMA = "path string, vector array<float>"


def store_of(spark, vectors, names=None):
    rows = [(names[i] if names else f"p{i:03d}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(names, vectors, query, limit):
    scored = []
    for name, v in zip(names, np.asarray(vectors, np.float32).astype(float)):
        if np.allclose(v, 0):
            continue
        score = float(np.dot(v, query) / (np.linalg.norm(v) * np.linalg.norm(query)))
        if score > 0:
            scored.append((name, score))
    return sorted(scored, key=lambda x: (-round(x[1], 12), x[0]))[:limit]


def random_vectors(n, dim=9, seed=0):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dim)).astype(np.float32)
    vectors[n // 3: 2 * n // 3] = vectors[0]  # a third of all rows are one vector
    vectors[-3:] = 0
    vectors[-4, 2] = np.nan
    return vectors


@pytest.mark.parametrize("arrow", [True, False])
@pytest.mark.parametrize("limit", [0, 1, 7, 60, 1000])
def test_search_equals_brute_force(spark, monkeypatch, arrow, limit):
    monkeypatch.setattr(S, "MERGE_ROWS", 100)  # larger limits take the second tier
    vectors = random_vectors(120)
    names = [f"p{i:03d}" for i in range(120)]
    query = vectors[0].astype(float) + 0.1
    got = S.search(store_of(spark, vectors).repartition(5), list(query), limit, use_arrow=arrow).collect()
    want = brute(names, vectors, query, limit)
    assert [r.path for r in got] == [w[0] for w in want]
    assert [r.score for r in got] == pytest.approx([w[1] for w in want])
    assert all(r.total_images == 120 for r in got)


def test_search_empty_store_and_zero_query(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.search(empty, [1.0, 0.0]).collect() == []
    one = store_of(spark, [[1, 0]])
    for arrow in (True, False):
        assert S.search(one, [0.0, 0.0], use_arrow=arrow).collect() == []


def test_search_refuses_other_lengths(spark):
    rows = store_of(spark, [[1, 0, 0]])
    for arrow in (True, False):
        with pytest.raises(Exception, match="differ in length"):
            S.search(rows, [1.0, 0.0], use_arrow=arrow).collect()
    with pytest.raises(ValueError):
        S.search(rows, [1.0, 0.0, 0.0], -1)


def test_rounding_comes_after_the_positive_test(spark):
    rows = store_of(spark, [[0.0004, 1.0], [1.0, 0.0], [-1.0, 0.0]])
    got = S.search_rounded(rows, [1.0, 0.0]).collect()
    assert [(r.path, r.score) for r in got] == [("p001", 1.0), ("p000", 0.0)]


def test_full_ranking_orders_ties_by_descending_key(spark):
    rows = store_of(spark, [[1, 0], [1, 0], [0, 1], [0, 0]])
    got = [(r.path, r.score) for r in S.full_ranking(rows, [1.0, 0.0]).collect()]
    assert got == [("p001", 1.0), ("p000", 1.0), ("p002", 0.0), ("p003", None)]


def test_topk_is_the_head_of_the_full_ranking(spark):
    rows = store_of(spark, np.random.default_rng(5).normal(size=(50, 4)))
    query = [0.3, -0.2, 0.9, 0.1]
    head = [r.path for r in S.full_ranking(rows, query).limit(8).collect()]
    assert [r.path for r in S.search(rows, query, 8).collect()] == head


@pytest.mark.parametrize("how", [{}, {"block_bytes": 600}, {"block_results": 1000}])
@pytest.mark.parametrize("limit", [1, 5, 45, 500])
def test_batch_search_equals_brute_force(spark, monkeypatch, how, limit):
    vectors = random_vectors(120, seed=3)
    names = [f"p{i:03d}" for i in range(120)]
    asked = np.vstack([random_vectors(30, seed=3)[:26], np.zeros((1, 9))])
    queries = spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(asked)],
                                    "query_id long, query_vec array<float>")
    got = S.batch_search(store_of(spark, vectors).repartition(3), queries, limit, **how).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by_query.setdefault(r.query_id, []).append(r.path)
    for i, q in enumerate(asked.astype(float)):
        if not np.any(q) or np.isnan(q).any():
            assert i not in by_query
            continue
        assert by_query.get(i, []) == [w[0] for w in brute(names, vectors, q, limit)]


def test_small_steps_give_the_same_answer():
    import pyarrow as pa
    rng = np.random.default_rng(1)
    rows, queries = rng.normal(size=(400, 6)), rng.normal(size=(7, 6))
    rows[100:300] = rows[5]
    keys = pa.array([f"k{i:04d}" for i in rng.permutation(400)])
    results = []
    for step in (1, 3, 400):
        top = S._RunningTopK(7, 4)
        block = S._QueryBlock(queries)
        for start in range(0, 400, step):
            top.add(keys.slice(start, step), rows[start:start + step], block)
        results.append(top.result(pa.array(range(7))).to_pylist())
    assert results[0] == results[1] == results[2]


def test_batch_search_without_queries(spark):
    none = spark.createDataFrame([], "query_id long, query_vec array<float>")
    assert S.batch_search(store_of(spark, [[1, 0]]), none).collect() == []


def test_numbered(spark):
    rows = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "path string, score double")
    got = S.numbered(rows).orderBy("rank").collect()
    assert [(r["rank"], r.path, r.label) for r in got] == [(1, "c", "0.900"), (2, "a", "0.500"), (3, "b", "0.500")]


def test_plans_do_not_shuffle_vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    plan = S.search(rows, [0.1] * 64, 10, "vec_id", "embedding")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert VECTOR.elementType.simpleString() == "float"
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    plan = S.batch_search(rows, queries, 3, "vec_id", "embedding")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("WindowGroupLimit") == 2
    plan = S.batch_search(rows, queries, 3, "vec_id", "embedding", block_bytes=40_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan  # one pass over the store for any number of blocks
    assert plan.count("MapInArrow") == 1 and plan.count("FileScan") == 1


@pytest.mark.parametrize("arrow", [True, False])
def test_one_rule_for_both_ways(spark, arrow):
    rows = spark.createDataFrame([
        ("whole", [1.0, 0.0]), ("null", None), ("zero", [0.0, 0.0]), ("tiny", [1e-9, 0.0]), ("nan", [float("nan"), 1.0]),
        ("small", [1e-6, 0.0])], SCHEMA)

    def found(query):
        return [(r.path, r.total_images) for r in S.search(rows, query, use_arrow=arrow).collect()]

    assert found([1.0, 0.0]) == [("small", 6), ("whole", 6)]
    assert found([1e-9, 0.0]) == [("small", 6), ("whole", 6)]
    assert found([0.0, 0.0]) == []


def test_batch_search_follows_the_rule(spark):
    rows = spark.createDataFrame([("whole", [1.0, 0.0]), ("null", None), ("zero", [0.0, 0.0])], SCHEMA)
    queries = spark.createDataFrame([(0, [1e-9, 0.0]), (1, None), (2, [0.0, 0.0])], "query_id long, query_vec array<float>")
    assert [(r.query_id, r.path) for r in S.batch_search(rows, queries).collect()] == [(0, "whole")]


@pytest.mark.parametrize("how", [{}, {"block_bytes": 700}, {"block_bytes": 700, "block_results": 20}])
def test_bounds_tiers_and_early_results(spark, monkeypatch, how):
    """A search that is large by its limits: seeded bounds, slots before the last ranking, results handed on early."""
    for name, value in (("MERGE_ROWS", 10), ("SEED_ROWS", 30), ("SLOT_ROWS", 5), ("STRETCH_BYTES", 2_000)):
        monkeypatch.setattr(S, name, value)
    vectors = random_vectors(200, seed=8)
    names = [f"p{i:03d}" for i in range(200)]
    asked = random_vectors(40, seed=9)[:36]
    queries = spark.createDataFrame([(f"q {i}", [float(x) for x in q]) for i, q in enumerate(asked)], "query_id string, query_vec array<float>")
    found = S.batch_search(store_of(spark, vectors).repartition(5), queries, 6, **how)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "__slot" in plan
    by_query = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        by_query.setdefault(r.query_id, []).append(r.path)
    assert {f"q {i}": [w[0] for w in brute(names, vectors, q.astype(float), 6)] for i, q in enumerate(asked)} == by_query


def test_a_task_hands_on_no_more_than_it_may_hold():
    import pyarrow as pa
    rng = np.random.default_rng(2)
    rows, queries = rng.normal(size=(600, 4)), rng.normal(size=(9, 4))

    class Files:
        blocks = [["a"], ["b"], ["none"]]

        def read(self, block):
            part = queries[block * 5:block * 5 + 5]
            return (pa.array(range(block * 5, block * 5 + len(part))), S._QueryBlock(part), np.zeros(len(part))) if len(part) else None

    batches = [pa.RecordBatch.from_pydict({"k": pa.array(range(at, at + 50)), "v": pa.array(list(rows[at:at + 50]))})
               for at in range(0, 600, 50)]
    for most in (0, 40, 10**6):
        parts = [b.to_pylist() for b in S._many_topk_task(Files(), 3, most)(iter(batches))]
        got = sorted(((r["__qid"], -r["score"], r["__key"]) for part in parts for r in part))
        for q in range(9):
            scores = rows @ queries[q] / np.linalg.norm(rows, axis=1) / np.linalg.norm(queries[q])
            assert [k for i, _, k in got if i == q][:3] == np.argsort(-scores)[:3].tolist()
        assert len(got) == 27 or most < 10**6


def test_rows_are_made_ready_once_for_all_blocks(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(5)
    rows, queries = rng.normal(size=(50, 4)), rng.normal(size=(24, 4))
    rows[10:20], rows[20, 1], rows[21, 2] = 0, np.nan, np.inf
    seen, real = [], S._without_hopeless_copies
    monkeypatch.setattr(S, "_without_hopeless_copies", lambda keys, rows, limit: seen.append(len(rows)) or real(keys, rows, limit))

    class Files:
        blocks = range(8)

        def read(self, block):
            return pa.array(range(block * 3, block * 3 + 3)), S._QueryBlock(queries[block * 3:block * 3 + 3]), np.zeros(3)

    batch = pa.RecordBatch.from_pydict({"k": pa.array(range(50)), "v": pa.array(list(rows))})
    got = [r for b in S._many_topk_task(Files(), 50, 10**6)(iter([batch])) for r in b.to_pylist()]
    assert seen == [38]
    with np.errstate(all="ignore"):
        scores = queries @ rows.T / np.linalg.norm(rows, axis=1) / np.linalg.norm(queries, axis=1)[:, None]
    assert sorted((r["__qid"], r["__key"]) for r in got) == sorted(map(tuple, np.argwhere(scores > 0).tolist()))


def test_small_blocks_share_a_file_and_many_queries_the_cores(spark, monkeypatch):
    files, real = [], S._many_topk_task
    monkeypatch.setattr(S, "_many_topk_task", lambda queries, *rest: files.append(queries) or real(queries, *rest))
    monkeypatch.setattr(S, "SPREAD_QUERIES", 30)
    vectors, asked = random_vectors(90, seed=12), np.random.default_rng(13).normal(size=(40, 9)).astype(np.float32)
    names = [f"p{i:03d}" for i in range(90)]
    queries = spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(asked)], "query_id long, query_vec array<float>")
    found = S.batch_search(store_of(spark, vectors).coalesce(1), queries, 6, block_bytes=400)
    assert len(files[0].files) == 1 and len(files[0].blocks) == 8
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().executedPlan().toString()
    by_query = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        by_query.setdefault(r.query_id, []).append(r.path)
    assert by_query == {i: [w[0] for w in brute(names, vectors, q.astype(float), 6)] for i, q in enumerate(asked)}


def test_first_bounds_are_those_of_the_seeds(spark):
    import pyarrow as pa
    rng = np.random.default_rng(6)
    vectors, asked = rng.normal(size=(40, 5)).astype(np.float32), rng.normal(size=(7, 5)).astype(np.float32)
    seeds = S._written(store_of(spark, vectors).toDF("__key", "__vec"))
    batch = pa.RecordBatch.from_pydict({"__qid": pa.array(range(7)), "__qvec": pa.array(list(asked)), "__floor": pa.array(np.zeros(7))})
    for limit in (3, 41):
        got, = S._floor_task(S._QueryFiles(seeds, 1), limit)(iter([batch]))
        scores = np.sort(asked @ vectors.T / np.linalg.norm(vectors, axis=1) / np.linalg.norm(asked, axis=1)[:, None], axis=1)
        assert got.column(2).to_numpy() == pytest.approx(scores[:, -3] if limit == 3 else np.zeros(7), abs=1e-5)
