import numpy as np
import pyarrow as pa
import pytest
from cases import ROWS, documents

from lumisync.llm import near_dedup as N
from lumisync.llm.components import connected_components


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows, percent=85):
    """{doc_id: smallest id reachable}; rows of one id count as one document."""
    sets = [(i, _shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, s) in enumerate(known):
        for j, t in known[:k]:
            if i != j and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def _check(spark, rows, frame=None):
    got = N.near_duplicates(documents(spark, rows) if frame is None else frame).collect()
    want = brute_force(rows)
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted(
        (i, len(_shingles(t))) for i, t in rows if i is not None)
    assert len(got) == len(rows)
    linked = {i for i, t in rows if _shingles(t)}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        elif r.doc_id in linked and r.n_shingles:
            assert r.component_id == want[r.doc_id]
        else:
            assert r.component_id == r.doc_id


def test_edge_cases(spark):
    _check(spark, ROWS)
    assert N.near_duplicates(documents(spark, [])).collect() == []


def test_chains_and_crowds_of_near_copies(spark):
    """Copies with a few to many changed words: links, chains and near misses around 0.85."""
    rng = np.random.default_rng(4)
    base = [f"word{i}" for i in range(150)]
    rows, texts = [], [base]
    for i in range(120):
        source = texts[rng.integers(len(texts))] if i % 3 == 0 else base
        copy = list(source)
        for at in rng.choice(len(copy), rng.integers(0, 9), replace=False):
            copy[at] = f"new{rng.integers(10**6)}"
        texts.append(copy)
        rows.append((1000 - i, " ".join(copy)))
    rows += [(2000 + i, " ".join(f"other{rng.integers(10**6)}" for _ in range(60))) for i in range(20)]
    rows += [(3000 + i, rows[0][1].upper()) for i in range(30)]
    _check(spark, rows)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    got = N.op6_near_dedup(spark, sf).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("seed", [0, 1])
def test_components_of_random_links(spark, seed):
    rng = np.random.default_rng(seed)
    links = [tuple(map(int, p)) for p in rng.integers(0, 120, (70, 2))] + [(1000 + i, 1001 + i) for i in range(25)]
    parent = {n: n for link in links for n in link}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for link in links if link[0] != link[1] for n in link}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("percent", [60, 80])
def test_other_similarities_by_brute_force(spark, percent):
    """60 copies with up to 12 of 150 words changed, against every pair."""
    rng = np.random.default_rng(percent)
    rows = []
    for i in range(60):
        copy = [f"word{j}" for j in range(150)]
        for at in rng.choice(len(copy), rng.integers(0, 13), replace=False):
            copy[at] = f"new{rng.integers(10**6)}"
        rows.append((i, " ".join(copy)))
    sets = [_shingles(t) for _, t in rows]
    links = {(i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    want = list(range(60))
    for _ in rows:
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
    got = {r.doc_id: r.component_id for r in N.near_duplicates(documents(spark, rows), percent).collect()}
    assert got == dict(enumerate(want))


def test_signing_holds_few_rows_as_python_values():
    texts = [f"some words {i % 50} of text number {i}" for i in range(1300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    parts = list(N._sign([batch, batch.slice(0, 0)]))
    assert [p.num_rows for p in parts] == [512, 512, 276]
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(1300))
    long = np.arange(5000, dtype=np.uint64) * N._MIX
    whole = ((N._FACTORS[:, None] * long[None, :] + N._SHIFTS[:, None]).min(axis=1) >> np.uint64(32)).astype(np.uint32)
    assert (N._minima(long) == whole).all()
