import collections
import math
import pickle
import zlib

import numpy as np
import pytest
from cases import ROWS, documents
from pyspark.sql import functions as F

from lumisync.llm import lm_scoring as L


def _tokens(text):
    return (text or "").encode().lower().split() + [b""]


def _base(rows, is_training):
    counts = collections.Counter(t for i, text in rows if is_training(i) for t in _tokens(text))
    n, v = sum(counts.values()), len(counts)
    return n, [(i, len(_tokens(t)), sum(counts[w] > 0 for w in _tokens(t)),
                sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in _tokens(t))) for i, t in rows]


def _compare(got, rows, is_training):
    n, want = _base(rows, is_training)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key)
    for a, b in zip(found, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])
    assert all(r.train_tokens == n and r.held_out == (not is_training(r.doc_id)) for r in got)


def test_counts_and_base_by_brute_force(spark):
    got = L.score_documents(documents(spark), F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))).collect()
    _compare(got, ROWS, lambda i: i is not None and i % 2 == 0)


def test_no_training_rows_and_no_rows(spark):
    got = L.score_documents(documents(spark), F.lit(False)).collect()
    _compare(got, ROWS, lambda i: False)
    assert all(math.isfinite(r.score) for r in got)
    assert L.score_documents(documents(spark, []), F.lit(True)).collect() == []


def test_query_beats_unigrams_on_held_out_rows(spark, sf):
    got = L.op2_lm_scoring(spark, "/root/testdata/sf0.01").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    _compare(got, rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(0)
    model = L.Model(rng.integers(0, 90, L.SLOTS), rng.integers(1, 9, L.SLOTS))
    model.weights[:] = rng.normal(size=model.weights.shape)
    total = 0.0
    for slot in range(L.SLOTS):  # the same history before a word of every slot
        hashes = np.array([7 << 24, 9 << 20, slot << 24], np.uint32)
        history = L._History(hashes, np.array([3]))
        total += math.exp(model.log_probs(history, slice(2, 3))[0])
    assert total == pytest.approx(1, abs=1e-5)


def test_history_ends_with_the_document():
    hashes = np.array([5, 6, 7, 5, 6, 7], np.uint32)
    apart, alone = L._History(hashes, np.array([3, 3])), L._History(hashes[:3], np.array([3]))
    for (_, _, a), (_, _, b) in zip(apart.levels(slice(0, 6)), alone.levels(slice(0, 3)), strict=True):
        assert all((x == np.tile(y, 2)).all() for x, y in zip(a, b, strict=True))


def test_model_follows_the_vocabulary():
    small, large = L.Shape.of(1_000), L.Shape.of(3_000_000)
    assert small.slots == 32 * 32 and large.slots * 32 >= 3_000_000
    assert large.class_row_bits > small.class_row_bits and large.slot_row_bits > small.slot_row_bits
    rng = np.random.default_rng(1)
    shape = L.Shape(11, 12, 15)  # one softmax has eight places only
    model = L.Model(rng.integers(0, 90, shape.slots), rng.integers(1, 9, shape.slots), shape)
    model.weights[:] = rng.normal(size=model.weights.shape)
    hashes = np.array([h for slot in range(shape.slots) for h in (7 << 24, 9 << 20, slot << 21)], np.uint32)
    history = L._History(hashes, np.full(shape.slots, 3), shape)
    every = np.exp(model.log_probs(history, slice(0, len(hashes))).astype(float))
    assert every[2::3].sum() == pytest.approx(1, abs=1e-4)


def test_scores_use_the_shape_of_the_vocabulary(spark, monkeypatch):
    shapes = []
    totals = L._slot_totals
    monkeypatch.setattr(L, "_slot_totals", lambda counts, shape: shapes.append(shape) or totals(counts, shape))
    rows = [(i, " ".join(f"w{j}" for j in range(i * 1_000, i * 1_000 + 1_000))) for i in range(40)]
    assert len(L.score_documents(documents(spark, rows), F.lit(True)).collect()) == 40
    assert shapes == [L.Shape.of(40_001)] and shapes[0].slots == 2_048


def test_steps_and_scores_by_a_plain_model(monkeypatch):
    monkeypatch.setattr(L, "STEP_TOKENS", 64)
    rng = np.random.default_rng(2)
    shape = L.Shape(10, 6, 8)
    hashes = rng.choice(rng.integers(0, 1 << 32, 40, dtype=np.uint32), 300)
    history = L._History(hashes, np.array([100, 0, 1, 199]), shape)
    tokens = np.bincount(hashes >> 22, minlength=shape.slots)
    model = L.Model(tokens, tokens, shape)
    used = [rows for _, _, rows in history.levels(slice(0, 300))]
    model.learn(history, np.arange(200), np.zeros(shape.rows, np.int64), np.zeros(shape.rows, np.float32))

    weights, squares = collections.defaultdict(lambda: [0.0] * L.CLASSES), collections.Counter()

    def softmax(level, token):
        at, bits = shape.levels[level]
        path, masses = int(hashes[token]) >> (32 - at) if at else 0, []
        for place in range(1 << bits):
            first = (path << bits | place) << (shape.slot_bits - at - bits)
            masses.append(sum(int(n) + 1.0 for n in tokens[first:first + (1 << (shape.slot_bits - at - bits))]))
        raw = [mass * math.exp(sum(weights[int(rows[token])][place] for rows in used[level]))
               for place, mass in enumerate(masses)]
        return [r / sum(raw) for r in raw], int(hashes[token]) >> (32 - at - bits) & ((1 << bits) - 1)

    for start in range(0, 200, 64):
        steps = []
        for level in range(len(shape.levels)):
            shares = [softmax(level, token) for token in range(start, min(start + 64, 200))]
            for rows in used[level]:
                change = collections.defaultdict(lambda: [0.0] * L.CLASSES)
                for token, (share, place) in enumerate(shares, start):
                    for i, p in enumerate(share):
                        change[int(rows[token])][i] += (i == place) - p
                steps.append(change)
        for change in steps:
            for row, entries in change.items():
                squares[row] += sum(x * x for x in entries) / L.CLASSES
                weights[row] = [w + L.RATE * x / math.sqrt(squares[row] + 1e-6) for w, x in zip(weights[row], entries)]
    got = model.log_probs(history, slice(200, 300))
    for token in range(200, 300):
        want = 0.0
        for level in range(len(shape.levels)):
            share, place = softmax(level, token)
            want += math.log(share[place])
        assert got[token - 200] == pytest.approx(want, abs=1e-3)


def test_changes_on_their_way():
    rng = np.random.default_rng(3)
    change = rng.normal(size=(9, L.CLASSES)).astype(np.float32)
    change[4] = 0
    back = L._expand_change(L._squeeze_change(change))
    assert np.abs(back - change).max() <= np.abs(change).max() / 250 and not back[4].any()


def test_sums_of_a_step_by_brute_force():
    rng = np.random.default_rng(4)
    rows = [rng.choice([3, 5, 70, 71, 900], L.STEP_TOKENS), 1_000 + rng.integers(0, 9_000, L.STEP_TOKENS)]
    gradient = rng.normal(size=(L.STEP_TOKENS, 8)).astype(np.float32)
    order, touched, first, uses = L._by_row(rows)
    got = L._sums_by_row(gradient, order, first, uses)
    want = np.zeros((10_000, 8))
    for used in rows:
        np.add.at(want, used, gradient)
    assert touched.tolist() == np.unique(np.concatenate(rows)).tolist() and {1, 2, 3} <= set(uses.tolist())
    assert np.abs(got - want[touched]).max() < 1e-2 and uses.sum() == 2 * L.STEP_TOKENS


def test_softmaxes_have_no_idle_places_and_widened_weights_the_same_scores():
    rng = np.random.default_rng(5)
    shape = L.Shape(11, 12, 15)
    model = L.Model(rng.integers(0, 90, shape.slots), rng.integers(1, 9, shape.slots), shape)
    assert [bias.shape for bias in model.biases] == [(1 << at, 1 << bits) for at, bits in shape.levels]
    model.weights[:] = rng.normal(size=model.weights.shape)
    sent = pickle.loads(pickle.dumps(model))
    history = L._History(rng.integers(0, 1 << 32, 500, dtype=np.uint32), np.array([200, 300]), shape)
    before = sent.log_probs(history, slice(0, 500))
    assert sent.weights.dtype == np.float16 and sent.widen().weights.dtype == np.float32
    assert (sent.log_probs(history, slice(0, 500)) == before).all()
