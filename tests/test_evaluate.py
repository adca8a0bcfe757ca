import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisync.functions import vectors as V
from lumisync.operators import runs as R
from lumisync.operators import similarity
from lumisync.operators.diff import throughput
from lumisync.operators.probe import INVERSE_STRENGTH, accuracy, fit_probe, predict
from lumisync.operators.similarity import contrastive_loss, similarity_summary


def vectors(spark, matrix, name="vector", batch=0):
    return spark.createDataFrame([(batch, 100 * batch + i, [float(x) for x in v]) for i, v in enumerate(matrix)],
                                 f"batch long, id long, {name} array<double>")


@pytest.mark.parametrize("rows_per_block", [4, 1000])
@pytest.mark.parametrize("scale", [0.0, 4.6])
def test_similarity_summary(spark, monkeypatch, rows_per_block, scale):
    monkeypatch.setattr(similarity, "ENTRIES_PER_STEP", 14)  # two matrix rows at a time
    rng = np.random.default_rng(2)
    t, i = rng.normal(size=(11, 5)), rng.normal(size=(7, 5))
    logits = t @ i.T * np.exp(scale)
    got = {(r.side, r.id): r for r in similarity_summary(
        vectors(spark, t).union(vectors(spark, t[:3], batch=1)),
        vectors(spark, i).union(vectors(spark, i[:2], batch=1)), scale, rows_per_block).collect()}
    assert len(got) == 18 + 5
    assert {(k, r.n) for (side, k), r in got.items() if k >= 100 and side == "text"} == {(100, 2), (101, 2), (102, 2)}
    for side, matrix in (("text", logits), ("image", logits.T)):
        for k, row in enumerate(matrix):
            r = got[side, k]
            assert r.n == len(row)
            peak = row.max()
            want = (row.mean(), row.min(), peak, peak + np.log(np.exp(row - peak).sum()))
            assert (r["mean"], r.low, r.high, r.logsumexp) == pytest.approx(want)


@pytest.mark.parametrize("rows_per_block", [3, 1000])
def test_contrastive_loss(spark, rows_per_block):
    rng = np.random.default_rng(3)
    t, i = rng.normal(size=(10, 6)), rng.normal(size=(10, 6))
    pairs = vectors(spark, t, "text").join(vectors(spark, i, "image"), ["batch", "id"])
    t, i = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (t, i))
    logits = t @ i.T * 100

    def entropy(m):
        peak = m.max(axis=1, keepdims=True)
        return np.mean(np.log(np.exp(m - peak).sum(axis=1)) + peak[:, 0] - np.diag(m))
    got = contrastive_loss(pairs, float(np.log(100)), rows_per_block).first().loss
    assert got == pytest.approx((entropy(logits) + entropy(logits.T)) / 2)


def test_vector_functions(spark):
    row = spark.range(1).select(
        V.dot(V.vector_literal([1, 2]), V.vector_literal([3, 4])).alias("dot"),
        V.norm(V.vector_literal([3, 4])).alias("norm"),
        V.cosine(V.vector_literal([1, 0]), V.vector_literal([0, 0])).alias("none"),
        V.normalize(V.vector_literal([3, 4])).alias("unit"),
        V.normalize(V.vector_literal([0, 0])).alias("nothing"),
        V.is_zero(V.vector_literal([1e-8, -1e-9])).alias("zero"),
        V.is_zero(V.vector_literal([1.1e-8])).alias("small"),
        V.is_zero(V.vector_literal([float("nan")])).alias("nan"),
        V.is_match(F.lit(float("nan"))).alias("nan_match"),
    ).first()
    assert (row.dot, row.norm, row.none, row.unit, row.nothing) == (11, 5, None, [0.6, 0.8], None)
    assert (row.zero, row.small, row.nan, row.nan_match) == (True, False, False, False)


@pytest.mark.parametrize("expression", [
    lambda: V.dot(V.vector_literal([1]), V.vector_literal([1, 2])),
    lambda: V.checked_vector(V.vector_literal([1]), 2),
])
def test_wrong_lengths_raise(spark, expression):
    with pytest.raises(Exception, match="differ in length|expected 2 entries"):
        spark.range(1).select(expression()).collect()


def test_probe_is_the_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 3))
    y = (x @ rng.normal(size=(3, 3)) + rng.normal(size=(150, 3))).argmax(axis=1)
    rows = spark.createDataFrame([([float(v) for v in f], int(t)) for f, t in zip(x, y)],
                                 "features array<double>, label int")
    model = fit_probe(rows)
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    logits = x @ weights.T + bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    # The gradient of C * sum(loss) + |w|^2 / 2, free bias, vanishes at the solution.
    slope = INVERSE_STRENGTH * (p - np.eye(3)[y]).T @ x + weights
    assert np.abs(slope).max() < 0.02 and np.abs((p - np.eye(3)[y]).sum(axis=0)).max() < 0.05
    scored = predict(model, rows)
    assert scored.columns == ["features", "label", "prediction"]
    got = scored.agg(accuracy(F.col("prediction"), F.col("label")).alias("a")).first().a
    assert got == pytest.approx(np.mean(logits.argmax(axis=1) == y) * 100)


def test_runs_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([(1, 0.1, 0.3), (25, 1.0, 2.0)], "images long, run_1 double, run_2 double")
    R.write_csv(wide, str(tmp_path / "csv"))
    back = R.read_csv(spark, str(tmp_path / "csv"), ["run_1", "run_2"])
    assert sorted(back.collect()) == sorted(wide.collect())
    long = R.to_long(back)
    assert long.count() == 4
    summary = {r.images: r for r in R.summarize_runs(long).collect()}
    assert summary[25]["mean"] == 1.5 and summary[25]["std"] == 0.5  # population, not sample
    more = R.append_run(long, spark.createDataFrame([(25, 3.0), (225, 9.0)], "images long, seconds double"))
    got = {r.images: tuple(r)[1:] for r in R.to_wide(more, ["run_1", "run_2", "run_3"]).collect()}
    assert got == {1: (0.1, 0.3, None), 25: (1.0, 2.0, 3.0), 225: (None, None, 9.0)}
    first = R.append_run(long.limit(0), spark.createDataFrame([(1, 2.0)], "images long, seconds double"))
    assert first.first().run == "run_1"


def test_throughput(spark):
    row = spark.range(1).select(throughput(F.lit(10), F.lit(4.0)).alias("a"), throughput(F.lit(10), F.lit(0.0)).alias("b")).first()
    assert (row.a, row.b) == (2.5, None)
