import collections
import struct
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from cases import ROWS, documents
from pyspark.sql import functions as F

from lumisync.llm import quality as Q


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = Q.op8_quality(spark, sf).collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    right = collections.Counter((labels[r.doc_id], r.predicted) for r in held)
    assert right[1, 1] >= 0.97 * (right[1, 0] + right[1, 1])
    assert right[0, 0] >= 0.85 * (right[0, 0] + right[0, 1])


def _order(doc_id):
    value = xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest()
    return value - (1 << 64) if value >> 63 else value


def brute_force(texts, labels):
    """Scores by the definition on one core; `texts` and `labels` by id, each id once."""
    known = sorted((_order(i), i, q) for i, q in labels.items() if i in texts)
    compressors = []
    for quality in (1, 0):
        content, size = [], 0
        for order, i, q in [k for k in known if k[2] == quality and k[0] % 2 == 0][:Q.DICTIONARY_ROWS]:
            body = texts[i].encode()
            if 0 < len(body) <= Q.LONGEST_SAMPLE:
                size += len(body)
                content += [body] if size <= Q.DICTIONARY_BYTES else []
        dictionary = zstandard.ZstdCompressionDict(b"\n".join(content), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=Q.LEVEL)
        compressors.append(zstandard.ZstdCompressor(dict_data=dictionary))

    def features(text):
        body = text.encode()
        blocks = [body[i:i + Q.BLOCK_BYTES] for i in range(0, len(body), Q.BLOCK_BYTES)]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in compressors)
        plain = len(zstandard.ZstdCompressor(level=Q.LEVEL).compress(body))
        return (bad - good) / max(1, min(good, bad)), plain / max(1, len(body)), np.log1p(len(body))

    sample = [(features(texts[i]), q) for order, i, q in known if order % 2 == 1][:Q.CALIBRATION_ROWS]
    x, y = np.array([f for f, _ in sample]), np.array([q for _, q in sample], float)
    centre, spread = x.mean(axis=0), x.std(axis=0)
    x, weights = np.column_stack([(x - centre) / spread, np.ones(len(x))]), np.zeros(4)
    for _ in range(60_000):  # plain gradient steps to the same optimum
        weights += 2 / len(y) * (x.T @ (y - 1 / (1 + np.exp(-x @ weights))) - 0.01 * weights)
    return {i: 1 / (1 + np.exp(-((np.array(features(t)) - centre) / spread) @ weights[:3] - weights[3])) for i, t in texts.items()}


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = brute_force(texts, {i: q for i, q in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2})
    got = {r.doc_id: r.score for r in Q.op8_quality(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert np.array([got[i] for i in want]) == pytest.approx(np.array(list(want.values())), abs=5e-3)


def test_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, "x") for i, _ in ROWS if i is not None] * 2 + [(None, 1, "x"), (4, None, "x")],
                                   "doc_id long, quality int, text string")
    got = Q.score_quality(documents(spark), labels, F.lit(True)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in ROWS)
    assert all(0 <= r.score <= 1 for r in got)
    one_class = Q.score_quality(documents(spark), labels.where("quality = 1"), F.lit(True)).collect()
    assert {r.score for r in one_class} == {0.5}
    assert Q.score_quality(documents(spark, []), labels, F.lit(True)).collect() == []
