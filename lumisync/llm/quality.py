"""Quality scores from compression: text that a dictionary of good text shortens more is good.

Two zstandard dictionaries are built from good and from bad labelled text. A text is cut into
blocks, and every block is compressed with either dictionary; the difference of the sizes over
the smaller size, how far the whole text compresses by itself and the log of its length go into
a logistic calibration, fitted on other labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import map_arrow
from .tables import crc_of_id, read_table

DICTIONARY_BYTES = 1 << 20  # of whole labelled texts; the next text that would go beyond ends the sample
DICTIONARY_ROWS = 2_000  # labelled rows of a class that may go into its dictionary
LONGEST_SAMPLE = 64 << 10  # a labelled text with more bytes is not taken as a sample
CALIBRATION_ROWS = 8_000  # labelled rows that may go into the calibration
BLOCK_BYTES = 4_096
LEVEL = 3
THRESHOLD = 0.7

_FEATURES = "doc_id long, difference double, ratio double, log_length double"
_ARROW_FEATURES = pa.schema([("doc_id", pa.int64()), ("difference", pa.float64()), ("ratio", pa.float64()),
                             ("log_length", pa.float64())])


@lru_cache(maxsize=2)
def _compressors(good: bytes, bad: bytes):
    both = []
    for content in (good, bad):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        both.append(zstandard.ZstdCompressor(dict_data=dictionary))
    return *both, zstandard.ZstdCompressor(level=LEVEL)


def _sizes(text: bytes, good, bad, plain) -> tuple[float, float, float]:
    blocks = [text[i:i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]
    with_good, with_bad = (sum(len(c.compress(b)) for b in blocks) for c in (good, bad))
    difference = (with_bad - with_good) / max(1, min(with_good, with_bad))
    return difference, len(plain.compress(text)) / max(1, len(text)), float(np.log1p(len(text)))


def measure(docs: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """The compression features of every row of `(doc_id, text)`."""
    session = docs.sparkSession
    shared = session.sparkContext.broadcast((good, bad))  # two dictionaries of fixed size

    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(*shared.value)
        for batch in batches:
            rows = [_sizes((t.as_py() or "").encode(), *compressors) for t in batch.column("text")]
            columns = [pa.array(c, pa.float64()) for c in (zip(*rows) if rows else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns],
                                             schema=_ARROW_FEATURES)

    return map_arrow(docs.select("doc_id", "text"), sizes, _FEATURES)


def _calibrate(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps with a little decay."""
    weights = np.zeros(features.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        gradient = features.T @ (labels - p) - 0.01 * weights
        curvature = (features * (p * (1 - p))[:, None]).T @ features + 0.01 * np.eye(len(weights))
        step = np.linalg.solve(curvature, gradient)
        weights += step / max(1.0, np.abs(step).max() / 5)
    return weights


def _dictionary(rows: DataFrame, labelled: DataFrame) -> bytes:
    """The whole texts of a sample of labelled rows: the first by hash of the id, up to the bounds above."""
    chosen = labelled.orderBy("order", "doc_id").limit(DICTIONARY_ROWS)
    texts = rows.join(F.broadcast(chosen), "doc_id").withColumn("bytes", F.octet_length("text"))
    texts = texts.where(F.col("bytes").between(1, LONGEST_SAMPLE))
    text_hash = F.xxhash64("text").alias("text_hash")  # a labelled row is one text of its id
    one = texts.groupBy("order", "doc_id").agg(F.min(F.struct(text_hash, "bytes")).alias("one")).select("order", "doc_id", "one.*")
    through = F.sum("bytes").over(Window.orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    keys = one.withColumn("through", through).where(F.col("through") <= DICTIONARY_BYTES).select("doc_id", "text_hash")
    taken = texts.select("*", text_hash).join(F.broadcast(keys), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    found = sorted(taken.select("order", "doc_id", "text").collect())  # at most DICTIONARY_BYTES
    return "\n".join(r.text for r in found).encode()


def score_quality(docs: DataFrame, labels: DataFrame, may_learn: Column) -> DataFrame:
    """(doc_id, score) of every row of `(doc_id, text)`; `labels` is `(doc_id, quality)`.

    Only labels where `may_learn`, a condition on `doc_id`, holds are used: a bounded sample by
    hash of the id for the dictionaries and another one for the calibration. A row labelled more
    than once counts with its mean, rows without label, id or text not at all. If the labels lack
    a class, every score is 0.5. Null and empty texts score like any text without bytes; repeated
    rows give a row each; other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    known = (labels.where(may_learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
             .groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
             .withColumn("order", F.xxhash64("doc_id")))
    part = F.pmod("order", F.lit(2))

    good, bad = (_dictionary(rows, known.where((part == 0) & (F.col("good") == good))) for good in (True, False))
    if not good or not bad:
        return rows.select("doc_id", F.lit(0.5).alias("score"))

    chosen = known.where(part == 1).orderBy("order", "doc_id").limit(CALIBRATION_ROWS)
    labelled = rows.join(F.broadcast(chosen.select("doc_id", "good")), "doc_id")
    flags = chosen.select("doc_id", "good")
    sample = measure(labelled, good, bad).join(F.broadcast(flags), "doc_id").drop("doc_id").collect()
    if len({r.good for r in sample}) < 2:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    features = np.array([[r.difference, r.ratio, r.log_length] for r in sample])
    centre, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    standard = np.column_stack([(features - centre) / spread, np.ones(len(features))])
    *weights, bias = _calibrate(standard, np.array([r.good for r in sample], float)).tolist()

    logit = F.lit(bias)
    for name, weight, mid, width in zip(("difference", "ratio", "log_length"), weights, centre.tolist(), spread.tolist()):
        logit = logit + (F.col(name) - mid) / width * weight
    return measure(rows, good, bad).select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of `documents`; a quarter of the ids is held out of the labels."""
    rest = F.pmod(crc_of_id(F.col("doc_id")), F.lit(4))
    scored = score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), rest != 2)
    return scored.select("doc_id", (rest == 2).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict[str, str] = {}
