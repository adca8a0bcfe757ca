"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

The probability of a word after its history is the product of these factors:

- its class among at most 16, a softmax over hashed features of the history: the word before, the
  word before that (a skip feature) and the pair of both;
- its place among the at most 16 of its class, and of those again as often as the vocabulary asks
  for, each a softmax over the two single-word features;
- the word within the slot that these places name, from corpus counts with one unit of mass for
  unknown words.

Class and places are leading bits of the word's crc32, dealt evenly to the softmaxes. The model follows
the training vocabulary: there are slots for every 32 words, at least 1,024, and the rows of the weight matrix that the
features are hashed to double whenever the vocabulary quadruples, for every task holds the matrix.
The weights are trained by distributed gradient updates: in each round, every task runs gradient
steps over its share of the training documents from the common weights, and the changes of each
row of the matrix are averaged by how often a task used the row. Corpus counts cover all training
documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from copy import copy
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_arrow, parallelism, ship_package
from .chunks import expand, expand_ranks, expand_words, pack, rank_order, spans, squeeze
from .tables import crc_of_id, materialize, read_table, shuffle_partitions

CLASS_BITS = 4
CLASSES = 1 << CLASS_BITS  # of the first softmax, and the places of each softmax below it, at most
WORDS_A_SLOT = 32
LEAST_SLOT_BITS = 10
LEAST_WORDS = WORDS_A_SLOT << LEAST_SLOT_BITS  # of a vocabulary that the least shape is made for
ROUNDS = 2
STEP_BITS = 13
STEP_TOKENS = 1 << STEP_BITS
RATE = 0.1
BLOCK_ROWS = 512
FEW_USES = 8  # rows of a step with up to so many uses are summed together


class Shape(NamedTuple):
    """Sizes of a model in bits: its slots, the rows of each class feature, those of each slot feature."""

    slot_bits: int
    class_row_bits: int
    slot_row_bits: int

    @classmethod
    def of(cls, n_words: int) -> Shape:
        """The sizes for a vocabulary."""
        more = max(0, (max(1, n_words) - 1).bit_length() - (LEAST_WORDS - 1).bit_length())
        return cls(LEAST_SLOT_BITS + more, 13 + (more + 1) // 2, 16 + (more + 1) // 2)

    @property
    def slots(self) -> int:
        return 1 << self.slot_bits

    @property
    def rows(self) -> int:
        return (3 << self.class_row_bits) + (2 << self.slot_row_bits)

    @property
    def levels(self) -> list[tuple[int, int]]:
        """Bits above and bits of each softmax."""
        n = -(-self.slot_bits // CLASS_BITS)
        edges = [-(-self.slot_bits * i // n) for i in range(n + 1)]
        return [(at, end - at) for at, end in zip(edges, edges[1:])]


SMALL = Shape(8, 13, 16)  # of a model that is given no vocabulary to follow
SLOTS = SMALL.slots

_COUNTS = "chunk long, bucket int, tally binary, counts binary, n_words long, hashes binary, uses binary"
_ARROW_COUNTS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("tally", pa.binary()),
                           ("counts", pa.binary()), ("n_words", pa.int64()), ("hashes", pa.binary()), ("uses", pa.binary())])
_TOTALS = "slot int, tokens long, words long"
_UPDATE = "block int, weight binary, change binary"
_ARROW_UPDATE = pa.schema([("block", pa.int32()), ("weight", pa.binary()), ("change", pa.binary())])
_SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, model_score double")
_ARROW_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                           ("n_known", pa.int64()), ("base_sum", pa.float64()), ("model_score", pa.float64())])


def _tokens(text: str) -> list[bytes]:
    """Words between ASCII white space with A-Z in lower case, and the end of the text, which is
    the empty word."""
    words = text.encode().lower().split()
    words.append(b"")
    return words


class _History:
    """The tokens of some documents and the two before each, 0 where a document begins."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, shape: Shape = SMALL):
        n, starts = len(hashes), spans(lengths)[:-1]
        starts = starts[lengths > 0]
        self.hashes, self.shape = hashes, shape
        self.before, self.skipped = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        self.before[1:], self.skipped[2:] = hashes[:-1], hashes[:-2]
        self.before[starts] = 0
        self.skipped[starts] = 0
        self.skipped[starts[starts + 1 < n] + 1] = 0

    def levels(self, at) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each softmax, of the tokens at these positions: the places above, their place and the
        rows of the weight matrix that they use."""
        shape, hashes, before, skipped = self.shape, self.hashes[at], self.before[at], self.skipped[at]
        pair = before * np.uint32(2654435761) + skipped * np.uint32(2246822519)
        for start, bits in shape.levels:
            above = _lead(hashes, start)
            place = _lead(hashes, start + bits) & np.uint32((1 << bits) - 1)
            if start == 0:
                rows = [(i << shape.class_row_bits) + _bits(h, shape.class_row_bits)
                        for i, h in enumerate((before, skipped, pair))]
            else:
                path, rows = (above + np.uint32(1 << start)) * np.uint32(3266489917), []
                for i, h in enumerate((before, skipped)):
                    mixed = (h ^ path) * np.uint32(2246822519)
                    mixed ^= mixed >> np.uint32(15)
                    first = (3 << shape.class_row_bits) + (i << shape.slot_row_bits)
                    rows.append(first + _bits(mixed, shape.slot_row_bits))
            yield above.astype(np.int32), place.astype(np.int64), rows


def _lead(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint32(32 - bits) if bits else np.zeros_like(hashes)


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * np.uint32(2654435769)) >> np.uint32(32 - bits)).astype(np.int32)


def _exponents(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    logits, places = bias, bias.shape[1]
    table = weights.reshape(-1, places)  # a softmax of few places uses the first part of a row
    for used in rows:
        logits += table.take(used * (CLASSES // places), axis=0)
    logits -= np.ascontiguousarray(logits.T).max(axis=0)[:, None]  # faster than along the rows
    return logits


def _row_sums(values: np.ndarray) -> np.ndarray:
    return values @ np.ones(values.shape[1], np.float32)


def _by_row(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Uses of rows, by row and then in order of the text: the token of each use, the rows,
    where their uses begin and how many they are."""
    n = np.arange(len(rows[0]))
    keys = np.concatenate([(r.astype(np.int64) << STEP_BITS) | n for r in rows])
    keys.sort()
    order, ranked = keys & (STEP_TOKENS - 1), keys >> STEP_BITS
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return order, ranked[first], first, np.diff(np.append(first, len(keys)))


def _sums_by_row(gradient: np.ndarray, order: np.ndarray, first: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """The sum of each row's gradients: `order` has their tokens row by row, `first` where a row's begin."""
    total = gradient.take(order[first], axis=0)
    for n in range(2, FEW_USES + 1):
        at = np.flatnonzero(uses == n)
        if len(at):
            rest = gradient.take(order[first[at] + 1], axis=0)
            for i in range(2, n):
                rest += gradient.take(order[first[at] + i], axis=0)
            total[at] += rest
    often = uses > FEW_USES
    if often.any():
        total[often] = np.add.reduceat(gradient.take(order[np.repeat(often, uses)], axis=0), spans(uses[often])[:-1], axis=0)
    return total


class Model:
    """Corpus totals and the weights; their sizes are those of the shape. A pickled model comes back
    with weights of 16 bits, to be read only; `widen` gives them 32."""

    def __init__(self, slot_tokens: np.ndarray, slot_words: np.ndarray, shape: Shape = SMALL):
        self.slot_tokens, self.slot_words, self.shape = slot_tokens, slot_words, shape
        prior = slot_tokens + 1.0
        self.biases = []
        for at, bits in shape.levels:
            mass = prior.reshape(1 << at, 1 << bits, -1).sum(axis=2)
            self.biases.append(np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32))
        self.weights = np.zeros((shape.rows, CLASSES), np.float32)

    def __getstate__(self) -> dict:
        """Weights go to the tasks in 16-bit floating point; steps and sums have 32 bits or more."""
        halves = self.weights.astype(np.float16)
        return vars(self) | {"weights": zstandard.ZstdCompressor(level=1).compress(halves)}

    def __setstate__(self, state: dict) -> None:
        halves = np.frombuffer(zstandard.ZstdDecompressor().decompress(state["weights"]), np.float16)
        vars(self).update(state, weights=halves.reshape(-1, CLASSES))

    def widen(self) -> Model:
        """The weights in 32 bits, as every use of 16 would convert them anew."""
        self.weights = self.weights.astype(np.float32, copy=False)
        return self

    def __copy__(self) -> Model:
        twin = Model.__new__(Model)
        vars(twin).update(vars(self))
        return twin

    @property
    def n_tokens(self) -> int:
        return int(self.slot_tokens.sum())

    @property
    def n_words(self) -> int:
        return int(self.slot_words.sum())

    def log_probs(self, history: _History, at: slice) -> np.ndarray:
        """Natural log of the slot of each token."""
        n, total = np.arange(at.stop - at.start), 0.0
        for bias, (above, place, rows) in zip(self.biases, history.levels(at)):
            logits = _exponents(bias.take(above, axis=0), self.weights, rows)
            own = logits.ravel().take(n * logits.shape[1] + place)
            total = total + own - np.log(_row_sums(np.exp(logits, out=logits)))
        return total

    def learn(self, history: _History, chosen: np.ndarray, seen: np.ndarray, squares: np.ndarray) -> None:
        """Gradient steps with a rate per row over the chosen tokens; `seen` counts the uses of a row."""
        for start in range(0, len(chosen), STEP_TOKENS):
            at = chosen[start:start + STEP_TOKENS]
            n, gradients = np.arange(len(at)), []
            for bias, (above, place, rows) in zip(self.biases, history.levels(at)):
                missing = _exponents(bias.take(above, axis=0), self.weights, rows)
                np.exp(missing, out=missing)
                missing *= (-1 / _row_sums(missing))[:, None]
                missing.ravel()[n * missing.shape[1] + place] += 1
                gradients.append((rows, missing))
            for rows, gradient in gradients:  # the features of a softmax have rows of their own
                order, touched, first, uses = _by_row(rows)
                total, places = _sums_by_row(gradient, order, first, uses), gradient.shape[1]
                seen[touched] += uses
                scale = squares[touched] + np.einsum("ij,ij->i", total, total) / CLASSES
                squares[touched] = scale
                total *= (RATE / np.sqrt(scale + 1e-6))[:, None]
                table, touched = self.weights.reshape(-1, places), touched * (CLASSES // places)
                total += table.take(touched, axis=0)
                whole = f"V{places * table.itemsize}"  # rows are put as wholes, not entry by entry
                np.put(table.view(whole), touched, total.view(whole))


def score_documents(docs: DataFrame, is_training, rounds: int = ROUNDS) -> DataFrame:
    """Score every row of `(doc_id, text)` with a model of the rows where `is_training` holds.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): `n_known`
    tokens occur in training rows, `train_tokens` is their number there, `base_score` the
    log10 probability of add-one unigrams and `score` that of the model. Every text ends in
    an end token; null text is empty, so it has that one only. Repeated rows and null ids
    give a row each. With no training rows the model is uniform. Other columns are ignored.
    """
    spark = docs.sparkSession
    flagged = docs.select("doc_id", "text", F.coalesce(is_training, F.lit(False)).alias("flag"))
    n_buckets = shuffle_partitions(spark)
    packed = materialize(pack(flagged, _tokens, n_buckets, hashed=True), "lm-chunks")

    words = packed.where("bucket is not null").select("chunk", "bucket", "words", "tally", "uses")
    ship_package(spark)
    counts = materialize(words.groupBy("bucket").applyInArrow(_count_bucket, _COUNTS), "lm-counts")
    shape = Shape.of(counts.agg(F.sum("n_words")).first()[0] or 0)
    model = Model(*_slot_totals(counts, shape), shape)

    chunks = packed.where("bucket is null").select("chunk", "doc_ids", "flags", "lengths", "numbers", "hashes")
    for number in range(rounds):
        share = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == number)
        _train_round(share, model)

    shared = spark.sparkContext.broadcast(model)
    word_counts = counts.where("chunk is not null").select("chunk", "bucket", "tally", "counts")
    scored = chunks.groupBy("chunk").cogroup(word_counts.groupBy("chunk")).applyInArrow(_scorer(shared), _SCORES)
    # log10 of (c + 1) / (N + 1 * (V + 1)) for each token
    unit = float(np.log10(model.n_tokens + model.n_words + 1))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * unit).alias("base_score"), F.col("model_score").alias("score"))


def _count_bucket(rows: pa.Table) -> pa.Table:
    """The corpus count of every word of a bucket, back in the order of each chunk, and its training words."""
    totals: dict[bytes, int] = defaultdict(int)
    chunks = rows.select(["chunk", "words", "tally", "uses"]).to_pylist()
    bucket = rows.column("bucket")[0].as_py()
    for row in chunks:
        for word, uses in zip(expand_words(row["words"]), expand(row["uses"]).tolist()):
            totals[word] += uses
    trained = [word for word, uses in totals.items() if uses]
    out = [{"bucket": bucket, "n_words": len(trained),
            "hashes": squeeze(np.fromiter(map(zlib.crc32, trained), np.uint32, len(trained))),
            "uses": squeeze(np.fromiter(map(totals.__getitem__, trained), np.uint64, len(trained)))}]
    for row in chunks:
        found = [totals[word] for word in expand_words(row["words"])]
        out.append({"chunk": row["chunk"], "bucket": bucket, "tally": row["tally"],
                    "counts": squeeze(np.array(found, np.uint64))})
    return pa.Table.from_pylist(out, schema=_ARROW_COUNTS)


def _slot_totals(counts: DataFrame, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and words of every slot."""
    def by_slot(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = np.zeros(shape.slots, np.int64), np.zeros(shape.slots, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                slots, uses = _lead(expand(row["hashes"]), shape.slot_bits), expand(row["uses"]).astype(np.int64)
                np.add.at(tokens, slots, uses)
                np.add.at(words, slots, 1)
        found = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array(tokens[found]), pa.array(words[found])], ["slot", "tokens", "words"])

    partial = map_arrow(counts.where("chunk is null").select("hashes", "uses"), by_slot, _TOTALS)
    sums = partial.groupBy("slot").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).toArrow()
    tokens, words = np.zeros(shape.slots, np.int64), np.zeros(shape.slots, np.int64)
    slots = sums.column("slot").to_numpy()  # one row per slot
    tokens[slots], words[slots] = sums.column("tokens").to_numpy(), sums.column("words").to_numpy()
    return tokens, words


def _train_round(chunks: DataFrame, model: Model) -> None:
    """One pass of gradient steps over the chunks; the averaged changes go into the weights."""
    spark = chunks.sparkSession
    start = spark.sparkContext.broadcast(model)
    tasks = chunks.coalesce(parallelism(spark))  # each task sends one copy of its changes
    changes = map_arrow(tasks, _trainer(start), _UPDATE)
    dealt = changes.repartition(shuffle_partitions(spark), "block")
    for row in map_arrow(dealt, _average, _UPDATE).toLocalIterator():  # the matrix, once
        at = row.block * BLOCK_ROWS
        change = np.frombuffer(row.change, np.float32).reshape(-1, CLASSES)
        model.weights[at:at + len(change)] += change
    start.destroy()


def _trainer(start):
    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = copy(start.value)
        model.weights, n_rows = start.value.weights.astype(np.float32), model.shape.rows
        seen, squares = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.float32)
        for batch in batches:
            for row in batch.to_pylist():
                lengths, training = expand(row["lengths"]), np.frombuffer(row["flags"], np.bool_)
                history = _History(expand(row["hashes"])[expand_ranks(row["numbers"])], lengths, model.shape)
                chosen = np.flatnonzero(np.repeat(training, lengths))
                model.learn(history, chosen, seen, squares)
        for at in range(0, n_rows, BLOCK_ROWS):
            if (weight := seen[at:at + BLOCK_ROWS]).any():
                used = at + np.flatnonzero(weight)  # other rows have not changed
                change = model.weights[used] - start.value.weights[used]
                yield pa.RecordBatch.from_pylist([{"block": at // BLOCK_ROWS, "weight": squeeze(weight),
                                                   "change": _squeeze_change(change)}], schema=_ARROW_UPDATE)

    return train


def _squeeze_change(change: np.ndarray) -> bytes:
    """A change of weights on its way: the peak of each row, and its entries as 127ths of that."""
    peak = np.maximum(np.abs(change).max(axis=1), 1e-30).astype(np.float32)
    shares = np.rint(change / peak[:, None] * 127).astype(np.int8)
    return zstandard.ZstdCompressor(level=3).compress(peak.tobytes() + shares.tobytes())


def _expand_change(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = len(raw) // (4 + CLASSES)
    peak, shares = np.frombuffer(raw, np.float32, n), np.frombuffer(raw, np.int8, offset=4 * n)
    return shares.reshape(-1, CLASSES) * (peak.astype(np.float64) / 127)[:, None]


def _average(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            weight = expand(row["weight"]).astype(np.float64)
            change = np.zeros((len(weight), CLASSES))
            change[weight > 0] = _expand_change(row["change"])
            change *= weight[:, None]
            if (old := sums.get(row["block"])) is not None:
                weight, change = old[0] + weight, old[1] + change
            sums[row["block"]] = weight, change
    for block, (weight, change) in sums.items():
        mean = (change / np.maximum(weight, 1)[:, None]).astype(np.float32)
        yield pa.RecordBatch.from_pylist([{"block": block, "weight": b"", "change": mean.tobytes()}],
                                         schema=_ARROW_UPDATE)


def _scorer(shared):
    def score(chunks: pa.Table, word_counts: pa.Table) -> pa.Table:
        model = shared.value.widen()
        found = sorted(word_counts.select(["bucket", "tally", "counts"]).to_pylist(), key=lambda row: row["bucket"])
        counts = np.concatenate([np.zeros(0, np.int64), *(expand(row["counts"]).astype(np.int64) for row in found)])
        counts = counts[rank_order(row["tally"] for row in found)]
        hashes = [np.zeros(0, np.uint32), *(expand(packed.as_py()) for packed in chunks.column("hashes"))]
        base = np.log10(counts + 1.0)
        in_slot = base - np.log10(model.slot_tokens + model.slot_words + 1.0)[
            _lead(np.concatenate(hashes), model.shape.slot_bits)]
        parts = []
        for row in chunks.to_pylist():
            lengths, numbers = expand(row["lengths"]), expand_ranks(row["numbers"])
            history = _History(expand(row["hashes"])[numbers], lengths, model.shape)
            scores = in_slot[numbers]
            for at in range(0, len(numbers), STEP_TOKENS):
                step = slice(at, min(at + STEP_TOKENS, len(numbers)))
                scores[step] += model.log_probs(history, step) / np.log(10)
            edges = spans(lengths)[:-1]
            parts.append(pa.Table.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array(~np.frombuffer(row["flags"], np.bool_)),
                pa.array(lengths.astype(np.int64)),
                pa.array(np.add.reduceat((counts[numbers] > 0).astype(np.int64), edges)),
                pa.array(np.add.reduceat(base[numbers], edges)), pa.array(np.add.reduceat(scores, edges)),
            ], schema=_ARROW_SCORES))
        return pa.concat_tables(parts) if parts else _ARROW_SCORES.empty_table()

    return score


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of `documents`; a seventh of the ids is held out of training."""
    is_training = F.pmod(crc_of_id(F.col("doc_id")), F.lit(7)) != 2
    return score_documents(read_table(spark, sf_dir, "documents"), is_training)


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
ORACLES: dict[str, str] = {}
