"""Documents packed into chunks: a vocabulary and, in order, the numbers of its words.

A chunk holds the documents of a stretch of one partition, a few megabytes of text. Its
words travel to other tasks once per chunk and not once per occurrence: they are dealt into
buckets by hash, one row for each chunk and bucket, sorted and compressed. A word that fills
a third of the corpus is one entry per chunk like any other, so no bucket becomes hot.

The packed table has two kinds of rows:

- `bucket` null: a chunk's documents (`doc_ids`, `flags`, `lengths` in words) and `numbers`,
  the word numbers of all its documents one after the other;
- `bucket` set: the chunk's sorted words of that bucket (`words`), how often the chunk has
  them (`tally`) and, if there are flags, how often its flagged documents do (`uses`).

A word's number is its rank by falling `tally`; of equal ones the lower bucket comes first,
then the sorted order. So numbers are mostly small, and `rank_order` finds a word from the
tallies of all buckets.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import map_arrow

CHUNK_BYTES = 16 << 20

_FIELDS = [
    ("chunk", T.LongType()), ("bucket", T.IntegerType()), ("doc_ids", T.ArrayType(T.LongType())),
    ("flags", T.BinaryType()), ("lengths", T.BinaryType()), ("numbers", T.BinaryType()),
    ("hashes", T.BinaryType()), ("words", T.BinaryType()), ("tally", T.BinaryType()), ("uses", T.BinaryType()),
]
PACKED = T.StructType([T.StructField(n, t) for n, t in _FIELDS])
_ARROW = pa.schema([
    ("chunk", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
    ("flags", pa.binary()), ("lengths", pa.binary()), ("numbers", pa.binary()),
    ("hashes", pa.binary()), ("words", pa.binary()), ("tally", pa.binary()), ("uses", pa.binary()),
])


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers from 0, compressed byte plane by byte plane; 32 bits wide if they come so."""
    width = 4 if values.dtype == np.uint32 else 8
    planes = np.ascontiguousarray(values, dtype=f"<u{width}").view(np.uint8).reshape(-1, width).T
    used = max((i + 1 for i in range(width) if planes[i].any()), default=0)
    packed = zstandard.ZstdCompressor(level=3).compress(planes[:used].tobytes())
    return bytes([width, used]) + len(values).to_bytes(8, "little") + packed


def expand(packed: bytes) -> np.ndarray:
    width, used, n = packed[0], packed[1], int.from_bytes(packed[2:10], "little")
    planes = np.zeros((width, n), np.uint8)
    raw = zstandard.ZstdDecompressor().decompress(packed[10:], max_output_size=max(1, used * n))
    planes[:used] = np.frombuffer(raw, np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def squeeze_ranks(ranks: np.ndarray) -> bytes:
    """Word numbers: a byte below 240, else one byte that holds the top four of twenty bits and two more."""
    if len(ranks) and ranks.max() >= 1 << 20:
        return b"\x00" + squeeze(ranks)
    large = ranks >= 240
    rest = ranks[large]
    lead = ranks.astype(np.uint8)
    lead[large] = 240 + (rest >> 16)
    planes = (lead, (rest >> 8).astype(np.uint8), rest.astype(np.uint8))
    packed = [zstandard.ZstdCompressor(level=3).compress(p.tobytes()) for p in planes]
    sizes = (len(lead), *map(len, packed))
    return b"\x01" + np.array(sizes, "<u8").tobytes() + b"".join(packed)


def expand_ranks(packed: bytes) -> np.ndarray:
    if packed[0] == 0:
        return expand(packed[1:])
    n, *sizes = np.frombuffer(packed[1:33], "<u8").tolist()
    edges = np.cumsum([33, *sizes]).tolist()
    lead, high, low = (
        np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[a:b], max_output_size=max(1, n)), np.uint8)
        for a, b in zip(edges, edges[1:]))
    ranks = lead.astype(np.uint32)
    large = lead >= 240
    ranks[large] = ((ranks[large] - 240) << 16) + (high.astype(np.uint32) << 8) + low
    return ranks


def rank_order(tallies: Iterable[bytes]) -> np.ndarray:
    """Where the word of each number is among the words of all buckets of its chunk, one after the other."""
    tally = np.concatenate([np.zeros(0, np.int64), *(expand(t).astype(np.int64) for t in tallies)])
    return np.argsort(-tally, kind="stable")


def squeeze_words(words: list[bytes]) -> bytes:
    """Words as their lengths and their bytes, so that a word may hold any byte."""
    lengths = squeeze(np.fromiter(map(len, words), np.uint32, len(words)))
    body = zstandard.ZstdCompressor(level=9).compress(b"".join(words))
    return len(lengths).to_bytes(8, "little") + lengths + body


def expand_words(packed: bytes) -> list[bytes]:
    at = 8 + int.from_bytes(packed[:8], "little")
    ends = np.cumsum(expand(packed[8:at]), dtype=np.int64).tolist()
    if not ends:
        return []
    body = zstandard.ZstdDecompressor().decompress(packed[at:], max_output_size=max(1, ends[-1]))
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def pack(
    docs: DataFrame,
    split: Callable[[str], list[bytes]],
    n_buckets: int,
    hashed: bool = False,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Pack `(doc_id, text[, flag])` rows; null text is empty. `split` gives a text's words.

    `flag` marks the documents whose words count in `uses`, which is null without it. `hashed` adds
    the crc32 of each word of the vocabulary. A chunk holds at least one document and ends
    with the document that reaches `chunk_bytes`.
    """
    has_flag = "flag" in docs.columns

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = count(TaskContext.get().partitionId() << 32)
        ids, flags, parts, size = [], [], [], 0
        numbers = defaultdict(count().__next__)
        for batch in batches:
            marks = batch.column("flag").to_pylist() if has_flag else [None] * batch.num_rows
            for doc_id, text, mark in zip(batch.column("doc_id").to_pylist(), batch.column("text"), marks):
                text = text.as_py() or ""
                words = split(text)
                ids.append(doc_id)
                flags.append(mark)
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                size += len(text) + 64
                if size >= chunk_bytes:
                    yield _packed(next(serial), ids, flags, parts, list(numbers), n_buckets, hashed)
                    ids, flags, parts, size = [], [], [], 0
                    numbers = defaultdict(count().__next__)
        if ids:
            yield _packed(next(serial), ids, flags, parts, list(numbers), n_buckets, hashed)

    return map_arrow(docs, rows, PACKED)


def _packed(chunk: int, ids: list, flags: list, parts: list[np.ndarray], vocabulary: list[bytes],
            n_buckets: int, hashed: bool) -> pa.RecordBatch:
    hashes = np.fromiter(map(zlib.crc32, vocabulary), np.uint32, len(vocabulary))
    buckets = hashes % n_buckets
    order = sorted(range(len(vocabulary)), key=vocabulary.__getitem__)
    order = np.array(order, np.int64)[np.argsort(buckets[order], kind="stable")] if order else np.zeros(0, np.int64)
    lengths = np.array([len(p) for p in parts], np.uint32)
    numbers = np.concatenate([np.zeros(0, np.uint32), *parts])
    parts.clear()  # as large as the numbers
    tally = np.bincount(numbers, minlength=len(vocabulary))[order]
    ranked = np.argsort(-tally, kind="stable")
    rank_of = np.empty(len(vocabulary), np.uint32)
    rank_of[order[ranked]] = np.arange(len(vocabulary), dtype=np.uint32)
    uses = None
    if flags[0] is not None:
        flagged = numbers[np.repeat(np.array(flags, bool), lengths)]
        uses = np.bincount(flagged, minlength=len(vocabulary))[order]
    rows = [{"chunk": chunk, "doc_ids": ids, "flags": bytes(map(bool, flags)), "lengths": squeeze(lengths),
             "numbers": squeeze_ranks(rank_of[numbers]), "hashes": squeeze(hashes[order][ranked]) if hashed else None}]
    starts, in_order = np.searchsorted(buckets[order], np.arange(n_buckets + 1)), [vocabulary[i] for i in order.tolist()]
    for bucket in np.unique(buckets).tolist():
        lo, hi = int(starts[bucket]), int(starts[bucket + 1])
        rows.append({"chunk": chunk, "bucket": bucket, "words": squeeze_words(in_order[lo:hi]),
                     "tally": squeeze(tally[lo:hi]), "uses": None if uses is None else squeeze(uses[lo:hi])})
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def spans(lengths: np.ndarray) -> np.ndarray:
    """Where each of some consecutive pieces starts, and the end of the last."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def take_runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs `values[start:start + length]`, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)
    return values[at]
