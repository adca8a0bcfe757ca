"""Token counts with overlap resynchronisation for huge documents.

A document of up to `window` characters is encoded as a whole. A longer one is cut into
windows that overlap, which are dealt to tasks one by one. Two neighbours are spliced at a
place in their overlap where both start a pre-token; if they share none, the document is cut
again with a wider overlap.

Why the splice is exact. From the start of a pre-token on, the splitting pattern looks only
ahead. So once the right window starts a pre-token where the left one, whose splitting is
true there, starts one too, all that the right window yields from there on is true. What the
left window yields close to its end may differ for want of the text that follows; starts
within `MARGIN` characters of the end are not used. The margin exceeds the longest special
string by the reach of the pattern's lookahead. Merges never cross pre-tokens.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import map_arrow
from .tables import materialize, read_table, shuffle_partitions

VOCABULARY = "byte_bpe_50k.json"
WINDOW = 32_768
OVERLAP = 512
MARGIN = 64
TOKEN_LIMIT = 1024

_COUNTS = "doc_id long, n_bytes long, n_tokens long"
_ARROW_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
_WINDOWS = "row long, part int, start long, is_last boolean, text string"
_ARROW_WINDOWS = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("start", pa.int64()),
                            ("is_last", pa.bool_()), ("text", pa.string())])
_ENDS = "row long, part int, head array<long>, before_head array<long>, tail array<long>, before_tail array<long>"
_ARROW_ENDS = pa.schema([("row", pa.int64()), ("part", pa.int32())] + [
    (name, pa.list_(pa.int64())) for name in ("head", "before_head", "tail", "before_tail")])
_ARROW_SPLICED = pa.schema([("row", pa.int64()), ("n_tokens", pa.int64())])


@lru_cache(maxsize=2)
def _windows_encoder(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def _whole_encoder(path: str) -> tiktoken.Encoding:
    """The same vocabulary for a faster library; ids of a byte-level BPE are its ranks.

    Both libraries agree on every code point (tests/llm/test_token_counts.py).
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    as_byte = {char: byte for byte, char in enumerate(_byte_alphabet())}
    ranks = {bytes(map(as_byte.__getitem__, token)): rank
             for token, rank in content["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it prints in Latin-1, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(byte) if byte in prints else chr(next(rest)) for byte in range(256)]


def count_tokens(
    docs: DataFrame,
    vocabulary: str | None = None,
    window: int = WINDOW,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of `(doc_id, text)`.

    `vocabulary` is a tokenizer file at the same place on every node. Special strings in a
    text count as the special token, which is the library's default; none are added. Null
    text is empty: no bytes, no tokens. Repeated rows and null ids give a row each; other
    columns are ignored.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = docs.select("doc_id", "text")
    is_huge = F.coalesce(F.length("text"), F.lit(0)) > window
    whole = map_arrow(rows.where(~is_huge), _count_whole(path), _COUNTS)
    huge = materialize(rows.where(is_huge).select(F.monotonically_increasing_id().alias("row"), "*"), "huge-texts")

    found, pending = [], huge
    while not pending.isEmpty():
        spliced = materialize(_count_windows(pending, path, window, overlap), "spliced")
        found.append(spliced.where("n_tokens is not null"))
        pending = huge.join(spliced.where("n_tokens is null"), "row", "left_semi")
        overlap *= 8
        window = max(window, 4 * overlap)
    for part in found:
        counted = huge.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes")).join(part, "row")
        whole = whole.union(counted.select("doc_id", "n_bytes", "n_tokens"))
    return whole


def _count_whole(path: str):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _whole_encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = [len(encoder.encode(t, allowed_special="all")) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(tokens, pa.int64())], schema=_ARROW_COUNTS)

    return count


def _count_windows(huge: DataFrame, path: str, window: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of each text; n_tokens is null where neighbours share no start."""
    assert window > 2 * overlap > 2 * MARGIN
    cut = map_arrow(huge.select("row", "text"), _cutter(window, overlap), _WINDOWS)
    dealt = cut.repartition(shuffle_partitions(huge.sparkSession), "row", "part")
    ends = map_arrow(dealt, _ends(path, overlap), _ENDS)
    return ends.groupBy("row").applyInArrow(_splice, "row long, n_tokens long")


def _cutter(window: int, overlap: int):
    step = window - overlap

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                text = text.as_py()
                starts = range(0, max(1, len(text) - overlap), step)
                for part, start in enumerate(starts):
                    yield pa.RecordBatch.from_pylist([{
                        "row": row, "part": part, "start": start, "is_last": part == len(starts) - 1,
                        "text": text[start:start + window]}], schema=_ARROW_WINDOWS)

    return cut


def _ends(path: str, overlap: int):
    """For each window the pre-token starts in its two overlaps, and how many tokens precede each."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _windows_encoder(path)
        for batch in batches:
            for row in batch.to_pylist():
                encoded = encoder.encode(row["text"], add_special_tokens=False)
                words = np.array([-1 if w is None else w for w in encoded.word_ids], np.int64)
                at = np.array([a for a, _ in encoded.offsets], np.int64) + row["start"]
                first = np.flatnonzero(np.concatenate([[True], np.diff(words) != 0]) | (words < 0)) if len(at) else []
                before, at = np.array(first, np.int64), at[first] if len(at) else at
                start, end = row["start"], row["start"] + len(row["text"])
                head = at < start + overlap - MARGIN if row["part"] else at == start
                tail = (at >= end - overlap) & (at < end - MARGIN)
                yield pa.RecordBatch.from_pylist([{
                    "row": row["row"], "part": row["part"],
                    "head": at[head].tolist(), "before_head": before[head].tolist(),
                    "tail": [end] if row["is_last"] else at[tail].tolist(),
                    "before_tail": [len(encoded)] if row["is_last"] else before[tail].tolist()}], schema=_ARROW_ENDS)

    return encode


def _splice(ends: pa.Table) -> pa.Table:
    parts = sorted(ends.to_pylist(), key=lambda row: row["part"])
    total: int | None = 0
    entry = dict(zip(parts[0]["head"], parts[0]["before_head"]))[0]
    for left, right in zip(parts, [*parts[1:], None]):
        if right is None:
            total += left["before_tail"][0] - entry
            break
        shared = sorted(set(left["tail"]) & set(right["head"]))
        if not shared:
            total = None
            break
        place = shared[0]
        total += dict(zip(left["tail"], left["before_tail"]))[place] - entry
        entry = dict(zip(right["head"], right["before_head"]))[place]
    return pa.Table.from_pylist([{"row": parts[0]["row"], "n_tokens": total}], schema=_ARROW_SPLICED)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text of `documents`."""
    counted = count_tokens(read_table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
