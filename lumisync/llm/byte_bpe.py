"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are split into pre-tokens with their positions and packed into chunks; the distinct
pre-tokens of a chunk travel to the task of their hash bucket, which encodes each once for
the whole corpus however many chunks use it. The ids travel back to the chunk, whose word
numbers put them in place. Decoding joins every id with its bytes in the token table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_arrow, ship_package
from .chunks import expand, expand_ranks, expand_words, pack, rank_order, spans, squeeze, take_runs
from .tables import materialize, read_table, shuffle_partitions

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHED_WORDS = 200_000

_ENCODED = "chunk long, bucket int, tally binary, ids binary, id_counts binary"
_ARROW_ENCODED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("tally", pa.binary()),
                            ("ids", pa.binary()), ("id_counts", pa.binary())])
_RESULT = "doc_id long, n_tokens long, ids binary, decoded binary"
_ARROW_RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
                           ("decoded", pa.binary())])


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a rank file, one `base64 id` pair a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def encode_and_decode(
    docs: DataFrame,
    vocabulary: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row of `(doc_id, text)`.

    `ids` are little-endian unsigned 32-bit numbers, `decoded` the bytes that they stand for.
    `vocabulary` is a rank file at the same place on every node. Null and empty texts have no
    tokens; repeated rows and null ids give a row each; other columns are ignored.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    compiled: list = []

    def split(text: str) -> list[bytes]:
        if not compiled:
            compiled.append(regex.compile(pattern))
        return [word.encode() for word in compiled[0].findall(text)]

    packed = materialize(pack(docs.select("doc_id", "text"), split, shuffle_partitions(spark)), "bpe-chunks")
    words = packed.where("bucket is not null").select("chunk", "bucket", "words", "tally")
    dealt = words.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket")
    encoded = map_arrow(dealt, _encoder(path, pattern), _ENCODED)
    chunks = packed.where("bucket is null").select("chunk", "doc_ids", "lengths", "numbers")
    ship_package(spark)
    return chunks.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(_assembler(path), _RESULT)


def _encoder(path: str, pattern: str):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, known, current = _encoding(path, pattern), {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != current or len(known) > CACHED_WORDS:
                    known, current = {}, row["bucket"]
                ids = []
                for word in expand_words(row["words"]):
                    if (found := known.get(word)) is None:
                        found = known[word] = encoding.encode_ordinary(word.decode())
                    ids.append(found)
                flat = np.fromiter((i for word in ids for i in word), np.uint32)
                counts = np.fromiter(map(len, ids), np.uint32, len(ids))
                yield pa.RecordBatch.from_pylist([{
                    "chunk": row["chunk"], "bucket": row["bucket"], "tally": row["tally"], "ids": squeeze(flat),
                    "id_counts": squeeze(counts)}], schema=_ARROW_ENCODED)

    return encode


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token table as one array of bytes and where each id's bytes start."""
    ranks = read_ranks(path)
    lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8), spans(lengths)


def _assembler(path: str):
    def assemble(chunks: pa.Table, encoded: pa.Table) -> pa.Table:
        found = sorted(encoded.to_pylist(), key=lambda row: row["bucket"])
        ids = np.concatenate([np.zeros(0, np.uint32), *(expand(row["ids"]) for row in found)])
        counts = np.concatenate([np.zeros(0, np.uint32), *(expand(row["id_counts"]) for row in found)]).astype(np.int64)
        places = rank_order(row["tally"] for row in found)
        starts, counts = spans(counts)[places], counts[places]
        token_bytes, token_starts = _token_bytes(path)
        parts = []
        for row in chunks.to_pylist():
            edges = spans(expand(row["lengths"]))
            numbers = expand_ranks(row["numbers"])
            for at in _stretches(edges):
                first, last = at
                here = numbers[edges[first]:edges[last]]
                of_words = counts[here]
                sequence = take_runs(ids, starts[here], of_words)
                in_doc = spans(of_words)[edges[first:last + 1] - edges[first]]
                lengths = (token_starts[1:] - token_starts[:-1])[sequence]
                text = take_runs(token_bytes, token_starts[sequence], lengths)
                in_text = spans(lengths)[in_doc]
                parts.append(pa.Table.from_arrays([
                    pa.array(row["doc_ids"][first:last], pa.int64()),
                    pa.array(np.diff(in_doc), pa.int64()),
                    _binary(sequence.astype("<u4").view(np.uint8), in_doc * 4),
                    _binary(text, in_text),
                ], schema=_ARROW_RESULT))
        return pa.concat_tables(parts) if parts else _ARROW_RESULT.empty_table()

    return assemble


def _stretches(edges: np.ndarray, words: int = 100_000) -> Iterator[tuple[int, int]]:
    """Consecutive documents of about so many words, to bound the memory of one step."""
    first = 0
    while first < len(edges) - 1:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + words, "right")) - 1)
        yield first, last
        first = last


def _binary(content: np.ndarray, edges: np.ndarray) -> pa.Array:
    whole = content.tobytes()
    return pa.array([whole[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary())


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every whole text of `documents`."""
    coded = encode_and_decode(read_table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLES: dict[str, str] = {}
