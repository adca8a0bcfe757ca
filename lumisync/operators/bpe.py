"""Byte-pair tokens for a text column, each distinct word encoded once.

Texts are cut into words once and packed into chunks: the distinct words of a few megabytes of text, and
every text as numbers of these. The distinct words of all chunks are a table of their own. Its words are
split by merge ranks that each task holds or, with a merge table too large for that, by joins with the merge
table, one merge of every word a round. Chunks then pick up the tokens of their words: from a copy in each task
if the encoded words are few enough for that, else by a join with one row for each word of a chunk, in which no
frequent word is hot.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import BOS, EOS, pretokenize
from ..session import map_arrow, parallelism, ship_package
from .joins import look_up, written

END_OF_WORD = "</w>"
MAX_MERGES = 48_894  # fixed value: merge lines of a published table that are used, after one header line
# So many rows of the merge table and of the vocabulary, and so many bytes of encoded words, does a task hold.
HELD_MERGES = 500_000
HELD_TOKENS = 1_000_000
HELD_WORD_BYTES = 64 << 20
CHUNK_BYTES = 16 << 20  # of the words of the texts in a chunk
ROWS_PER_STEP = 1_000
LONG_WORD = 64
_UNRANKED = float("inf")


@dataclass(frozen=True)
class BpeTables:
    """Merges (rank, a, b) and, for ids, the vocabulary (token, id), of any size."""

    merges: DataFrame
    vocab: DataFrame | None = None


def read_merges(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(rank, a, b) from a merges file: one header line, then one pair per line, of which the first `MAX_MERGES`
    count unless the `whole` file does."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split(F.regexp_replace("value", r"\A\s+|\s+\z", ""), "\n")))
    pair = F.split(F.trim("col"), r"\s+")
    used = lines.where((F.col("pos") >= 1) & (F.lit(whole) | (F.col("pos") <= MAX_MERGES)))
    return used.select((F.col("pos") - 1).alias("rank"), pair[0].alias("a"), pair[1].alias("b"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) from a JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))


def split_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Join neighbours, best-ranked pair first, until no known pair is left."""
    if word in (BOS, EOS):
        return [word]
    parts = [*word[:-1], word[-1] + END_OF_WORD]
    ranked = [ranks.get(pair, _UNRANKED) for pair in pairwise(parts)]
    while ranked and (best := min(ranked)) != _UNRANKED:
        if len(parts) > LONG_WORD:
            parts = _join_everywhere(parts, ranked, best)
            ranked = [ranks.get(pair, _UNRANKED) for pair in pairwise(parts)]
            continue
        while best in ranked:  # a join changes only the two pairs beside it
            at = ranked.index(best)
            parts[at] += parts.pop(at + 1)
            ranked.pop(at)
            if at:
                ranked[at - 1] = ranks.get((parts[at - 1], parts[at]), _UNRANKED)
            if at < len(ranked):
                ranked[at] = ranks.get((parts[at], parts[at + 1]), _UNRANKED)
    return parts


def _join_everywhere(parts: list[str], ranked: list[float], best: float) -> list[str]:
    """Join every pair of rank `best` from the left in one pass, for very long symbol runs."""
    joined, at = [], 0
    while at < len(parts):
        width = 2 if at < len(ranked) and ranked[at] == best else 1
        joined.append("".join(parts[at:at + width]))
        at += width
    return joined


def encode_words(words: DataFrame, tables: BpeTables) -> DataFrame:
    """(word, pieces[, ids]) of a table of distinct words; ids with a vocabulary, and a piece that it
    lacks is an error. Null words are not allowed."""
    spark = words.sparkSession
    merges = tables.merges.select("rank", "a", "b").limit(HELD_MERGES + 1).toArrow()
    if merges.num_rows > HELD_MERGES:
        pieces = _split_by_joins(words, tables.merges)
    else:
        held = spark.sparkContext.broadcast(merges)

        def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rank, a, b = (held.value.column(c).to_pylist() for c in ("rank", "a", "b"))
            ranks = dict(zip(zip(a, b), rank))
            for batch in batches:
                found = [split_word(word, ranks) for word in batch.column("word").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(found, pa.list_(pa.string()))],
                                                 names=["word", "pieces"])

        pieces = map_arrow(words.select("word").repartition(parallelism(spark)), split, "word string, pieces array<string>")
    return pieces if tables.vocab is None else _with_ids(pieces, tables.vocab)


def _with_ids(pieces: DataFrame, vocab: DataFrame) -> DataFrame:
    spark = pieces.sparkSession
    known = vocab.select("token", "id").limit(HELD_TOKENS + 1).toArrow()
    if known.num_rows <= HELD_TOKENS:
        held = spark.sparkContext.broadcast(known)

        def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = dict(zip(*(held.value.column(c).to_pylist() for c in ("token", "id"))))
            for batch in batches:
                found = [[ids[p] for p in word] for word in batch.column("pieces").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))],
                                                 names=["word", "pieces", "ids"])

        return map_arrow(pieces, number, "word string, pieces array<string>, ids array<int>")
    of_words = written(pieces, "pieces")
    tokens = written(of_words.select("word", F.posexplode("pieces").alias("at", "token")), "tokens")
    numbered = look_up(tokens, vocab.select("token", F.col("id").cast("int").alias("id")), ["token"])
    checked = F.coalesce("id", F.raise_error(F.concat(F.lit("KeyError: "), "token")).cast("int"))
    ids = numbered.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", checked.alias("id")))).alias("found"))
    return of_words.join(ids.select("word", F.col("found.id").alias("ids")), "word")


def _split_by_joins(words: DataFrame, merges: DataFrame) -> DataFrame:
    """(word, pieces) with a merge table of any size: in each round, a join finds the best pair of every word that
    has one, and all its places are joined. A word without one is done; the rounds end when all are."""
    special = F.col("word").isin(BOS, EOS)
    chars = F.split("word", "")
    last = F.array(F.concat(F.element_at(chars, -1), F.lit(END_OF_WORD)))
    pieces = F.when(special, F.array("word")).otherwise(F.concat(F.slice(chars, 1, F.length("word") - 1), last))
    still_open = written(words.select("word", pieces.alias("pieces"), F.lit(True).alias("open")), "split")
    done = []

    def join_best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for parts, best in zip(batch.column("pieces").to_pylist(), batch.column("best").to_pylist()):
                ranked = [0 if best and pair == (best["a"], best["b"]) else _UNRANKED for pair in pairwise(parts)]
                found.append(_join_everywhere(parts, ranked, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array(found, pa.list_(pa.string())), pc.is_valid(batch.column("best"))],
                names=["word", "pieces", "open"])

    while not still_open.isEmpty():
        n = F.size("pieces")
        sides = F.arrays_zip(F.slice("pieces", 1, n - 1).alias("a"), F.slice("pieces", 2, n - 1).alias("b"))
        pairs = still_open.where((n > 1) & ~special).select("word", F.inline(sides)).distinct()
        known = look_up(written(pairs, "pairs"), merges.select("rank", "a", "b"), ["a", "b"]).where("rank is not null")
        best = known.groupBy("word").agg(F.min(F.struct("rank", "a", "b")).alias("best"))
        stepped = still_open.select("word", "pieces").join(best, "word", "left")
        table = written(map_arrow(stepped, join_best, "word string, pieces array<string>, open boolean"), "split")
        done.append(table.where("not open").select("word", "pieces"))
        still_open = table.where("open")
    return reduce(DataFrame.union, done) if done else still_open.select("word", "pieces")


def bpe_pieces(docs: DataFrame, text_col: str, tables: BpeTables, out_col: str = "pieces") -> DataFrame:
    """Add the byte-pair pieces of each text. `docs` is read once."""
    packed = _packed(docs, text_col)
    encoded = encode_words(_words_of(packed), BpeTables(tables.merges))
    return _pick_up(docs, packed, out_col, encoded.select("word", F.col("pieces").alias("value")))


def token_ids(docs: DataFrame, text_col: str, tables: BpeTables, out_col: str = "ids",
              prepend_bos: bool = True, append_eos: bool = True) -> DataFrame:
    """Add the token ids of each text. A piece missing from the vocabulary is an error. `docs` is read once."""
    packed = _packed(docs, text_col)
    encoded = encode_words(_words_of(packed), tables)
    coded = _pick_up(docs, packed, out_col, encoded.select("word", F.col("ids").alias("value")))
    special = {r.token: r.id for r in tables.vocab.where(F.col("token").isin(BOS, EOS)).collect()}
    ends = [[F.array(F.lit(special[token]))] if wanted else []
            for token, wanted in ((BOS, prepend_bos), (EOS, append_eos))]
    return coded.withColumn(out_col, F.concat(*ends[0], F.col(out_col), *ends[1]))


def distinct_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word): the distinct words of a text column."""
    # by way of the outer form, for the plain one first filters by its argument, which cuts every text twice
    words = docs.select(F.explode_outer(F.array_distinct(_tokens(text_col))).alias("word"))
    return words.where("word is not null").distinct()


def _tokens(text_col: str):
    """The tokens of the normalised text. White space is in none, so lower case is all of it that they need."""
    return pretokenize(F.lower(F.col(text_col)))


def _packed(docs: DataFrame, text_col: str) -> DataFrame:
    """(chunk, rows, words), written: the rows of a chunk in Arrow's file format, with the numbers of the
    words of each text among the distinct `words` of the chunk, null for null text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = count(TaskContext.get().partitionId() << 33)
        for table in _stretches(batches, CHUNK_BYTES):
            tokens = table.column("__tokens").combine_chunks()
            coded = tokens.flatten().dictionary_encode()
            lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
            numbers = pa.ListArray.from_arrays(offsets, coded.indices, mask=tokens.is_null())
            rows = _to_bytes(table.drop_columns("__tokens").append_column("__numbers", numbers))
            words = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
            yield pa.RecordBatch.from_arrays([pa.array([next(serial)], pa.int64()), pa.array([rows], pa.binary()), words],
                                             names=["chunk", "rows", "words"])

    cut = docs.select(*docs.columns, _tokens(text_col).alias("__tokens"))
    return written(map_arrow(cut, run, "chunk long, rows binary, words array<string>"), "packed")


def _stretches(batches: Iterable[pa.RecordBatch], n_bytes: int) -> Iterator[pa.Table]:
    """Consecutive rows with about `n_bytes` of words, or one longer row by itself."""
    held, size = [], 0
    for batch in batches:
        tokens = batch.column("__tokens")
        ends = np.r_[0, np.cumsum(pc.binary_length(tokens.flatten()).to_numpy(zero_copy_only=False))]
        of_row = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        sizes = np.diff(ends[np.r_[0, np.cumsum(of_row)]]).tolist()
        first = 0
        for at, length in enumerate(sizes):
            if size and size + length > n_bytes:
                held.append(batch.slice(first, at - first))
                yield pa.Table.from_batches(held)
                held, size, first = [], 0, at
            size += length
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _words_of(packed: DataFrame) -> DataFrame:
    return packed.select(F.explode("words").alias("word")).distinct()


def _pick_up(docs: DataFrame, packed: DataFrame, out_col: str, encoded: DataFrame) -> DataFrame:
    """The rows of `docs` with the values of the words of each text, one after the other; null for null text."""
    encoded = written(encoded, "encoded")
    schema = docs.withColumn(out_col, F.lit(None).cast(encoded.schema["value"].dataType)).schema
    size = encoded.agg(F.sum(F.octet_length("word") + F.size("value") * 16 + 32)).first()[0] or 0
    if size > HELD_WORD_BYTES:
        return _pick_up_by_join(packed, out_col, encoded, schema)
    held = encoded.toArrow().combine_chunks()
    words, values = (held.column(c).combine_chunks() if held.num_rows else pa.array([], held.schema.field(c).type)
                     for c in ("word", "value"))
    shared = docs.sparkSession.sparkContext.broadcast((words, values))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, values = shared.value
        for batch in batches:
            for rows, own in zip(batch.column("rows"), batch.column("words")):
                places = pc.index_in(own.values, value_set=words)
                yield from _unpacked(rows.as_py(), values.take(places), out_col, schema)

    return map_arrow(packed.select("rows", "words"), run, schema)


def _unpacked(rows: bytes, values: pa.ListArray, out_col: str, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk with the values of their words, some rows at a time."""
    table = pa.ipc.open_stream(rows).read_all()
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    for batch in table.to_batches(max_chunksize=ROWS_PER_STEP):
        numbers = batch.column("__numbers")
        per_word = numbers.flatten()
        word_ends = np.r_[0, np.cumsum(sizes[per_word.to_numpy(zero_copy_only=False)])]
        lengths = numbers.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = pa.array(word_ends[np.r_[0, np.cumsum(lengths)].astype(np.int64)].astype(np.int32))
        coded = pa.ListArray.from_arrays(offsets, values.take(per_word).flatten(), mask=numbers.is_null())
        columns = [coded if c == out_col else batch.column(c) for c in schema.names]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)


def _pick_up_by_join(packed: DataFrame, out_col: str, encoded: DataFrame, schema: T.StructType) -> DataFrame:
    """The same by a join of the words of all chunks with the encoded words. A word is one row for a chunk,
    however often it occurs there."""
    used = packed.select("chunk", F.posexplode("words").alias("at", "word"))
    found = used.join(encoded, "word").select(F.col("chunk").alias("of"), "at", "value")

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        values = found.column("value").combine_chunks().take(pc.sort_indices(found.column("at")))
        parts = [part for rows in chunk.column("rows") for part in _unpacked(rows.as_py(), values, out_col, schema)]
        return pa.Table.from_batches(parts)

    ship_package(packed.sparkSession)
    return packed.select("chunk", "rows").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(run, schema)
