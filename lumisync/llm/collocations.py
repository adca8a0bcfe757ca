"""Phrase collocations from a prefix-free parse of the texts.

Each document is a stream of words with a separator between pieces and three at its end. A window
of three tokens whose hash falls below a bound is a trigger: it ends one chunk and starts the
next, so neighbouring chunks share exactly that window. Chunks depend on content only: copies,
repeated lines and shared passages parse alike, and the dictionary of distinct chunks holds each
once with its parse frequency. Phrases are counted inside distinct chunks, weighted. A phrase
of up to four words belongs to the chunk in which it starts before the last three tokens, so those
in a shared window are counted once.

Counting goes by length. Words are counted first; then pairs of frequent words; then phrases of
three and four words all of whose pairs are frequent. No candidate is lost, for a phrase is
never more frequent than its parts. Tasks test this in a bitmap of hashes with a bounded size; a
chance hit lets a phrase through to be counted, nothing else.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import map_arrow
from .tables import arrow_slices, look_up, materialize, read_table

LEAST_COUNT = 30
INSIDE_PERCENT = 80  # of a phrase's occurrences in a longer one make it a part of that
FIRST = 2000
LONGEST = 4
OVERLAP = LONGEST - 1
CHUNK_TOKENS = 16  # mean distance of triggers
SLICE_BYTES = 8 << 20
BITS_A_PHRASE = 32
LEAST_BITS, MOST_BITS = 20, 30  # logarithms of the bitmap's size: 128 KB to 128 MB
SUMMITS = 64  # first tier of the ranking

_SEPARATOR = b"."
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")

_CHUNKS = "lang string, chunk string, parses long"
_PHRASES = "lang string, size int, phrase string, f long"


def _tokens(text: bytes) -> list[bytes]:
    """Words in lower case and a `.` for each end of a piece; words hold neither space nor `.`."""
    return text.translate(_FOLD).replace(_SEPARATOR, b" . ").split()


def _mix(*hashes: np.ndarray) -> np.ndarray:
    """One 32-bit hash of some hashes in order."""
    total = np.zeros(1, np.uint32)
    for h in hashes:
        total = (total ^ h) * np.uint32(2654435769)
        total = total ^ (total >> np.uint32(15))
        total = total * np.uint32(2246822519)
        total = total ^ (total >> np.uint32(13))
    return total


def _cuts(hashes: np.ndarray) -> np.ndarray:
    """Places after the first at which a trigger starts, in the tokens of one document up to some point."""
    if len(hashes) <= LONGEST:
        return np.zeros(0, np.int64)
    window = _mix(*(hashes[i:len(hashes) - OVERLAP + 1 + i] for i in range(OVERLAP)))
    found = np.flatnonzero(window <= np.uint32((1 << 32) // CHUNK_TOKENS - 1))
    return found[(found > 0) & (found < len(hashes) - OVERLAP)]


def _parse(texts: Iterable[bytes]) -> Iterator[bytes]:
    """The chunks of one document whose text comes in parts that end between tokens."""
    known: dict[bytes, int] = {}
    carried: list[bytes] = []
    for part in texts:
        carried += _tokens(part)
        starts = [0, *_cuts(_hashes(carried, known)).tolist()]
        # a trigger too close to the end of the tokens so far is found with the next part
        for first, last in zip(starts, starts[1:]):
            yield b" ".join(carried[first:last + OVERLAP])
        carried = carried[starts[-1]:]
    if carried:
        carried += [_SEPARATOR] * OVERLAP
        starts = [0, *_cuts(_hashes(carried, known)).tolist()]
        for first, last in zip(starts, [*starts[1:], len(carried)]):
            yield b" ".join(carried[first:last + OVERLAP])


def _hashes(tokens: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    for token in set(tokens).difference(known):
        known[token] = zlib.crc32(token)
    return np.fromiter(map(known.__getitem__, tokens), np.uint32, len(tokens))


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of bounded size that end at a space, a tab or the end of a piece."""
    first = 0
    while first < len(text):
        last = min(len(text), first + SLICE_BYTES)
        while last < len(text) and text[last] not in b" \t.,;:!?\n\x0b\x0c\r":
            last += 1
        yield text[first:last]
        first = last


def parse_chunks(docs: DataFrame) -> DataFrame:
    """(lang, chunk, parses): the distinct chunks of each language and how often the texts parse to them.

    Null text is empty, null language `und`. Other columns are ignored.
    """
    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrow_slices(batches, "text", SLICE_BYTES):
            found: dict[str, Counter] = defaultdict(Counter)
            langs, texts = table.column("lang").to_pylist(), table.column("text").cast(pa.large_binary())
            for lang, text in zip(langs, texts):
                found[lang].update(_parse(_parts(text.as_py())))
            for lang, chunks in found.items():
                yield from _batches(lang, list(chunks), list(chunks.values()))

    columns = [F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")]
    parsed = map_arrow(docs.select(*columns), parse, _CHUNKS)
    return parsed.groupBy("lang", "chunk").agg(F.sum("parses").alias("parses"))


def _batches(lang: str, chunks: list[bytes], parses: list[int], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(chunks), rows):
        here = pa.array(chunks[at:at + rows], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(lang, pa.string()), len(here)), here, pa.array(parses[at:at + rows], pa.int64())],
            names=["lang", "chunk", "parses"])


class _Slice:
    """The tokens of some chunks as numbers, with the weight of the phrases that start at each; 0 where none does."""

    def __init__(self, table: pa.Table):
        chunks = table.column("chunk").cast(pa.large_binary())
        tokens: list[bytes] = []
        lengths = np.empty(table.num_rows, np.int64)
        for i, chunk in enumerate(chunks):
            words = chunk.as_py().split(b" ")
            lengths[i] = len(words)
            tokens += words
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        numbers[_SEPARATOR]  # 0
        self.numbers = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
        self.words = pa.array(list(numbers), pa.binary())
        langs = table.column("lang").combine_chunks().dictionary_encode()
        langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
        self.langs = langs.dictionary
        self.lang = np.repeat(langs.indices.to_numpy().astype(np.int64), lengths)
        ends = np.cumsum(lengths)
        owned = np.ones(len(tokens), bool)
        for back in range(1, OVERLAP + 1):
            owned[(ends - back)[lengths >= back]] = False
        self.weight = np.repeat(table.column("parses").to_numpy(), lengths)
        self.weight[~owned | (self.numbers == 0)] = 0
        word_hash = np.fromiter(map(zlib.crc32, numbers), np.uint32, len(numbers))
        lang_hash = np.fromiter((zlib.crc32(name.encode()) for name in self.langs.to_pylist()), np.uint32, len(self.langs))
        self.lang_hash, self.hash = lang_hash[self.lang], word_hash[self.numbers]

    def frequent(self, size: int, bitmap: np.ndarray) -> np.ndarray:
        """Whether the `size` tokens from each place may be a frequent phrase. Phrases with a separator are not."""
        out = np.zeros(len(self.numbers), bool)
        n = len(out) - size + 1
        if n > 0:
            at = _place(_mix(self.lang_hash[:n], *(self.hash[i:n + i] for i in range(size))), bitmap)
            out[:n] = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            for i in range(size):
                out[:n] &= self.numbers[i:n + i] > 0
        return out

    def counts(self, size: int, wanted: np.ndarray) -> pa.RecordBatch:
        """The weighted counts of the phrases of `size` words that start at the wanted places."""
        at = np.flatnonzero(wanted & (self.weight > 0))
        key = self.lang[at]
        for i in range(size):  # a phrase is the number of its beginning and its last word
            key = np.unique(key * len(self.words) + self.numbers[at + i], return_inverse=True)[1]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        total = np.add.reduceat(self.weight[at][order], first) if len(first) else np.zeros(0, np.int64)
        here = at[order][first]
        words = [self.words.take(pa.array(self.numbers[here + i])) for i in range(size)]
        phrase = words[0] if size == 1 else pc.binary_join_element_wise(*words, b" ")
        return pa.RecordBatch.from_arrays(
            [self.langs.take(pa.array(self.lang[here])), pa.repeat(pa.scalar(size, pa.int32()), len(here)),
             phrase.cast(pa.string()), pa.array(total, pa.int64())], names=["lang", "size", "phrase", "f"])


def _place(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """The place of each hash in a bitmap, whose size is a power of two."""
    return (hashes & np.uint32(len(bitmap) * 8 - 1)).astype(np.int64)


def _phrases(chunks: DataFrame, sizes: tuple[int, ...], below: tuple[int, np.ndarray] | None) -> DataFrame:
    """(lang, size, phrase, f) of the phrases of some sizes; with `below`, only of those whose parts of
    that size are in its bitmap."""
    part, bitmap = below or (0, None)
    shared = None if below is None else chunks.sparkSession.sparkContext.broadcast(bitmap)

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrow_slices(batches, "chunk", SLICE_BYTES):
            tokens = _Slice(table)
            parts = np.ones(len(tokens.numbers), bool) if shared is None else tokens.frequent(part, shared.value)
            for size in sizes:
                wanted = parts.copy()
                for i in range(1, size - part + 1 if part else 1):
                    wanted[:-i] &= parts[i:]
                    wanted[len(wanted) - i:] = False
                found = tokens.counts(size, wanted)
                for at in range(0, found.num_rows, 50_000):
                    yield found.slice(at, 50_000)

    partial = map_arrow(chunks, tally, _PHRASES)
    return partial.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of some phrases, of `BITS_A_PHRASE` bits for each up to 128 MB in all."""
    bits = min(MOST_BITS, max(LEAST_BITS, (phrases.count() * BITS_A_PHRASE).bit_length()))
    empty = np.zeros((1 << bits) // 8, np.uint8)

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.array([
                int(_mix(*(np.array([zlib.crc32(p)], np.uint32) for p in (lang, *phrase.split(b" "))))[0])
                for lang, phrase in zip(batch.column("lang").cast(pa.binary()).to_pylist(),
                                        batch.column("phrase").cast(pa.binary()).to_pylist())], np.uint32)
            at = _place(hashes, empty)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], names=["page", "bit"])

    pages = map_arrow(phrases.select("lang", "phrase"), places, "page long, bit long").groupBy("page").agg(
        F.bitmap_construct_agg("bit").alias("bits"))
    bitmap = empty
    for page in pages.toLocalIterator():  # at most 32,768 pages of 4 KB
        bitmap[page.page * 4096:(page.page + 1) * 4096] = np.frombuffer(page.bits, np.uint8)
    return bitmap


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of one to four words with at least `least` occurrences, and
    (lang, n), the number of words of each language."""
    chunks = materialize(parse_chunks(docs), "phrase-chunks")
    words = materialize(_phrases(chunks, (1,), None), "words")
    enough = F.col("f") >= least
    totals = materialize(words.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    pairs = materialize(_phrases(chunks, (2,), (1, _bitmap(words.where(enough)))).where(enough), "pairs")
    longer = materialize(_phrases(chunks, (3, 4), (2, _bitmap(pairs))).where(enough), "longer-phrases")
    return words.where(enough).unionByName(pairs).unionByName(longer), totals


def collocations(docs: DataFrame, least: int = LEAST_COUNT, inside_percent: int = INSIDE_PERCENT,
                 first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the strongest phrases of two to four words of each language.

    `a` counts a phrase, `l` and `r` its two sides at the cut that binds it least, and the score is
    2,000,000 a / (l + r) rounded down. A phrase is left out if a longer one of at least `least` occurrences
    holds it and has `inside_percent` of its occurrences. An empty table gives no rows.
    """
    phrases, totals = frequent_phrases(docs, least)
    frequent = materialize(phrases, "frequent")
    candidates = frequent.where("size >= 2")
    sides = candidates.select("lang", "phrase", "size", F.col("f").alias("a"),
                              F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = sides.select("*", F.expr("substring_index(phrase, ' ', k)").alias("left"),
                         F.expr("substring_index(phrase, ' ', k - size)").alias("right"))
    known = frequent.select("lang", "phrase", "f")
    sides = materialize(sides, "sides")
    for side, name in (("left", "l"), ("right", "r")):
        sides = materialize(look_up(sides, known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)),
                                    ["lang", side]), "sides")
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div cast(l + r as decimal(20,0))")
    weakest = sides.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    parts = candidates.where("size > 2").select(
        "lang", "size", "phrase", "f", F.explode(F.expr("sequence(2, size - 1)")).alias("k"))
    parts = parts.select("lang", "f", F.explode(F.expr("""
        transform(sequence(0, size - k), i -> array_join(slice(split(phrase, ' ', -1), i + 1, k), ' '))""")).alias("phrase"))
    held = parts.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    inside = F.col("most").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * inside_percent
    free = weakest.join(held, ["lang", "phrase"], "left").where(F.col("most").isNull() | ~inside)
    scored = free.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # two tiers, so that what one task ranks is bounded however many tasks there are before it
    falling = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    tier = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*falling))
    best = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SUMMITS))).withColumn("at", tier)
    best = best.where(F.col("at") <= first).drop("part", "at")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*falling)).cast("long")
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language over all whole texts of `documents`."""
    return collocations(read_table(spark, sf_dir, "documents"))


# The definition on all phrases of all pieces, without chunks or a filter.
_ORACLE = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) as piece
    from documents),
lists as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
spans as (
    select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i
          from lists, (select unnest(range(1, 5)) as k) where len(w) >= k)),
freq as (select lang, phrase, k as size, count(*) as f from spans group by all having count(*) >= 30),
totals as (select lang, sum(len(w)) as n from lists group by lang having sum(len(w)) > 0),
halves as (
    select lang, phrase, size, f as a, k, string_split(phrase, ' ') as w
    from freq, (select unnest(range(1, 4)) as k) where size >= 2 and k < size),
cuts as (
    select h.lang, h.phrase, h.size, h.a, h.k, x.f as l, y.f as r,
           cast((2000000::hugeint * h.a) // (x.f + y.f) as bigint) as score
    from halves h
    join freq x on x.lang = h.lang and x.phrase = array_to_string(h.w[1:h.k], ' ')
    join freq y on y.lang = h.lang and y.phrase = array_to_string(h.w[h.k + 1:h.size], ' ')),
weakest as (
    select * from (select *, row_number() over (partition by lang, phrase order by score, k) as nth from cuts) where nth = 1),
dropped as (
    select distinct p.lang, p.phrase from freq p join freq q
    on p.lang = q.lang and p.size >= 2 and q.size > p.size
       and contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ') and 100 * q.f >= 80 * p.f),
ranked as (
    select w.lang, row_number() over (partition by w.lang order by score desc, a desc, w.phrase) as rank,
           w.phrase, a, l, r, score
    from weakest w left join dropped d on d.lang = w.lang and d.phrase = w.phrase where d.phrase is null)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from ranked join totals using (lang) where rank <= 2000
"""

QUERIES = {"op13_collocations": op13_collocations}
ORACLES = {"op13_collocations": _ORACLE}
