"""Source divergence audit: how far the word use of each source is from the others of its language.

Word statistics come from a token-start pointer sort. A task works on slices of the Arrow text
column: a pointer to the start of every word of the slice's byte buffer, sorted by multikey
quicksort with eight bytes as one character. Equal words are then one run of pointers; as the
documents of a slice are put in order of their group before, the run falls into stretches of one
(language, source) each, whose lengths are occurrences and whose changes of document are the
document frequency. Spark sums these partial counts.

The distance of two sources is summed over blocks of words and of sources, so that no task holds
the words of a language or all of its sources, and no row is made for a word and a pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import map_arrow, ship_package
from .chunks import spans, take_runs
from .tables import arrow_slices, look_up, materialize, read_table

LEAST_DOCUMENTS = 30
TOP_TERMS = 50
SLICE_BYTES = 8 << 20
TERMS_A_BLOCK = 4096
SOURCES_A_BLOCK = 256

BASE_POINTERS = 1 << 16  # a slice of so many pointers is sorted at once
DEEP = 64  # words that agree in so many bytes are compared whole

_COUNTS = "lang string, source string, term string, n long, docs long"
_DISTANCES = "lang string, source string, item string, value long"

# ASCII letters in lower case and all bytes of other characters; 0 stands between words.
_LETTER = np.zeros(256, np.uint8)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER[ord("a"):ord("z") + 1] = _LETTER[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_HEAD = np.array([(1 << 64) - (1 << 8 * (8 - n)) for n in range(9)], np.uint64)  # the first n of eight bytes


def _characters(text: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number, 0 beyond the `left` bytes of the word. `text` ends in eight zeros."""
    window = np.lib.stride_tricks.sliding_window_view(text, 8)[np.minimum(at, len(text) - 8)]
    return window.view(">u8").ravel().astype(np.uint64) & _HEAD[np.clip(left, 0, 8)]


def sort_pointers(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by their bytes, and for each place in it whether a word differs from the one before.

    Equal words stay in the order given. No byte of a word is 0.
    """
    order, fresh = np.arange(len(starts)), np.zeros(len(starts), bool)
    stack = [(0, len(starts), 0, None)] if len(starts) else []
    while stack:
        low, high, depth, keys = stack.pop()
        fresh[low] = True
        if high - low <= BASE_POINTERS or depth >= DEEP:
            _sort_base(text, starts, lengths, order[low:high], fresh[low:high], depth)
            continue
        mine = order[low:high]
        if keys is None:
            keys = _characters(text, starts[mine] + depth, lengths[mine] - depth)
        pivot = _middle(keys)
        less, more = keys < pivot, keys > pivot
        same = ~(less | more)
        order[low:high] = np.concatenate([mine[less], mine[same], mine[more]])
        first, last = low + int(less.sum()), high - int(more.sum())
        if first > low:
            stack.append((low, first, depth, keys[less]))
        if last < high:
            stack.append((last, high, depth, keys[more]))
        fresh[first] = True
        if int(pivot) & 0xFF:  # the word goes on
            stack.append((first, last, depth + 8, None))
    return order, fresh


def _middle(keys: np.ndarray) -> np.uint64:
    sample = np.sort(keys[:: max(1, len(keys) // 255)])
    return sample[len(sample) // 2]


def _sort_base(text, starts, lengths, order: np.ndarray, fresh: np.ndarray, depth: int) -> None:
    """Sort a slice in place character by character; only runs that are still equal go on."""
    run, active = np.zeros(len(order), np.int64), np.arange(len(order))
    while len(active) and depth < DEEP:
        mine = order[active]
        keys = _characters(text, starts[mine] + depth, lengths[mine] - depth)
        ranked = np.lexsort((keys, run[active]))
        order[active], keys = mine[ranked], keys[ranked]
        runs = run[active]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (runs[1:] != runs[:-1])])
        fresh[active[new]] = True
        number = np.cumsum(new) - 1
        run[active] = number
        active = active[((keys & np.uint64(0xFF)) != 0) & (np.bincount(number)[number] > 1)]
        depth += 8
    if len(active):
        mine, runs = order[active], run[active].tolist()
        words = [text[a:a + n].tobytes() for a, n in zip(starts[mine].tolist(), lengths[mine].tolist())]
        ranked = sorted(range(len(words)), key=lambda i: (runs[i], words[i]))
        order[active] = mine[ranked]
        new = [i == 0 or runs[a] != runs[b] or words[a] != words[b] for i, (a, b) in enumerate(zip(ranked, [0, *ranked]))]
        fresh[active[np.array(new)]] = True


def _word_pointers(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case with zeros between words, and where words start and how long they are.

    No word goes beyond a text; texts lie between consecutive `edges`.
    """
    text = np.concatenate([_LETTER[data], np.zeros(8, np.uint8)])
    inside = text[:len(data)] != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[edges] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return text, starts, ends - starts


def _count_slice(table: pa.Table) -> pa.Table:
    """Occurrences and documents of each word of each group in some rows of (lang, source, text)."""
    names = [table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source")]
    names = [n.combine_chunks() if isinstance(n, pa.ChunkedArray) else n for n in names]
    codes = [n.indices.to_numpy().astype(np.int64) for n in names]
    group = codes[0] * max(1, len(names[1].dictionary)) + codes[1]
    by_group = np.argsort(group, kind="stable")
    texts = table.column("text").cast(pa.large_binary()).take(pa.array(by_group)).combine_chunks()
    texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    content = texts.buffers()[2]
    data = np.frombuffer(content, np.uint8)[edges[0]:edges[-1]] if content is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]

    text, starts, lengths = _word_pointers(data, edges)
    doc = np.searchsorted(edges, starts, "right") - 1
    order, new_word = sort_pointers(text, starts, lengths)
    doc = doc[order]
    of_group = group[by_group][doc]
    new_row = new_word.copy()
    new_row[1:] |= of_group[1:] != of_group[:-1]
    new_doc = new_row.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    rows = np.flatnonzero(new_row)
    at = order[rows]
    terms = pa.Array.from_buffers(
        pa.large_utf8(), len(rows),
        [None, pa.py_buffer(spans(lengths[at])), pa.py_buffer(take_runs(text, starts[at], lengths[at]))])
    docs = np.add.reduceat(new_doc.astype(np.int64), rows) if len(rows) else np.zeros(0, np.int64)
    here = by_group[doc[rows]]
    return pa.Table.from_arrays(
        [names[0].dictionary.take(pa.array(codes[0][here])), names[1].dictionary.take(pa.array(codes[1][here])),
         terms.cast(pa.string()), pa.array(np.diff(np.append(rows, len(order)))), pa.array(docs)],
        names=["lang", "source", "term", "n", "docs"])


def _count_long(row: pa.Table) -> Iterator[pa.Table]:
    """The same of one long document, piece by piece; a piece ends between words, and a word counts the document once."""
    text, group = row.column("text")[0].as_py().encode(), row.select(["lang", "source"])
    seen: set[str] = set()
    first = 0
    while first < len(text):
        last = min(len(text), first + SLICE_BYTES)
        while last < len(text) and _LETTER[text[last]]:
            last += 1
        counts = _count_slice(group.append_column("text", pa.array([text[first:last]], pa.large_binary())))
        terms = counts.column("term").to_pylist()
        docs = np.array([term not in seen for term in terms], np.int64)
        seen.update(terms)
        yield counts.set_column(4, "docs", pa.array(docs, pa.int64()))
        first = last


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) for each group and word: its occurrences and the documents that hold it.

    Null text, language and source count as empty; a repeated row is a document of its own.
    Other columns are ignored.
    """
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrow_slices(batches, "text", SLICE_BYTES):
            long = table.num_rows == 1 and len(table.column("text")[0].as_py()) > SLICE_BYTES
            for counts in _count_long(table) if long else [_count_slice(table)]:
                yield from counts.combine_chunks().to_batches(max_chunksize=65_536)

    columns = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    partial = map_arrow(docs.select(*columns), count, _COUNTS)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, words: str):
    """One more than the smoothed share of a word in a thousand millionths, in exact arithmetic."""
    return F.expr(f"1 + cast({count} + 5 as decimal(20,0)) * 1000000000 div cast(nullif({total} + 5 * {words}, 0) as decimal(20,0))")


def audit_sources(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between the sources of a language, and their own words.

    A language keeps the words that occur in at least `least_documents` of its documents. Part `pair` has a
    row for each other source of the language with the distance of their word shares, summed over all kept
    words (0 if none is kept); part `term` the `top_terms` words whose share in the source is most above that
    in the language. Ranks go by falling value, then by item. An empty table gives no rows.
    """
    counts = materialize(word_counts(docs), "word-counts")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = materialize(of_lang.where(F.col("docs") >= least_documents).drop("docs"), "kept-terms")
    present = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "present")

    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    named = materialize(named, "groups")
    of_langs = named.groupBy("lang").agg(F.count("*").alias("sources")).join(
        kept.groupBy("lang").agg(F.count("*").alias("words"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    totals = present.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = look_up(named, of_langs, ["lang"]).join(totals, ["lang", "source"], "left").na.fill(0)
    groups = materialize(
        groups.withColumn("absent", F.coalesce(_share("0", "total", "words"), F.lit(0)))
        .withColumn("source_blocks", F.ceil(F.col("sources") / SOURCES_A_BLOCK).cast("int"))
        .withColumn("term_blocks", F.greatest(F.lit(1), F.ceil(F.col("words") / TERMS_A_BLOCK)).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("source"), F.col("source_blocks")).cast("int")), "groups")
    shares = materialize(
        look_up(present, groups, ["lang", "source"]).withColumn("share", _share("n", "total", "words"))
        .withColumn("lang_share", _share("lang_n", "lang_total", "words"))
        .withColumn("term_block", F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int")), "shares")

    pairs = _distances(groups, shares).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    above = shares.where("share > lang_share").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (F.col("share") - F.col("lang_share")).alias("value"))
    by_value = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(by_value).alias("rank")
    return pairs.select("*", ranked).unionByName(above.select("*", ranked).where(F.col("rank") <= top_terms))


def _distances(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language."""
    key = ["lang", "term_block", "low", "high"]

    def to_block_pairs(rows: DataFrame) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.col("source_blocks") - 1)).alias("other")
        return rows.select("*", other).withColumns(
            {"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    sources = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("term_block"))
    sources = to_block_pairs(sources).select(*key, "source", "block", "absent")
    there = to_block_pairs(shares).select(*key, "source", "term", "share")
    ship_package(groups.sparkSession)
    partial = sources.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(_block_distances, _DISTANCES)
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _block_distances(sources: pa.Table, there: pa.Table) -> pa.Table:
    """Distances over the words of one block between the sources of two blocks, or of one."""
    lang, low, high = (sources.column(c)[0].as_py() for c in ("lang", "low", "high"))
    names, blocks = sources.column("source").to_pylist(), sources.column("block").to_numpy()
    number = {name: i for i, name in enumerate(names)}
    terms = there.column("term").combine_chunks().dictionary_encode()
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    matrix = np.repeat(sources.column("absent").to_numpy()[:, None], max(0, len(terms.dictionary)), axis=1)
    rows = np.array([number[name] for name in there.column("source").to_pylist()], np.int64)
    matrix[rows, terms.indices.to_numpy()] = there.column("share").to_numpy()
    left, right = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    out = []
    others = matrix[right]
    for i in left.tolist():
        values = np.abs(others - matrix[i]).sum(axis=1).tolist()
        for j, value in zip(right.tolist(), values):
            if i != j:
                out.append((lang, names[i], names[j], value))
                if low != high:
                    out.append((lang, names[j], names[i], value))
    columns = list(zip(*out)) if out else [(), (), (), ()]
    return pa.Table.from_arrays(
        [*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())],
        names=["lang", "source", "item", "value"])


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between sources and their own words over all whole texts of `documents`."""
    return audit_sources(read_table(spark, sf_dir, "documents"))


# The definition over every kept word and every group, without sorting or blocks.
_ORACLE = r"""
with docs as (
    select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
    from documents),
words as (select d, lang, source, unnest(w) as term from docs),
kept as (
    select lang, term, count(*) as lang_n from words group by lang, term having count(distinct d) >= 30),
langs as (select lang, count(*) as v, sum(lang_n) as n from kept group by lang),
groups as (select distinct lang, source from docs),
used as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
totals as (select lang, source, sum(n) as total from used group by all),
dense as (
    select g.lang, g.source, k.term, coalesce(u.n, 0) as n,
           1 + (1000000000::hugeint * (coalesce(u.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) as p,
           1 + (1000000000::hugeint * (k.lang_n + 5)) // (l.n + 5 * l.v) as q
    from groups g join kept k using (lang) join langs l using (lang)
    left join used u on u.lang = g.lang and u.source = g.source and u.term = k.term
    left join totals t on t.lang = g.lang and t.source = g.source),
distances as (
    select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value
    from dense x join dense y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
pairs as (
    select g.lang, g.source, 'pair' as part, h.source as item, cast(coalesce(s.value, 0) as bigint) as value
    from groups g join groups h on g.lang = h.lang and g.source <> h.source
    left join distances s on s.lang = g.lang and s.source = g.source and s.item = h.source),
terms as (
    select lang, source, 'term' as part, term as item, cast(p - q as bigint) as value from dense where n > 0 and p > q)
select lang, source, part, item, value,
       cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from pairs
union all
select lang, source, part, item, value, rank from (
    select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from terms)
where rank <= 50
"""

QUERIES = {"op12_divergence": op12_divergence}
ORACLES = {"op12_divergence": _ORACLE}
