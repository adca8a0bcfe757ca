"""Registered tokenisation and text-embedding queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BOS, EOS, normalize_text, pretokenize
from ..operators import bpe as B
from ..operators.embed import embed
from ..operators.encoders import HashedTextEncoder
from ..operators.joins import numbered
from ..session import fresh_dir, spread
from .fixtures import table
from .sync_queries import vector_summary_frame
from .text_sql import normalized, tokens, vector_summary

DIM = 512

# A merge table learnt from the words themselves: neighbouring characters, then pairs with
# a third and a fourth character, all of them, the most frequent first.
_PAIRS_SQL = """
select a, b, count(*) as n from (
  select c0 as a, c1 as b from grams where c1 is not null union all
  select concat(c0, c1), c2 from grams where c2 is not null union all
  select concat(c0, c1), concat(c2, c3) from grams where c3 is not null) p
group by a, b"""


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def _words(docs: DataFrame) -> DataFrame:
    """(word, chars): the distinct words as a table of their own, and the characters of each
    in order, the last one marked as the end."""
    target = fresh_dir(docs.sparkSession, "words")
    words = B.distinct_words(docs, "text")
    words.where(~F.col("word").isin(BOS, EOS)).write.parquet(target)
    words = docs.sparkSession.read.schema("word string").parquet(target)
    chars, size = F.split("word", ""), F.length("word")
    last = F.array(F.concat(F.element_at(chars, -1), F.lit(B.END_OF_WORD)))
    return words.select("word", F.concat(F.slice(chars, 1, size - 1), last).alias("chars"))


def _merges(words: DataFrame) -> DataFrame:
    size = F.size("chars")
    shifted = [F.slice("chars", i, size).alias(f"c{i - 1}") for i in range(1, 5)]
    grams = words.select(*shifted).select(F.inline(F.arrays_zip("c0", "c1", "c2", "c3")))
    pairs = words.sparkSession.sql(_PAIRS_SQL.replace("grams", "{grams}"), grams=grams)
    ranked = numbered(pairs, "rank", F.desc("n"), F.asc("a"), F.asc("b"))
    return ranked.select("rank", "a", "b")


def _vocab(words: DataFrame, merges: DataFrame) -> DataFrame:
    """Ids in token order for every character form, every merge result and both specials."""
    singles = words.select(F.explode("chars").alias("token"))
    joined = merges.select(F.concat("a", "b").alias("token"))
    special = words.sparkSession.createDataFrame([(BOS,), (EOS,)], "token string")
    return numbered(singles.union(joined).union(special).distinct(), "id", F.asc("token"))


_learnt: dict[tuple[str, str], str] = {}


def _table_files(spark: SparkSession, sf: str) -> str:
    """The folder of the merge and the vocabulary file, written once per session and table."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _learnt:
        folder = fresh_dir(spark, "bpe-tables")
        words = _words(_docs(spark, sf))
        learnt = _merges(words)
        learnt.write.parquet(f"{folder}/learnt")
        merges = spark.read.schema(learnt.schema).parquet(f"{folder}/learnt")
        header = spark.createDataFrame([(-1, "#version:", "1")], "rank int, a string, b string")
        lines = header.union(merges.select(F.col("rank").cast("int"), "a", "b")).coalesce(1).sortWithinPartitions("rank")
        lines.select(F.concat_ws(" ", "a", "b").alias("value")).write.text(f"{folder}/merges")
        entries = F.collect_list(F.struct("token", F.col("id").cast("int")))  # one JSON object, as the format asks
        vocab = _vocab(words, merges).agg(F.to_json(F.map_from_entries(entries)).alias("value"))
        vocab.coalesce(1).write.text(f"{folder}/vocab")
        _learnt[key] = folder
    return _learnt[key]


def _tables(spark: SparkSession, sf: str) -> B.BpeTables:
    folder = _table_files(spark, sf)
    return B.BpeTables(B.read_merges(spark, f"{folder}/merges", whole=True), B.read_vocab(spark, f"{folder}/vocab"))


def bpe_tables(spark, sf):
    """The merges and the vocabulary as read back from their files."""
    tables = _tables(spark, sf)
    merges, vocab = tables.merges, tables.vocab
    return merges.select(F.lit("merge").alias("kind"), F.col("rank").cast("bigint").alias("number"), "a", "b").union(
        vocab.select(F.lit("token"), F.col("id").cast("bigint"), "token", F.lit(None).cast("string")))


def text_normalize(spark, sf):
    docs = _docs(spark, sf).select("doc_id", normalize_text(F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5(F.encode("t", "utf-8")).alias("digest"))


def text_pretokenize(spark, sf):
    docs = _docs(spark, sf).select("doc_id", pretokenize(normalize_text(F.col("text"))).alias("t"))
    joined = F.concat_ws(" ", "t")
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.encode(joined, "utf-8")).alias("digest"))


def bpe_encode(spark, sf):
    docs = _docs(spark, sf)
    pieces = B.bpe_pieces(docs, "text", _tables(spark, sf))
    return pieces.select("doc_id", F.size("pieces").cast("bigint").alias("n"),
                         F.md5(F.encode(F.concat_ws(" ", "pieces"), "utf-8")).alias("digest"))


def token_ids(spark, sf):
    docs = _docs(spark, sf)
    coded = B.token_ids(docs, "text", _tables(spark, sf))
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n"),
                        F.md5(F.encode(joined, "utf-8")).alias("digest"))


def embed_text(spark, sf):
    turns = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    return vector_summary_frame(embed(turns, "text", HashedTextEncoder(DIM)), ["conv_id", "turn"])


QUERIES = {
    "text_normalize": text_normalize,
    "text_pretokenize": text_pretokenize,
    "bpe_tables": bpe_tables,
    "bpe_encode": bpe_encode,
    "token_ids": token_ids,
    "embed_text": embed_text,
}

# Symbols of a word are kept in one string, each between chr(1) and chr(2), so replacing a
# pair of neighbours is one replace() that works from the left and never overlaps.
_BPE_SQL = f"""
with recursive doc_tokens as (
  select doc_id, unnest(t) as word, unnest(range(len(t))) as pos from (
    select doc_id, {tokens('text')} as t from documents)),
words as (select distinct word from doc_tokens where word not in ('{BOS}', '{EOS}')),
chars as (select word, list_transform(range(1, length(word) + 1), lambda i:
    substr(word, i, 1) || case when i = length(word) then '{B.END_OF_WORD}' else '' end) as s from words),
spots as (select s, unnest(range(1, len(s) + 1)) as i from chars),
grams as (select s[i] as c0, s[i + 1] as c1, s[i + 2] as c2, s[i + 3] as c3 from spots),
pairs as ({_PAIRS_SQL}),
merges as (select row_number() over (order by n desc, a, b) - 1 as rank, a, b from pairs),
vocab as (select token, row_number() over (order by token) - 1 as id from (
  select unnest(s) as token from chars union select a || b from merges
  union select '{BOS}' union select '{EOS}')),
steps as (
  select word, list_aggregate(list_transform(s, lambda x: chr(1) || x || chr(2)), 'string_agg', '') as state, 0 as step
  from chars
  union all
  select word, replace(any_value(state),
      chr(1) || arg_min(m.a, m.rank) || chr(2) || chr(1) || arg_min(m.b, m.rank) || chr(2),
      chr(1) || arg_min(m.a, m.rank) || arg_min(m.b, m.rank) || chr(2)), any_value(step) + 1
  from (select word, state, step, p, unnest(range(1, len(p))) as i from (
      select word, state, step, string_split(substr(state, 2, length(state) - 2), chr(2) || chr(1)) as p from steps)) g
  join merges m on m.a = g.p[g.i] and m.b = g.p[g.i + 1]
  group by word),
final as (select word, string_split(substr(state, 2, length(state) - 2), chr(2) || chr(1)) as parts from (
    select word, arg_max(state, step) as state from steps group by word)
  union all select '{BOS}', ['{BOS}'] union all select '{EOS}', ['{EOS}']),
doc_pieces as (select doc_id, flatten(list(parts order by pos)) as pieces
  from doc_tokens join final using (word) group by doc_id),
doc_ids as (select doc_id, list(id order by pos, i) as ids from (
    select doc_id, pos, unnest(parts) as token, unnest(range(len(parts))) as i from doc_tokens join final using (word))
  join vocab using (token) group by doc_id)"""

ORACLES = {
    "text_normalize": f"""with d as (select doc_id, {normalized('text')} as t from documents)
select doc_id, cast(length(t) as bigint) as n, md5(t) as digest from d""",
    "text_pretokenize": f"""with d as (select doc_id, {tokens('text')} as t from documents)
select doc_id, cast(len(t) as bigint) as n, md5(array_to_string(t, ' ')) as digest from d""",
    "bpe_tables": f"""{_BPE_SQL}
select 'merge' as kind, rank as number, a, b from merges union all select 'token', id, token, null from vocab""",
    "bpe_encode": f"""{_BPE_SQL}
select doc_id, cast(coalesce(len(pieces), 0) as bigint) as n,
  md5(coalesce(array_to_string(pieces, ' '), '')) as digest
from documents left join doc_pieces using (doc_id)""",
    "token_ids": f"""{_BPE_SQL},
ends as (select min(id) filter (token = '{BOS}') as bos, min(id) filter (token = '{EOS}') as eos from vocab),
whole as (select doc_id, list_concat([bos], coalesce(ids, []), [eos]) as ids
  from documents left join doc_ids using (doc_id), ends)
select doc_id, cast(len(ids) as bigint) as n, md5(array_to_string(ids, ',')) as digest from whole""",
    "embed_text": vector_summary("conversations", ["conv_id", "turn"], "text", DIM),
}
