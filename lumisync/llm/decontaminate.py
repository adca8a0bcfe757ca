"""Benchmark decontamination by winnowing, in DataFrame operations only.

A benchmark item is the set of its windows: every run of 10 words, or all its words if it has
fewer. Of each window of a text, the smallest hash of its 5-word grams is the fingerprint, kept
once for every run of windows that have it; a span of 10 shared words therefore always shares
one. Fingerprints of documents are looked up among those of the benchmark, which reach every
executor in blocks of bounded size; the few that match are extended to the left and right over
their run, whose windows are compared word by word. Items of fewer words get windows and grams
of their own length in the same way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import lower_ascii, materialize, read_table

WINDOW = 10
GRAM = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_FINGERPRINTS = 2_000_000  # of 8 bytes each, sent to every executor at a time


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; none of null."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _sliding(values: Column, size: int, combine) -> Column:
    """`combine` of each run of `size` values; `values` is a plain column, for it is read at every place."""
    starts = F.sequence(F.lit(0), F.size(values) - size)
    made = F.transform(starts, lambda i: combine(*[F.get(values, i + j) for j in range(size)]))
    return F.when(F.size(values) >= size, made).otherwise(F.array().cast("array<bigint>"))


def _smallest(values: Column, size: int) -> Column:
    return values if size == 1 else _sliding(values, size, F.least)


def _phrase(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def _with_fingerprints(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Add `runs`, an array of (length, first, last, fingerprint), for windows of the given lengths.

    `rows` has `words`, an array. All windows from `first` to `last` have the same fingerprint, the
    ones next to them have another. Each step is a projection of its own, so that no array is made
    twice. Explode `runs` with `explode_outer`: for the inner form Spark infers a filter on the
    array's size and pushes it below these projections, where it makes every array anew for
    every element.
    """
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    for length in lengths:
        gram = min(GRAM, length)
        rows = rows.withColumn("grams", _sliding(F.col("hashes"), gram, F.xxhash64))
        rows = rows.withColumn("minima", _smallest(F.col("grams"), length - gram + 1))
        rows = rows.withColumn("firsts", _changes(F.col("minima")))
        rows = rows.withColumn(f"r{length}", _runs(F.col("minima"), F.col("firsts"), length))
    packed = [F.col(f"r{length}") for length in lengths]
    return rows.withColumn("runs", F.concat(*packed)).drop(
        "hashes", "grams", "minima", "firsts", *[f"r{n}" for n in lengths])


def _changes(minima: Column) -> Column:
    """The places whose value differs from the one before."""
    places = F.transform(minima, lambda v, at: F.when((at == 0) | (v != F.get(minima, at - 1)), at))
    return F.filter(places, lambda at: at.isNotNull())


def _runs(minima: Column, firsts: Column, length: int) -> Column:
    return F.transform(firsts, lambda first, n: F.struct(
        F.lit(length).alias("length"), first.alias("first"),
        (F.coalesce(F.get(firsts, n + 1), F.size(minima)) - 1).alias("last"), F.get(minima, first).alias("fingerprint")))


def _windows_of(run: str = "run") -> Column:
    """(start, phrase) of every window of a run; null if its length is 0."""
    length = F.col(f"{run}.length")
    places = F.sequence(F.col(f"{run}.first"), F.col(f"{run}.last"))
    return F.when(length > 0, F.transform(places, lambda at: F.struct(
        at.alias("start"), _phrase(F.col("words"), at, length).alias("phrase"))))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(phrase, length, fingerprint, item_ids) of the distinct windows of all items."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    lengths = [r.n for r in items.select(F.least(F.size("words"), F.lit(WINDOW)).alias("n")).distinct().collect()]
    if not lengths:  # at most ten lengths
        return benchmark.sparkSession.createDataFrame(
            [], "phrase string, length int, fingerprint long, item_group long, item_ids array<string>")
    whole = F.least(F.size("words"), F.lit(WINDOW))
    rows = (_with_fingerprints(items, sorted(lengths))
            .select("item_id", "words", whole.alias("n"), F.explode_outer("runs").alias("run")).where("run.length = n"))
    phrases = rows.select("item_id", "run.length", "run.fingerprint", F.explode(_windows_of()).alias("w")).select(
        "item_id", "w.phrase", "length", "fingerprint")
    return phrases.groupBy("phrase", "length", "fingerprint").agg(
        F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("item_ids")
    ).withColumn("item_group", F.xxhash64("item_ids"))


def find_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items_sha256) of every row of `(doc_id, text)`.

    `text_hash` is xxhash64 of the text; `benchmark` is `(item_id, text)`. A word is hit if it lies in a place where a window of an
    item occurs; `items_sha256` digests the ids of the items with such windows, sorted as
    strings and joined by commas. Null texts have no words, items without words no windows; the
    id of an item without one is the empty text. Repeated rows and null ids give a row each.
    Other columns are ignored.
    """
    windows = materialize(benchmark_windows(benchmark), "windows")
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    if not lengths:
        return texts.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                            F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"))

    fingerprints = materialize(windows.select("fingerprint").distinct(), "fingerprints")
    blocks = math.ceil(fingerprints.count() / BLOCK_FINGERPRINTS)
    looked_up = _with_fingerprints(texts, lengths)
    key = ["doc_id", "text_hash"]
    marker = F.array(F.struct(F.lit(0).alias("length"), F.lit(0).alias("first"), F.lit(0).alias("last"),
                              F.lit(None).cast("long").alias("fingerprint")))
    found = None
    for block in range(blocks):
        here = fingerprints.where(F.pmod(F.xxhash64("fingerprint"), F.lit(blocks)) == block)
        # one extra run of windows of length 0 stands for the document itself, so that one pass gives both
        rows = looked_up.withColumn("runs", F.concat(marker, "runs") if block == 0 else F.col("runs"))
        rows = rows.select(*key, "words", F.explode_outer("runs").alias("run")).withColumn("fingerprint", F.col("run.fingerprint"))
        matched = rows.join(F.broadcast(here.withColumn("known", F.lit(True))), "fingerprint", "left").where("known or run.length = 0")
        part = matched.select(*key, "run.length", F.when(F.col("run.length") == 0, F.size("words")).alias("n_words"),
                              F.explode_outer(_windows_of()).alias("w")).select(*key, "length", "n_words", "w.start", "w.phrase")
        found = part if found is None else found.union(part)
    found = materialize(found, "matches")

    documents = found.where("length = 0").groupBy(*key).agg(F.first("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"))
    hits = found.where("length > 0").join(windows.select("phrase", "length", "item_group"), ["phrase", "length"])
    places = F.array_sort(F.collect_set(F.struct("start", "length")))
    per_doc = hits.groupBy(*key).agg(places.alias("places"), F.array_sort(F.collect_set("item_group")).alias("groups"))
    per_doc = materialize(per_doc.select(*key, _covered(F.col("places")).alias("n_hit"), "groups",
                                         F.md5(F.to_json("groups")).alias("groups_key")), "hits")
    # documents without hits have no key and stay out of this join
    named = per_doc.join(_items_of(per_doc, windows), "groups_key").drop("groups", "groups_key")
    same = [documents[c].eqNullSafe(named[c]) for c in key]
    joined = documents.join(named, same, "left").select(
        documents.doc_id, documents.text_hash, "n_words", "copies", "n_hit", "n_items", "items_sha256")
    return joined.select(
        "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def _covered(places: Column) -> Column:
    """How many words some (start, length) cover, sorted by start."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(so_far: Column, place: Column) -> Column:
        end = F.greatest(so_far["end"], place["start"] + place["length"])
        return F.struct(end.alias("end"), (so_far["n"] + end - F.greatest(so_far["end"], place["start"])).alias("n"))

    return F.aggregate(places, begin, add)["n"]


def _items_of(per_doc: DataFrame, windows: DataFrame) -> DataFrame:
    """Number and digest of the items behind each distinct set of item groups."""
    sets = per_doc.groupBy("groups_key").agg(F.first("groups").alias("groups"))
    groups = windows.select("item_group", "item_ids").dropDuplicates(["item_group"])
    named = (sets.select("groups_key", F.explode("groups").alias("item_group")).join(groups, "item_group")
             .groupBy("groups_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("ids")))
    return named.select("groups_key", F.size("ids").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text of `documents` that windows of `benchmark` items hit."""
    found = find_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash").withColumn("contaminated", F.col("n_hit") > 0)


# The definition by plain equality of windows, without fingerprints.
_ORACLE = r"""
with doc_words as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents),
item_words as (
    select item_id, w, least(len(w), 10) as n from (
        select item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
        from benchmark)
    where len(w) > 0),
windows as (
    select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as phrase
    from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from item_words)),
lengths as (select distinct n from windows),
places as (
    select d.doc_id, d.i, d.n, array_to_string(d.w[d.i:d.i + d.n - 1], ' ') as phrase
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc_words, lengths where len(w) >= n) d),
hits as (select p.doc_id, p.i, p.n, x.item_id from places p join windows x on p.phrase = x.phrase and p.n = x.n),
covered as (
    select doc_id, count(*) as n_hit
    from (select distinct doc_id, unnest(range(i, i + n)) as at from (select distinct doc_id, i, n from hits)) group by doc_id),
items as (
    select doc_id, count(*) as n_items, sha256(string_agg(id, ',' order by id)) as items_sha256
    from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
       coalesce(i.items_sha256, sha256('')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from doc_words d left join covered c using (doc_id) left join items i using (doc_id)
"""

QUERIES = {"op3_decontamination": op3_decontamination}
ORACLES = {"op3_decontamination": _ORACLE}
