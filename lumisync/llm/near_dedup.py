"""Near-duplicate documents by MinHash: banding, verification and connected components.

1. Every text becomes its set of 5-word shingles (64-bit hashes) and 128 universal hash minima,
   dealt into 32 bands of 4. Two sets of similarity 0.85 share a band but for 1 pair in 10^10,
   of 0.80 but for 1 in 2 * 10^7.
   Equal sets become one class at once, so a group of copies is one node from here on.
2. The classes of a band bucket are linked to the smallest of them, its representative, not to
   each other. Signatures discard pairs that agree in too few of the 128 minima, for 85 % fewer
   than 79 (a pair of the asked similarity does so once in 10^10); the rest is confirmed on full sets.
3. Buckets whose classes are then in one component are done, for all other pairs in them would
   link nothing new. The classes of the other buckets are joined by an exact prefix filter: two
   sets of the asked similarity share one of the rarest shingles of each, early enough to leave
   room for the overlap. What passes is confirmed as before. No bucket is capped.
4. The components of all links are the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_arrow
from .components import connected_components
from .tables import materialize, read_table

WORDS = 5
PERCENT = 85
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
MISSED = 1e-10  # the share of pairs of the asked similarity that signatures may discard
BROADCAST_IDS = 1_000_000  # up to so many ids (16 MB) go to every executor instead of a shuffle of all texts
CACHED_WORDS = 60_000
BLOCK = 2_048
ROWS_PER_STEP = 512  # signed rows that a task holds as Python values

_MIX = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(20_240_607)
_FACTORS = _RANDOM.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**63, MINIMA, dtype=np.uint64)

_SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>"
_ARROW_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
                           ("bands", pa.list_(pa.int64()))])
_SETS = "doc_id long, set_key binary, minima binary, shingles array<long>"
_ARROW_SETS = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("minima", pa.binary()),
                         ("shingles", pa.list_(pa.int64()))])


class Shingler:
    """Sets of shingles; remembers the hashes of words."""

    def __init__(self):
        self._hashes: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes of the 5-word shingles; of fewer words, one of them all."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self._hashes) > CACHED_WORDS:
            self._hashes.clear()
        known = self._hashes
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(WORDS, len(words))
        n = len(words) - size + 1
        mixed = np.full(n, size, np.uint64)
        for at in range(size):
            mixed = (mixed ^ hashes[at:at + n]) * _MIX
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def _minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of many universal hash functions over a set."""
    smallest = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        values = _FACTORS[:, None] * shingles[None, at:at + BLOCK] + _SHIFTS[:, None]
        np.minimum(smallest, values.min(axis=1), out=smallest)
    return (smallest >> np.uint64(32)).astype(np.uint32)


def _band_keys(minima: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for column in minima.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in (whole.slice(at, ROWS_PER_STEP) for whole in batches for at in range(0, whole.num_rows, ROWS_PER_STEP)):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            found = shingler.shingles(text.as_py())
            bands = _band_keys(_minima(found)).tolist() if len(found) else []
            rows.append({"doc_id": doc_id, "n_shingles": len(found), "set_key": _set_key(found), "bands": bands})
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_SIGNED)


def _expand_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            found = shingler.shingles(text.as_py())
            yield pa.RecordBatch.from_arrays([
                pa.array([doc_id], pa.int64()), pa.array([_set_key(found)], pa.binary()),
                pa.array([_minima(found).tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found.view(np.int64)))],
                schema=_ARROW_SETS)


def least_agreeing(percent: int) -> int:
    """Minima in which a pair of that similarity agrees but for `MISSED` of the pairs."""
    p, below = percent / 100, 0.0
    for k in range(MINIMA + 1):
        below += comb(MINIMA, k) * p**k * (1 - p) ** (MINIMA - k)
        if below > MISSED:
            return k
    return MINIMA


def _agreeing(least: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose signatures agree in `least` minima or more."""
    def agreeing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, MINIMA)
                               for c in ("minima_a", "minima_b"))
                kept = pa.array((left == right).sum(axis=1) >= least)
                yield batch.select(["a", "b"]).filter(kept)

    return agreeing


def similar_size(n: Column, m: Column, percent: int) -> Column:
    """Sets of such sizes can have the asked similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `(doc_id, text)`.

    Words stand between ASCII white space, A-Z in lower case. Sets whose intersection has at
    least `percent` % of the size of their union are linked; `component_id` is the smallest doc_id
    reachable over links. Null and empty texts have no shingles and link with nothing. Rows of
    one doc_id count as one document: each keeps its row, and their groups are joined. Rows
    without doc_id have a null component and are linked with nothing. Other columns are ignored.
    """
    texts = docs.select("doc_id", "text")
    signed = materialize(map_arrow(texts, _sign, _SIGNED), "signed")
    classes = materialize(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("first"))
        .select("set_key", F.col("first.doc_id").alias("node"), F.col("first.n_shingles").alias("n"),
                F.col("first.bands").alias("bands")), "classes")
    members = _bucket_members(classes)
    sets = _sets_of(texts, classes, members)

    pairs = members.where("node <> rep").where(similar_size(F.col("n"), F.col("rep_n"), percent))
    found = _confirmed(pairs.select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct(), sets, percent, signatures=True)
    links = materialize(found, "star-links")
    rest = _unresolved(members, connected_components(links), sets)
    more = materialize(_confirmed(_prefix_pairs(rest, percent), sets, percent), "rest-links")

    # rows of one id in several classes join these
    same_id = (signed.where("n_shingles > 0").join(classes.select("set_key", "node"), "set_key")
               .where("doc_id <> node").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
               .where("a <> b").select("a", "b"))
    components = connected_components(links.union(more).union(same_id))

    of_class = classes.select("set_key", "node")
    joined = signed.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left").join(components, "node", "left")
    own = F.coalesce("component", "node", "doc_id")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), own).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))


def _bucket_members(classes: DataFrame) -> DataFrame:
    """(band, node, n, rep, rep_n) of the buckets of two or more classes."""
    dealt = classes.select(F.explode("bands").alias("band"), "node", "n")
    buckets = dealt.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n")).alias("rep"))
    shared = buckets.where("size > 1").select("band", F.col("rep.node").alias("rep"), F.col("rep.n").alias("rep_n"))
    return materialize(dealt.join(shared, "band"), "buckets")


def _sets_of(texts: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(node, set_key, n, minima, shingles) of the classes that share a bucket, made anew from their texts."""
    wanted = materialize(members.select("node").distinct().join(classes.select("node", "set_key", "n"), "node"), "members")
    ids = wanted.select(F.col("node").alias("doc_id")).distinct()
    few = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    made = map_arrow(texts.join(few, "doc_id", "left_semi"), _expand_sets, _SETS).withColumnRenamed("doc_id", "node")
    rows = made.join(wanted, ["node", "set_key"]).groupBy("node", "set_key").agg(
        F.first("n").alias("n"), F.first("minima").alias("minima"), F.first("shingles").alias("shingles"))
    return materialize(rows, "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, signatures: bool = False) -> DataFrame:
    """The pairs `(a, b)` whose full sets have the asked similarity."""
    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    if signatures:
        known = pairs.join(side("a", "minima"), "a").join(side("b", "minima"), "b")
        pairs = map_arrow(known.select("a", "b", "minima_a", "minima_b"), _agreeing(least_agreeing(percent)), "a long, b long")
    both = pairs.join(side("a", "n", "shingles"), "a").join(side("b", "n", "shingles"), "b")
    shared = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long")
    counted = both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), shared.alias("shared"))
    return counted.where(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent).select("a", "b")


def _unresolved(members: DataFrame, components: DataFrame, sets: DataFrame) -> DataFrame:
    """(row, node, n, shingles, component) of the classes in a bucket of two or more components."""
    labelled = members.join(components, "node", "left").select(
        "band", "node", F.coalesce("component", "node").alias("component"))
    open_bands = (labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                  .where("low < high").select("band"))
    nodes = labelled.join(open_bands, "band", "left_semi").select("node", "component").distinct()
    rows = sets.select(F.xxhash64("node", "set_key").alias("row"), "node", "n", "shingles")
    return materialize(nodes.join(rows, "node"), "unresolved")


def _prefix_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that an exact prefix filter lets through.

    Shingles are put in one order for all sets, the rarest first. If x and y, not larger, have
    similarity t, they share a shingle among the first `n_x - ceil(t n_x) + 1` of x and the
    first `n_y - ceil(2 t / (1 + t) n_y) + 1` of y; taking the first that they share, what
    follows it in either set must suffice for the overlap.
    """
    tokens = rest.select("row", F.explode("shingles").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ordered = (tokens.join(counts, "token").groupBy("row")
               .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens")))
    n = F.col("n")
    probe = (n - F.ceil(n * percent / 100) + 1).cast("int")
    prefixed = (ordered.join(rest.select("row", "node", "n", "component"), "row")
                .select("node", "n", "component", F.posexplode(F.slice("tokens", 1, probe)).alias("at", "item"))
                .where("item.df > 1").select("node", "n", "component", "at", F.col("item.token").alias("token")))
    prefixed = materialize(prefixed, "prefixes")
    index = F.col("n_y") - F.ceil(F.col("n_y") * (2 * percent) / (100 + percent)) + 1
    x = prefixed.select("token", *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "component", "at")])
    y = prefixed.select("token", *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "component", "at")])
    smaller = (F.col("n_y") < F.col("n_x")) | ((F.col("n_y") == F.col("n_x")) & (F.col("node_y") < F.col("node_x")))
    room = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    enough = room * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent
    matched = (x.token == y.token) & smaller & (F.col("component_x") != F.col("component_y")) & (
        F.col("at_y") < index) & similar_size(F.col("n_x"), F.col("n_y"), percent) & enough
    pairs = x.join(y, matched).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))
    return pairs.distinct()


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all whole texts of `documents`; the smallest id of each is kept."""
    grouped = near_duplicates(read_table(spark, sf_dir, "documents"))
    return grouped.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


# The definition on sets of strings, without hashes, bands or a filter.
_ORACLE = r"""
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents),
shingles as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
classes as (
    select key, min(doc_id) as node from (
        select doc_id, md5(string_agg(s, chr(10) order by s)) as key from shingles group by doc_id)
    group by key),
of_class as (
    select k.doc_id, c.node from (
        select doc_id, md5(string_agg(s, chr(10) order by s)) as key from shingles group by doc_id) k
    join classes c using (key)),
of_nodes as (select s.doc_id, s.s from shingles s join classes c on s.doc_id = c.node),
shared as (
    select x.doc_id as a, y.doc_id as b, count(*) as k from of_nodes x join of_nodes y on x.s = y.s and x.doc_id < y.doc_id
    group by 1, 2),
links as (
    select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b
    where 100 * k >= 85 * (p.n + q.n - k)),
both_ways as (select a, b from links union select b, a from links),
reach(node, other) as (
    select node, node from classes
    union select r.node, e.b from reach r join both_ways e on r.other = e.a),
lowest as (select node, min(other) as component from reach group by node)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(l.component, d.doc_id) as component_id,
       d.doc_id = coalesce(l.component, d.doc_id) as kept
from documents d left join sizes s using (doc_id) left join of_class o using (doc_id) left join lowest l on l.node = o.node
"""

QUERIES = {"op6_near_dedup": op6_near_dedup}
ORACLES = {"op6_near_dedup": _ORACLE}
