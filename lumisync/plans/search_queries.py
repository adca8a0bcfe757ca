"""Registered vector and search queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import search as S
from ..operators.encoders import HashedTextEncoder
from ..operators.embed import embed
from ..operators.similarity import contrastive_loss, similarity_summary
from ..session import spread
from .fixtures import FILES_CTE, files, table
from .text_sql import hashed_vectors

LOGIT_SCALE = 2.0
TEXT_DIM = 64
BATCH = 128  # vectors that are contrasted with each other


def _emb() -> Column:
    return F.col("embedding")


def _rev() -> Column:
    """A second vector per row: the entries in reverse."""
    return F.reverse(F.col("embedding"))


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


def _store(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector, and a failed (zero) row for each."""
    rows = _embeddings(spark, sf)
    failed = rows.select((-1 - F.col("vec_id")).alias("vec_id"),
                         F.transform("embedding", lambda x: F.lit(0.0).cast("float")).alias("embedding"))
    return rows.unionByName(failed)


def _query(spark: SparkSession, sf: str) -> list[float]:
    return _embeddings(spark, sf).where("vec_id = 0").first()["embedding"]


def _r6(name: str):
    return F.round(name, 6).alias(name)


def vector_topk(spark, sf):
    best = S.search(_store(spark, sf), _query(spark, sf), 10, "vec_id", "embedding")
    return best.select("vec_id", _r6("score"), "total_images")


def vector_topk_native(spark, sf):
    best = S.search(_store(spark, sf), _query(spark, sf), 10, "vec_id", "embedding", use_arrow=False)
    return best.select("vec_id", _r6("score"), "total_images")


def _tiny(spark, sf):
    """A query whose entries would pass the test for failed rows, which is not made on queries."""
    return [x * 1e-9 for x in _query(spark, sf)]


def vector_topk_tiny_query(spark, sf):
    """One rule for both ways of scoring."""
    both = [S.search(_store(spark, sf), _tiny(spark, sf), 10, "vec_id", "embedding", use_arrow=how)
            .select(F.lit(how).alias("in_arrow"), "vec_id", _r6("score"), "total_images") for how in (True, False)]
    return both[0].union(both[1])


def vector_topk_rounded(spark, sf):
    return S.search_rounded(_store(spark, sf), _query(spark, sf), 5, "vec_id", "embedding")


def ranked_results(spark, sf):
    best = S.search(_store(spark, sf), _query(spark, sf), 10, "vec_id", "embedding")
    return S.numbered(best, "vec_id").select("rank", "label", "vec_id")


def full_ranking(spark, sf):
    ranked = S.full_ranking(_store(spark, sf), _query(spark, sf), "vec_id", "embedding")
    return ranked.select("vec_id", _r6("score"))


def _asked(spark, sf):
    return _embeddings(spark, sf).select(F.col("vec_id").alias("query_id"), _emb().alias("query_vec"))


def batch_topk(spark, sf):
    best = S.batch_search(_store(spark, sf), _asked(spark, sf), 5, "vec_id", "embedding")
    return best.select("query_id", "rank", "vec_id", _r6("score"))


def batch_topk_blocks(spark, sf):
    best = S.batch_search(_store(spark, sf), _asked(spark, sf), 5, "vec_id", "embedding", block_bytes=64 << 10)
    return best.select("query_id", "rank", "vec_id", _r6("score"))


def text_search(spark, sf):
    encoder = HashedTextEncoder(TEXT_DIM)
    docs = embed(spread(table(spark, sf, "documents").select("doc_id", "text")), "text", encoder)
    asked = embed(table(spark, sf, "benchmark"), "text", encoder)
    best = S.batch_search(
        docs, asked.select(F.col("item_id").alias("query_id"), F.col("vector").alias("query_vec")),
        3, "doc_id", "vector")
    return best.select("query_id", "rank", "doc_id", _r6("score"))


def vec_dot(spark, sf):
    return _embeddings(spark, sf).select("vec_id", F.round(V.dot(_emb(), _rev()), 6).alias("dot"))


def vec_norm(spark, sf):
    return _embeddings(spark, sf).select("vec_id", F.round(V.norm(_emb()), 6).alias("norm"))


def vec_cosine(spark, sf):
    rows = _store(spark, sf)
    return rows.select("vec_id", F.round(V.cosine(_emb(), _rev()), 6).alias("cosine"))


def vec_normalize(spark, sf):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = _embeddings(spark, sf).select("vec_id", F.posexplode(V.normalize(tripled)))
    return unit.select("vec_id", "pos", F.round("col", 6).alias("value"))


def zero_vector_filter(spark, sf):
    rows = _embeddings(spark, sf)
    scaled = rows.select("vec_id", F.explode(F.array(*map(F.lit, (0.0, 1e-9, 1e-7, 1.0)))).alias("scale"), "embedding")
    vec = F.transform("embedding", lambda x: x.cast("double") * F.col("scale"))
    return scaled.where(~V.is_zero(vec)).select("vec_id", "scale")


def cast_vector(spark, sf):
    wide = F.transform("embedding", lambda x: x.cast("double") * 1.1)
    cast = _embeddings(spark, sf).select("vec_id", V.checked_vector(wide, 64).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return cast.select("vec_id", F.size("v").cast("bigint").alias("n"), F.round(total, 6).alias("total"))


def total_images(spark, sf):
    return _store(spark, sf).agg(F.count("*").alias("total_images"))


def first_n(spark, sf):
    return files(spark, sf).select("path").orderBy("path").limit(225)


def _batch() -> Column:
    return F.floor(F.col("vec_id") / BATCH).alias("batch")


def similarity_matrix(spark, sf):
    rows = _embeddings(spark, sf)
    summary = similarity_summary(
        rows.select(_batch(), F.col("vec_id").alias("id"), _emb().alias("vector")),
        rows.select(_batch(), F.col("vec_id").alias("id"), _rev().alias("vector")), LOGIT_SCALE)
    return summary.select("side", "id", "n", *[_r6(c) for c in ("mean", "low", "high", "logsumexp")])


def contrastive(spark, sf):
    pairs = _embeddings(spark, sf).select(
        _batch(), F.col("vec_id").alias("id"), _emb().alias("text"), _rev().alias("image"))
    return contrastive_loss(pairs, LOGIT_SCALE).select("batch", _r6("loss"))


QUERIES = {
    "vector_topk": vector_topk,
    "vector_topk_native": vector_topk_native,
    "vector_topk_tiny_query": vector_topk_tiny_query,
    "vector_topk_rounded": vector_topk_rounded,
    "ranked_results": ranked_results,
    "full_ranking": full_ranking,
    "batch_topk": batch_topk,
    "batch_topk_blocks": batch_topk_blocks,
    "text_search": text_search,
    "vec_dot": vec_dot,
    "vec_norm": vec_norm,
    "vec_cosine": vec_cosine,
    "vec_normalize": vec_normalize,
    "zero_vector_filter": zero_vector_filter,
    "cast_vector": cast_vector,
    "total_images": total_images,
    "first_n": first_n,
    "similarity_matrix": similarity_matrix,
    "contrastive_loss": contrastive,
}

_STORE_SQL = """
e as (select vec_id, cast(embedding as double[]) as v from embeddings),
store as (select vec_id, v from e
    union all select -1 - vec_id, list_transform(v, lambda x: cast(0 as double)) from e)"""

_SCORED_SQL = f"""
with {_STORE_SQL},
q as (select v as qv from e where vec_id = 0),
scored as (select vec_id, case when list_max(list_transform(v, lambda x: abs(x))) > 1e-8
    then list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))) end as score
  from store, q)"""


def _zero(expr: str) -> str:
    """Round to six decimals and turn -0.0 into 0.0."""
    return f"case when round({expr}, 6) = 0 then cast(0 as double) else round({expr}, 6) end"


_TOPK_SQL = f"""{_SCORED_SQL}
select vec_id, round(score, 6) as score, (select count(*) from store) as total_images
from scored where score > 0 order by scored.score desc, vec_id limit 10"""

_BATCH_SQL = f"""
with {_STORE_SQL},
ranked as (
  select a.vec_id as query_id, b.vec_id as vec_id,
    list_dot_product(b.v, a.v) / (sqrt(list_dot_product(b.v, b.v)) * sqrt(list_dot_product(a.v, a.v))) as score
  from e a, store b where b.vec_id >= 0),
best as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank
  from ranked where score > 0)
select query_id, cast(rank as integer) as rank, vec_id, round(score, 6) as score from best where rank <= 5"""

_LOGITS_SQL = f"""
with e as (select vec_id as id, cast(embedding as double[]) as v from embeddings),
l as (select a.id as t, b.id as i, list_dot_product(a.v, list_reverse(b.v)) * exp(cast({LOGIT_SCALE} as double)) as z
  from e a join e b on a.id // {BATCH} = b.id // {BATCH}),
sides as (select 'text' as side, t as id, z from l union all select 'image', i, z from l),
peaks as (select side, id, max(z) as peak from sides group by side, id),
summary as (select side, id, count(*) as n, avg(z) as mean, min(z) as low, max(z) as high,
    max(peak) + ln(sum(exp(z - peak))) as logsumexp
  from sides join peaks using (side, id) group by side, id)"""

ORACLES = {
    "vector_topk": _TOPK_SQL,
    "vector_topk_native": _TOPK_SQL,
    "vector_topk_tiny_query": f"""with best as ({_TOPK_SQL})
select in_arrow, vec_id, score, total_images from best, (values (true), (false)) t(in_arrow)""",
    "vector_topk_rounded": f"""{_SCORED_SQL}
select vec_id, round(score, 3) as score from scored where score > 0
order by scored.score desc, vec_id limit 5""",
    "ranked_results": f"""{_SCORED_SQL},
best as (select vec_id, score from scored where score > 0 order by score desc, vec_id limit 10)
select cast(row_number() over (order by score desc, vec_id) as integer) as rank,
  printf('%.3f', score) as label, vec_id from best""",
    "full_ranking": f"""{_SCORED_SQL}
select vec_id, {_zero('score')} as score from scored""",
    "batch_topk": _BATCH_SQL,
    "batch_topk_blocks": _BATCH_SQL,
    "text_search": f"""
with {hashed_vectors('documents', ['doc_id'], 'text', TEXT_DIM, 'd')},
{hashed_vectors('benchmark', ['item_id'], 'text', TEXT_DIM, 'b')},
scored as (select b.item_id as query_id, d.doc_id as doc_id,
    list_dot_product(d.v, b.v) / (sqrt(list_dot_product(d.v, d.v)) * sqrt(list_dot_product(b.v, b.v))) as score
  from b_vectors b, d_vectors d),
best as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank
  from scored where score > 0)
select query_id, cast(rank as integer) as rank, doc_id, round(score, 6) as score from best where rank <= 3""",
    "vec_dot": f"""with e as (select vec_id, cast(embedding as double[]) as v from embeddings)
select vec_id, {_zero('list_dot_product(v, list_reverse(v))')} as dot from e""",
    "vec_norm": """with e as (select vec_id, cast(embedding as double[]) as v from embeddings)
select vec_id, round(sqrt(list_dot_product(v, v)), 6) as norm from e""",
    "vec_cosine": f"""with {_STORE_SQL}
select vec_id, case when list_dot_product(v, v) > 0
  then {_zero('list_cosine_similarity(v, list_reverse(v))')} end as cosine from store""",
    "vec_normalize": f"""
with e as (select vec_id, list_transform(cast(embedding as double[]), lambda x: x * 3) as v from embeddings),
u as (select vec_id, unnest(range(64)) as pos, unnest(v) / sqrt(list_dot_product(v, v)) as x from e)
select vec_id, cast(pos as integer) as pos, {_zero('x')} as value from u""",
    "zero_vector_filter": """
with s as (select vec_id, scale, list_transform(cast(embedding as double[]), lambda x: abs(x * scale)) as v
  from embeddings, (values (cast(0 as double)), (cast(1e-9 as double)), (cast(1e-7 as double)), (cast(1 as double))) t(scale))
select vec_id, scale from s where list_max(v) > 1e-8""",
    "cast_vector": f"""
with e as (select vec_id, list_transform(cast(embedding as double[]), lambda x: cast(x * cast(1.1 as double) as float)) as v
  from embeddings)
select vec_id, cast(len(v) as bigint) as n, {_zero('list_sum(cast(v as double[]))')} as total from e""",
    "total_images": f"with {_STORE_SQL} select count(*) as total_images from store",
    "first_n": FILES_CTE + "select path from files order by path limit 225",
    "similarity_matrix": f"""{_LOGITS_SQL}
select side, id, n, {_zero('mean')} as mean, {_zero('low')} as low, {_zero('high')} as high,
  {_zero('logsumexp')} as logsumexp from summary""",
    "contrastive_loss": f"""{_LOGITS_SQL}
select s.id // {BATCH} as batch, round(avg(s.logsumexp - l.z), 6) as loss
from summary s join l on l.t = s.id and l.i = s.id group by all""",
}
