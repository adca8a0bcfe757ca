"""Registered scan, snapshot, store and refresh queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import diff as D
from ..operators.encoders import ColumnEncoder, HashedTextEncoder
from ..session import fresh_dir, spread
from ..sources.scan import scan_images, sorted_paths
from ..sources.store import VectorStore
from ..streaming.refresh import embed_arrivals, read_cycles, run_cycles, start_refresh
from .fixtures import (
    FILES_CTE, TREE_SQL, file_tree, files, files_current, files_stored, relative, table,
)
from .sync import concat_rows, stats_frame, sync
from .text_sql import vector_summary

ROOT = "/r"
TEXT_DIM = 128


def _path() -> Column:
    return F.col("path")


def _generation(number: int) -> ColumnEncoder:
    """An encoder both engines can compute; the number shows which sync wrote a row."""
    return ColumnEncoder(3, lambda p: F.array(
        F.length(p).cast("float"), F.ascii(F.substring(p, -1, 1)).cast("float"), F.lit(float(number)).cast("float")))


def _vector_sql(number: str) -> str:
    return f"cast(length(path) as double) as v0, cast(ascii(right(path, 1)) as double) as v1, " \
           f"cast({number} as double) as v2"


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("path", "mtime", *[F.col("vector")[i].cast("double").alias(f"v{i}") for i in range(3)])


def _new_store(spark: SparkSession) -> VectorStore:
    return VectorStore(spark, fresh_dir(spark, "store"))


def _filled_store(spark: SparkSession, sf: str) -> VectorStore:
    store = _new_store(spark)
    sync(store, files_stored(spark, sf), _generation(1))
    return store


# -- listing ------------------------------------------------------------------------

def scan_files(spark, sf):
    root = file_tree(spark, sf)
    listing = scan_images(spark, root, exclude=P.DEFAULT_EXCLUDES)
    return sorted_paths(listing).select(relative(_path(), root).alias("path"))


def file_snapshot(spark, sf):
    root = file_tree(spark, sf)
    return scan_images(spark, root, entries_per_task=200).select(relative(_path(), root).alias("path"), "mtime")


def scan_nonrecursive(spark, sf):
    root = file_tree(spark, sf)
    return scan_images(spark, root, recursive=False).select(relative(_path(), root).alias("path"), "mtime")


def direct_children(spark, sf):
    return files(spark, sf).where(P.is_direct_child(_path(), f"{ROOT}/p")).select("path")


def filter_extension(spark, sf):
    return files(spark, sf).where(P.is_image(_path())).select("path")


def filter_hidden(spark, sf):
    return files(spark, sf).where(~P.is_hidden(_path(), ROOT)).select("path")


def filter_exclude(spark, sf):
    kept = P.is_image(_path()) & ~P.is_hidden(_path(), ROOT) & ~P.is_excluded(_path(), ROOT, P.DEFAULT_EXCLUDES)
    return files(spark, sf).where(kept).select("path")


def filter_exclude_globs(spark, sf):
    return files(spark, sf).where(~P.is_excluded(_path(), ROOT, ["Lib*", "[!v-z]env", "f?7.*", "node_module[r-t]"])).select("path")


# -- store --------------------------------------------------------------------------

def store_read(spark, sf):
    return _flat(_filled_store(spark, sf).read())


def store_write(spark, sf):
    store = _filled_store(spark, sf)
    rows = files_current(spark, sf).select(
        "path", "mtime", _generation(2).expression(_path()).alias("vector"), F.lit(None).cast("string").alias("error"))
    store.write(rows, 3)
    return _flat(store.read())


def store_snapshot(spark, sf):
    return _filled_store(spark, sf).snapshot()


def keep_by_keys(spark, sf):
    return D.keep_by_keys(files_stored(spark, sf), files_current(spark, sf))


def store_concat(spark, sf):
    old = files_stored(spark, sf)
    return concat_rows(old, files_current(spark, sf).select("mtime", "path"))


# -- comparison ---------------------------------------------------------------------

def _both(operator):
    return lambda spark, sf: operator(files_current(spark, sf), files_stored(spark, sf))


def _diff(spark, sf):
    return D.classify(files_current(spark, sf), files_stored(spark, sf))


def work_set(spark, sf):
    return D.work_set(_diff(spark, sf)).orderBy("path")


def sync_summary(spark, sf):
    store = _filled_store(spark, sf)
    stats = sync(store, files_current(spark, sf), _generation(2))
    return stats_frame(spark, stats).drop("elapsed")


def diff_summary(spark, sf):
    return D.summarize(_diff(spark, sf))


def sync_plan(spark, sf):
    plan = D.dry_run(_diff(spark, sf))
    return plan.withColumn("estimated_seconds", F.round("estimated_seconds", 4))


def sync_store(spark, sf):
    store = _filled_store(spark, sf)
    sync(store, files_current(spark, sf), _generation(2))
    return _flat(store.read())


def sync_store_shuffled(spark, sf):
    store = _filled_store(spark, sf)
    sync(store, files_current(spark, sf), _generation(2), broadcast_key_bytes=0)
    return _flat(store.read())


# -- refresh ------------------------------------------------------------------------

def _refreshed(spark, sf, log_table=None):
    """A store after three cycles over a changing source; the second one fails and must not matter."""
    store = _new_store(spark)
    seen = iter(("stored", "broken", "current"))

    def list_current() -> DataFrame:
        state = next(seen, "current")
        if state == "broken":
            raise OSError("source is away")
        return files_stored(spark, sf) if state == "stored" else files_current(spark, sf)

    run_cycles(lambda note: start_refresh(
        store, list_current, _generation(1), seconds=0.2, on_cycle=note, log_table=log_table), 3)
    return store


def refresh_stream(spark, sf):
    """The store after the cycles."""
    return _flat(_refreshed(spark, sf).read())


def refresh_log(spark, sf):
    """What the first three cycles left in their log."""
    log_table = fresh_dir(spark, "cycles")
    _refreshed(spark, sf, log_table)
    counts = ("new", "modified", "deleted", "unchanged", "total", "failed")
    return read_cycles(spark, log_table).where("cycle < 3").select("cycle", *counts, "error")


def stream_new_files(spark, sf):
    """Documents arrive in two batches; each is embedded once."""
    arrivals, target, progress = (fresh_dir(spark, n) for n in ("arrivals", "embedded", "progress"))
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    encoder = HashedTextEncoder(TEXT_DIM)
    for part in (docs.where("lang = 'en'"), docs.where("lang is distinct from 'en'")):
        part.write.mode("append").parquet(arrivals)
        embed_arrivals(spark, arrivals, docs.schema, "text", encoder, target, progress).awaitTermination()
    return vector_summary_frame(spark.read.parquet(target), ["doc_id"])


def vector_summary_frame(rows: DataFrame, keys: list[str]) -> DataFrame:
    v = F.col("vector")
    weighted = F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        *keys, F.size(F.filter(v, lambda x: x > 0)).cast("bigint").alias("filled"),
        F.array_max(v).cast("double").alias("top"), F.round(weighted, 6).alias("weighted"))


QUERIES = {
    "scan_files": scan_files,
    "file_snapshot": file_snapshot,
    "scan_nonrecursive": scan_nonrecursive,
    "direct_children": direct_children,
    "filter_extension": filter_extension,
    "filter_hidden": filter_hidden,
    "filter_exclude": filter_exclude,
    "filter_exclude_globs": filter_exclude_globs,
    "store_read": store_read,
    "store_write": store_write,
    "store_snapshot": store_snapshot,
    "keep_by_keys": keep_by_keys,
    "store_concat": store_concat,
    "diff_new": _both(D.new_keys),
    "diff_deleted": _both(D.deleted_keys),
    "diff_common": _both(D.common_keys),
    "diff_modified": _both(D.modified_keys),
    "diff_unchanged": _both(D.unchanged_keys),
    "snapshot_diff": _diff,
    "work_set": work_set,
    "diff_summary": diff_summary,
    "sync_summary": sync_summary,
    "sync_plan": sync_plan,
    "sync_store": sync_store,
    "sync_store_shuffled": sync_store_shuffled,
    "refresh_stream": refresh_stream,
    "refresh_log": refresh_log,
    "stream_new_files": stream_new_files,
}

_IMAGE = r"'\.(jpg|jpeg|png|gif|webp|bmp|tiff|tif|heic|heif)$'"
_DEFAULTS = r"'/(Library|\.Trash|\.cache|Cache|node_modules|\.git|\.venv|venv)(/|$)'"
_TREE_CTE = f"with tree as ({TREE_SQL.format(customer='customer')}) "
_TREE_SEEN = f"regexp_matches(rel, {_IMAGE}) and not regexp_matches('/' || rel, '/[.]')"
_CLASSES = FILES_CTE + """, d as (
  select coalesce(c.path, o.path) as path, case when o.path is null then 'new' when c.path is null then 'deleted'
    when c.mtime <> o.mtime then 'modified' else 'unchanged' end as status,
    c.mtime as mtime, o.mtime as stored_mtime
  from cur c full join old o on c.path = o.path) """
_COUNTS = """count(*) filter (status = 'new') as "new", count(*) filter (status = 'modified') as modified,
  count(*) filter (status = 'deleted') as deleted, count(*) filter (status = 'unchanged') as unchanged,
  count(*) filter (status <> 'deleted') as total"""
_SYNCED = f"""{_CLASSES} select path, mtime, {_vector_sql("case when status = 'unchanged' then 1 else 2 end")}
from d where status <> 'deleted'"""

ORACLES = {
    "scan_files": f"""{_TREE_CTE} select rel as path from tree
where {_TREE_SEEN} and not regexp_matches('/' || rel, {_DEFAULTS})""",
    "file_snapshot": f"{_TREE_CTE} select rel as path, mtime from tree where {_TREE_SEEN}",
    "scan_nonrecursive": f"""{_TREE_CTE} select rel as path, mtime from tree
where {_TREE_SEEN} and not contains(rel, '/')""",
    "direct_children": FILES_CTE + "select path from files where regexp_matches(path, '^/r/p/[^/]+$')",
    "filter_extension": FILES_CTE + f"select path from files where regexp_matches(path, {_IMAGE})",
    "filter_hidden": FILES_CTE + "select path from files where not regexp_matches(path, '/[.]')",
    "filter_exclude": FILES_CTE + f"""select path from files where regexp_matches(path, {_IMAGE})
  and not regexp_matches(path, '/[.]') and not regexp_matches(path, {_DEFAULTS})""",
    "filter_exclude_globs": FILES_CTE + r"""select path from files
where not regexp_matches(path, '/(Lib[^/]*|[^v-z/]env|f[^/]7\.[^/]*|node_module[r-t])(/|$)')""",
    "store_read": FILES_CTE + f"select path, mtime, {_vector_sql('1')} from old",
    "store_write": FILES_CTE + f"select path, mtime, {_vector_sql('2')} from cur",
    "store_snapshot": FILES_CTE + "select path, mtime from old",
    "keep_by_keys": FILES_CTE + "select path, mtime from old where path in (select path from cur)",
    "store_concat": FILES_CTE + "select path, mtime from old union all select path, mtime from cur",
    "diff_new": FILES_CTE + "select path from cur except select path from old",
    "diff_deleted": FILES_CTE + "select path from old except select path from cur",
    "diff_common": FILES_CTE + "select path from old intersect select path from cur",
    "diff_modified": FILES_CTE + "select path from cur join old using (path) where cur.mtime <> old.mtime",
    "diff_unchanged": FILES_CTE + "select path from cur join old using (path) where cur.mtime = old.mtime",
    "snapshot_diff": _CLASSES + "select path, status, mtime, stored_mtime from d",
    "work_set": _CLASSES + "select path, mtime from d where status in ('new', 'modified') order by path",
    "diff_summary": _CLASSES + f"select {_COUNTS} from d",
    "sync_summary": _CLASSES + f"select {_COUNTS}, cast(0 as bigint) as failed from d",
    "sync_plan": _CLASSES + f""", c as (select {_COUNTS} from d)
select total as found, unchanged + modified + deleted as stored, unchanged, "new", modified,
  deleted as removed, "new" + modified as to_embed,
  round(("new" + modified) / cast(280 as double), 4) as estimated_seconds from c""",
    "sync_store": _SYNCED,
    "sync_store_shuffled": _SYNCED,
    "refresh_log": _CLASSES + """, counts as (
  select count(*) filter (status = 'new') as new, count(*) filter (status = 'modified') as modified,
    count(*) filter (status = 'deleted') as deleted, count(*) filter (status = 'unchanged') as unchanged,
    count(*) filter (status <> 'deleted') as total from d),
first as (select count(*) as n from old)
select cast(0 as bigint) as cycle, n as new, cast(0 as bigint) as modified, cast(0 as bigint) as deleted,
  cast(0 as bigint) as unchanged, n as total, cast(0 as bigint) as failed, cast(null as varchar) as error from first
union all select 1, null, null, null, null, null, null, 'OSError: source is away'
union all select 2, new, modified, deleted, unchanged, total, 0, null from counts""",
    "refresh_stream": FILES_CTE + f"select path, mtime, {_vector_sql('1')} from cur",
    "stream_new_files": vector_summary("documents", ["doc_id"], "text", TEXT_DIM),
}
