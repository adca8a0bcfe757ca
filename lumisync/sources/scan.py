"""Distributed listing of image files with include, hidden and exclude rules."""

from __future__ import annotations

import itertools
import math
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.paths import IMAGE_EXTENSIONS, glob_regex
from ..schemas import LISTING
from ..session import fresh_dir, map_arrow, parallelism
from .files import TooManyNames, is_folder, is_uri, list_folder, strip_file_scheme

ENTRIES_PER_TASK = 50_000
ROWS_PER_BATCH = 10_000
# A folder to be walked may be a share of its names.
_FOUND = T.StructType([*LISTING.fields, T.StructField("share", T.IntegerType()), T.StructField("shares", T.IntegerType())])
_WHOLE = ("cast(null as int) as share", "cast(null as int) as shares")
_ARROW_FOUND = pa.schema(
    [("path", pa.string()), ("mtime", pa.float64()), ("is_dir", pa.bool_()), ("share", pa.int32()), ("shares", pa.int32())]
)


def scan_images(
    spark: SparkSession,
    root: str,
    recursive: bool = True,
    exclude: Iterable[str] | None = None,
    entries_per_task: int = ENTRIES_PER_TASK,
) -> DataFrame:
    """(path, mtime) of every image file below `root`.

    Folders that may not be read or vanish meanwhile are skipped. Any other error fails the
    task, for an incomplete listing would pass the files it lacks for deleted ones.

    The tree is walked in rounds. A task walks its folders until it has seen
    `entries_per_task` names and hands back the folders it did not get to; the next
    round spreads those over the cluster. A local folder with more names than that is only
    counted and handed back in shares of its names by hash, each for a task of its own. However
    lopsided the tree is, no subtree and no flat folder is tied to one task, and nothing but a
    count of open folders reaches the driver.
    """
    root = strip_file_scheme(root)
    root = root.rstrip("/") if is_uri(root) else os.path.realpath(root)
    if not is_folder(root):
        raise NotADirectoryError(root)
    skipped = glob_regex(exclude or ())
    walk = _walker(recursive, skipped, entries_per_task)

    base = fresh_dir(spark, "scan")
    frontier = spark.createDataFrame([(root,)] if _visible(os.path.basename(root), skipped) else [],
                                     "path string").coalesce(1).selectExpr("path", *_WHOLE)
    for round_no in itertools.count():
        target = f"{base}/round={round_no}"
        map_arrow(frontier, walk, _FOUND).write.parquet(target)
        pending = spark.read.schema(_FOUND).parquet(target).where("is_dir").select("path", "share", "shares")
        n_pending = pending.count()
        if n_pending == 0:
            break
        frontier = pending.repartition(min(n_pending, 4 * parallelism(spark)))

    rounds = [f"{base}/round={i}" for i in range(round_no + 1)]
    return spark.read.schema(LISTING).parquet(*rounds).where("not is_dir").select("path", "mtime")


def sorted_paths(listing: DataFrame) -> DataFrame:
    return listing.orderBy("path")


def _visible(name: str, skipped: str | None) -> bool:
    return not name.startswith(".") and not (skipped and re.fullmatch(skipped, name))


def _walker(recursive: bool, skipped: str | None, budget: int) -> Callable:
    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(_walk_one_batch(b) for b in batches)
        while chunk := list(itertools.islice(rows, ROWS_PER_BATCH)):
            columns = [pa.array(c, f.type) for c, f in zip(zip(*chunk), _ARROW_FOUND)]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW_FOUND)

    def _walk_one_batch(batch: pa.RecordBatch) -> Iterator[tuple]:
        seen, stack = 0, [(r["path"], r["share"], r["shares"]) for r in batch.to_pylist()]
        while stack and seen < budget:
            folder, share, shares = stack.pop()
            try:
                for path, name, is_dir, mtime in list_folder(folder, _in_share(share, shares), None if shares else budget):
                    seen += 1
                    if not _visible(name, skipped):
                        continue
                    if is_dir:
                        if recursive:
                            stack.append((path, None, None))
                    elif name.endswith(IMAGE_EXTENSIONS):
                        yield path, mtime, False, None, None
            except TooManyNames as crowd:
                shares = math.ceil(crowd.count / budget)
                yield from ((folder, None, True, share, shares) for share in range(shares))
            except (PermissionError, FileNotFoundError):
                continue  # a closed or vanished folder is skipped, as a listing tool would
        for path, share, shares in stack:
            yield path, None, True, share, shares

    return walk


def _in_share(share: int | None, shares: int | None) -> Callable[[str], bool] | None:
    if shares is None:
        return None
    return lambda name: zlib.crc32(os.fsencode(name)) % shares == share
