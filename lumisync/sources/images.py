"""Images as pixels, decoded by Spark's image source in the JVM (PNG, JPEG, GIF, BMP and what else its codecs read)."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir, map_arrow, parallelism
from .files import is_uri

RGB_SCHEMA = "path string, height int, width int, rgb binary, error string"
IMAGE = "struct<height:int,width:int,nChannels:int,data:binary>"
STEP_BYTES = 4 << 20  # pixels that become RGB at a time
# The image source takes its files as a list that goes through the driver; more files than this go in waves.
WAVE_FILES = 50_000
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decode every file below a folder to RGB in the JVM's image codecs.

    One row per file: (path, height, width, rgb bytes in row order, error). A file that
    does not decode keeps its row with an error and no pixels.
    """
    source = spark.read.format("image").option("recursiveFileLookup", "true")
    images = _named(source.load(path if is_uri(path) else f"file://{path}"))
    return map_arrow(images.select("path", "image.*"), _to_rgb, RGB_SCHEMA)


def _named(images: DataFrame) -> DataFrame:
    """(path, image) with paths as a listing has them."""
    plain = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))
    fields = [F.col(f"image.{name}") for name in ("height", "width", "nChannels", "data")]
    return images.select(F.regexp_replace(plain, "^file:/+", "/").alias("path"), F.struct(*fields).alias("image"))


def rgb_of(height: int, width: int, channels: int, data) -> np.ndarray:
    """uint8 [height, width, 3] of the pixels of an image row, which are gray, BGR or BGRA."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]


def _to_rgb(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in _steps(whole)):
        out = []
        for row in batch.to_pylist():
            if row["height"] < 0:
                out.append((row["path"], None, None, None, NOT_READABLE))
                continue
            rgb = rgb_of(row["height"], row["width"], row["nChannels"], row["data"])
            out.append((row["path"], row["height"], row["width"], rgb.tobytes(), None))
        types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
        names = ("path", "height", "width", "rgb", "error")
        columns = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [
            pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, with about `STEP_BYTES` of pixels at a time or one larger picture."""
    first = size = 0
    for at, length in enumerate(pc.binary_length(batch.column("data")).to_pylist()):
        if at > first and size + (length or 0) > STEP_BYTES:
            yield batch.slice(first, at - first)
            first, size = at, 0
        size += length or 0
    yield batch.slice(first)


NOT_READABLE = "not a readable image"
_GONE = "FileNotFoundError: no such file"
_NO_PATH = "ValueError: no path"


def with_pixels(rows: DataFrame, path_col: str, image_col: str, error_col: str,
                use: Callable[[DataFrame], DataFrame], wave_files: int | None = None) -> DataFrame:
    """`use` of the rows with the pixels of the file that each names, in `image_col`.

    A row whose file is gone, or that has no path, has no pixels and says so in `error_col`, which is null
    otherwise. Only the files of the rows are read. Their paths pass through the driver, about `wave_files`
    at a time: beyond that each wave is written to the shared folder before the next one is listed.
    `rows` is read several times, so it should be a written table, and narrow.
    """
    spark = rows.sparkSession
    waves = max(1, math.ceil(rows.count() / (wave_files or WAVE_FILES)))
    wave = F.pmod(F.xxhash64(path_col), F.lit(waves))
    if waves == 1:
        return use(_wave(rows, path_col, image_col, error_col))
    folders = []
    for number in range(waves):
        made = use(_wave(rows.where(wave == number), path_col, image_col, error_col))
        folders.append(fresh_dir(spark, "wave"))
        made.write.parquet(folders[-1])
    return spark.read.schema(made.schema).parquet(*folders)


def _wave(rows: DataFrame, path_col: str, image_col: str, error_col: str) -> DataFrame:
    others = [c for c in rows.columns if c not in (image_col, error_col)]
    images, gone = _listed(rows.select(F.col(path_col).alias("path")).where("path is not null").distinct())
    missing = rows.sparkSession.createDataFrame([(path,) for path in gone], "gone string")
    lost = rows.join(F.broadcast(missing), rows[path_col] == missing["gone"], "left_semi").union(
        rows.where(F.col(path_col).isNull()))
    problem = F.when(F.col(path_col).isNull(), F.lit(_NO_PATH)).otherwise(F.lit(_GONE))
    lost = lost.select(*others, F.lit(None).cast(IMAGE).alias(image_col), problem.alias(error_col))
    if images is None:
        return lost
    own = images.select(F.col("path").alias("__path"), F.col("image").alias(image_col))
    found = own.join(F.broadcast(rows.select(*others)), F.col("__path") == F.col(path_col))  # a wave of narrow rows
    return found.select(*others, image_col, F.lit(None).cast("string").alias(error_col)).union(lost)


def _listed(paths: DataFrame) -> tuple[DataFrame | None, list[str]]:
    """The image rows of the files that exist, and the paths of the others."""
    for attempts_left in (2, 1, 0):
        asked = map_arrow(paths, _ask, "path string, there boolean").collect()  # a wave of paths
        files = [_source_path(r.path) for r in asked if r.there]
        try:
            images = _named(_load(paths.sparkSession, files)) if files else None
            return images, [r.path for r in asked if not r.there]
        except AnalysisException:  # a file went after it was seen
            if not attempts_left:
                raise


def _load(spark: SparkSession, files: list[str]) -> DataFrame:
    """The image rows of some files, which are listed by a few tasks for each core and not by one for each file."""
    before = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(4 * parallelism(spark)))
    try:
        return spark.read.format("image").load(files)
    finally:
        spark.conf.set(LISTING_TASKS, before)


def _source_path(path: str) -> str:
    """A path as the image source takes it: with its scheme, and no character read as a pattern."""
    return ("" if is_uri(path) else "file://") + re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        there = [_is_file(path) for path in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(there, pa.bool_())], names=["path", "there"])


def _is_file(path: str) -> bool:
    if not is_uri(path):
        return os.path.isfile(path)
    remote, inner = pafs.FileSystem.from_uri(path)
    return remote.get_file_info(inner).type == pafs.FileType.File
