"""Inputs of the registered queries, derived by Spark from the given tables.

File snapshots come from `orders`, file trees from `customer`, images from `supplier`.
The SQL text of a derivation is shared with the oracle, so both engines see one definition.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir, map_arrow, spread
from ..sources.files import strip_file_scheme, write_bytes


FILES_PER_STEP = 64  # files that a task holds at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- file snapshots -----------------------------------------------------------------

FILES_SQL = """
select concat('/r/', case o_orderkey % 9 when 0 then 'Pictures' when 1 then 'Library'
    when 2 then '.cache' when 3 then 'node_modules' when 4 then 'a/b' when 5 then 'venv'
    when 6 then 'Downloads' when 7 then 'x/.git/y' else 'p' end,
  '/f', cast(o_orderkey as varchar(20)),
  case o_orderkey % 11 when 0 then '.jpg' when 1 then '.JPG' when 2 then '.png'
    when 3 then '.gif' when 4 then '.txt' when 5 then '.webp' when 6 then '.bmp'
    when 7 then '.tiff' when 8 then '.heic' when 9 then '.csv' else '.jpeg' end) as path,
  o_orderkey as k, cast(o_totalprice as double) as mtime
from {orders}"""

CURRENT_SQL = """
select path, case when k % 6 = 0 then mtime + 0.5 else mtime end as mtime
from {files} where k % 10 <> 3"""

STORED_SQL = "select path, mtime from {files} where k % 10 <> 4"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FILES_SQL.format(orders="{orders}"), orders=table(spark, sf_dir, "orders"))


def files_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CURRENT_SQL, files=files(spark, sf_dir))


def files_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STORED_SQL, files=files(spark, sf_dir))


FILES_CTE = f"with files as ({FILES_SQL.format(orders='orders')}), " \
            f"cur as ({CURRENT_SQL.format(files='files')}), old as ({STORED_SQL.format(files='files')}) "

# -- a real file tree ---------------------------------------------------------------

TREE_SQL = """
select concat(case c_custkey % 12 when 0 then '' when 1 then 'Library/' when 2 then '.cache/'
    when 3 then 'a/b/c/' when 4 then '_under/' when 5 then 'sp ace/' when 6 then 'a/node_modules/x/'
    when 7 then 'a/.hid/' when 8 then 'plus+x%20y/' when 9 then 'a/' when 10 then 'k=v/' else '' end,
  case c_custkey % 17 when 0 then '.' when 1 then '_' else 'f' end, cast(c_custkey as varchar(20)),
  case c_custkey % 7 when 0 then '.jpg' when 1 then '.JPG' when 2 then '.png' when 3 then '.heif'
    when 4 then '.txt' when 5 then '.tif' else 'png' end) as rel,
  cast(1600000000 + c_custkey as double) + (c_custkey % 4) * cast(0.25 as double) as mtime
from {customer}"""


def file_tree(spark: SparkSession, sf_dir: str) -> str:
    """Write the tree with Spark tasks to a new shared folder and return its root."""
    rows = spark.sql(TREE_SQL, customer=spread(table(spark, sf_dir, "customer").select("c_custkey")))
    return write_files(rows.select("rel", "mtime", F.lit(b"x").alias("content")))


def write_files(rows: DataFrame) -> str:
    """Write (rel, mtime, content) rows as files from the tasks that hold them."""
    spark = rows.sparkSession
    root = strip_file_scheme(fresh_dir(spark, "files")) + "/tree"

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, FILES_PER_STEP):
                for row in batch.slice(start, FILES_PER_STEP).to_pylist():
                    write_bytes(f"{root}/{row['rel']}", row["content"], row["mtime"])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    map_arrow(rows.select("rel", "mtime", "content"), write, "n long").agg(F.sum("n")).collect()
    return root


def relative(path, root: str):
    return F.substring(path, F.lit(len(root) + 2), F.length(path))


# -- images -------------------------------------------------------------------------

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
SIDE = 32  # side of the patterned images, and the crop size of the registered image queries


def encode_png(pixels: np.ndarray) -> bytes:
    """uint8 [height, width, 3 or 4] as a PNG whose lines use all five filters in turn, Paeth most."""
    height, width, channels = pixels.shape
    around = np.zeros((height + 1, width + 1, channels), np.int16)
    around[1:, 1:] = pixels
    left, up, corner = around[1:, :-1], around[:-1, 1:], around[:-1, :-1]
    off = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))  # from left, up and corner
    nearest = np.choose(off.argmin(axis=0), (left, up, corner))
    modes = np.array([4, 1, 4, 2, 4, 3, 4, 0])[np.arange(height) % 8]
    guess = np.choose(modes[:, None, None], (0, left, up, (left + up) >> 1, nearest))
    lines = np.concatenate([modes[:, None], (pixels - guess).reshape(height, -1) & 0xFF], axis=1).astype(np.uint8)
    header = struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6}[channels], 0, 0, 0)
    body = b""
    for kind, data in ((b"IHDR", header), (b"IDAT", zlib.compress(lines.tobytes(), 1)), (b"IEND", b"")):
        body += struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return PNG_MAGIC + body


def _pattern(k: int) -> np.ndarray:
    """Even keys: SIDE x SIDE pattern, every fourth with alpha. Odd keys: one flat colour in
    a size that differs from key to key."""
    c = np.arange(3)
    if k % 2 == 0:
        y, x = np.arange(SIDE)[:, None, None], np.arange(SIDE)[None, :, None]
        pixels = (k * 7 + y * 3 + x * 5 + c * 11) % 256
    else:
        pixels = np.broadcast_to((k * 13 + c * 50) % 256, (20 + k % 53, 20 + k % 37, 3))
    pixels = pixels.astype(np.uint8)
    if k % 4 == 0:
        pixels = np.concatenate([pixels, np.full((*pixels.shape[:2], 1), 200, np.uint8)], axis=2)
    return pixels


# The same pixels on the SIDE x SIDE grid after resize and crop, in SQL.
PIXEL_SQL = f"""
select s_suppkey as k, y, x, c, case when s_suppkey % 2 = 0
    then (s_suppkey * 7 + y * 3 + x * 5 + c * 11) % 256 else (s_suppkey * 13 + c * 50) % 256 end as p
from supplier, range({SIDE}) ty(y), range({SIDE}) tx(x), range(3) tc(c)"""

# Larger pictures, of twice and three times SIDE, whose lines and columns all differ.
WIDE_PIXEL_SQL = f"""
select s_suppkey as k, y, x, c, (s_suppkey * 7 + y * y * 3 + x * 5 + (x * y) % 13 * 9 + c * 11) % 256 as p
from supplier, range({2 * SIDE}) ty(y), range({3 * SIDE}) tx(x), range(3) tc(c)"""


def _wide(k: int) -> np.ndarray:
    y, x, c = np.ogrid[:2 * SIDE, :3 * SIDE, :3]
    return ((k * 7 + y * y * 3 + x * 5 + (x * y) % 13 * 9 + c * 11) % 256).astype(np.uint8)


BROKEN_SQL = "s_suppkey % 9 = 4"


def image_files(spark: SparkSession, sf_dir: str, broken: bool = True, draw: Callable = _pattern) -> str:
    """One PNG per supplier; every ninth is not an image when `broken` is set."""
    keys = spread(table(spark, sf_dir, "supplier").select("s_suppkey")).select("s_suppkey", F.expr(BROKEN_SQL).alias("bad"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.to_pylist()
            for start in range(0, len(keys), FILES_PER_STEP):
                rows = keys[start:start + FILES_PER_STEP]
                content = [b"not an image" if broken and r["bad"] else encode_png(draw(r["s_suppkey"]))
                           for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{r['s_suppkey']}.png" for r in rows]),
                     pa.array([1.6e9 + r["s_suppkey"] for r in rows]), pa.array(content, pa.binary())],
                    names=["rel", "mtime", "content"])

    return write_files(map_arrow(keys, encode, "rel string, mtime double, content binary"))


def wide_image_files(spark: SparkSession, sf_dir: str) -> str:
    return image_files(spark, sf_dir, broken=False, draw=_wide)


def photo_files(spark: SparkSession, n: int) -> str:
    """Filtered PNG files about the size that models take, for timing only."""
    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                y, x, c = np.ogrid[:256, :256 + k % 97, :3]
                pixels = (y * (1 + k % 3) + x * 2 + c * 40 + (x * y + k) % 7).astype(np.uint8)
                yield pa.RecordBatch.from_pylist([{"rel": f"{k}.png", "mtime": 1.6e9 + k, "content": encode_png(pixels)}])

    rows = spark.range(n).repartition(max(1, spark.sparkContext.defaultParallelism))
    return write_files(map_arrow(rows, draw, "rel string, mtime double, content binary"))


def image_key(path) -> Callable:
    return F.regexp_extract(path, r"(\d+)\.png$", 1).cast("bigint")
