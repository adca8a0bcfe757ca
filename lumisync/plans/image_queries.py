"""Registered image queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.embed import embed
from ..operators.encoders import GridImageEncoder
from ..operators.tensor import IMAGE_MEAN, IMAGE_STD, TensorSpec, tensors
from ..sources.images import read_images
from ..sources.scan import scan_images
from .fixtures import BROKEN_SQL, PIXEL_SQL, SIDE, WIDE_PIXEL_SQL, image_files, image_key, table, wide_image_files

SPEC = TensorSpec(size=SIDE, crop=SIDE)
GRID = 4
CROP = 24  # of a side of 32: what a halved picture has without the reach of its border

SIZES_SQL = """select p_partkey, cast(1 + (p_partkey * 37) % 900 as int) as w,
  cast(1 + (p_partkey * 53) % 700 as int) as h from {part}"""


def resize_geometry(spark, sf):
    sizes = spark.sql(SIZES_SQL, part=table(spark, sf, "part"))
    width, height = G.resized(F.col("w"), F.col("h"))
    return sizes.select("p_partkey", width.alias("width"), height.alias("height"))


def crop_box(spark, sf):
    sizes = spark.sql(SIZES_SQL, part=table(spark, sf, "part"))
    box = G.crop_box(F.col("w"), F.col("h"))
    return sizes.select("p_partkey", *[c.alias(f"box_{n}") for n, c in box.items()])


def decode_images(spark, sf):
    """Sizes and a position-weighted checksum per channel of every decoded file."""
    images = read_images(spark, image_files(spark, sf))
    rgb = F.transform(F.split(F.regexp_replace(F.hex("rgb"), "(..)", "$1,"), ","),
                      lambda b: F.coalesce(F.conv(b, 16, 10).cast("bigint"), F.lit(0)))
    checksum = F.aggregate(F.transform(rgb, lambda v, i: v * (i % 97 + 1)), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return images.select(
        image_key(F.col("path")).alias("k"), "height", "width",
        F.when(F.col("error").isNull(), checksum).alias("checksum"), F.col("error").isNotNull().alias("failed"))


def image_tensor(spark, sf):
    images = read_images(spark, image_files(spark, sf))
    prepared = tensors(images.select("path", "height", "width", "rgb", "error"), SPEC)
    weighted = F.aggregate(F.transform("tensor", lambda x, i: x.cast("double") * (i % 13 + 1)), F.lit(0.0), lambda a, x: a + x)
    return prepared.select(
        image_key(F.col("path")).alias("k"), F.size("tensor").cast("bigint").alias("n"),
        F.array_min("tensor").cast("double").alias("low"), F.array_max("tensor").cast("double").alias("high"),
        F.round(weighted, 6).alias("weighted"), F.col("error").isNotNull().alias("failed"))


def image_resample(spark, sf):
    """Checksum of pictures of 64 lines and 96 columns, halved and cropped to the middle."""
    images = read_images(spark, wide_image_files(spark, sf))
    halved = tensors(images, TensorSpec(size=SIDE, crop=CROP, normalize=False))
    levels = F.transform("tensor", lambda x, i: F.round(x.cast("double") * 255).cast("bigint") * (i % 97 + 1))
    checksum = F.aggregate(levels, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return halved.select(image_key(F.col("path")).alias("k"), F.size("tensor").cast("bigint").alias("n"), checksum.alias("checksum"))


def _features(spark, sf, unit: bool, broken: bool) -> DataFrame:
    listing = scan_images(spark, image_files(spark, sf, broken))
    return embed(listing, "path", GridImageEncoder(GRID, SPEC, unit))


def _cells(rows: DataFrame) -> DataFrame:
    cells = rows.select(image_key(F.col("path")).alias("k"), F.posexplode("vector").alias("cell", "value"))
    return cells.withColumn("value", F.col("value").cast("double"))


def embed_batch(spark, sf):
    return _cells(_features(spark, sf, unit=True, broken=False))


def embed_failures(spark, sf):
    rows = _features(spark, sf, unit=True, broken=True)
    zero = F.forall("vector", lambda x: x == 0)
    return rows.select(
        image_key(F.col("path")).alias("k"), zero.alias("is_zero"), F.col("error").isNotNull().alias("failed"),
        F.size("vector").cast("bigint").alias("dim"))


def extract_features(spark, sf):
    rows = _features(spark, sf, unit=False, broken=False)
    labelled = rows.withColumn("label", (image_key(F.col("path")) % 10).cast("int"))
    return labelled.select(
        image_key(F.col("path")).alias("k"), "label", F.posexplode("vector").alias("cell", "value")
    ).withColumn("value", F.col("value").cast("double"))


QUERIES = {
    "resize_geometry": resize_geometry,
    "crop_box": crop_box,
    "decode_images": decode_images,
    "image_tensor": image_tensor,
    "image_resample": image_resample,
    "embed_batch": embed_batch,
    "embed_failures": embed_failures,
    "extract_features": extract_features,
}


def _per_channel(values) -> str:
    return "case c " + " ".join(f"when {i} then cast({v!r} as double)" for i, v in enumerate(values)) + " end"


_SIZES = f"with s as ({SIZES_SQL.format(part='part')}) "
# Each pixel prepared as float32, as it is stored in the tensor.
_TENSOR = f"""
with px as ({PIXEL_SQL}),
t as (select k, y, x, c, cast(cast((p / cast(255 as double) - {_per_channel(IMAGE_MEAN)})
    / {_per_channel(IMAGE_STD)} as float) as double) as v from px),
cells as (select k, (y // {SIDE // GRID}) * {3 * GRID} + (x // {SIDE // GRID}) * 3 + c as cell, avg(v) as value
  from t group by all)"""

def _taps(n_out: int) -> str:
    """Weights of the bicubic rule (a = -0.5) that halves `2 * n_out` lines, spread over twice its reach."""
    return f"""select o, j, w / sum(w) over (partition by o) as w from (
      select o, j, case when d < 1 then (1.5 * d - 2.5) * d * d + 1 else ((-0.5 * d + 2.5) * d - 4) * d + 2 end as w
      from (select o, j, cast(abs(j + 0.5 - (o + 0.5) * 2) / 2 as double) as d
            from range({n_out}) t(o), range({2 * n_out}) s(j)) where d < 2)"""


ORACLES = {
    "image_resample": f"""with px as ({WIDE_PIXEL_SQL}), tx as ({_taps(3 * SIDE // 2)}), ty as ({_taps(SIDE)}),
across as (select k, y, o as x, c, greatest(least(floor(sum(p * w) + 0.5), 255), 0) as p
  from px join tx on px.x = tx.j group by all),
down as (select k, o as y, x, c, greatest(least(floor(sum(p * w) + 0.5), 255), 0) as p
  from across join ty on across.y = ty.j group by all),
middle as (select k, y - {(SIDE - CROP) // 2} as y, x - {(3 * SIDE // 2 - CROP) // 2} as x, c, cast(p as bigint) as p from down)
select k, count(*) as n, cast(sum(p * ((y * {3 * CROP} + x * 3 + c) % 97 + 1)) as bigint) as checksum from middle
where y between 0 and {CROP - 1} and x between 0 and {CROP - 1} group by k""",
    "resize_geometry": f"""{_SIZES}, n as (select *,
    cast(floor(cast(224 as double) * greatest(w, h) / least(w, h)) as integer) as long from s)
select p_partkey,
  cast(case when least(w, h) = 224 then w when w <= h then 224 else long end as integer) as width,
  cast(case when least(w, h) = 224 then h when w <= h then long else 224 end as integer) as height from n""",
    "crop_box": f"""{_SIZES}, b as (select p_partkey, cast(floor((w - 224) / 2.0) as integer) as l,
    cast(floor((h - 224) / 2.0) as integer) as t from s)
select p_partkey, l as box_left, t as box_top, l + 224 as box_right, t + 224 as box_bottom from b""",
    "decode_images": f"""
with s as (select s_suppkey as k, {BROKEN_SQL} as bad, s_suppkey % 2 = 0 as pat,
    cast(case when s_suppkey % 2 = 0 then {SIDE} else 20 + s_suppkey % 53 end as integer) as h,
    cast(case when s_suppkey % 2 = 0 then {SIDE} else 20 + s_suppkey % 37 end as integer) as w from supplier),
cell as (select k, h, w, bad, pat, unnest(range(h * w * 3)) as i from s),
px as (select k, i, case when pat then (k * 7 + (i // (w * 3)) * 3 + (i // 3 % w) * 5 + (i % 3) * 11) % 256
    else (k * 13 + (i % 3) * 50) % 256 end as p from cell),
sums as (select k, cast(sum(p * (i % 97 + 1)) as bigint) as checksum from px group by k)
select k, case when not bad then h end as height, case when not bad then w end as width,
  case when not bad then checksum end as checksum, bad as failed from s join sums using (k)""",
    "image_tensor": f"""{_TENSOR},
sums as (select k, min(v) as low, max(v) as high,
    sum(v * ((y * {SIDE * 3} + x * 3 + c) % 13 + 1)) as weighted from t group by k)
select k, case when not bad then cast({SIDE * SIDE * 3} as bigint) end as n,
  case when not bad then low end as low, case when not bad then high end as high,
  case when not bad then round(weighted, 6) end as weighted, bad as failed
from sums join (select s_suppkey as k, {BROKEN_SQL} as bad from supplier) using (k)""",
    "embed_batch": f"""{_TENSOR}
select k, cast(cell as integer) as cell,
  cast(cast(value / sqrt(sum(value * value) over (partition by k)) as float) as double) as value from cells""",
    "embed_failures": f"""select s_suppkey as k, {BROKEN_SQL} as is_zero, {BROKEN_SQL} as failed,
  cast({3 * GRID * GRID} as bigint) as dim from supplier""",
    "extract_features": f"""{_TENSOR}
select k, cast(k % 10 as integer) as label, cast(cell as integer) as cell,
  cast(cast(value as float) as double) as value from cells""",
}
