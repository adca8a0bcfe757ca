"""Resize and crop sizes as integer column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE = 224  # fixed value: short side after the resize and side of the crop


def resized(width: Column, height: Column, size: int = SIZE) -> tuple[Column, Column]:
    """(width, height) over the short side times `size`, rounded down."""
    short = F.least(width, height)
    scaled = [side.cast("long") * size for side in (width, height)]
    return tuple(((side - side % short) / short).cast("int") for side in scaled)


def crop_box(
    width: Column, height: Column, crop_width: int = SIZE, crop_height: int = SIZE
) -> dict[str, Column]:
    """Left, top, right and bottom of the centre crop; odd crop sizes are an error."""
    if crop_width % 2 or crop_height % 2:
        raise ValueError("only even crop sizes are supported")
    left = F.floor((width - crop_width) / F.lit(2.0)).cast("int")
    top = F.floor((height - crop_height) / F.lit(2.0)).cast("int")
    return {"left": left, "top": top, "right": left + crop_width, "bottom": top + crop_height}
