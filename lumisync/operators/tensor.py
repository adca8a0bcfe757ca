"""Image preparation: resize, centre crop, rescale and normalise in one Arrow stage."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import map_arrow

# Per-channel mean and standard deviation of the normalisation.
IMAGE_MEAN = (0.48145466, 0.4578275, 0.40821073)
IMAGE_STD = (0.26862954, 0.26130258, 0.27577711)


LINES_PER_STEP = 16


@dataclass(frozen=True)
class TensorSpec:
    """Which preparation steps run and to what size."""

    size: int = 224
    crop: int = 224
    resize: bool = True
    center_crop: bool = True
    normalize: bool = True
    mean: tuple[float, float, float] = IMAGE_MEAN
    std: tuple[float, float, float] = IMAGE_STD

    def __post_init__(self) -> None:
        if self.crop % 2:
            raise ValueError("only even crop sizes are supported")


def tensors(images: DataFrame, spec: TensorSpec = TensorSpec()) -> DataFrame:
    """Add the flat float tensor of (height, width, rgb); failed images get an error."""
    keep = [c for c in images.columns if c not in ("rgb", "error")]
    added = [T.StructField("tensor", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())]
    schema = T.StructType([images.schema[c] for c in keep] + added)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                yield _tensor_batch(batch.slice(start, 64), keep, spec)

    wanted = [*keep, *(c for c in ("rgb", "error") if c in images.columns)]
    return map_arrow(images.select(*wanted), run, schema)


def _tensor_batch(batch: pa.RecordBatch, keep: list[str], spec: TensorSpec) -> pa.RecordBatch:
    flat, errors = [], []
    for row in batch.to_pylist():
        if row["rgb"] is None:
            flat.append(None)
            errors.append(row.get("error") or "no pixels")
            continue
        pixels = np.frombuffer(row["rgb"], np.uint8).reshape(row["height"], row["width"], 3)
        flat.append(image_tensor(pixels, spec).reshape(-1))
        errors.append(None)
    columns = [batch.column(c) for c in keep]
    columns += [pa.array(flat, pa.list_(pa.float32())), pa.array(errors, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[*keep, "tensor", "error"])


def image_tensor(pixels: np.ndarray, spec: TensorSpec = TensorSpec()) -> np.ndarray:
    """uint8 [height, width, 3] to float32 [crop, crop, 3]."""
    height, width = pixels.shape[:2]
    size = _resized(height, width, spec.size) if spec.resize else (height, width)
    # Rows and columns of the resized image that the crop keeps; the rest is not computed.
    spans = [_crop_span(n, spec.crop) if spec.center_crop else (0, n) for n in size]
    if size != (height, width):
        pixels = _resample(pixels, size, *spans)
    else:
        pixels = pixels[slice(*spans[0]), slice(*spans[1])]
    if spec.center_crop:
        pixels = _pad(pixels, size, spec.crop)
    table = _channel_values(spec.mean, spec.std) if spec.normalize else _channel_values((0, 0, 0), (1, 1, 1))
    values = np.empty(pixels.shape, np.float32)
    for channel in range(3):
        np.take(table[:, channel], pixels[..., channel], out=values[..., channel], mode="clip")
    return values


@lru_cache(maxsize=8)
def _channel_values(mean: tuple, std: tuple) -> np.ndarray:
    """float32 [256, 3]: what each byte becomes per channel, so pixels are one lookup."""
    scaled = np.arange(256)[:, None] / 255.0
    return ((scaled - np.array(mean)) / np.array(std)).astype(np.float32)


def _resized(height: int, width: int, size: int) -> tuple[int, int]:
    """Both sides over the short one times `size`, rounded down."""
    return height * size // min(height, width), width * size // min(height, width)


def _crop_span(n: int, crop: int) -> tuple[int, int]:
    """Start and stop of the centre crop along one side, as far as the image reaches."""
    start = (n - crop) // 2
    return max(start, 0), min(start + crop, n)


def _pad(pixels: np.ndarray, size: tuple[int, int], crop: int) -> np.ndarray:
    """What the crop takes from outside the image is black."""
    if pixels.shape[:2] == (crop, crop):
        return pixels
    out = np.zeros((crop, crop, 3), pixels.dtype)
    top, left = (max(0, -((n - crop) // 2)) for n in size)
    out[top:top + pixels.shape[0], left:left + pixels.shape[1]] = pixels
    return out


def _resample(pixels: np.ndarray, size: tuple[int, int], rows: tuple[int, int],
              columns: tuple[int, int]) -> np.ndarray:
    """Antialiased bicubic to `size`, first across and then down; only the given spans."""
    n_rows, n_columns = pixels.shape[:2]
    first, last = _taps(n_rows, size[0], *rows)
    lines = pixels[first:last].transpose(1, 0, 2).reshape(n_columns, -1)
    across = _resample_axis(lines, n_columns, size[1], columns)
    across = across.reshape(-1, last - first, 3).transpose(1, 0, 2)
    down = _resample_axis(across.reshape(last - first, -1), n_rows, size[0], rows, first)
    return down.reshape(len(down), -1, 3)


def _resample_axis(lines: np.ndarray, n_in: int, n_out: int, span: tuple[int, int],
                   offset: int = 0) -> np.ndarray:
    """Output lines `span` of `n_out`, from input lines starting at `offset` of `n_in`.

    A few output lines at a time share a window of input lines, so the product stays small
    however large the image is.
    """
    lines = lines.astype(np.float32)
    out = np.empty((span[1] - span[0], lines.shape[1]), np.uint8)
    for start in range(span[0], span[1], LINES_PER_STEP):
        stop = min(start + LINES_PER_STEP, span[1])
        low, high = _taps(n_in, n_out, start, stop)
        weights = _bicubic_weights(n_in, n_out, start, stop, low, high)
        values = weights @ lines[low - offset:high - offset]
        out[start - span[0]:stop - span[0]] = np.clip(np.floor(values + 0.5), 0, 255)
    return out


def _taps(n_in: int, n_out: int, start: int, stop: int) -> tuple[int, int]:
    """Input lines that output lines start..stop draw on."""
    scale = n_in / n_out
    reach = 2 * max(scale, 1.0)
    low = math.floor((start + 0.5) * scale - reach)
    high = math.ceil((stop - 0.5) * scale + reach)
    return max(low, 0), min(high, n_in)


def _bicubic_weights(n_in: int, n_out: int, start: int, stop: int, low: int, high: int) -> np.ndarray:
    """[stop - start, high - low] weights (a = -0.5), each row summing to one."""
    scale = n_in / n_out
    centers = (np.arange(start, stop) + 0.5) * scale
    places = np.arange(low, high) + 0.5
    distance = np.abs(places[None, :] - centers[:, None]) / max(scale, 1.0)
    near = (1.5 * distance - 2.5) * distance**2 + 1.0
    far = ((-0.5 * distance + 2.5) * distance - 4.0) * distance + 2.0
    weights = np.where(distance < 1, near, np.where(distance < 2, far, 0.0))
    return (weights / weights.sum(axis=1, keepdims=True)).astype(np.float32)
