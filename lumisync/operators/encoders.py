"""What turns an input value into a vector. Bring your own by subclassing Encoder."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

from ..functions.text import hash_buckets, normalize_text, pretokenize
from ..sources.files import read_bytes
from ..sources.images import NOT_READABLE, rgb_of
from .tensor import TensorSpec, image_tensor


class Encoder:
    """A batch model: `open` once per task, `load` per row, `encode` per batch of rows.

    An exception in `load` fails that row alone. `encode` sees only loaded rows and
    returns one float vector of length `dim` for each.
    """

    dim: int
    batch_rows = 256
    takes_pixels = False  # its input is an image row of the JVM's codecs, not what the column holds

    def prepare(self, column: Column) -> Column:
        """JVM-side work on the input column before rows travel to Python."""
        return column

    def open(self) -> None:
        """Load weights; runs in the task, not on the driver."""

    def load(self, value: Any) -> Any:
        return value

    def encode(self, items: Sequence[Any]) -> np.ndarray:
        raise NotImplementedError

    def encode_column(self, values: pa.Array) -> tuple[np.ndarray, list[str | None]]:
        """Vectors and errors for a batch of inputs, failures isolated by position.

        Override this instead of `load` and `encode` where whole Arrow columns are faster.
        """
        items, places, errors = [], [], [None] * len(values)
        for place, value in enumerate(values.to_pylist()):
            try:
                if value is None:
                    raise ValueError("no input")
                items.append(self.load(value))
                places.append(place)
            except Exception as error:  # any unreadable input is that row's failure alone
                errors[place] = f"{type(error).__name__}: {error}"
        matrix = np.zeros((len(values), self.dim), np.float32)
        if items:
            matrix[places] = np.asarray(self.encode(items), np.float32)
        return matrix, errors


class ColumnEncoder:
    """An encoder that is a Column expression, so it never leaves the JVM."""

    def __init__(self, dim: int, expression: Callable[[Column], Column]):
        self.dim = dim
        self.expression = expression


class HashedTextEncoder(Encoder):
    """Token counts hashed into `dim` buckets, unit length. Text without tokens is zero."""

    batch_rows = 2048

    def __init__(self, dim: int = 512):
        self.dim = dim

    def prepare(self, column: Column) -> Column:
        return hash_buckets(pretokenize(normalize_text(column)), self.dim)

    def encode_column(self, values: pa.Array) -> tuple[np.ndarray, list[str | None]]:
        sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        cells = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        cells += np.repeat(np.arange(len(values)) * self.dim, sizes)
        counts = np.bincount(cells, minlength=len(values) * self.dim).reshape(-1, self.dim)
        errors = ["ValueError: no input" if missing else None for missing in values.is_null().to_pylist()]
        return unit_rows(counts.astype(np.float64)).astype(np.float32), errors


class GridImageEncoder(Encoder):
    """Mean colour of a grid of cells of the prepared image.

    A deterministic stand-in for a vision model: it supports image-to-image search and
    exercises the whole path. `unit=False` gives the features before normalisation.
    """

    takes_pixels = True
    batch_rows = 64

    def __init__(self, grid: int = 8, spec: TensorSpec = TensorSpec(), unit: bool = True):
        if spec.crop % grid:
            raise ValueError("the crop size must be a multiple of the grid")
        self.grid, self.spec, self.unit = grid, spec, unit
        self.dim = 3 * grid * grid

    def load(self, value: dict) -> np.ndarray:
        if value["height"] < 0:
            raise ValueError(NOT_READABLE)
        return image_tensor(rgb_of(value["height"], value["width"], value["nChannels"], value["data"]), self.spec)

    def encode(self, items: Sequence[np.ndarray]) -> np.ndarray:
        cell = self.spec.crop // self.grid
        tensors = np.stack(items).astype(np.float64)
        cells = tensors.reshape(-1, self.grid, cell, self.grid, cell, 3).mean(axis=(2, 4))
        features = cells.reshape(len(items), self.dim)
        return unit_rows(features) if self.unit else features


class OnnxEncoder(Encoder):
    """A model file run by onnxruntime, one session per task.

    `model` is a path on storage every executor reaches. The input is the stacked result
    of `loader` (for example decoded image tensors, or token ids), the output the vectors.
    """

    def __init__(self, model: str, dim: int, loader: Callable[[Any], np.ndarray], unit: bool = True):
        self.model, self.dim, self.loader, self.unit = model, dim, loader, unit

    def open(self) -> None:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # a Spark task owns one core
        self.session = onnxruntime.InferenceSession(read_bytes(self.model), options)
        self.input_name = self.session.get_inputs()[0].name

    def load(self, value: Any) -> np.ndarray:
        return self.loader(value)

    def encode(self, items: Sequence[np.ndarray]) -> np.ndarray:
        output = self.session.run(None, {self.input_name: np.stack(items)})[0]
        return unit_rows(output) if self.unit else output


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Each row divided by its length; zero rows stay zero."""
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)
