"""The batch embedding job: rows in, the same rows with a vector and an error out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import checked_vector
from ..schemas import VECTOR
from ..session import map_arrow
from ..sources.images import with_pixels
from .encoders import ColumnEncoder, Encoder

_INPUT, _IMAGE, _PROBLEM = "__encoder_input", "__image", "__problem"


def embed(
    rows: DataFrame, input_col: str, encoder: Encoder | ColumnEncoder, vector_col: str = "vector"
) -> DataFrame:
    """Add `vector_col` and `error`. A failed row gets the zero vector and its error text.

    An encoder that takes pixels reads either a column of Spark's image source or, from a column of
    paths, the files it names (see `with_pixels`; such rows are read several times).
    """
    if isinstance(encoder, ColumnEncoder):
        vector = checked_vector(encoder.expression(F.col(input_col)), encoder.dim)
        return rows.withColumns({vector_col: vector, "error": F.lit(None).cast("string")})

    rows = rows.drop("error") if "error" in rows.columns else rows
    if encoder.takes_pixels and isinstance(rows.schema[input_col].dataType, T.StringType):
        def use(decoded: DataFrame) -> DataFrame:
            made = _encoded(decoded, _IMAGE, encoder, vector_col, [*rows.columns, _PROBLEM])
            error = F.coalesce(_PROBLEM, "error").alias("error")
            return made.select(*rows.columns, vector_col, error)

        return with_pixels(rows, input_col, _IMAGE, _PROBLEM, use)
    return _encoded(rows, input_col, encoder, vector_col, rows.columns)


def _encoded(rows: DataFrame, input_col: str, encoder: Encoder, vector_col: str, keep: list[str]) -> DataFrame:
    added = [T.StructField(vector_col, VECTOR), T.StructField("error", T.StringType())]
    schema = T.StructType([rows.schema[c] for c in keep] + added)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.open()
        for batch in batches:
            for start in range(0, batch.num_rows, encoder.batch_rows):
                part = batch.slice(start, encoder.batch_rows)
                matrix, errors = encoder.encode_column(part.column(_INPUT))
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * encoder.dim
                vectors = pa.ListArray.from_arrays(offsets, matrix.reshape(-1))
                columns = [part.column(c) for c in keep] + [vectors, pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, vector_col, "error"])

    prepared = rows.select(*keep, encoder.prepare(F.col(input_col)).alias(_INPUT))
    return map_arrow(prepared, run, schema)


def embed_text(spark: SparkSession, text: str, encoder: Encoder | ColumnEncoder) -> list[float]:
    """The vector of one query text, by the same job that embeds tables."""
    row = spark.createDataFrame([(text,)], "text string")
    return list(embed(row, "text", encoder).first()["vector"])
