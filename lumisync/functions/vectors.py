"""Vector arithmetic as Column expressions over array<float>, accumulated in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_TOLERANCE = 1e-8  # fixed value: absolute tolerance of the all-zero test


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    """Dot product; vectors of different length are an error, not a silent NULL."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    mismatch = F.raise_error(F.lit("vectors differ in length")).cast("double")
    return F.when(F.size(a) != F.size(b), mismatch).otherwise(total)


def norm(a: Column) -> Column:
    squares = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL when either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalize(a: Column) -> Column:
    """Scale to unit length; NULL for a zero vector."""
    def scale(length: Column) -> Column:
        return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length))
    # The outer lambda binds the length, so it is computed once and not once per entry.
    return F.element_at(F.transform(F.array(norm(a)), scale), 1)


def is_zero(a: Column) -> Column:
    """True when every entry is zero within tolerance. A NaN entry makes it false."""
    return F.forall(a, lambda x: F.abs(x) <= F.lit(ZERO_TOLERANCE))


def is_match(score: Column) -> Column:
    """Positive and a number. Spark sorts NaN above everything, so it needs its own test."""
    return (score > 0) & ~F.isnan(score)


def checked_vector(a: Column, dim: int) -> Column:
    """Cast to the store's vector type and refuse any other length."""
    message = F.concat(F.lit(f"expected {dim} entries, found "), F.size(a).cast("string"))
    wrong = F.raise_error(message).cast("array<float>")
    return F.when(F.size(a) == dim, a.cast("array<float>")).otherwise(wrong)
