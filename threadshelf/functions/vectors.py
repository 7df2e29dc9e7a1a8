"""Expressions over ARRAY<FLOAT> vectors, computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores that agree to this many digits are ties, broken by id. Sums taken in another
# order differ in the last bits; without the rounding equal vectors would not tie.
SCORE_DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_to_unit(a: Column, unit: Column) -> Column:
    """Similarity in [-1, 1] to a vector of length 1; 0 when the other has no length."""
    length = norm(a)
    return F.when(length > 0, dot(a, unit) / length).otherwise(0.0)


def normalised(a: Column) -> Column:
    # the length is taken once per row, not once per element
    lengths = F.array_repeat(norm(a), F.size(a))
    return F.zip_with(
        a, lengths, lambda x, length: F.when(length > 0, x / length).otherwise(x).cast("float")
    )


def similarity_label(score: Column) -> Column:
    return F.format_string("%.3f", score.cast("double"))
