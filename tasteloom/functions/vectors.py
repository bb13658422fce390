"""Vector arithmetic on ``array<float|double>`` columns, computed in double."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import map_with


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def _double(v) -> Column:
    return _col(v).cast("array<double>")


def dot(u, v) -> Column:
    return _total(F.zip_with(_double(u), _double(v), lambda a, b: a * b))


def hadamard(u, v) -> Column:
    return F.zip_with(_double(u), _double(v), lambda a, b: a * b)


def l2_distance(u, v) -> Column:
    """Squared Euclidean distance."""
    return _total(F.zip_with(_double(u), _double(v), lambda a, b: (a - b) * (a - b)))


def norm(v) -> Column:
    return F.sqrt(_total(F.transform(_double(v), lambda x: x * x)))


def l2_normalize(v) -> Column:
    """Divide by the norm; a zero vector stays zero."""
    size = norm(v)
    safe = F.when(size == 0, F.lit(1.0)).otherwise(size)
    return map_with(_double(v), safe, lambda x, n: x / n)


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def mean_vector(v, weight=None) -> Column:
    """Weighted mean of a vector column; an aggregate with map-side partial sums."""
    vec = array_to_vector(_double(v))
    return vector_to_array(Summarizer.mean(vec, *([_col(weight)] if weight is not None else [])))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(x)))


def softplus(x) -> Column:
    """``ln(1 + e^x)`` without overflow."""
    c = _col(x)
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))
